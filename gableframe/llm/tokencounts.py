"""Tokens of whole documents attributed to the sections they fall in."""

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most", "share")


@lru_cache(2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The byte-level vocabulary of a rank file, and the bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token of a text that is encoded as a whole.

    Tokens may divide a character; it belongs to the token that holds its first byte.
    """
    codec, lengths = encoding(path, pattern)
    body = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum(lengths[np.array(codec.encode_ordinary(text), np.int64)])
    chars = np.append(0, np.cumsum((body & 0xC0) != 0x80))
    edges = np.append(0, chars[ends])
    return edges[:-1], edges[1:]


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of a section's tokens cross into or out of it.

    edges are the ascending bounds of sections that cover the text. A token that crosses a bound
    counts for the section of its first character ("first"), for the one that holds most of its
    characters, the earlier of equals ("most"), or for each by its part ("share"). A token without a
    character of its own counts where it stands.
    """
    n = len(edges) - 1
    last = np.maximum(ends - 1, starts)
    first_of = np.clip(np.searchsorted(edges, starts, "right") - 1, 0, n - 1)
    last_of = np.clip(np.searchsorted(edges, last, "right") - 1, 0, n - 1)
    inside = first_of == last_of
    counts = np.bincount(first_of[inside], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    for i in np.flatnonzero(~inside):
        own = np.arange(first_of[i], last_of[i] + 1)
        overlap = np.minimum(edges[own + 1], ends[i]) - np.maximum(edges[own], starts[i])
        crossing[own[overlap > 0]] += 1
        if rule == "share":
            counts[own] += overlap / overlap.sum()
        else:
            counts[own[0] if rule == "first" else own[overlap.argmax()]] += 1
    return counts, crossing


def line_edges(text: str) -> np.ndarray:
    """Bounds of lines; a line holds its own line feed."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero(codes == 10) + 1
    return np.unique(np.concatenate([[0], inner, [len(codes)]]))


def tokens_per_section(
    docs: DataFrame, path: str, pattern: str, rule: str = "most", id_col: str = "doc_id", fields: tuple[str, ...] = ("text",)
) -> DataFrame:
    """Per field and line: doc_id, field, section (from 0), n_chars, n_tokens (double), n_crossing.

    The fields of a row are joined by line feeds and encoded once, as one document; the line feed
    counts for the field before it. Every line of every field is a section. Null fields count as empty
    ones; an empty field has one section without characters, unless others follow. The tokens of a
    row sum up to those of its document under each rule.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [[] for _ in range(6)]
                for ident, *values in zip(*[part.column(c).to_pylist() for c in part.schema.names], strict=True):
                    parts = [(v or "") + ("\n" if i + 1 < len(values) else "") for i, v in enumerate(values)]
                    whole = "".join(parts)
                    bounds, owner, number = [0], [], []
                    for name, body in zip(fields, parts, strict=True):
                        own = line_edges(body)[1:] + bounds[-1] if body else [bounds[-1]]
                        owner += [name] * len(own)
                        number += range(len(own))
                        bounds += list(own)
                    edges = np.array(bounds)
                    starts, ends = token_spans(whole, path, pattern)
                    counts, crossing = attribute(starts, ends, edges, rule)
                    for column, more in zip(
                        out, [[ident] * len(owner), owner, number, np.diff(edges), counts, crossing], strict=True
                    ):
                        column.extend(more)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                names = ["doc_id", "field", "section", "n_chars", "n_tokens", "n_crossing"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("__id"), *[F.col(f"`{c}`").cast("string").alias(f"__{c}") for c in fields]
    )
    return rows.mapInArrow(
        run, "doc_id long, field string, section long, n_chars long, n_tokens double, n_crossing long"
    )
