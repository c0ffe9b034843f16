"""Passages that repeat across or within documents, found by rolling hashes of all word windows."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gableframe.llm import members
from gableframe.llm.text import SPACES, bodies, id_and_text, mix, powers
from gableframe.scratch import settle

WINDOW = 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
# Bytes hashed at once, words whose windows are compared inside a task before anything is shuffled.
PIECE = 1 << 20
BATCH_WORDS = 1 << 20
# Text per range of hashes: about half a million windows, held by a task at a time.
BYTES_PER_RANGE = 1 << 22
MIN_RANGES = 64
NO_ID = -(2**63)


@lru_cache
def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


@lru_cache
def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(base, n), powers(_inverse(base), n)


def _bounded(n: int) -> int:
    return 1 << max(16, (n - 1).bit_length())


def _rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value * base**position, and base**-position: the hash of any stretch is a difference."""
    up, down = _tables(base, _bounded(len(values) + 1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def word_hashes(body: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    found, at = [], 0
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    while at < len(body):
        end = at + PIECE
        while end < len(body) and body[end] not in SPACES:  # a piece ends between words
            end += 1
        piece = np.frombuffer(body, np.uint8, min(end, len(body)) - at, at)
        at = end
        gap = np.ones(len(piece) + 2, bool)
        gap[1:-1] = space[piece]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, stops = edge[::2], edge[1::2]
        sums, down = _rolling(codes[piece], BYTE_BASE)
        found.append(mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _windows(words: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a whole window of one document starts, and the hashes of these windows."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, down = _rolling(words, WORD_BASE)
    at = np.flatnonzero(left[: len(words) - window + 1] >= window)
    return at, mix((sums[at + window] - sums[at]) * down[at])


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value; bytes of equal weight stand together."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.zeros(1, values.dtype))


def _pack_places(ids: np.ndarray, starts: np.ndarray, *more: np.ndarray) -> bytes:
    """Places in ascending order of document and start."""
    return _packed(_steps(ids), _steps(starts.astype(np.uint32)), *more)


def _unpack_places(blob: bytes, *more: str) -> list[np.ndarray]:
    ids, starts, *rest = _unpacked(blob, "<i8", "<u4", *more)
    return [np.cumsum(ids), np.cumsum(starts, dtype=np.uint32).astype(np.int64), *rest]


def _later(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first place of each hash, and of the places that come after the first.

    Places of rows that repeat an id and a start are as early as the first.
    """
    order = np.argsort(hashes)
    shared = np.zeros(len(order), bool)
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared[1:] |= same
    shared[:-1] |= same
    single, many = order[~shared], order[shared]
    many = many[np.lexsort((starts[many], ids[many], hashes[many]))]
    new = np.ones(len(many), bool)
    new[1:] = hashes[many[1:]] != hashes[many[:-1]]
    first = many[new][np.cumsum(new) - 1]
    after = (ids[many] != ids[first]) | (starts[many] != starts[first])
    return np.concatenate([single, many[new]]), many[after]


def _rows(kind: int, part: np.ndarray, ids: np.ndarray, starts: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """One row per part with its places packed, which come in ascending order."""
    order = np.argsort(part, kind="stable")
    part, ids, starts, more = part[order], ids[order], starts[order], [m[order] for m in more]
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a < b:
            yield int(part[a]), kind, _pack_places(ids[a:b], starts[a:b], *[m[a:b] for m in more])


def _batch(rows: list, names: tuple[str, ...] = ("part", "kind", "blob")) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _part_of_ids(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _found_in_batch(docs: list[tuple[int, np.ndarray]], window: int, parts: int) -> pa.RecordBatch:
    """The first place of each window of some documents by hash range, and the repeats among them."""
    docs.sort(key=lambda d: d[0])
    lengths = np.array([len(w) for _, w in docs])
    words = np.concatenate([w for _, w in docs])
    position = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, hashes = _windows(words, np.repeat(lengths, lengths) - position, window)
    ids, starts = np.repeat(np.array([d for d, _ in docs], np.int64), lengths)[at], position[at]
    del words, position
    first, after = map(np.sort, _later(hashes, ids, starts))  # places stand in ascending order
    ranges = ((hashes[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    # The top byte is spared: it differs only within a range whose other seven bytes tell hashes apart.
    low, high = hashes[first].astype(np.uint32), (hashes[first] >> np.uint64(32)).astype(np.uint32)
    rows = list(_rows(0, ranges, ids[first], starts[first], low, high.astype(np.uint16), (high >> np.uint32(16)).astype(np.uint8)))
    rows += _rows(1, _part_of_ids(ids[after], parts), ids[after], starts[after])
    return _batch(rows)


def _candidates(docs: DataFrame, window: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for ident, body in zip(batch.column("doc_id").to_pylist(), bodies(batch), strict=True):
                words = word_hashes(body or b"")
                if len(words) < window:
                    continue
                held.append((NO_ID if ident is None else ident, words))
                n += len(words)
                if n >= BATCH_WORDS:
                    yield _found_in_batch(held, window, parts)
                    held, n = [], 0
        if held:
            yield _found_in_batch(held, window, parts)

    return docs.mapInArrow(run, "part int, kind int, blob binary")


def _compare_ranges(candidates: DataFrame, parts: int) -> DataFrame:
    """Per range of hashes the places after the first of each hash, dealt to parts by document."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [b for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == 0]
        rows = [(key[0].as_py(), 1, b) for k, b in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True) if k]
        if blobs:
            cells = [_unpack_places(b, "<u4", "<u2", "u1") for b in blobs]
            ids, starts, low, mid, high = (np.concatenate(c) for c in zip(*cells, strict=True))
            del cells, blobs
            hashes = low | mid.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64) << np.uint64(48)
            after = _later(hashes, ids, starts)[1]
            after = after[np.lexsort((starts[after], ids[after]))]
            rows += _rows(1, _part_of_ids(ids[after], parts), ids[after], starts[after])
        return pa.Table.from_batches([_batch(rows)])

    return candidates.groupBy("part").applyInArrow(run, "part int, kind int, blob binary")


def _merge_spans(places: DataFrame, window: int) -> DataFrame:
    """Windows that overlap or touch become one span of words [from, to)."""

    def run(table: pa.Table) -> pa.Table:
        cells = [_unpack_places(b) for b in table["blob"].to_pylist()]
        ids, starts = (np.concatenate(c) for c in zip(*cells, strict=True))
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + window)
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(ids)) - 1
        of = ids[opens]
        bounds = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(np.int32))) for v in (starts[opens], starts[closes] + window)]
        return pa.table({"doc_id": of[bounds[:-1]], "from": lists[0], "to": lists[1]})

    return places.groupBy("part").applyInArrow(run, "doc_id long, from array<int>, to array<int>")


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, from, to): the maximal spans of words to remove, for documents that have any.

    A word goes if a window over it also starts earlier, in a document of smaller id or further up
    in the same. All windows are hashed; a task sends the first place of each hash on and settles
    repeats among its own documents itself, so that a passage of a third of all documents arrives
    once per batch. Hashes meet by range, 56 of their bits within a range of their own. A null id
    counts as the smallest; rows that share an id share its spans.
    """
    body = id_and_text(docs, id_col, text_col)
    total = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(MIN_RANGES, -(-total // BYTES_PER_RANGE))
    found = _compare_ranges(_candidates(body, window, parts), parts)
    return settle(_merge_spans(settle(found, "repeats", drop_shuffles=True), window), "spans", drop_shuffles=True)


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """Adds __from and __to, null for rows without spans.

    A filter of bounded size tells which rows may have spans; only these are joined, all others
    pass by, so that texts without repeats are never shuffled.
    """
    own = spans.select(F.col("doc_id").alias("__id"), F.col("from").alias("__from"), F.col("to").alias("__to"))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    filled = docs.sparkSession.sparkContext.broadcast(members.filter_of(spans.select("doc_id")))
    marked = docs.withColumn("__may", members.may_be_in(key, filled))
    none = F.lit(None).cast("array<int>")
    others = marked.where(~F.col("__may")).withColumns({"__from": none, "__to": none}).drop("__may")
    return marked.where("__may").drop("__may").join(own, key == F.col("__id"), "left").drop("__id").unionByName(others)


def _kept(body: bytes, opens: list[int], closes: list[int]) -> list[list[bytes]]:
    """Runs of words outside the spans."""
    words = body.split()
    edges = [0, *[x for pair in zip(opens, closes, strict=True) for x in pair], len(words)]
    return [words[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def cut_texts(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A null text has no words and leaves an empty one.
    """
    rows = _with_spans(docs.select(id_col, text_col), spans, id_col).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").cast("binary").alias("body"),
        F.coalesce("__from", F.array().cast("array<int>")).alias("opens"),
        F.coalesce("__to", F.array().cast("array<int>")).alias("closes"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = batch.column("doc_id"), [batch.column(c) for c in ("opens", "closes")]
            for at in range(0, len(ids), 512):
                part = batch.slice(at, 512)
                n, gone, texts = [], [], []
                for body, opens, closes in zip(
                    bodies(part), *[b.slice(at, 512).to_pylist() for b in bounds], strict=True
                ):
                    if opens:
                        runs = _kept(body or b"", opens, closes)
                        words = [w for run in runs for w in run]
                        gone.append(sum(closes) - sum(opens))
                    else:
                        words = (body or b"").split()
                        gone.append(0)
                    n.append(len(words) + gone[-1])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out; those of which nothing is left go.

    A document without a repeat keeps its text as it is. One that is cut keeps its words, joined
    by one space.
    """
    spans = repeated_spans(docs, window, id_col, text_col)
    marked = _with_spans(docs, spans, id_col)

    @F.pandas_udf("string")
    def cut(text: pd.Series, opens: pd.Series, closes: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if a is None or t is None else b" ".join(w for run in _kept(t.encode(), a, b) for w in run).decode()
                for t, a, b in zip(text, opens, closes, strict=True)
            ],
            dtype=object,
        )

    is_cut = F.col("__from").isNotNull()
    body = F.when(is_cut, cut(F.col(f"`{text_col}`"), "__from", "__to")).otherwise(F.col(f"`{text_col}`"))
    return marked.withColumn(text_col, body).where(~is_cut | (F.length(F.col(f"`{text_col}`")) > 0)).drop("__from", "__to")
