"""Encoding and decoding with a byte-pair vocabulary; long unsplit text goes by tree concatenation."""

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from gableframe.llm.text import bodies, id_and_text

# Longer stretches without white space are cut into leaves of this many symbols.
LEAF = 1024
# Stretches that a worker remembers with their tokens; the older half is dropped when it is full. One is
# remembered when it comes up for the second time, so that those met once do not push out others;
# a table of so many marks, by hash, tells which came up before.
REMEMBERED = 300_000
MARKS = 1 << 22
# Bytes of text and rows encoded together, which look up each distinct stretch once.
TEXT_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 256


def foldable(body: bytes) -> bool:
    """Whether A-Z can be lowered at once, as the clean-up will do it later.

    Not beside combining marks, which only some small letters are joined with, and not where an
    added token may stand, which is told from other text by its case.
    """
    return b"<|" not in body and b"\xcc" not in body and b"\xcd" not in body


class Codec:
    """One vocabulary file: ids and decoded text of a document, just as the tokenizer gives them.

    White space ends every token, and neither clean-up nor merges look across it. So a document
    is its stretches between white space, one after the other, and frequent ones are remembered.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in self.ids.items()}
        self.added = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.suffix = model["end_of_word_suffix"] or ""
        self.leaf = leaf
        self.path, self.ending = path, self.whole.model
        self.recent: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.marks, self.marked = bytearray(MARKS), 0

    @cached_property
    def inner(self) -> models.BPE:
        """The same merges for text that goes on, where no symbol is the last of its word; only long stretches need them."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        return models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])

    def merge(self, symbols: str, ends: bool) -> list[int]:
        return [t.id for t in (self.ending if ends else self.inner).tokenize(symbols)]

    def symbols(self, ids: list[int], ends: bool) -> str:
        joined = "".join(self.text[i] for i in ids)
        return joined[: len(joined) - len(self.suffix)] if ends else joined

    def stands(self, left: int, right: int, ends: bool) -> bool:
        """Whether two adjacent tokens stay as they are when merged by themselves."""
        return self.merge(self.symbols([left, right], ends), ends) == [left, right]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Tokens of two halves of one stretch, the window around the join encoded anew.

        A list of tokens is the encoding of its text if and only if every two neighbours are. In
        either half they are; so the window grows until its first and last token stand beside
        the tokens that are left on either side.
        """
        if self.stands(left[-1], right[0], ends and len(right) == 1):
            return left + right
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            closes = ends and b == len(right)
            middle = self.merge(self.symbols(left[a:] + right[:b], closes), closes)
            fits = not a or self.stands(left[a - 1], middle[0], closes and len(middle) == 1)
            if fits and (b == len(right) or self.stands(middle[-1], right[b], ends and b + 1 == len(right))):
                return left[:a] + middle + right[b:]
            reach *= 2

    def tree(self, symbols: str, ends: bool = True) -> list[int]:
        """Tokens of a stretch of symbols by halves."""
        if len(symbols) <= self.leaf:
            return self.merge(symbols, ends)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half], False), self.tree(symbols[half:], ends), ends)

    def long(self, stretch: str) -> list[int]:
        """Tokens of a stretch too long to be encoded in one go."""
        found = []
        for piece in self.added.split(stretch):
            if self.added.fullmatch(piece):
                found.append(self.ids[piece])
            elif piece:
                plain = self.whole.normalizer.normalize_str(piece)
                for symbols, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain):
                    found += self.tree(symbols)
        return found

    def tokens(self, stretches: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded text of each stretch."""
        texts = [s.decode("utf-8", "replace") for s in stretches]
        coded = iter(self.whole.encode_batch_fast([t for t in texts if len(t) <= self.leaf], add_special_tokens=False))
        for text in texts:
            ids = next(coded).ids if len(text) <= self.leaf else self.long(text)
            yield np.array(ids, np.int32).tobytes(), " ".join([self.text[i] for i in ids]).encode()

    def remember(self, stretch: bytes, found: tuple[bytes, bytes]) -> None:
        """Keeps what was found if the stretch came up before."""
        mark = hash(stretch) & (MARKS - 1)
        if self.marks[mark]:
            self.recent[stretch] = found
        else:
            self.marks[mark] = 1
            self.marked += 1

    def look_up(self, stretches: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        recent, older = self.recent, self.older
        known = {s: recent[s] for s in stretches if s in recent}
        again = {s: older[s] for s in stretches if s not in known and s in older}
        recent.update(again)
        known.update(again)
        fresh = [s for s in stretches if s not in known]
        for s, found in zip(fresh, self.tokens(fresh), strict=True):
            known[s] = found
            self.remember(s, found)
        if len(recent) > REMEMBERED // 2:
            self.older, self.recent = recent, {}
        if self.marked > MARKS // 4:
            self.marks, self.marked = bytearray(MARKS), 0
        return known

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
        """Ids of each text, and what decoding them gives."""
        split = [(t.lower() if foldable(t) else t).split() for t in texts]
        known = self.look_up(set().union(*split))
        out = []
        for stretches in split:
            pairs = [known[s] for s in stretches]
            ids = np.frombuffer(b"".join([p[0] for p in pairs]), np.int32)
            out.append((ids, b" ".join([p[1] for p in pairs if p[1]])))
        return out

    def encode(self, body: bytes) -> tuple[np.ndarray, bytes]:
        return self.encode_all([body])[0]


@lru_cache(2)
def codec(path: str) -> Codec:
    """One per worker process, so that what it remembers serves all of its tasks.

    A task has one core: threads of the tokenizer's own, as many as the machine has cores, would each hold memory
    beside what Spark reckons with, and take time from other tasks.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int), decoded (the text that the ids give).

    path names the vocabulary file, which every executor has. A null text counts as an empty one
    and has no ids. Rows are neither shuffled nor grouped; a long text costs memory in proportion
    to its length only.
    """

    def some(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        """Rows that are encoded together, with where they start."""
        start, held, size = 0, [], 0
        for at, body in enumerate(bodies(batch)):
            held.append(body or b"")
            size += len(held[-1])
            if size >= TEXT_AT_ONCE or len(held) >= ROWS_AT_ONCE:
                yield start, held
                start, held, size = at + 1, [], 0
        if held:
            yield start, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for start, texts in some(batch):
                done = own.encode_all(texts)
                bounds = np.cumsum([0, *[len(i) for i, _ in done]], dtype=np.int32)
                ids = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([i for i, _ in done])))
                out = pa.array([t for _, t in done], pa.binary()).cast(pa.string())
                rows = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows, ids, out], ["doc_id", "ids", "decoded"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
