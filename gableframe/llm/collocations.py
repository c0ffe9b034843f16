"""Collocations of two to four words, mined by stripes: one counter of next words per prefix."""

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gableframe.llm import members
from gableframe.llm.text import bodies, mix
from gableframe.scratch import settle

LONGEST = 4
LEAST = 30
TOP = 2000
# A candidate goes if a longer one stands in this many per cent of its places.
SUBSUMED = 80
SCALE = 2_000_000
# Words whose stripes a task merges before it sends them on; bytes of a text split at once.
WORDS_AT_ONCE = 1 << 19
PIECE = 1 << 20
# A stripe is dealt by the next word to as many segments, so that no task holds all words that follow a frequent prefix.
WORD_SEGMENTS, PHRASE_SEGMENTS = 1024, 64
# Text per part of the stripes of phrases, which a task merges at a time.
BYTES_PER_PART = 1 << 24
MIN_PARTS = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_CUT = re.compile(rb"[ \t.,;:!?\n-\r]")


def tokens(body: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words in order, b'.' where a piece ends; long texts in several lists."""
    at = 0
    while at < len(body):
        cut = _CUT.search(body, at + PIECE)
        end = cut.start() if cut else len(body)
        yield body[at:end].lower().translate(_BREAKS).replace(b".", b" . ").split()
        at = end


class _Codes(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _phrase_hashes(langs: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Of phrases whose i-th words have the hashes parts[i]."""
    total = mix(langs)
    for part in parts:
        total = mix(total * BASE + part)
    return total


class _Held:
    """Words of some documents and the stripes of their phrases."""

    def __init__(self, words: int, filled: np.ndarray | None):
        self.words, self.filled = words, filled
        self.clear()

    def clear(self) -> None:
        self.code, self.lang = _Codes(), _Codes()
        self.runs: list[np.ndarray] = []
        self.of: list[int] = []
        self.n = 0

    def add(self, lang: bytes, body: bytes) -> None:
        stop = self.code[b"."]
        for part in tokens(body):
            run = np.fromiter(map(self.code.__getitem__, part), np.int64, len(part))
            self._append(run, lang)
        self._append(np.full(1, stop), lang)

    def _append(self, run: np.ndarray, lang: bytes) -> None:
        self.runs.append(run)
        self.of.append(self.lang[lang])
        self.n += len(run)

    def _stream(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words, and of all words in order the code and the code of the language."""
        langs = np.repeat(np.array(self.of, np.int32), [len(r) for r in self.runs])
        return list(self.code), np.concatenate(self.runs), langs

    def of_words(self) -> Iterator[pa.RecordBatch]:
        """Stripes of the empty prefix: the counts of all words by language and segment."""
        words, codes, langs = self._stream()
        segments = (_word_hashes(words) % np.uint64(WORD_SEGMENTS)).astype(np.int64)
        keep = codes != self.code[b"."]
        keys = langs[keep] * WORD_SEGMENTS + segments[codes[keep]]
        found, counts = np.unique(keys * len(words) + codes[keep], return_counts=True)
        if len(found):
            stripe, word = found // len(words), found % len(words)
            opens = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1]))
            bounds = np.append(opens, len(found)).astype(np.int32)
            names = pa.array(list(self.lang), pa.binary()).cast(pa.string())
            text = pa.array(words, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    names.take(pa.array(stripe[opens] // WORD_SEGMENTS)),
                    pa.array((stripe[opens] % WORD_SEGMENTS).astype(np.int32)),
                    pa.ListArray.from_arrays(bounds, text.take(pa.array(word))),
                    pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64))),
                ],
                ["lang", "seg", "next", "n"],
            )

    def of_phrases(self, parts: int) -> Iterator[pa.RecordBatch]:
        """Stripes of prefixes that may be frequent, packed by part: hashes of prefix and next word, counts.

        A next word counts only if the phrase without its first word may be frequent as well; all other
        places of a prefix are counted under the hash zero, so that totals stay whole.
        """
        words, codes, langs = self._stream()
        hashes = np.maximum(_word_hashes(words), np.uint64(1))
        before, inside = self.words - 1, codes != self.code[b"."]
        whole = inside.copy()  # whether a prefix starts here
        for i in range(1, before):
            whole[:-i] &= inside[i:]
            whole[-i:] = False
        at = np.flatnonzero(whole)
        of = _word_hashes(list(self.lang))[langs[at]]
        prefix = _phrase_hashes(of, [hashes[codes[at + i]] for i in range(before)])
        likely = members.may_hold(self.filled, prefix)
        at, prefix = at[likely], prefix[likely]
        whole[:] = False
        whole[at] = True
        # A document ends with a stop, so that no prefix ends with the stream.
        counted = inside[at + before] & whole[at + 1]
        follows = np.where(counted, hashes[codes[at + before]], np.uint64(0))
        dealt = mix(prefix ^ mix(follows % np.uint64(PHRASE_SEGMENTS)))
        part = ((dealt >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        prefix, follows, counts, part = _merge(prefix, follows, np.ones(len(at), np.int64), part)
        if len(part):
            edges = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
            cuts = list(zip(edges[:-1], edges[1:], strict=True))
            own = [int(part[a]) for a, _ in cuts]
            blobs = [_pack(prefix[a:b], follows[a:b], counts[a:b].astype(np.uint32)) for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _merge(prefix: np.ndarray, follows: np.ndarray, counts: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal pairs of a prefix and a next word added up, in order of part and prefix."""
    order = np.lexsort((follows, prefix, part))
    prefix, follows, part = prefix[order], follows[order], part[order]
    new = np.append(True, (prefix[1:] != prefix[:-1]) | (follows[1:] != follows[:-1]))[: len(order)]
    opens = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], opens) if len(opens) else counts[order]
    return prefix[opens], follows[opens], sums, part[opens]


def _pack(prefix: np.ndarray, follows: np.ndarray, counts: np.ndarray) -> bytes:
    raw = len(counts).to_bytes(4, "little") + prefix.tobytes() + follows.tobytes()
    planes = counts.view(np.uint8).reshape(-1, 4).T.tobytes()  # high bytes, nearly all zero, stand together
    return zstandard.ZstdCompressor(level=1).compress(raw + planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    hashes = np.frombuffer(raw, np.uint64, 2 * n, 4)
    planes = np.frombuffer(raw, np.uint8, 4 * n, 4 + 16 * n).reshape(4, n)
    return hashes[:n], hashes[n:], np.ascontiguousarray(planes.T).view(np.uint32).reshape(n).astype(np.int64)


def _held(docs: DataFrame, words: int, filled: Broadcast | None, parts: int, schema: str) -> DataFrame:
    """Stripes as tasks have merged them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(words, filled.value if filled else None)

        def emit() -> Iterator[pa.RecordBatch]:
            yield from held.of_phrases(parts) if words > 1 else held.of_words()
            held.clear()

        for batch in batches:
            for lang, body in zip(batch.column("lang").to_pylist(), bodies(batch), strict=True):
                held.add(lang.encode(), body)
                if held.n >= WORDS_AT_ONCE:
                    yield from emit()
        if held.n:
            yield from emit()

    return docs.mapInArrow(run, schema)


def _words(docs: DataFrame, least: int) -> DataFrame:
    """The stripe of the empty prefix in segments: (lang, next, n, total), frequent words and the sum of all counts.

    Tasks' stripes are merged element by element where they were dealt to.
    """
    found = _held(docs, 1, None, 0, "lang string, seg int, next array<string>, n array<long>")
    pairs = found.repartition("lang", "seg").select("lang", "seg", F.explode(F.arrays_zip("next", "n")).alias("e"))
    sums = pairs.groupBy("lang", "seg", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n"))
    stripe = F.collect_list(F.when(F.col("n") >= least, F.struct("next", "n")))
    merged = sums.groupBy("lang", "seg").agg(stripe.alias("s"), F.sum("n").alias("total"))
    return merged.select("lang", F.col("s.next").alias("next"), F.col("s.n").alias("n"), "total")


def _stripes(docs: DataFrame, words: int, filled: Broadcast, parts: int, least: int) -> DataFrame:
    """(prefix, next, n, total, most) by hashes: per prefix and part the words that follow at least so often.

    total sums the counts of all, most is the largest of a word, null if none is frequent.
    """

    def run(table: pa.Table) -> pa.Table:
        prefix, follows, counts = (np.concatenate(c) for c in zip(*map(_unpack, table["blob"].to_pylist()), strict=True))
        prefix, follows, counts, _ = _merge(prefix, follows, counts, np.zeros(len(prefix), np.int32))
        opens = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
        kept = (counts >= least) & (follows != 0)
        most = np.maximum.reduceat(np.where(kept, counts, 0), opens)
        bounds = np.append(0, np.cumsum(np.add.reduceat(kept, opens, dtype=np.int64))).astype(np.int32)
        return pa.table(
            {
                "prefix": prefix[opens].view(np.int64),
                "next": pa.ListArray.from_arrays(bounds, pa.array(follows[kept].view(np.int64))),
                "n": pa.ListArray.from_arrays(bounds, pa.array(counts[kept])),
                "total": np.add.reduceat(counts, opens),
                "most": pa.array(most, mask=most == 0),
            }
        )

    found = _held(docs, words, filled, parts, "part int, blob binary")
    return found.groupBy("part").applyInArrow(run, "prefix long, next array<long>, n array<long>, total long, most long")


def _hashed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, n, key, last): the hash of a phrase and of its last word, as tasks make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [x.encode() for x in batch.column("lang").to_pylist()]
            parts = [x.encode().split(b" ") for x in batch.column("phrase").to_pylist()]
            if parts:
                hashes = [np.maximum(_word_hashes(list(column)), np.uint64(1)) for column in zip(*parts, strict=True)]
                keys = _phrase_hashes(_word_hashes(langs), hashes)
                columns = [*[batch.column(c) for c in ("lang", "phrase", "n")], pa.array(keys.view(np.int64)), pa.array(hashes[-1].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n", "key", "last"])

    return phrases.select("lang", "phrase", "n").mapInArrow(run, "lang string, phrase string, n long, key long, last long")


def stripes(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the merged stripes of all prefixes hold, one pass over the texts per number of words.

    (lang, n): all words of a language, the total of the empty prefix. (lang, phrase, words, n): extensions
    that occur at least so often. (lang, phrase, n, most): totals of the prefixes that may be frequent,
    with the largest count of a word that follows, null if none does so often.

    From the second word on, phrases of which a part is rare are left out, told by a filter of fixed size
    (members.BITS) that lets all frequent ones through. Phrases travel as 64-bit hashes of prefix and next
    word; frequent ones get their text back from the words and prefixes they extend.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(MIN_PARTS, -(-size // BYTES_PER_PART))
    single = settle(_words(rows, least), "words", drop_shuffles=True)
    sizes = single.groupBy("lang").agg(F.sum("total").alias("n"))
    cells = single.select("lang", F.explode(F.arrays_zip("next", "n")).alias("e"))
    known = settle(_hashed(cells.select("lang", F.col("e.next").alias("phrase"), F.col("e.n").alias("n"))), "phrases")
    texts = settle(known.select("last", F.col("phrase").alias("word")).distinct(), "texts")
    extensions, prefixes = [known], []
    for words in range(2, longest + 1):
        filled = spark.sparkContext.broadcast(members.filter_of(known.select("key")))
        found = settle(_stripes(rows, words, filled, parts, least), "stripes", drop_shuffles=True)
        filled.destroy()
        named = known.select("lang", F.col("phrase").alias("before"), F.col("key").alias("prefix"))
        found = settle(found.join(named, "prefix"), "named", drop_shuffles=True)
        prefixes.append(found.groupBy("lang", F.col("before").alias("phrase")).agg(F.sum("total").alias("n"), F.max("most").alias("most")))
        cells = found.select("lang", "before", F.explode(F.arrays_zip("next", "n")).alias("e"))
        cells = cells.select("lang", "before", F.col("e.next").alias("last"), F.col("e.n").alias("n")).join(texts, "last")
        known = settle(_hashed(cells.select("lang", F.concat_ws(" ", "before", "word").alias("phrase"), "n")), "phrases")
        extensions.append(known)
    every = [e.select("lang", "phrase", F.lit(i + 1).alias("words"), "n") for i, e in enumerate(extensions)]
    return sizes, reduce(DataFrame.unionByName, every), settle(reduce(DataFrame.unionByName, prefixes), "prefixes")


def _joined(words: Column, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates that no longer candidate subsumes.

    Of the cuts of a phrase the one of the lowest score counts, of equal ones the first.
    """
    sizes, extensions, prefixes = stripes(docs, least, longest, lang_col, text_col)
    counts = prefixes.select("lang", "phrase", "n")
    candidates = extensions.where("words > 1")

    # The largest count of a phrase that has one word more, behind (in the stripe of the phrase) or before.
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase")
    before = candidates.where("words > 2").select("lang", rest, F.col("n").alias("most"))
    behind = prefixes.where("phrase like '% %' and most is not null").select("lang", "phrase", "most")
    longer = behind.unionByName(before).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    subsumed = F.lit(100).cast("decimal(38,0)") * F.col("most") >= F.lit(SUBSUMED).cast("decimal(38,0)") * F.col("n")
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(subsumed, F.lit(False)))
    kept = settle(kept.select("lang", "phrase", F.col("n").alias("a")), "kept")

    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut")
    parts = kept.select("lang", "phrase", "a", cut).select(
        "lang", "phrase", "a", "cut",
        _joined(words, 1, F.col("cut")).alias("left"),
        _joined(words, F.col("cut") + 1, F.size(words)).alias("right"),
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    weighed = parts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    exact = "cast(a as decimal(38,0)) * {} div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"
    scored = weighed.withColumn("score", F.expr(exact.format(f"cast({SCALE} as decimal(38,0))")))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    return worst.join(sizes, "lang").select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased in A-Z; phrases of two to longest words do not cross . , ; : ! ? or line
    ends. A null language counts as und together with a language of that name, a null text as an
    empty one; repeated rows count as often as they come. A language without a candidate has no
    row, and so has an empty table. Other columns are not looked at.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = settle(phrases(docs, least, longest, lang_col, text_col), "phrases")
    # The best of 64 parts of a language before all of them meet, as one language may hold most phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = found.withColumn("part", part).withColumn("at", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    near = near.where(F.col("at") <= top)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
