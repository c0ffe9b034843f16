"""Code lengths of texts by context-tree weighting, beside a smoothed word model."""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.llm.text import bodies, id_and_text
from gableframe.scratch import settle

# Bytes of context, seven at most.
DEPTH = 5
FOLDS, HELD_OUT = 7, 2
# In a tree that one process holds, contexts with a smaller share of all bytes share one leaf with their like.
MIN_SHARE = 2e-5
# Contexts that end in the same so many bytes are weighed in one task.
SPLIT = 3
# The most frequent words, at most so many, travel with the tasks; all others are joined.
HEAD_WORDS = 200_000
# So do the most frequent bytes with their contexts.
HEAD_CODES = 1 << 21
CODES_AT_ONCE = 1 << 18
RARE_AT_ONCE = 1 << 20
WORDS_AT_ONCE = 400_000
BYTES_AT_ONCE = 1 << 23
PIECE = 1 << 16
CONTEXTS_AT_ONCE = 1 << 10
STEPS_PER_OCTAVE = 16
# Ends a text: no byte of UTF-8.
END = b"\xff"
START = b"\x00" * DEPTH
NODES = 255


def held_out(id_col: Column) -> Column:
    """By the checksum of the id; a null id is learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _framed(body: bytes) -> np.ndarray:
    return np.frombuffer(START + body.lower() + END, np.uint8)


def codes(body: bytes) -> np.ndarray:
    """For each byte of the lower-cased text and its end: the bytes before it, and itself, as one number."""
    b = _framed(body).astype(np.uint64)
    code = b[: len(b) - DEPTH]
    for i in range(1, DEPTH + 1):
        code = code << np.uint64(8) | b[i : len(b) - DEPTH + i]
    return code


def count_codes(docs: DataFrame) -> DataFrame:
    """(code, n): occurrences of all bytes after their context, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], ["code", "n"])

        for batch in batches:
            for body in bodies(batch):
                held.append(codes(body or b""))
                size += len(held[-1])
                if size >= BYTES_AT_ONCE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the lower-cased texts, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for body in bodies(batch):
                counts.update((body or b"").lower().split())
                if len(counts) >= WORDS_AT_ONCE:
                    yield out()
                    counts.clear()
        yield out()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1/2, by its series from x + 8 on."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def _bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 decisions by which a byte is told, from byte counts (k, 256)."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1).astype(float), np.concatenate(ones, axis=1).astype(float)


def _kt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Krichevsky-Trofimov: log probability of what was seen, and of a one to come, per decision."""
    seen, one = np.empty((2, len(counts), NODES))
    for at in range(0, len(counts), CONTEXTS_AT_ONCE):
        a, b = _bit_counts(counts[at : at + CONTEXTS_AT_ONCE])
        seen[at : at + len(a)] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1)
        one[at : at + len(a)] = (b + 0.5) / (a + b + 1)
    return seen, one


def _byte_table(ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the probabilities of ones."""
    total = np.zeros((len(ones), 1))
    for level in range(8):
        p = ones[:, (1 << level) - 1 : (2 << level) - 1]
        total = np.stack([total + np.log10(1 - p), total + np.log10(p)], axis=2).reshape(len(ones), 2 << level)
    return total.astype(np.float32)


class Tree:
    """A context tree over the last bytes, whose depths are mixed by their weights.

    A context is kept if it holds a given share of all bytes and its shorter contexts are kept. What
    a kept context has beside its kept extensions is one more leaf below it. So contexts are at
    most 1 / share per depth, however much is counted, and every count is in the tree. An inner
    node weighs its own estimate and the product of its children by one half each; the estimate
    for a byte mixes all depths on the way to its leaf by what the data have made of these weights.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[d]: the kept contexts of d bytes in order, the nearest byte lowest, and their byte counts (k, 256)."""
        keys, counts = map(list, zip(*levels, strict=True))
        last = len(keys) - 1
        parents = [None, *[np.searchsorted(keys[d - 1], keys[d] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, last + 1)]]
        # Upwards: what the data say of each node by itself, and of the leaves below it.
        shares, rest = [1.0] * (last + 1), [None] * (last + 1)
        below = _kt(counts[last])[0]
        for d in range(last - 1, -1, -1):
            left = counts[d].copy()
            np.subtract.at(left, parents[d + 1], counts[d + 1])
            own, (product, rest[d]) = _kt(counts[d])[0], _kt(left)
            np.add.at(product, parents[d + 1], below)
            below = np.logaddexp(own, product) - np.log(2)
            shares[d] = np.exp(own - np.log(2) - below).astype(np.float32)
        # Downwards: each node adds its estimate to the mixture of the nodes above it.
        mixed, open_, tables = np.zeros((1, NODES)), np.ones((1, NODES)), []
        for d in range(last + 1):
            if d:
                mixed, open_ = mixed[parents[d]], open_[parents[d]]
            mixed = mixed + open_ * shares[d] * _kt(counts[d])[1]
            open_ = open_ * (1 - shares[d])
            counts[d] = None  # levels are large: what is done with is let go
            tables.append(_byte_table(mixed + open_ * rest[d] if d < last else mixed))
        self.table = np.concatenate(tables)
        first = np.cumsum([0, *map(len, keys)])
        # The longer context that a byte before makes of an inner node, -1 for one that is not kept.
        self.longer = np.full(first[last] * 256, -1, np.int32)
        for d in range(1, last + 1):
            at = (first[d - 1] + parents[d]) * 256 + (keys[d] >> 8 * (d - 1))
            self.longer[at] = first[d] + np.arange(len(keys[d]))

    def log10(self, body: bytes) -> float:
        """log10 probability of a text and its end."""
        total = 0.0
        for at in range(0, len(body) + 1, PIECE):  # a piece looks back over the bytes before it
            lead = min(at, DEPTH)
            b = _framed(body[at - lead : at + PIECE])[lead:]
            if at + PIECE <= len(body):
                b = b[:-1]
            n = len(b) - DEPTH
            node, going = np.zeros(n, np.int64), np.arange(n)
            for d in range(1, DEPTH + 1):
                found = self.longer[node[going] * 256 + b[going + (DEPTH - d)]]
                going = going[found >= 0]
                node[going] = found[found >= 0]
            total += float(self.table[node, b[DEPTH:]].sum(dtype=np.float64))
        return total


def train_tree(docs: DataFrame, min_share: float = MIN_SHARE) -> Tree:
    """The tree of all bytes of the column body, for one process: its kept contexts come to the driver, by their bound.

    score() does without it and keeps all contexts.
    """
    counted = settle(count_codes(docs), "codes", drop_shuffles=True)
    total = counted.agg(F.sum("n")).first()[0] or 0
    levels = []
    for depth in range(DEPTH + 1):
        context = F.shiftright("code", 8).bitwiseAND((1 << 8 * depth) - 1).alias("context")
        by_byte = counted.groupBy(context, F.col("code").bitwiseAND(255).alias("byte")).agg(F.sum("n").alias("n"))
        kept = by_byte.groupBy("context").agg(F.sum("n").alias("of")).where(F.col("of") >= min_share * total)
        cells = by_byte.join(kept, "context").select("context", "byte", "n").toArrow()
        keys, at = np.unique(cells["context"].to_numpy(), return_inverse=True)
        if not depth and not len(keys):
            keys = np.zeros(1, np.int64)
        counts = np.zeros((len(keys), 256), np.int64)
        counts[at, cells["byte"].to_numpy()] = cells["n"].to_numpy()
        levels.append((keys.astype(np.int64), counts))
    return Tree(levels)


class Level:
    """The decisions met in contexts of one length: sorted keys (context, node), their counts and weights."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        total = zeros + ones
        self.own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(total + 1)
        self.one = (ones + 0.5) / (total + 1)
        self.below, self.share = self.own, np.ones(len(keys))

    def weigh(self, product: np.ndarray) -> None:
        """Sets what the data say of the node and all below it, from the product over its children."""
        self.below = np.logaddexp(self.own, product) - np.log(2)
        self.share = np.exp(self.own - np.log(2) - self.below)


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """The same decisions in the contexts cut to so many bytes."""
    return (keys >> 8 & (1 << 8 * depth) - 1) << 8 | keys & 255


def _decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the eight decisions by which the byte of each code is told, and the bits taken, (8, k)."""
    level = np.arange(8)[:, None]
    byte = code & 255
    return 1 << level | byte >> 8 - level, byte >> 7 - level & 1


def _subtrees(code: np.ndarray, n: np.ndarray) -> tuple[dict[int, Level], dict[int, np.ndarray]]:
    """Levels from SPLIT bytes on, and where in each the decisions of the codes are; whole subtrees at a time."""
    nodes, bits = _decisions(code)
    zeros, ones = (np.where(bits == b, n, 0).ravel().astype(float) for b in (0, 1))
    keys, first, at = np.unique((code >> 8) << 8 | nodes, return_index=True, return_inverse=True)
    where, levels = {DEPTH: at.ravel()}, {}
    levels[DEPTH] = Level(keys, np.bincount(where[DEPTH], zeros), np.bincount(where[DEPTH], ones))
    for d in range(DEPTH - 1, SPLIT - 1, -1):
        longer = levels[d + 1]
        keys, up = np.unique(_shorter(longer.keys, d), return_inverse=True)
        levels[d] = Level(keys, np.bincount(up, longer.zeros), np.bincount(up, longer.ones))
        levels[d].weigh(np.bincount(up, longer.below))
        where[d] = up[where[d + 1]]
    return levels, where


def _in_whole_subtrees(
    counted: DataFrame, what: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str
) -> DataFrame:
    """what(code, n) for all codes, those whose contexts end in the same SPLIT bytes at once."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, due = [], 0, CODES_AT_ONCE
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("end", "code", "n")]))
            size += batch.num_rows
            if size >= due:
                rows = np.concatenate(held, axis=1)
                whole = np.searchsorted(rows[0], rows[0, -1])  # the last subtree may go on
                if whole:
                    yield pa.RecordBatch.from_arrays(what(*rows[1:, :whole]), names)
                held, size = [rows[:, whole:]], len(rows[0]) - whole
                due = max(CODES_AT_ONCE, 2 * size)
        if size:
            yield pa.RecordBatch.from_arrays(what(*np.concatenate(held, axis=1)[1:]), names)

    end = F.shiftright("code", 8).bitwiseAND((1 << 8 * SPLIT) - 1).alias("end")
    return counted.select(end, "code", "n").repartition("end").sortWithinPartitions("end").mapInArrow(run, schema)


def _top(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys at SPLIT - 1 bytes, what the mixture has of each down to there, and the share that is left for longer contexts."""
    rows = rows.sort_by("key")
    level = Level(*(rows[c].to_numpy() for c in ("key", "zeros", "ones")))
    level.weigh(rows["product"].to_numpy())
    levels, ups = [level], []
    for d in range(SPLIT - 2, -1, -1):
        keys, up = np.unique(_shorter(level.keys, d), return_inverse=True)
        shorter = Level(keys, np.bincount(up, level.zeros), np.bincount(up, level.ones))
        shorter.weigh(np.bincount(up, level.below))
        level = shorter
        levels.append(level)
        ups.append(up)
    mixed, left = np.zeros(len(level.keys)), np.ones(len(level.keys))
    for level in reversed(levels):
        mixed, left = mixed + left * level.share * level.one, left * (1 - level.share)
        if ups:
            up = ups.pop()
            mixed, left = mixed[up], left[up]
    return levels[0].keys, mixed, left


def code_logs(counted: DataFrame) -> DataFrame:
    """(code, log): log10 probability of the byte of each code after its context, under the whole tree.

    counted has distinct codes with n, how often each was learnt, which may be never. Every context
    met is a node. Subtrees of contexts that end in the same SPLIT bytes are weighed in tasks; the driver
    sees one row per decision of contexts one byte shorter, of which there are 2**24 at most, whatever is counted.
    """
    spark = counted.sparkSession

    def up(code: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        level = _subtrees(code, n)[0][SPLIT]
        keys, at = np.unique(_shorter(level.keys, SPLIT - 1), return_inverse=True)
        return [pa.array(keys), *(pa.array(np.bincount(at, x)) for x in (level.zeros, level.ones, level.below))]

    sums = _in_whole_subtrees(counted, up, "key long, zeros double, ones double, product double")
    top = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "product")])
    shared = spark.sparkContext.broadcast(_top(top.toArrow()))

    def down(code: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        keys, mixed, left = shared.value
        levels, where = _subtrees(code, n)
        nodes, bits = _decisions(code)
        at = np.searchsorted(keys, _shorter(((code >> 8) << 8 | nodes).ravel(), SPLIT - 1))
        mixed, left = mixed[at], left[at]
        for d in range(SPLIT, DEPTH + 1):
            share = levels[d].share[where[d]]
            mixed, left = mixed + left * share * levels[d].one[where[d]], left * (1 - share)
        taken = np.where(bits.ravel() == 1, mixed, 1 - mixed)
        return [pa.array(code), pa.array(np.log10(taken).reshape(8, -1).sum(axis=0))]

    return settle(_in_whole_subtrees(counted, down, "code long, log double"), "logs", drop_shuffles=True)


def _head_codes(counted: DataFrame, logs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes met most often, in order, with their logs."""
    least = _least(counted.select(F.col("met").alias("n")), most)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    found = logs.join(counted.where(_step("met") >= least).select("code"), "code").toArrow().sort_by("code")
    return found["code"].to_numpy(), found["log"].to_numpy()


def _looked_up(body: bytes, codes_: np.ndarray, logs: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """Sum of the logs of a text and its end over the codes given, and the other codes with how often they occur."""
    total, others = 0.0, []
    for at in range(0, len(body) + 1, PIECE):  # a piece looks back over the bytes before it
        lead = min(at, DEPTH)
        code = codes(body[at - lead : at + PIECE])[lead:]
        if at + PIECE <= len(body):
            code = code[:-1]
        code, n = np.unique(code.view(np.int64), return_counts=True)
        place = np.minimum(np.searchsorted(codes_, code), max(0, len(codes_) - 1))
        known = codes_[place] == code if len(codes_) else np.zeros(len(code), bool)
        total += float(logs[place[known]] @ n[known])
        if not known.all():
            others.append((code[~known], n[~known]))
    return total, others


def _step(n: str) -> Column:
    return F.floor(F.log2(n) * STEPS_PER_OCTAVE)


def _least(counted: DataFrame, most: int) -> int | None:
    """The step of n from which on there are no more rows than the given number."""
    taken, least = 0, None
    for row in sorted(counted.groupBy(_step("n").alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += row["count"]
        if taken > most:
            break
        least = row["step"]
    return least


def _head(counted: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words, no more than the given number: those from some count on."""
    least = _least(counted, most)
    if least is None:
        return {}
    found = counted.where(_step("n") >= least).toArrow()
    return dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Both models learn from all rows that are not held out. base_score is the log10 probability of
    words and end under counts smoothed by one; score that of the bytes and their end under the
    tree of all contexts. A null text counts as an empty one, whose only token is its end.
    """
    spark = docs.sparkSession
    body = id_and_text(docs, id_col, text_col)
    learnt = body.where(~held_out(F.col("doc_id")))
    counted = settle(count_words(learnt), "words", drop_shuffles=True)
    words, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    ends = learnt.count()
    train_tokens, distinct = words + ends, vocabulary + (ends > 0)
    met = count_codes(learnt).withColumn("met", F.col("n")).unionByName(
        count_codes(body.where(held_out(F.col("doc_id")))).select("code", F.lit(0).cast("long").alias("n"), F.col("n").alias("met"))
    )
    met = settle(met.groupBy("code").agg(F.sum("n").alias("n"), F.sum("met").alias("met")), "codes", drop_shuffles=True)
    logs = code_logs(met)
    shared = spark.sparkContext.broadcast((_head(counted, HEAD_WORDS), _head_codes(met, logs, HEAD_CODES)))

    names = ["row", "n_tokens", "n_known", "logs", "score", "n_bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def left_over(rows: pa.Array, words: pa.Array, codes_: pa.Array, n: pa.Array) -> pa.RecordBatch:
        """How often rows hold words, or codes, that do not travel with the tasks."""
        blank = [pa.nulls(len(rows), k) for k in kinds[1:]]
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows), pa.int64()), rows, *blank, words, codes_, n], ["doc_id", *names, "word", "code", "n"]
        )

    def rare_codes(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        r, c, n = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
        return left_over(r, pa.nulls(len(r), pa.binary()), c, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (head, head_logs) = shared.value
        row = TaskContext.get().partitionId() << 33
        end = np.log10(ends + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, rare, codes_left, size = [], [], [], 0
                for text in bodies(part):
                    text = text or b""
                    row += 1
                    tokens = text.lower().split()
                    found = np.array([known.get(t, -1) for t in tokens], np.float64)
                    in_head = found[found > 0]
                    if len(in_head) < len(tokens):
                        others = Counter([t for t, n in zip(tokens, found.tolist(), strict=True) if n < 0])
                        rare += [(row, word, n) for word, n in others.items()]
                    score_, others = _looked_up(text, head, head_logs)
                    for code, n in others:
                        codes_left.append((np.full(len(code), row), code, n))
                        size += len(code)
                    if size >= RARE_AT_ONCE:
                        yield rare_codes(codes_left)
                        codes_left, size = [], 0
                    rows.append((row, len(tokens) + 1, len(in_head) + (ends > 0), np.log10(in_head + 1).sum() + end, score_, len(text)))
                if codes_left:
                    yield rare_codes(codes_left)
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                nothing = [pa.nulls(len(rows), k) for k in (pa.binary(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *arrays, *nothing], ["doc_id", *names, "word", "code", "n"]
                )
                if rare:
                    r, w, n = zip(*rare, strict=True)
                    yield left_over(
                        pa.array(r, pa.int64()), pa.array(w, pa.binary()), pa.nulls(len(r), pa.int64()), pa.array(n, pa.int64())
                    )

    schema = "doc_id long, row long, n_tokens long, n_known long, logs double, score double, n_bytes long, word binary, code long, n long"
    # One pass writes the figures of each row, its rare words and codes, so that all name rows alike.
    passed = settle(body.mapInArrow(run, schema), "scored")
    shared.unpersist()
    rare = passed.where(F.col("word").isNotNull()).select("row", "word", F.col("n").alias("times"))
    looked_up = rare.join(counted, "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs")
    )
    rare = passed.where(F.col("code").isNotNull()).select("row", "code", F.col("n").alias("times"))
    more_score = rare.join(logs, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    main = passed.where(F.col("word").isNull() & F.col("code").isNull()).drop("word", "code", "n")
    main = main.join(more_score, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1))
    return main.join(looked_up, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
