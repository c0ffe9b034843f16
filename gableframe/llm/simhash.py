"""SimHash fingerprints and the groups of documents that few differing bits connect."""

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.llm import members
from gableframe.llm.components import components
from gableframe.llm.text import bodies, id_and_text
from gableframe.scratch import settle

BITS = 64
WORDS = 3
DISTANCE = 3
SEED = 42
GROUPS = 6
# A cell with more fingerprints than this is linked through midpoints instead of pairs.
DENSE = 256
AT_ONCE = 1 << 15


def fingerprint(body: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is set in more than half of the hashes of the shingles; 0 without words."""
    parts = (body or b"").lower().split()  # bytes.lower() touches A-Z alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    n = max(1, len(parts) - words + 1)
    stops = ends[words - 1 :] or ends[-1:]
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, AT_ONCE):
        pieces = [joined[a:b] for a, b in zip(starts[at : min(at + AT_ONCE, n)], stops[at : at + AT_ONCE], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed long, 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b) for b in bodies(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], ["doc_id", "text_hash", "fp"]
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("body"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segment_counts(fp: Column) -> Column:
    """The embedding: set bits of each of 32 two-bit segments, counts 0, 1, 2 written as 00, 01, 11.

    So written, the Manhattan distance of two embeddings is the number of bits in which they differ.
    """
    low = F.lit(0x5555555555555555)
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(low), 1))


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _grid_masks(distance: int, groups: int) -> list[int]:
    """Masks of the coordinates that a cell fixes.

    Coordinates are dealt to groups. Points within a Manhattan distance agree in all but so many
    groups, so that they share the cell of at least one choice of the other groups.
    """
    of = [0] * groups
    for segment in range(BITS // 2):
        of[segment * groups // (BITS // 2)] |= 3 << (2 * segment)
    return [_signed(sum(of[g] for g in chosen)) for chosen in combinations(range(groups), groups - distance)]


def _balls() -> tuple[list[int], list[int]]:
    """Bit patterns with at most one, and with exactly two, set bits."""
    single = [1 << i for i in range(BITS)]
    return [0, *map(_signed, single)], [_signed(a | b) for a, b in combinations(single, 2)]


def _through_midpoints(dense: DataFrame) -> DataFrame:
    """Links that connect just what pairs within three bits would, without forming the pairs.

    Of two values within three bits, some value between them is at most one bit from the first and
    two from the second. All within two bits of such a midpoint are within three of one that is
    within one bit of it: each is linked to the least of these. A midpoint has at most 2,081 values
    around it, and the links are no more than the rows.
    """
    near, far = _balls()

    def around(patterns: list[int], is_near: bool) -> DataFrame:
        flips = F.explode(F.array(*[F.lit(p) for p in patterns])).alias("flip")
        return dense.select("fp", flips).select(
            F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp", F.lit(is_near).alias("is_near")
        )

    hubs = around(near, True).groupBy("mid").agg(F.min("fp").alias("hub"))
    rest = around(near, True).unionByName(around(far, False)).select("mid", "fp")
    return rest.join(hubs, "mid").where("fp != hub").select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct()


def links(values: DataFrame, groups: int = GROUPS, dense: int = DENSE) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints just as all pairs within three bits do.

    values has the column fp, each value once. Cells of the grid over segment counts meet in a join;
    a pair survives if the Manhattan distance, a lower bound, and then the exact distance are within
    three. Cells that hold many values, as groups of near copies make them, go through midpoints,
    so that no cell yields more than a bounded number of pairs per value.
    """
    masks = _grid_masks(DISTANCE, groups)
    cell = F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m in masks])).alias("way", "cell")
    points = values.select("fp", _segment_counts(F.col("fp")).alias("counts"))
    placed = points.select("fp", cell)
    counted = settle(placed.groupBy("way", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    few = placed.join(counted.where(F.col("n") <= dense).drop("n"), ["way", "cell"])
    few = settle(few, "grid")
    a, b = few.select("way", "cell", F.col("fp").alias("u")), few.select("way", "cell", F.col("fp").alias("v"))
    bound = F.bit_count(_segment_counts(F.col("u")).bitwiseXOR(_segment_counts(F.col("v")))) <= DISTANCE
    exact = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = a.join(b, ["way", "cell"]).where(F.col("u") < F.col("v")).where(bound).where(exact).select("u", "v")
    crowded = placed.join(counted.where(F.col("n") > dense).drop("n"), ["way", "cell"]).select("fp").distinct()
    return pairs.distinct().unionByName(_through_midpoints(settle(crowded, "crowded")))


def _rooted(found: DataFrame) -> DataFrame:
    """(fp, root): for each distinct fingerprint the least one that links reach."""
    values = settle(found.select("fp").distinct(), "values")
    roots = settle(components(links(values)), "roots")
    return values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id among the documents that links connect. Texts are compared by
    lower-cased words in shingles of three; null and empty texts have fingerprint zero and are linked
    like any other; repeated rows come back as often as they came. A null id gets the component of its
    fingerprint, which is null if no member has an id.
    """
    found = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = settle(_rooted(found), "rooted")
    firsts = found.groupBy("fp").agg(F.min("doc_id").alias("first")).join(rooted, "fp")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    members = settle(rooted.join(least, "root").select("fp", "component_id"), "members")
    return found.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row left of each group of near copies: that of the least doc_id.

    Of rows that share this id, texts with the least hash stay, and of equal rows one. What goes is
    found on narrow rows; a filter of bounded size tells which rows that may concern, and only these
    meet the decisions, so that texts of documents without copies are never shuffled.
    """
    found = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    row = F.struct("doc_id", "text_hash")
    firsts = found.groupBy("fp").agg(F.min(row).alias("row")).join(_rooted(found), "fp")
    chosen = firsts.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    chosen = settle(chosen.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "chosen")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    is_chosen = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash").eqNullSafe(F.col("__hash")))
    kept = rows.join(chosen, is_chosen, "left_semi").where("n = 1")
    concerned = rows.join(kept, ["doc_id", "text_hash"], "left_anti").select(F.xxhash64("doc_id", "text_hash").alias("key"))
    filled = docs.sparkSession.sparkContext.broadcast(members.filter_of(concerned))

    body = F.xxhash64(F.col(f"`{text_col}`").cast("binary"))
    keyed = docs.withColumns({"__of": F.col(f"`{id_col}`").cast("long"), "__text": body})
    keyed = keyed.withColumn("__may", members.may_be_in(F.xxhash64("__of", "__text"), filled))
    same = F.col("__of").eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__hash"))
    met = keyed.where("__may").join(chosen, same, "left_semi").dropDuplicates(["__of", "__text"])
    left = met.unionByName(keyed.where(~F.col("__may")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
