"""Centroid clustering with heaps of bounds: only vectors whose gap has expired are looked at again."""

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gableframe.scratch import drop, settle

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
# Components up to this size have squared distances that 64 bits hold.
LARGEST = 1 << 27
# Vectors per block, the unit that holds heaps.
BLOCK = 4096
# Bounds give way by this share, so that rounding never keeps a vector from being looked at.
SLACK = 1e-9
BLOCKS = "ids array<long>, vectors binary, sizes binary, keys binary, places binary, moved array<long>"


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has so many components, none of them null, infinite or not a number."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & whole, F.lit(False))


def whole_numbers(values: np.ndarray, dimensions: int) -> np.ndarray:
    """floor(256 x) of each component."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}, where squared distances leave 64 bits")
    return scaled.astype(np.int64).reshape(-1, dimensions)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    cross = vectors @ centroids.T
    return (vectors * vectors).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)


class Block:
    """Some vectors and, per cluster, a heap of the gaps between the bounds of its vectors.

    The gap is the distance to the second nearest centroid less that to the nearest. A key is the
    gap plus what the cluster had drifted when the vector came in, so that one number per cluster
    ages all of its keys, and the heap yields those that have expired without a look at the others.
    """

    def __init__(self, vectors: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.vectors, self.heaps = vectors, heaps

    @classmethod
    def unpack(cls, vectors: bytes, sizes: bytes, keys: bytes, places: bytes, dimensions: int) -> "Block":
        bounds = np.cumsum(np.frombuffer(sizes, np.int32))
        cells = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(places, np.int32).tolist(), strict=True))
        heaps = [cells[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]
        return cls(np.frombuffer(vectors, np.int32).astype(np.int64).reshape(-1, dimensions), heaps)

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        cells = [c for heap in self.heaps for c in heap]
        return (
            self.vectors.astype(np.int32).tobytes(),
            np.array([len(h) for h in self.heaps], np.int32).tobytes(),
            np.array([k for k, _ in cells], np.float64).tobytes(),
            np.array([p for _, p in cells], np.int32).tobytes(),
        )

    def nearest(self) -> np.ndarray:
        """The cluster of each vector."""
        out = np.zeros(len(self.vectors), np.int64)
        for cluster, heap in enumerate(self.heaps):
            out[[p for _, p in heap]] = cluster
        return out

    def _push(self, places: np.ndarray, centroids: np.ndarray, drifted: np.ndarray) -> np.ndarray:
        """Exact scan of some vectors; each goes to the heap of its nearest centroid, of equal ones the first."""
        far = distances(self.vectors[places], centroids)
        near = far.argmin(axis=1)
        rows = np.arange(len(places))
        upper = np.sqrt(far[rows, near].astype(np.float64))
        if far.shape[1] > 1:
            far[rows, near] = np.iinfo(np.int64).max
            lower = np.sqrt(far.min(axis=1).astype(np.float64))
            gaps = lower - upper - SLACK * (lower + upper + drifted[near])
        else:
            gaps = np.full(len(places), np.inf)
        for key, place, cluster in zip((gaps + drifted[near]).tolist(), places.tolist(), near.tolist(), strict=True):
            heapq.heappush(self.heaps[cluster], (key, place))
        return near

    def fill(self, centroids: np.ndarray, drifted: np.ndarray) -> np.ndarray:
        """All vectors assigned for the first time; counts and sums that clusters gain."""
        self.heaps = [[] for _ in centroids]
        places = np.arange(len(self.vectors))
        return self._gains(places, self._push(places, centroids, drifted), 1)

    def advance(self, centroids: np.ndarray, drifted: np.ndarray) -> np.ndarray:
        """Vectors of expired gaps are popped and assigned anew; counts and sums that clusters gain or lose."""
        popped, left = [], []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drifted[cluster]:
                popped.append(heapq.heappop(heap)[1])
                left.append(cluster)
        places = np.array(popped, np.int64)
        gains = self._gains(places, np.array(left, np.int64), -1)
        return gains + self._gains(places, self._push(places, centroids, drifted), 1) if popped else gains

    def _gains(self, places: np.ndarray, clusters: np.ndarray, sign: int) -> np.ndarray:
        out = np.zeros((len(self.heaps), self.vectors.shape[1] + 1), np.int64)
        np.add.at(out[:, 0], clusters, sign)
        np.add.at(out[:, 1:], clusters, sign * self.vectors[places])
        return out


def _rows(blocks: list[tuple]) -> pa.RecordBatch:
    names = ["ids", "vectors", "sizes", "keys", "places", "moved"]
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), kinds, strict=True)], names)


def _filled(vectors: DataFrame, centroids: np.ndarray, dimensions: int) -> DataFrame:
    """The table in blocks, each vector in the heap of its nearest centroid."""
    still = np.zeros(len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                block = Block(whole_numbers(values, dimensions), [])
                moved = block.fill(centroids, still)
                yield _rows([(part.column("vec_id").to_pylist(), *block.pack(), moved.ravel())])

    return vectors.mapInArrow(run, BLOCKS)


def _advanced(blocks: DataFrame, centroids: np.ndarray, drifted: np.ndarray) -> DataFrame:
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vectors, sizes, keys, places, _ = (c[at].as_py() for c in batch.columns)
                block = Block.unpack(vectors, sizes, keys, places, dimensions)
                moved = block.advance(centroids, drifted)
                yield _rows([(ids, *block.pack(), moved.ravel())])

    return blocks.mapInArrow(run, BLOCKS)


def _gained(blocks: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Counts and sums per cluster, exact; the driver gets clusters x (dimensions + 1) numbers."""
    cells = blocks.select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = np.zeros(shape[0] * shape[1], object)
    for r in cells.collect():
        out[r["at"]] = int(r["x"])
    return out.reshape(shape)


def _seeds(vectors: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("digest", digest).orderBy("digest", "vector").limit(clusters).collect()
    return whole_numbers(np.array([r["vector"] for r in rows], np.float64), dimensions)


def _drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Per cluster how far its own centroid and that of any other may have closed the gap."""
    moved = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64))
    other = np.array([np.delete(moved, i).max() if len(moved) > 1 else 0.0 for i in range(len(moved))])
    return (moved + other) * (1 + SLACK)


def fit(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS
) -> tuple[DataFrame, np.ndarray]:
    """Blocks with all vectors (vec_id, vector) assigned to the last centroids, and these centroids.

    The state of a round is written to the shared folder and that of the round before deleted.
    """
    centroids = _seeds(vectors, clusters, dimensions)
    drifted, totals = np.zeros(len(centroids)), np.zeros((len(centroids), dimensions + 1), object)
    blocks = settle(_filled(vectors, centroids, dimensions), "blocks")
    for _ in range(rounds):
        totals = totals + _gained(blocks, totals.shape)
        moved = centroids.copy()
        for i, (n, *sums) in enumerate(totals):
            if n:
                moved[i] = [s // n for s in sums]
        drifted = drifted + _drifts(centroids, moved)
        centroids, before = moved, blocks
        blocks = settle(_advanced(blocks, centroids, drifted), "blocks")
        drop(before)
    return blocks, centroids


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) per vector."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, vectors, sizes, keys, places, _ = (c[at].as_py() for c in batch.columns)
                block = Block.unpack(vectors, sizes, keys, places, dimensions)
                near = block.nearest()
                far = ((block.vectors - centroids[near]) ** 2).sum(axis=1)
                columns = [pa.array(ids, pa.int64()), pa.array(near.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    table: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null ones, and those with a component that is null or not finite take
    no part. Distances are squared and exact, between components floor(256 x); ties go to the smaller
    number. A null id counts as an empty one where the first centroids are drawn, rows of one hash by
    their vectors; repeated rows are vectors of their own, so that later copies of a first centroid may
    stay empty and where they are. Fewer vectors than clusters make as many clusters; no usable vector
    gives no rows. A component beyond 2**19 is an error, as distances would not fit.
    """
    spark: SparkSession = table.sparkSession
    vector = F.col(f"`{vector_col}`")
    kept = table.where(usable(vector, dimensions)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    blocks, centroids = fit(kept, clusters, rounds, dimensions)
    found = settle(_assigned(blocks, centroids), "assigned")
    drop(blocks)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()
    whole = sum(int(r["x"]) for r in sums)
    own = {r["cluster"]: int(r["x"]) for r in sums}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, x, whole, shas[i]) for i, x in own.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
