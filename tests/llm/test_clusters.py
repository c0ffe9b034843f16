import hashlib
import math

import numpy as np
import pytest

from gableframe.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, vector string"


def brute(rows, k=40, rounds=5, dims=64):
    """rows of (id, vector): Lloyd's rounds with whole numbers, every distance computed."""
    kept = []
    for d, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((d, tuple(math.floor(256 * float(np.float32(x))) for x in v), tuple(v)))
    digest = lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [list(r[1]) for r in sorted(kept, key=lambda r: (digest(r), r[2]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v, _ in kept]
        for i in range(len(centroids)):
            own = [v for (_, v, _), c in zip(kept, of, strict=True) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(d, *near(v)) for d, v, _ in kept]
    inertia = sum(x for _, x, _ in last)
    per = {c: sum(x for _, x, i in last if i == c) for _, _, c in last}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((d, c, x, per[c], inertia, sha[c]) for d, x, c in last), key=repr)


def got(table, **more):
    return sorted((tuple(r) for r in C.cluster(table, **more).collect()), key=repr)


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert len(rows) >= 100 and got(table) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    ok = [float(x) for x in rng.normal(size=64).astype(np.float32)]
    rows = [(i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(30)]
    rows += [(7, ok)] * 9 + [(None, ok), (None, [0.0] * 64), (40, None), (41, []), (42, ok[:63]), (43, [*ok[:63], None])]
    rows += [(44, [*ok[:63], math.nan]), (45, [*ok[:63], -math.inf]), (46, [-x for x in ok]), (47, [1000.0] * 64)]
    table = spark.createDataFrame([(*r, None, 3, "x") for r in rows], SCHEMA)
    for k in (1, 3, 40, 100):
        assert got(table, clusters=k) == brute(rows, k)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(table.where("vec_id between 40 and 45")) == []
    with pytest.raises(Exception, match="beyond"):
        got(spark.createDataFrame([(1, [1e9] * 64, 1, 1, "x")], SCHEMA))


def test_blocks_equal_full_scans_and_spare_most(spark, monkeypatch):
    """Round by round the heaps give what a scan of all vectors gives, and fewer and fewer are popped."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 8)) * 2000
    vectors = (middles[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)) * 200).astype(np.int64)
    centroids = vectors[:12].copy()
    block, drifted = C.Block(vectors, []), np.zeros(12)
    block.fill(centroids, drifted)
    popped = []
    for _ in range(12):
        near = block.nearest()
        assert (near == C.distances(vectors, centroids).argmin(axis=1)).all()
        moved = np.array([np.floor_divide(vectors[near == i].sum(axis=0), max(1, (near == i).sum())) if (near == i).any() else centroids[i] for i in range(12)])
        drifted = drifted + C._drifts(centroids, moved)
        centroids = moved
        popped.append(sum(k <= drifted[i] for i, heap in enumerate(block.heaps) for k, _ in heap))
        packed = C.Block.unpack(*block.pack(), 8)
        assert packed.heaps == block.heaps and (packed.vectors == block.vectors).all()
        block.advance(centroids, drifted)
    assert popped[-1] < 100 and popped[0] > popped[-1]


def test_small_blocks(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = got(table, clusters=5, rounds=3)
    monkeypatch.setattr(C, "BLOCK", 7)
    assert got(table, clusters=5, rounds=3) == want
