"""Sparse multinomial logistic regression: follow the regularised leader, then a temperature."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 4
# Features whose states a task averages at a time.
BLOCK = 4096
TEMPERATURES = np.geomspace(0.02, 20, 80)


@dataclass(frozen=True)
class Pace:
    """Step size (alpha, beta), the two penalties of the elastic net, and rounds over the examples."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005
    rounds: int = 3


def _weights(z: np.ndarray, n: np.ndarray, pace: Pace) -> np.ndarray:
    """Weights of the regularised leader; the L1 part keeps most of them at zero."""
    pull = np.sign(z) * np.maximum(np.abs(z) - pace.l1, 0)
    return -pull / ((pace.beta + np.sqrt(n)) / pace.alpha + pace.l2)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int, pace: Pace) -> None:
    """One example; the last feature is the bias of every example."""
    at, x = np.append(at, len(z) - 1), np.append(x, 1.0)
    zs, ns = z[at], n[at]
    w = _weights(zs, ns, pace)
    error = softmax(x @ w)
    error[label] -= 1
    g = x[:, None] * error
    z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / pace.alpha * w
    n[at] = ns + g * g


def fit(examples: DataFrame, classes: int, features: int, pace: Pace) -> np.ndarray:
    """Weights (features + 1, classes), the bias last.

    examples has key (long), label (int), at (array<int>), x (array<double>), and is a bounded sample.
    Shards learn from the shared state in parallel, in the order of the key, and their states are
    averaged after each round; a state is as large as the weights, whatever the number of examples.
    """
    dealt = examples.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SHARDS)))
    z, n = np.zeros((2, features + 1, classes))
    starts = range(0, features + 1, BLOCK)
    for _ in range(pace.rounds):

        def run(key: tuple, table: pa.Table) -> pa.Table:
            z1, n1 = z.copy(), n.copy()
            for batch in table.sort_by("key").to_batches():
                for label, at, x in zip(
                    batch.column("label").to_pylist(), batch.column("at"), batch.column("x"), strict=True
                ):
                    _learn(z1, n1, at.values.to_numpy(), x.values.to_numpy(), label, pace)
            parts = [[m[i : i + BLOCK].tobytes() for i in starts] for m in (z1, n1)]
            same = [[v] * len(starts) for v in (key[0].as_py(), table.num_rows)]
            return pa.table([list(starts), *same, *parts], names=["start", "shard", "seen", "z", "n"])

        def average(table: pa.Table) -> pa.Table:
            table = table.sort_by("shard")
            seen = table["seen"].to_pylist()
            means = [
                sum(np.frombuffer(s) * (k / sum(seen)) for s, k in zip(table[c].to_pylist(), seen, strict=True)) for c in ("z", "n")
            ]
            return pa.table({"start": table["start"][:1], "z": [means[0].tobytes()], "n": [means[1].tobytes()]})

        states = dealt.groupBy("shard").applyInArrow(run, "start long, shard long, seen long, z binary, n binary")
        # The driver gets the mean alone, not the state of each shard.
        blocks = states.groupBy("start").applyInArrow(average, "start long, z binary, n binary").toArrow()
        if not blocks.num_rows:
            break
        z, n = z.copy(), n.copy()
        for start, z1, n1 in zip(*(blocks[c].to_pylist() for c in ("start", "z", "n")), strict=True):
            for state, mean in ((z, z1), (n, n1)):
                state[start : start + BLOCK] = np.frombuffer(mean).reshape(-1, classes)
    return _weights(z, n, pace)


def temperature(examples: DataFrame, weights: np.ndarray) -> float:
    """The divisor of scores at which examples that were not learnt from are likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, at, x in zip(
                batch.column("label").to_pylist(), batch.column("at"), batch.column("x"), strict=True
            ):
                scores = x.values.to_numpy() @ weights[at.values.to_numpy()] + weights[-1]
                p = softmax(scores[None, :] / TEMPERATURES[:, None])[:, label]
                loss -= np.log(np.maximum(p, 1e-300))
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(loss)), "loss": loss})

    rows = examples.mapInArrow(run, "i long, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    if not rows or not any(r["loss"] for r in rows):
        return 1.0
    return float(TEMPERATURES[min(rows, key=lambda r: (r["loss"], r["i"]))["i"]])
