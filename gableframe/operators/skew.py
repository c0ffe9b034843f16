"""Joins in which one key may hold a large part of the rows, without relying on a runtime re-plan."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.scratch import settle

# Rows of one key that a task may get; keys above it number at most as many as HOT_KEYS.
ROWS_PER_TASK = 1_000_000
HOT_KEYS = 10_000


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key, as hot_keys looks at them."""
    counts = df.groupBy(*[F.col(f"`{c}`") for c in on]).agg(F.count(F.lit(1)).alias("__n"))
    return settle(counts.where("__n > 1"), "key-counts")


def hot_keys(counts: DataFrame, on: Sequence[str], n: str = "__n", rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """Keys with more rows than a task should get, and the number of parts to split them into; None without such keys.

    counts has a row per key with the number of its rows. The limit grows with the table, so that
    never more than HOT_KEYS of them are hot: this side is small enough to be sent to every task.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(rows_per_task, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= limit:
        return None
    parts = F.ceil(F.col(n) / limit).cast("int").alias("__parts")
    return settle(counts.where(F.col(n) > limit).select(*[F.col(f"`{c}`") for c in on], parts), "hot-keys")


def _meets(hot: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
    named = hot.select(*[F.col(f"`{c}`").alias(f"__hot_{i}") for i, c in enumerate(on)], "__parts")
    return F.broadcast(named), reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"__hot_{i}")) for i, c in enumerate(on)])


def salted(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds __salt: rows of a hot key dealt to its parts in turn, zero for all others."""
    side, same = _meets(hot, on)
    turn = F.pmod(F.monotonically_increasing_id(), F.col("__parts").cast("long")).cast("int")
    drop = [f"__hot_{i}" for i in range(len(on))]
    return df.join(side, same, "left").withColumn("__salt", F.coalesce(turn, F.lit(0))).drop(*drop, "__parts")


def replicated(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds __salt: rows of a hot key once per part, all others once."""
    side, same = _meets(hot, on)
    every = F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)
    drop = [f"__hot_{i}" for i in range(len(on))]
    return df.join(side, same, "left").withColumn("__salt", F.explode(every)).drop(*drop, "__parts")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
    n: str = "__n",
) -> DataFrame:
    """left joined to a right side that has few rows per key; how is inner or left.

    Rows of the left side are counted per key; those of hot keys are dealt to as many parts as the
    count asks for, and the rows of the right side sent to each part. Cold keys join as ever, and so
    do all where none is hot. Columns come as with a join on names. `counts` takes the keys with
    their number of rows, in the column `n`, where these are known anyway.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    hot = hot_keys(key_counts(left, on) if counts is None else counts, on, n, rows_per_task)
    if hot is None:
        return left.join(right, list(on), how)
    both = salted(left, hot, on).join(replicated(right, hot, on), [*on, "__salt"], how)
    return both.drop("__salt")
