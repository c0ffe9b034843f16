"""Exact quantiles per group without a group ever meeting in one task.

The built-in exact percentile keeps every distinct value of a group in the memory of one
task. Here a mergeable sketch per group first tells between which values a wanted rank lies. One
exact pass then counts the values outside of these bounds, and combines those within to (group,
bucket, value, count). Buckets divide the bounds evenly, so that they fit values of any size and
spread. The histogram over buckets, bounded in size, finds the one that holds the rank; only the
values of that bucket are ranked.
"""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gableframe.operators.skew import skew_join
from gableframe.scratch import settle

# The sketch is right to one in so many ranks; smaller groups are taken between their least and largest value.
ACCURACY = 10_000
# Buckets between two bounds.
BUCKETS = 1024


def _sketched(rows: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Per group __total, __sum and the bounds __lo0, __hi0, ... of the wanted ranks, ascending."""
    margin = 3.0 / accuracy
    asked = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    cuts = F.percentile_approx("__v", asked, accuracy).alias("__cuts")
    found = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        cuts, F.count(F.lit(1)).alias("__total"), F.sum("__v").alias("__sum"), F.min("__v").alias("__min"), F.max("__v").alias("__max")
    )
    few = F.col("__total") <= accuracy
    out = []
    for i, p in enumerate(probs):
        low = F.lit(True) if p <= margin else few
        high = F.lit(True) if p >= 1 - margin else few
        out.append(F.when(low, F.col("__min")).otherwise(F.col("__cuts")[2 * i]).alias(f"__lo{i}"))
        out.append(F.when(high, F.col("__max")).otherwise(F.col("__cuts")[2 * i + 1]).alias(f"__hi{i}"))
    return found.select(*[F.col(f"`{k}`") for k in keys], "__total", "__sum", *out)


def _placed(n: int) -> tuple[Column, Column]:
    """Bucket of a value, which never decreases as the value grows, and whether it lies within bounds."""
    v = F.col("__v")
    bucket, inside = F.lit(n * (BUCKETS + 2)), F.lit(False)
    for i in reversed(range(n)):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        # Bounds so far apart that their distance is no number make one bucket.
        share = F.nanvl(F.try_divide(v - lo, hi - lo), F.lit(0.0))
        place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS)).cast("int")
        within = v >= lo
        own = F.when(within, place + F.lit(i * (BUCKETS + 2) + 1)).otherwise(F.lit(i * (BUCKETS + 2)))
        bucket, inside = F.when(v <= hi, own).otherwise(bucket), F.when(v <= hi, within).otherwise(inside)
    return bucket, inside


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    mean: str | None = None,
    count: str | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Linearly interpolated quantiles of `value` per group, with mean and count on request.

    Rows whose value or key is missing are left out. An empty `by` gives one row over all,
    or none when there is nothing to measure. Keys and values are settled once as a narrow table,
    which the sketch and the exact pass read; the rows of a hot group meet its bounds in many tasks.
    """
    by = list(by)
    known = [F.col(f"`{k}`").isNotNull() for k in by]
    known += [F.col("__v").isNotNull(), ~F.isnan("__v")]
    rows = df.select(*[F.col(f"`{k}`") for k in by], F.col(f"`{value}`").cast("double").alias("__v"))
    rows = settle(rows.where(reduce(and_, known)).withColumn("__all", F.lit(0)), "values")
    group = by or ["__all"]
    keys = [F.col(f"`{k}`") for k in group]
    order = sorted(probs.values())
    sketch = settle(_sketched(rows, group, order, accuracy), "bounds")
    bucket, inside = _placed(len(order))
    met = skew_join(rows.select(*keys, "__v"), sketch, group, counts=sketch, n="__total")
    cells = (
        met.select(*keys, bucket.alias("__b"), F.when(inside, F.col("__v")).alias("__v"))
        .groupBy(*keys, "__b", "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    totals = sketch.select(*keys, "__total", "__sum")

    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        cells.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__m"))
        .select(*keys, "__b", "__m", (F.sum("__m").over(upto) - F.col("__m")).alias("__from"))
        .join(totals, group)
    )

    def rank(p: float) -> Column:
        return F.lit(float(p)) * (F.col("__total") - 1)

    def covers(start: Column, size: Column, position: Column) -> Column:
        return (start <= position) & (position < start + size)

    holds = [
        covers(F.col("__from"), F.col("__m"), edge(rank(p)))
        for p in probs.values()
        for edge in (F.floor, F.ceil)
    ]
    spans = buckets.where(reduce(or_, holds)).drop("__m")

    inside_bucket = (
        Window.partitionBy(*keys, F.col("__b"))
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = cells.join(spans, [*group, "__b"]).withColumn(
        "__at", F.col("__from") + F.sum("__n").over(inside_bucket) - F.col("__n")
    )

    def at_rank(position: Column) -> Column:
        return F.max(F.when(covers(F.col("__at"), F.col("__n"), position), F.col("__v")))

    aggs = [F.max("__total").alias("__total"), F.max("__sum").alias("__sum")]
    for i, p in enumerate(probs.values()):
        aggs += [at_rank(F.floor(rank(p))).alias(f"__lo{i}"), at_rank(F.ceil(rank(p))).alias(f"__hi{i}")]
    found = ranked.groupBy(*keys).agg(*aggs)

    out = [F.col(f"`{k}`") for k in by]
    for i, (name, p) in enumerate(probs.items()):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (rank(p) - F.floor(rank(p)))).alias(name))
    if mean:
        out.append((F.col("__sum") / F.col("__total")).alias(mean))
    if count:
        out.append(F.col("__total").alias(count))
    return found.select(*out)


def grouped_median(
    df: DataFrame, by: Sequence[str], value: str, name: str = "median", **extra: str
) -> DataFrame:
    """Median per group; `mean=` and `count=` name further outputs."""
    return grouped_quantiles(df, by, value, {name: 0.5}, **extra)
