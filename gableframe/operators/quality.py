"""Outliers, missing values, mixes and distributions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gableframe.operators.market import col
from gableframe.operators.quantiles import grouped_quantiles
from gableframe.operators.skew import ROWS_PER_TASK, skew_join
from gableframe.scratch import settle


def percentile_pair(
    df: DataFrame, value: str = "Price", lower: float = 0.01, upper: float = 0.99
) -> DataFrame:
    """Exact lower and upper percentile in one row."""
    return grouped_quantiles(df, [], value, {"lo": lower, "hi": upper})


def with_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds the one-row limits as columns through one scalar subquery."""
    row = limits.select(F.struct(*[F.col(c) for c in limits.columns])).scalar()
    return df.withColumn("__limits", row).select(
        "*", *[F.col("__limits")[c].alias(f"__{c}") for c in limits.columns]
    ).drop("__limits")


def _limits(df: DataFrame, value: str, lower: float, upper: float) -> tuple[Column, Column]:
    """The percentiles as constants. Two numbers come to the driver, so that a filter on them
    reaches the scan and the plan of what follows stays small."""
    row = percentile_pair(df, value, lower, upper).first()
    lo, hi = (row.lo, row.hi) if row else (None, None)
    return F.lit(lo).cast("double"), F.lit(hi).cast("double")


def winsorise(
    df: DataFrame,
    value: str = "Price",
    lower: float = 0.01,
    upper: float = 0.99,
    out: str = "Price_w",
) -> DataFrame:
    """Adds the value clipped to its percentiles; a missing value stays missing."""
    lo, hi = _limits(df, value, lower, upper)
    clipped = F.least(F.greatest(col(value), lo), hi)
    return df.withColumn(out, F.when(col(value).isNotNull(), clipped))


def outliers(
    df: DataFrame, value: str = "Price", lower: float = 0.01, upper: float = 0.99, tie: str | None = "Transaction ID"
) -> DataFrame:
    """Rows outside the percentiles, highest value first, equal ones by `tie` if there is such a column."""
    lo, hi = _limits(df, value, lower, upper)
    ties = [col(tie)] if tie in df.columns else []
    return df.where((col(value) < lo) | (col(value) > hi)).orderBy(F.desc(f"`{value}`"), *ties)


def missingness(df: DataFrame) -> DataFrame:
    """Share of missing values per column, highest first."""
    shares = df.agg(
        *[F.avg(F.when(col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in df.columns]
    )
    return shares.unpivot(
        [], [col(c) for c in df.columns], "column", "missing"
    ).orderBy(F.desc("missing"), "column")


def value_mix(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value, the missing value included."""
    counts = df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n"))
    # Summed over the aggregate, whose shuffle is reused, not over the rows.
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), col(column))


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 0 to bins-1 of equal width, the highest value in the last bin."""
    place = F.floor((v - lo) / (hi - lo) * bins)
    inner = F.least(place, F.lit(bins - 1).cast("bigint"))
    return F.when(hi > lo, inner).otherwise(F.lit(0).cast("bigint"))


def histogram(
    df: DataFrame, value: str = "Price", bins: int = 60, log: bool = False
) -> DataFrame:
    """Equal-width histogram of the value or of its natural logarithm.

    Empty bins are not listed. With `log`, values that have no logarithm are left out.
    """
    v = F.ln(col(value)) if log else col(value).cast("double")
    known = df.select(v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    limits = known.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    width = (F.col("lo") + (F.col("hi") - F.col("lo")) / bins * F.col("bin")).alias("start")
    return (
        with_limits(known, limits)
        .groupBy(
            F.col("__lo").alias("lo"),
            F.col("__hi").alias("hi"),
            bin_of(F.col("__v"), F.col("__lo"), F.col("__hi"), bins).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", width, "n")
        .orderBy("bin")
    )


def box_stats(
    df: DataFrame,
    by: str = "Property Type",
    value: str = "Price",
    reach: float = 1.5,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Quartiles, whiskers and number of suspected outliers per group.

    The quartiles are settled first: few of them meet the rows without a shuffle, and where there
    are many, the rows of a hot group meet them in several tasks.
    """
    quartiles = grouped_quantiles(
        df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, count="__n"
    ).withColumns(
        {
            "__lo": F.col("q1") - reach * (F.col("q3") - F.col("q1")),
            "__hi": F.col("q3") + reach * (F.col("q3") - F.col("q1")),
        }
    )
    rows = df.select(col(by), col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    quartiles = settle(quartiles, "quartiles")
    return (
        skew_join(rows, quartiles, [by], rows_per_task=rows_per_task, counts=quartiles)
        .groupBy(col(by), "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("__v"))).alias("lower_whisker"),
            F.max(F.when(inside, F.col("__v"))).alias("upper_whisker"),
            F.count(F.when(~inside, F.lit(1))).alias("outliers"),
        )
    )


def density(
    df: DataFrame,
    by: str = "Property Type",
    value: str = "Price",
    bins: int = 40,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Share of each equal-width bin within its group.

    Limits and bin counts are map-side aggregates; a group has at most `bins` rows. The limits
    are settled first: few of them meet the rows without a shuffle, and where there are many, the
    rows of a hot group meet them in several tasks.
    """
    rows = df.select(col(by), col(value).cast("double").alias("__v")).where(
        col(by).isNotNull() & F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    limits = rows.groupBy(col(by)).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("__n"))
    limits = settle(limits, "limits")
    counts = (
        skew_join(rows, limits, [by], rows_per_task=rows_per_task, counts=limits)
        .groupBy(
            col(by), "lo", "hi", bin_of(F.col("__v"), F.col("lo"), F.col("hi"), bins).alias("bin")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(col(by)))
    start = F.col("lo") + (F.col("hi") - F.col("lo")) / bins * F.col("bin")
    return counts.select(col(by), "bin", start.alias("start"), "n", (F.col("n") / total).alias("share"))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have every named column."""
    return df.dropna(subset=list(columns))
