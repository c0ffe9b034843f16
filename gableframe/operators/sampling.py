"""Balanced samples, random subsets and splits as pure functions of seed and row key.

A row's draw is the hash of seed and key, so a recomputed task draws the same rows. Ranks are
not taken by ordering a stratum: the histogram of hash prefixes tells which prefix holds the
last row to take, only the rows of that prefix are ranked to find that row, and the sample
is then a filter on hashes up to it. The rows themselves are never shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gableframe.operators.linkage import HASH_DIGITS, hash_order
from gableframe.scratch import settle

SPAN = float(2**32)


def uniform(key: Column, seed: object, purpose: str = "") -> Column:
    """Number in [0, 1) from the hash of seed, purpose and key."""
    head = F.substring(hash_order(F.concat_ws("|", F.lit(purpose), key.cast("string")), seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(SPAN)


def _hashed(df: DataFrame, key: str, seed: object) -> DataFrame:
    """Adds the draw of each row and its prefix."""
    h = hash_order(F.col(f"`{key}`"), seed)
    return df.withColumn("__draw", F.struct(h.alias("h"), F.col(f"`{key}`").alias("k"))).withColumn(
        "__p", F.substring(F.col("__draw")["h"], 1, HASH_DIGITS)
    )


def _last_draw(
    rows: DataFrame, cells: DataFrame, order: Sequence[str], n: Column, within: Sequence[str] = ()
) -> DataFrame:
    """The row that is n-th by (order, draw), per group of `within`.

    `cells` counts rows per group and value of `order`. A group of fewer rows gives none. Where
    those rows lie is settled first, one entry per group, and the rows are filtered by it.
    """
    keys = [*within, *order]
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    holding = placed.where((F.col("__from") < n) & (n <= F.col("__from") + F.col("__n")))
    needed = settle(holding.select(*keys, (n - F.col("__from")).alias("__need")), "needed")
    ranks = Window.partitionBy(*keys).orderBy("__draw")
    return (
        rows.join(needed, keys)
        .withColumn("__r", F.row_number().over(ranks))
        .where(F.col("__r") == F.col("__need"))
    )


def random_subset(df: DataFrame, n: int, key: str, seed: object = 42) -> DataFrame:
    """`n` rows drawn without replacement, or all when there are not more."""
    rows = _hashed(df, key, seed)
    if n <= 0:
        return df.limit(0)
    cells = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    last = _last_draw(rows, cells, ["__p"], F.lit(n)).select("__draw").scalar()
    return rows.where(F.coalesce(F.col("__draw") <= last, F.lit(True))).drop("__draw", "__p")


def balanced_sample(
    df: DataFrame, n_total: int, key: str, stratum: Column, seed: object = 42
) -> DataFrame:
    """Sample of `n_total` rows with an equal share of each stratum as far as it reaches.

    Every stratum gives up to n_total divided by the number of strata, at least one; what is
    then missing comes from the remaining rows of all strata together. Of more strata than
    rows wanted, the first rows by hash are kept. Of no more rows than wanted, all are kept.

    Keys, strata and draws are written to the shared folder once; the cuts come from that narrow
    table, and the rows are read a second time to be filtered.
    """
    # In a struct a missing stratum is a value that joins and counts like any other.
    drawn = _hashed(df.withColumn("__s", F.struct(stratum.alias("value"))), key, seed)
    draws = settle(drawn.select("__s", "__draw", "__p"), "draws")
    cells = settle(draws.groupBy("__s", "__p").agg(F.count(F.lit(1)).alias("__n")), "cells")
    strata = cells.agg(F.count_distinct("__s").alias("k"))
    quota = strata.select(
        F.greatest(F.lit(1), F.floor(F.lit(n_total) / F.greatest("k", F.lit(1)))).cast("bigint")
    ).scalar()
    # Last draw of each stratum's share; a stratum that is used up has none.
    last_of_share = _last_draw(draws, cells, ["__p"], quota, ["__s"])
    shares = settle(last_of_share.select("__s", F.col("__draw").alias("__last")), "shares")

    def tiered(rows: DataFrame) -> DataFrame:
        in_share = F.coalesce(F.col("__draw") <= F.col("__last"), F.lit(True))
        return rows.join(shares, "__s", "left").withColumn(
            "__tier", F.when(in_share, F.lit(0)).otherwise(F.lit(1))
        )

    # Rows per tier and prefix follow from the histogram: no further count of rows.
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    own = F.least(
        F.col("__n"),
        F.greatest(F.lit(0), quota - F.coalesce(F.sum("__n").over(before), F.lit(0))),
    )
    tiers = (
        cells.withColumn("__own", own)
        .select(
            "__p",
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("__tier"), F.col("__own").alias("__c")),
                    F.struct(F.lit(1).alias("__tier"), (F.col("__n") - F.col("__own")).alias("__c")),
                )
            ),
        )
        .groupBy("__tier", "__p")
        .agg(F.sum("__c").alias("__n"))
        .where(F.col("__n") > 0)
    )
    last = (
        _last_draw(tiered(draws), tiers, ["__tier", "__p"], F.lit(n_total))
        .select(F.struct("__tier", "__draw"))
        .scalar()
    )
    taken = F.coalesce(F.struct("__tier", "__draw") <= last, F.lit(True))
    return tiered(drawn).where(taken).drop("__draw", "__p", "__s", "__last", "__tier")


def train_holdout(df: DataFrame, key: str, ratio: float = 0.1, seed: object = 42) -> DataFrame:
    """Adds `split`: test with the given chance per row, else train."""
    drawn = uniform(F.col(f"`{key}`"), seed, "split") < F.lit(float(ratio))
    return df.withColumn("split", F.when(drawn, "test").otherwise("train"))


def group_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per split or stratum."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
