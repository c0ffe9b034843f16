"""Hedonic regression of the log price."""

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.scratch import drop, settle

TERMS = ("Property Type", "Old/New", "Duration", "Year", "Month", "Outward")
# Systems of up to so many levels are solved at once, larger ones by conjugate gradients on Spark.
DIRECT_LEVELS = 2048
# Sums are taken over whole multiples of 1e-14, so that they do not depend on the order of tasks.
EXACT = "decimal(38,14)"
MOST_STEPS, TOLERANCE = 500, 1e-11


def _safe(name: str) -> str:
    return name.lower().replace(" ", "_").replace("/", "_")


def _sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT))


def level_cells(df: DataFrame, price: str = "Price", terms: Sequence[str] = TERMS) -> DataFrame:
    """One row per combination of levels: the levels, n rows, and the sum s of their log prices.

    Rows without a price or a level, and prices that have no logarithm, are left out.
    """
    rows = df.select(
        F.ln(F.col(f"`{price}`")).alias("y"), *[F.col(f"`{t}`").cast("string").alias(_safe(t)) for t in terms]
    ).dropna()
    return rows.groupBy(*[_safe(t) for t in terms]).agg(F.count(F.lit(1)).alias("n"), _sum(F.col("y")).alias("s"))


def _entries(cells: DataFrame, terms: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The normal equations, sparse: (term, level, term2, level2, n), and (term, level, n, s).

    Every row has the level "" of the intercept besides one per term.
    """
    def cell(t: str) -> Column:
        level = F.lit("") if t == "intercept" else F.col(t)
        return F.struct(F.lit(t).alias("term"), level.alias("level"))

    held = F.array(*[cell(t) for t in ("intercept", *terms)])
    one = cells.select("n", "s", F.explode(held).alias("a"))
    right = one.groupBy("a.term", "a.level").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    two = cells.select("n", F.explode(held).alias("a"), held.alias("all")).select("n", "a", F.explode("all").alias("b"))
    left = two.groupBy("a.term", "a.level", F.col("b.term").alias("term2"), F.col("b.level").alias("level2"))
    return left.agg(F.sum("n").alias("n")), right


def _direct(left: DataFrame, right: DataFrame) -> list[tuple[str, str, float]]:
    """The system solved in the driver, which it fits."""
    rows = sorted((r["term"], r["level"], float(r["s"])) for r in right.collect())
    at = {(t, v): i for i, (t, v, _) in enumerate(rows)}
    matrix = np.zeros((len(rows), len(rows)))
    for r in left.collect():
        matrix[at[r["term"], r["level"]], at[r["term2"], r["level2"]]] = r["n"]
    if not rows:
        return []
    found = np.linalg.lstsq(matrix, np.array([s for *_, s in rows]), rcond=None)[0]
    return [(t, v, float(b)) for (t, v, _), b in zip(rows, found, strict=True)]


def _by_steps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(term, level, coefficient) by conjugate gradients, preconditioned with the counts of the levels.

    The vectors are tables with a row per level; a step joins the entries with one of them, adds up
    per level, and brings two numbers to the driver.
    """
    left, key = settle(left, "entries"), ["term", "level"]
    zero = F.lit(0.0)
    residual = F.col("s").cast("double")
    state = right.select(*key, "n", zero.alias("x"), residual.alias("r"), (residual / F.col("n")).alias("p"))
    state = settle(state, "state")

    def size(df: DataFrame, unit: float) -> float:
        # As shares of what is known to be larger: small residuals would vanish among whole multiples of 1e-14.
        return float(df.agg(_sum(F.col("r") * F.col("r") / F.col("n") / F.lit(unit))).first()[0] or 0) * unit

    before = first = size(state, 1.0)
    for _ in range(MOST_STEPS):
        if before <= TOLERANCE**2 * max(first, 1.0):
            break
        there = state.select(F.col("term").alias("term2"), F.col("level").alias("level2"), "p")
        unit = F.lit(math.sqrt(before))
        summed = (_sum(F.col("n") * F.col("p") / unit).cast("double") * unit).alias("q")
        product = left.join(there, ["term2", "level2"]).groupBy(*key).agg(summed)
        moved = settle(state.join(product, key), "moved")
        bend = float(moved.agg(_sum(F.col("p") * F.col("q") / F.lit(before))).first()[0]) * before
        if bend <= 0:
            drop(moved)
            break
        rate = F.lit(before / bend)
        stepped = settle(
            moved.select(*key, "n", (F.col("x") + rate * F.col("p")).alias("x"), (F.col("r") - rate * F.col("q")).alias("r"), "p"), "stepped"
        )
        after = size(stepped, before)
        drop(moved)
        drop(state)
        state = settle(stepped.withColumn("p", F.col("r") / F.col("n") + F.lit(after / before) * F.col("p")), "state")
        drop(stepped)
        before = after
    return state.select(*key, F.col("x").alias("coefficient"))


def hedonic(df: DataFrame, price: str = "Price", terms: Sequence[str] = TERMS, direct: int = DIRECT_LEVELS) -> DataFrame:
    """Effect of each level of each term on the log price, against the first level of the term.

    Every term is categorical. The result has one row per level but the first ones, with the
    coefficient and the premium in per cent, exp(coefficient) - 1, plus one for the intercept, which is no premium.
    Rows are first added up per combination of levels, exactly, so that the result is the same on every
    run. Terms that do not vary are left out. Any number of levels will do: more than `direct` are
    solved by conjugate gradients over tables, so that no vector of levels comes to the driver.
    """
    cells = settle(level_cells(df, price, terms), "cells")
    names = [_safe(t) for t in terms]
    firsts = cells.agg(*[F.min(t).alias(t) for t in names], *[F.max(t).alias(f"{t}__last") for t in names]).first()
    # A term with one level has no effect that could be told from the intercept.
    varying = [t for t in names if firsts[t] != firsts[f"{t}__last"]]
    base = {t: firsts[t] for t in varying}
    left, right = _entries(cells, varying)
    is_base = [F.col("term").eqNullSafe(t) & F.col("level").eqNullSafe(v) for t, v in base.items()]
    for test in is_base:
        right = right.where(~test)
    for side in ("", "2"):
        for t, v in base.items():
            left = left.where(~(F.col(f"term{side}").eqNullSafe(t) & F.col(f"level{side}").eqNullSafe(v)))
    right = settle(right, "levels")
    if right.count() <= direct:
        found = df.sparkSession.createDataFrame(_direct(left, right), "term string, level string, coefficient double")
    else:
        found = _by_steps(left, right)
    premium = (F.exp("coefficient") - 1.0) * 100.0
    return found.withColumn("premium_pct", F.when(F.col("term") != "intercept", premium))
