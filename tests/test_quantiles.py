"""Exact quantiles against NumPy, with ties, hot groups, negatives and missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gableframe.operators.quantiles import grouped_median, grouped_quantiles

PROBS = {"p01": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}


def frame(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows + [("a", None), (None, 1.0), ("a", float("nan"))], "k string, v double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(7)
    return {
        "a": rng.normal(0, 1000, 300),
        "hot": np.concatenate([np.full(1000, 250_000.0), rng.integers(1, 500_000, 999)]),
        "one": [42.0],
        "pair": [-3.0, 4.0],
        "wide": 10.0 ** rng.uniform(-12, 12, 200),
    }


def test_matches_numpy(spark, groups):
    got = {r.k: r for r in grouped_quantiles(frame(spark, groups), ["k"], "v", PROBS, "mean", "n").collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in PROBS.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9), (k, name)
        assert got[k]["mean"] == pytest.approx(np.mean(values))
        assert got[k]["n"] == len(values)


def test_without_groups(spark, groups):
    df = spark.createDataFrame([(float(v),) for v in groups["hot"]], "v double")
    row = grouped_quantiles(df, [], "v", PROBS).first()
    for name, p in PROBS.items():
        assert row[name] == pytest.approx(np.quantile(groups["hot"], p))


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert grouped_median(df, ["k"], "v").collect() == []
    assert grouped_median(df, [], "v").collect() == []


def test_rows_are_shuffled_once_after_combining(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = grouped_median(orders, ["o_orderstatus"], "o_totalprice")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert "percentile" not in plan.lower()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert orders.where(F.col("o_totalprice").isNull()).count() == 0


def test_buckets_fit_values_of_large_offset_and_small_spread(spark):
    """Moments in seconds: a sketch leaves few values between the bounds, and these fall into many buckets."""
    from gableframe.operators import quantiles as Q

    values = 1.7e9 + np.random.default_rng(5).permutation(60_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = grouped_quantiles(df, [], "v", PROBS, "mean", "n").first()
    for name, p in PROBS.items():
        assert got[name] == np.quantile(values, p)
    assert got["n"] == 60_000
    rows = df.select(F.lit(0).alias("__all"), F.col("v").alias("__v"))
    order = sorted(PROBS.values())
    bucket, inside = Q._placed(len(order))
    met = rows.join(Q._sketched(rows, ["__all"], order, Q.ACCURACY), "__all").where(inside)
    sizes = [r["count"] for r in met.groupBy(bucket.alias("b")).count().collect()]
    assert sum(sizes) < 60_000 * 0.01 and max(sizes) <= 10


def test_infinite_values_and_groups_beyond_the_accuracy(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.lognormal(10, 3, 3000), "b": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]), "c": np.full(700, -0.5), "d": np.array([1e308, -1e308, 0.0])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for accuracy in (50, 10_000):
        for r in grouped_quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "p90": 0.9}, accuracy=accuracy).collect():
            if r.k == "b":
                assert r.median == 2.0
            elif r.k == "d":
                assert r.median == 0.0
            else:
                assert [r.q1, r.median, r.p90] == pytest.approx(np.quantile(groups[r.k], [0.25, 0.5, 0.9]).tolist())
