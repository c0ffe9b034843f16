"""How often costly columns are made: once per row, whatever a figure does with them."""

import pytest
from pyspark.sql import functions as F

from gableframe.functions import tokens as T
from gableframe.functions.values import to_moment
from gableframe.operators import market as M
from gableframe.plans import rendering as X


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def counted(spark):
    """Sales whose price counts how often it is made."""
    made = spark.sparkContext.accumulator(0)

    def price(i):
        made.add(1)
        return float(i * 7 % 40)

    rows = spark.range(60).select(
        F.concat(F.lit("A"), F.col("id") % 3).alias("Outward"),
        (F.lit(2000) + F.col("id") % 4).cast("int").alias("Year"),
        F.when(F.col("id") % 2 == 0, "Flat").otherwise("House").alias("Property Type"),
        F.udf(price, "double")("id").alias("Price"),
    )
    return rows, made


def test_area_figures_make_the_sales_once(counted):
    rows, made = counted
    summary = M.area_summary(rows).collect()[0]
    assert summary["n"] == 60 and summary["common_type"] == "Flat"
    assert made.value == 60


def test_area_ranking_makes_the_sales_once(counted):
    rows, made = counted
    ranked = M.area_ranking(rows, "Outward").collect()
    assert [r["Year"] for r in ranked] == [2003] * 3 and all(r["volume"] == 5 for r in ranked)
    assert made.value == 60


def test_xml_is_rendered_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def pairs(i):
        made.add(1)
        return [(f"W{i}", "StreetName")]

    rows = spark.range(50).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.udf(pairs, "array<struct<token string, label string>>")("id").alias("labelled"),
    )
    X.write_labelled_xml(rows, str(tmp_path / "xml"), "id", rows_per_shard=15)
    assert made.value == 50
    back = X.read_labelled_xml(spark, str(tmp_path / "xml"))
    assert {r.raw_text for r in back.collect()} == {f"W{i}" for i in range(50)}
    shards = {(r["split"], r["shard"]): r["count"] for r in back.groupBy("split", "shard").count().collect()}
    assert shards == {("test", 0): 10, ("train", 0): 15, ("train", 1): 15, ("train", 2): 10}


MOMENTS = {
    "2001-02-03": "2001-02-03 00:00:00", "2001-2-3 4:5": "2001-02-03 04:05:00", "3/2/2001": "2001-02-03 00:00:00",
    "03/02/2001 4:5": "2001-02-03 04:05:00", "3/2/2001 14:05:06": "2001-02-03 14:05:06", "2001/2/3": "2001-02-03 00:00:00",
    " 2001/02/03 4:5 ": "2001-02-03 04:05:00", "2001/2/3 4:5:6": "2001-02-03 04:05:06", "31/2/2001": None, "3/2/2001 25:00": None,
    "3/2/2001 4": None, "3/2/2001 ": "2001-02-03 00:00:00", "2001/2/3 4:5:": None, "14:05": None, "garbage": None, "": None, None: None,
}


def test_moments_take_few_tests(spark):
    df = spark.createDataFrame([(t,) for t in MOMENTS], "t string").select("t", to_moment(F.col("t")).cast("string").alias("m"))
    assert {r.t: r.m for r in df.collect()} == MOMENTS
    # Seven tests made long code wherever a date is used.
    assert str(to_moment(F.col("t"))).lower().count("rlike(") == 3


def test_array_features_are_those_of_each_token(spark):
    tokens = ["Flat", "25", "dr.", "GL510PU", "٣", "12\n", "A.\n", ".", "1-2-3", "ß", "", None, "COURT", "Nw", "leeds"]
    lookups = T.Lookups(outcodes=["GL510PU"], posttowns=["LEEDS"])
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    got = df.select(T.array_features(F.col("tokens"), lookups).alias("f")).collect()[0].f
    one = df.select(F.posexplode("tokens").alias("i", "t")).select("i", T.token_features(F.col("t"), lookups).alias("f"))
    assert got == [r.f for r in one.orderBy("i").collect()]
    # Upper case is made once per token; was anew for nearly each feature.
    assert plan_of(T.sequence_features(df, "tokens", lookups)).count("upper(") == 1
