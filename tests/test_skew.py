"""Joins with a hot key, with adaptive execution off."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gableframe.operators import linkage as K
from gableframe.operators import quality as Q
from gableframe.operators import series
from gableframe.operators.skew import hot_keys, key_counts, skew_join


@pytest.fixture
def plain(spark):
    """No runtime re-plan, no broadcast by size."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24"}
    before = {c: spark.conf.get(c) for c in held}
    for c, v in held.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def rows(spark):
    """A third of the rows has one key; one key is null."""
    return spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 997 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id").alias("v"),
    )


def test_a_hot_key_is_split(spark, plain, rows):
    right = rows.groupBy("k").agg(F.max("v").alias("most"))
    straight = rows.join(right, "k")
    split = skew_join(rows, right, ["k"], rows_per_task=200)
    assert split.columns == straight.columns
    assert sorted(split.collect()) == sorted(straight.collect())
    assert largest_share(straight) > 1 / 3 > 0.3 > largest_share(split)
    left = skew_join(rows, right.where("k != 'k7'"), ["k"], "left", rows_per_task=200)
    assert left.count() == 9000 and left.where("most is null").count() == rows.where("k = 'k7' or k is null").count()


def test_only_hot_keys_are_split(spark, plain, rows):
    hot = hot_keys(key_counts(rows, ["k"]), ["k"], rows_per_task=200)
    assert [(r.k, r["__parts"]) for r in hot.collect()] == [("hot", 15)]
    assert hot_keys(key_counts(rows, ["k"]), ["k"]) is None
    assert hot_keys(key_counts(rows.where("false"), ["k"]), ["k"]) is None
    assert skew_join(rows.where("false"), rows, ["k"]).count() == 0
    with pytest.raises(ValueError):
        skew_join(rows, rows, ["k"], "full")


def test_repeated_addresses_split_a_hot_address(spark, plain, rows):
    named = rows.withColumnRenamed("k", "ADDRESS_ID")
    want = sorted(series.repeated_addresses(named).collect())
    split = series.repeated_addresses(named, rows_per_task=200)
    assert sorted(split.collect()) == want and largest_share(split) < 0.3


def test_boxes_and_densities_of_hot_groups(spark, plain, rows):
    for stats in (Q.box_stats, Q.density):
        want = stats(rows, "k", "v").collect()
        assert sorted(stats(rows, "k", "v", rows_per_task=200).collect(), key=str) == sorted(want, key=str)


SALES = "`Transaction ID` string, `Date of Transfer` date, Postcode string, SAON string, PAON string, Street string, `Property Type` string"
CERTS = "LMK_KEY string, POSTCODE string, ADDRESS1 string, ADDRESS2 string, INSPECTION_DATE string, LODGEMENT_DATE string, PROPERTY_TYPE string"


def test_contained_addresses(spark):
    day = dt.date(2020, 6, 1)
    sales = [
        ("s1", day, "GL1 1AA", None, "12", "High Street", "D"),
        ("s2", day, "GL1 1AA", "Flat 2", "12", "High Street", "F"),
        ("s3", day, "GL1 1AA", None, None, None, "D"),
        ("s4", day, None, None, "12", "High Street", "D"),
        ("s5", day, "GL1 1AA", None, "14", "High Street", "D"),
        ("s6", None, "GL1 1AA", None, "12", "High Street", "D"),
        ("s7", day, "GL1 1AA", None, "12", "High-Street", None),
    ]
    certs = [
        ("c1", "GL11AA", "12 High Street", None, "2020-05-01", None, "House"),
        ("c2", "GL1 1AA", "FLAT 2, 12", "High street, Newtown", None, "2020-05-01", "Flat"),
        ("c3", "GL1 1AA", "Flat 2", "12 High Street", "2020-05-01", None, "House"),
        ("c4", "GL1 1AA", "12 High Street", "Newtown", "2018-05-01", None, "House"),
        ("c5", "GL1 1AB", "12 High Street", None, "2020-05-01", None, "House"),
        ("c6", "GL1 1AA", None, None, "2020-05-01", None, "House"),
        ("c7", None, "12 High Street", None, "2020-05-01", None, "House"),
    ]
    got = {
        (r["Transaction ID"], r.epc_lmk_key): r.tier
        for r in K.link_contained(spark.createDataFrame(sales, SALES), spark.createDataFrame(certs, CERTS)).collect()
    }
    assert got == {("s1", "c1"): 1, ("s1", "c2"): 2, ("s1", "c3"): 2, ("s2", "c2"): 2, ("s7", "c1"): 1, ("s7", "c2"): 2, ("s7", "c3"): 2}
    none = K.link_contained(spark.createDataFrame([], SALES), spark.createDataFrame(certs, CERTS))
    assert none.count() == 0 and K.link_contained(spark.createDataFrame(sales, SALES), spark.createDataFrame([], CERTS)).count() == 0


def test_contained_equals_all_pairs(spark, sf_dir, plain):
    from workload.registry import certificates, lake

    sales, certs = lake(spark, sf_dir), certificates(spark, sf_dir)
    got = K.link_contained(sales, certs, rows_per_task=50).select("`Transaction ID`", "epc_lmk_key").collect()
    lines = [F.col(c) for c in ("ADDRESS1", "ADDRESS2", "ADDRESS3")]
    own = K.certificate_side(certs.withColumn("has", K._listed(lines))).select("epc_lmk_key", "epc_has", "epc_postcode_norm", "epc_date", "epc_property_type").collect()
    asked = K.sale_side(sales).withColumn("needs", K._listed([F.col(c) for c in ("SAON", "PAON", "Street")])).collect()
    by_postcode = {}
    for c in own:
        by_postcode.setdefault(c.epc_postcode_norm, []).append(c)
    want = set()
    for s in asked:
        for c in by_postcode.get(s.postcode_norm, []) if s.postcode_norm else []:
            flat = (s["Property Type"] or "").upper() != "F" or (c.epc_property_type or "").upper() in K.FLAT_TYPES
            if flat and s.needs and set(s.needs) <= set(c.epc_has) and c.epc_date and -180 <= (s["Date of Transfer"] - c.epc_date).days <= 365:
                want.add((s["Transaction ID"], c.epc_lmk_key))
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want and want
    linked = {(r["Transaction ID"], r.epc_lmk_key) for r in K.link(sales, certs).collect()}
    assert len(want - linked) > 0


def test_candidates_do_not_grow_with_the_square_of_a_street(spark):
    sizes = []
    for n in (200, 800):
        needed = spark.range(n).selectExpr("'GL1' as postcode_norm", "array(cast(id as string), 'HIGH', 'STREET') as needs")
        offered = spark.range(n).selectExpr("'GL1' as postcode_norm", "array(cast(id as string), 'HIGH', 'NEWTOWN', 'STREET') as has")
        sizes.append(K.containing_lists(needed, offered).count())
    assert sizes == [200, 800]
