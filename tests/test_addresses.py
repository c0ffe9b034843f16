"""Address strings, linkage and cohorts."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from gableframe.functions import address as A
from gableframe.functions import cohort as H
from gableframe.operators import linkage as K
from gableframe.plans.cohort import address_cohort


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "column, text, want",
    [
        (A.number_name, "THE POND HOUSE, 19", "19 THE POND HOUSE"),
        (A.number_name, "19", "19"),
        (A.number_name, "the pond house", "THE POND HOUSE"),
        (A.number_name, "12A", "12A"),
        (A.number_name, "123456", None),
        (A.number_name, None, None),
        (A.name_only, "19 THE POND HOUSE", "THE POND HOUSE"),
        (A.name_only, "19", None),
        (A.name_only, "THE POND HOUSE", "THE POND HOUSE"),
        (A.flat_number, "FLAT 3/2", 3),
        (A.flat_number, "APT 12", 12),
        (A.flat_number, "FLAT FIRST FLOOR FRONT", None),
        (A.first_int, "UNIT 7 OF 9", 7),
        (A.first_int, "123456", None),
        (A.norm_street, "High  St.", "HIGH STREET"),
        (A.norm_street, "Mill gdns, Park rd", "MILL GARDENS PARK ROAD"),
        (A.norm_street, " , ", None),
        (A.de_punct, "3/2, O'Neil-House_", "3/2 O Neil House_"),
        (A.up, "  a \t b ", "A B"),
    ],
)
def test_strings(spark, column, text, want):
    assert one(spark, text, column) == want


def test_street_line(spark):
    df = spark.createDataFrame(
        [("FLAT 1", "5 HIGH STREET", "OLD TOWN"), ("AB", "CD", None), ("A", None, "LONGEST"), (None, None, None)], "a string, b string, c string"
    )
    got = [r.y for r in df.select(A.street_line([F.col("a"), F.col("b"), F.col("c")]).alias("y")).collect()]
    assert got == ["5 HIGH STREET", "AB", "LONGEST", None]


def sides(spark):
    day = dt.date(2020, 6, 15)
    sales = [("s1", day, "GL52 2QZ", None, "19", "High St"), ("s2", None, "GL52 2QZ", None, "19", "High St"), ("s3", day, None, None, "1", "x")]
    gaps = [0, 365, 366, -180, -181]
    certs = [(f"c{g}", "gl522qz", "19", "HIGH ST", str(day - dt.timedelta(days=g))) for g in gaps]
    certs += [("other", "GL52 2QZ", "20", "HIGH ST", str(day)), ("undated", "GL52 2QZ", "19", "HIGH ST", None)]
    return (
        spark.createDataFrame(sales, "`Transaction ID` string, `Date of Transfer` date, Postcode string, SAON string, PAON string, Street string"),
        spark.createDataFrame([(*c, None) for c in certs], "LMK_KEY string, POSTCODE string, ADDRESS1 string, ADDRESS2 string, INSPECTION_DATE string, LODGEMENT_DATE string"),
    )


def test_link_tolerance(spark):
    sales, certs = sides(spark)
    got = {(r["Transaction ID"], r.epc_lmk_key): r.days_diff for r in K.link(sales, certs).collect()}
    assert got == {("s1", "c0"): 0, ("s1", "c365"): 365, ("s1", "c-180"): 180}


def test_link_keeps_unmatched(spark):
    sales, certs = sides(spark)
    left = K.link(sales, certs, how="left").collect()
    assert sorted(r["Transaction ID"] for r in left) == ["s1", "s1", "s1", "s2", "s3"]
    full = K.link(sales, certs, how="full").collect()
    assert len(full) == 9 and {r.epc_lmk_key for r in full if r["Transaction ID"] is None} == {"c366", "c-181", "other", "undated"}
    with pytest.raises(ValueError):
        K.link(sales, certs, how="cross")


def test_link_equals_all_pairs_for_a_hot_address(spark):
    base = dt.date(2015, 1, 1)
    days = [base + dt.timedelta(days=37 * i) for i in range(60)]
    sales = spark.createDataFrame(
        [(f"s{i}", d, "GL1 1AA", None, None, None) for i, d in enumerate(days)],
        "`Transaction ID` string, `Date of Transfer` date, Postcode string, SAON string, PAON string, Street string",
    )
    certs = spark.createDataFrame(
        [(f"c{i}", "GL1 1AA", None, str(d + dt.timedelta(days=11)), None) for i, d in enumerate(days)],
        "LMK_KEY string, POSTCODE string, ADDRESS1 string, INSPECTION_DATE string, LODGEMENT_DATE string",
    )
    want = {
        (f"s{i}", f"c{j}")
        for (i, a), (j, b) in itertools.product(enumerate(days), enumerate(days))
        if -180 <= (a - b - dt.timedelta(days=11)).days <= 365
    }
    got = [(r["Transaction ID"], r.epc_lmk_key) for r in K.link(sales, certs).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_dense_ids(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    assert sorted(r.unique_id for r in K.dense_ids(df, "k", start=5).collect()) == list(range(5, 505))
    by = K.dense_ids(df.repartition(7), "k", by=("g",)).collect()
    assert sorted(r.unique_id for r in by if r.g == 0) == list(range(1, 251))
    again = {r.k: r.unique_id for r in K.dense_ids(df.coalesce(1), "k", by=("g",)).collect()}
    assert again == {r.k: r.unique_id for r in by}


def test_cohort(spark):
    names = "property_type postcode paon saon street locality town_city district county".split()
    rows = [
        ("F", "gl52 2qz", "THE POND HOUSE, 19", "FLAT 3"),
        ("D", "GL52 2QZ", "12 - 14", None),
        ("D", "GL52 2QZ", "ROSE COTTAGE", ""),
        ("D", "GL52 2QZ", "12", "FLAT 3"),
        ("F", "GL52 2QZ", "12", None),
        ("D", "NOWHERE", "12", None),
        ("D", "GL52 2QZ", "12/3", None),
        (None, "GL52 2QZ", "12", None),
        ("D", "GL52 2QZ", None, None),
    ]
    df = spark.createDataFrame([(*r, "ST", None, "TOWN", None, None) for r in rows], ", ".join(f"{n} string" for n in names))
    got = [(r.BuildingName, r.BuildingNumber, r.SubBuildingName, r.Postcode) for r in address_cohort(df).collect()]
    assert got == [
        ("THE POND HOUSE", "19", "FLAT 3", "GL52 2QZ"),
        (None, "12 - 14", None, "GL52 2QZ"),
        ("ROSE COTTAGE", None, None, "GL52 2QZ"),
    ]


@pytest.mark.parametrize(
    "saon, want",
    [(None, "none"), (" ", "none"), ("Flat 3", "flat"), ("UNITY", "name"), ("12", "num"), ("12A", "alnum"), ("A1", "alnum"), ("12.0", "num"), ("UPPER", "name")],
)
def test_saon_pattern(spark, saon, want):
    assert one(spark, saon, H.saon_pattern) == want


def test_postcode_tokens(spark):
    df = spark.createDataFrame(
        [("gl1 1aa", None, None), ("x", "GL1", "1AA"), ("GL11AA", None, ""), (None, None, None)], "p string, o string, i string"
    )
    got = [r.y for r in df.select(H.postcode_tokens(F.col("p"), F.col("o"), F.col("i")).alias("y")).collect()]
    assert got == [["GL1", "1AA"], ["GL1", "1AA"], ["GL11AA"], []]


ODD = ["", " ", "12", "12 13", "12 A 13", "A 12", "Flat 3/2, THE  mill-house 12a", "x  y z", "ß st. ǅ rd", "st", " ST RD 7", "a\n12\nb",
       "ΐ 12٣ _ / é'e", "no.12 ave", "AVE", "St. St. 5 st5 5st", "12\t13 - 14", "St\x85Rd", None]


def test_normalised_text_is_what_single_steps_give(spark):
    def collapse(c):
        return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))

    def bare(c):
        return collapse(F.regexp_replace(c, r"(?U)[^\w\s/]", " "))

    def plain(c):
        return F.filter(F.split(F.coalesce(collapse(F.upper(bare(c))), F.lit("")), r"\s+"), lambda w: w != "")

    def text(ws):
        return F.nullif(F.array_join(ws, " "), F.lit(""))

    c, full = F.col("c"), A.literal_map(A.STREET_WORDS)
    rows = spark.createDataFrame([(t,) for t in ODD], "c string").select(
        A.normal(c).alias("a1"), bare(collapse(F.upper(c))).alias("a2"),
        A.norm_street(c).alias("b1"), text(F.transform(plain(c), lambda w: F.coalesce(F.try_element_at(full, w), w))).alias("b2"),
        A.building_name(c, F.lit("5 b")).alias("c1"),
        text(F.filter(plain(F.concat_ws(" ", F.nullif(c, F.lit("")), F.lit("5 b"))), lambda w: ~w.rlike(r"^\d+$"))).alias("c2"),
        A.without_numbers(A.normal(c)).alias("d1"), text(F.filter(plain(c), lambda w: ~w.rlike(r"^\d+$"))).alias("d2"),
    ).collect()
    for r in rows:
        assert (r.a1, r.b1, r.c1, r.d1) == (r.a2, r.b2, r.c2, r.d2)


def test_prepared_certificates_normalise_each_line_once(spark):
    lines = spark.createDataFrame([(t, "Flat 2, 7 High St", None) for t in ODD], "ADDRESS1 string, ADDRESS2 string, ADDRESS3 string")
    done = K.prep_certificate_addresses(lines)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)[^\w/]+") == 3 and "(?U)" not in plan.replace(r"(?U)[^\w/]+", "")
    for r in done.collect():
        assert r.building_name == " ".join(w for w in r.full_norm.split(" ") if not (w.isascii() and w.isdigit()))
        assert r.Street_norm.split(" ")[-1] == "STREET" or r.ADDRESS1 is not None


def test_links_carry_wanted_columns_and_make_keys_once(spark):
    sales, certs = sides(spark)
    wanted = ["Transaction ID", "epc_lmk_key", "days_diff"]
    for how in ("inner", "left", "full"):
        some, every = K.link(sales, certs, how=how, columns=wanted), K.link(sales, certs, how=how)
        assert some.columns == wanted
        assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*[f"`{c}`" for c in wanted]).collect()))
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan and "regexp_replace" not in plan
