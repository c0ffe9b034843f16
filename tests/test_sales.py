"""Cleaning, enrichment and market figures on small hand-made sales."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gableframe.functions import values as V
from gableframe.schema import text_schema
from gableframe.operators import market as M
from gableframe.operators import quality as Q
from gableframe.operators import series as S
from gableframe.plans.sales import clean_sales, enrich_sales
from gableframe.schema import CANONICAL
from gableframe.sources import csv as C


def raw(spark, rows):
    full = [tuple(r.get(c) for c in CANONICAL) for r in rows]
    return spark.createDataFrame(full, text_schema())


def sale(i, price, date, **more):
    return {"Transaction ID": str(i), "Price": price, "Date of Transfer": date, "Postcode": "GL52 2QZ", **more}


def test_clean_keeps_rows_with_price_and_date(spark):
    rows = [
        sale(1, "100", "2024-02-29 00:00", **{"Property Type": "d", "Duration": "U", "Street": "  high street "}),
        sale(2, "abc", "2024-01-01"),
        sale(3, "5", "garbage"),
        sale(4, None, None),
        sale(5, " 7 ", "2023-12-31", County="nan", PAON="THE  POND HOUSE, 19", SAON=None),
    ]
    got = {r["Transaction ID"]: r for r in clean_sales(raw(spark, rows)).collect()}
    assert set(got) == {"1", "5"}
    one, five = got["1"], got["5"]
    assert (one["Property Type"], one["Duration"], one["Street"]) == ("Detached", "U", "HIGH STREET")
    assert (one["Year"], one["Month"], one["Quarter"], one["Month Name"], one["Day"]) == (2024, 2, 1, "February", 29)
    assert five["Price"] == 7.0 and five["County"] is None
    assert five["ADDRESS_ID"] == "THE POND HOUSE, 19|||GL52 2QZ"


@pytest.mark.parametrize(
    "postcode, outward, sector, joined",
    [
        ("GL52 2QZ", "GL52", "2", "GL52 2"),
        ("GL522QZ", "GL52", "2", "GL52 2"),
        ("GL1 2AB", "GL1", "2", "GL1 2"),
        ("GL12AB", "GL1", "2", "GL1 2"),
        ("M1 1AE", "M1", "1", "M1 1"),
        ("EC1A 1BB", "EC1A", "1", "EC1A 1"),
        ("EC1A1BB", "EC1A", "1", "EC1A 1"),
        ("GL52", "GL52", "2", "GL52 2"),
        ("UNKNOWN", None, None, ""),
        (None, None, None, ""),
    ],
)
def test_postcode_parts(spark, postcode, outward, sector, joined):
    c = F.lit(postcode).cast("string")
    row = spark.range(1).select(V.outward(c).alias("o"), V.sector(c).alias("s"), V.postcode_sector(c).alias("p")).first()
    assert (row.o, row.s, row.p) == (outward, sector, joined)


def test_enrich_dates_and_sentinel(spark):
    rows = [sale(1, "5", "29/02/2024"), sale(2, "5", "2023-03-01 00:00", Postcode=None), sale(3, "5", "03-2024")]
    got = {r["Transaction ID"]: r for r in enrich_sales(raw(spark, rows)).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].sale_year, got["1"].sale_month, got["1"].outcode2) == ("2024", "02", "GL")
    assert got["2"].outcode2 == "ZZ" and got["2"]["Date of Transfer"] == dt.date(2023, 3, 1)


def test_enrich_needs_a_date(spark):
    with pytest.raises(ValueError):
        enrich_sales(spark.createDataFrame([(1,)], "Price long"))


def test_headers(spark):
    assert C.normalise_headers(["a", "b", "Price", "Date"]) is None
    assert C.normalise_headers([" Amount ", "DATE", "Town", "tenure", "x"]) == [
        "Price", "Date of Transfer", "Town/City", "Duration", "x",
    ]


def test_short_and_long_lines_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("t1,10,2024-01-01,GL1 1AA\n" + ",".join(["t2", "20", "2024-01-02"] + ["x"] * 15) + "\n")
    got = C.read_sales_csv(spark, str(tmp_path)).orderBy("Transaction ID").collect()
    assert len(got[0]) == 16 and got[0]["Street"] is None and got[1]["Record Status"] == "x"


def prices(spark, rows):
    return spark.createDataFrame(
        [(str(i), y, a, float(p), dt.datetime(y, 1 + i % 12, 1)) for i, (y, a, p) in enumerate(rows)],
        "`Transaction ID` string, Year int, District string, Price double, `Date of Transfer` timestamp",
    )


def test_ranking_and_growth(spark):
    df = prices(
        spark,
        [(2023, "A", 100), (2023, "A", 300), (2024, "A", 400), (2024, "B", 50), (2023, "C", 9), (2024, None, 1000)],
    )
    got = [(r.District, r.Year, r.median_price, r.volume, r.median_prev, r.yoy_pct) for r in M.area_ranking(df, "District").collect()]
    assert got == [("A", 2024, 400.0, 1, 200.0, 100.0), ("B", 2024, 50.0, 1, None, None)]
    assert [r.District for r in M.top_movers(df, "District").collect()] == ["A"]
    grown = M.location_growth(df, "District").collect()
    assert [(r.District, r.growth_pct) for r in grown] == [("A", 100.0)]


def test_growth_keeps_areas_with_every_year_only(spark):
    df = prices(spark, [(2022, "A", 1), (2023, "A", 2), (2024, "A", 4), (2023, "B", 1), (2024, "B", 3)])
    assert [r.District for r in M.location_growth(df, "District").collect()] == ["A"]
    both = M.location_growth(df, "District", every_year=False).orderBy("District").collect()
    assert [(r.District, r.growth_pct) for r in both] == [("A", 100.0), ("B", 200.0)]


def test_yoy_without_previous_year(spark):
    row = M.yoy_median(prices(spark, [(2024, "A", 5), (2022, "A", 5)])).first()
    assert (row.latest_year, row.median_latest, row.yoy) == (2024, 5.0, None)


def test_top_or_all(spark):
    few = spark.createDataFrame([(f"k{i:02}", i) for i in range(25)], "k string, v int")
    many = spark.createDataFrame([(f"k{i:02}", i) for i in range(26)], "k string, v int")
    assert [r.v for r in M.top_or_all(few, "k", "v").collect()] == list(range(25))
    assert [r.v for r in M.top_or_all(many, "k", "v").collect()] == list(range(6, 26))


def test_filters(spark):
    df = prices(spark, [(2023, "A", 100), (2024, "B", 200)])
    assert M.filter_sales(df, prices=(100, 150)).count() == 1
    assert M.filter_sales(df, district=["B"]).count() == 1
    assert M.filter_sales(df, district=[]).count() == 2
    with pytest.raises(ValueError):
        M.filter_sales(df, colour=["red"])


def repeat_frame(spark):
    rows = [
        ("1", "x", dt.datetime(2020, 1, 1), 100.0),
        ("2", "x", dt.datetime(2020, 1, 1), 110.0),
        ("3", "x", dt.datetime(2021, 1, 1), 220.0),
        ("4", "x", dt.datetime(2022, 1, 1), None),
        ("5", "x", dt.datetime(2023, 1, 1), 440.0),
        ("6", "y", dt.datetime(2020, 1, 1), 5.0),
    ] + [(f"h{i:03}", "|||", dt.datetime(2020, 1, 1 + i % 9), float(i + 1)) for i in range(90)]
    return spark.createDataFrame(rows, "`Transaction ID` string, ADDRESS_ID string, `Date of Transfer` timestamp, Price double")


def test_repeat_sales_match_pandas(spark):
    df = repeat_frame(spark)
    p = df.toPandas().sort_values(["Date of Transfer", "Transaction ID"])
    p["np"] = p.groupby("ADDRESS_ID")["Price"].shift(-1)
    p["nd"] = p.groupby("ADDRESS_ID")["Date of Transfer"].shift(-1)
    p = p.dropna(subset=["np", "nd"])
    want = {r["Transaction ID"]: (r["np"], (r["nd"] - r["Date of Transfer"]).days / 30.44) for _, r in p.iterrows()}
    got = {r["Transaction ID"]: (r.next_price, pytest.approx(r.months)) for r in S.repeat_sales(df).collect()}
    assert got == want


def test_monthly_series_has_no_gaps_and_rolls_like_pandas(spark):
    rows = [("1", dt.datetime(2020, 1, 5), 10.0), ("2", dt.datetime(2020, 2, 5), 20.0), ("3", dt.datetime(2020, 5, 5), 30.0),
            ("4", dt.datetime(2020, 6, 5), 50.0), ("5", dt.datetime(2020, 6, 6), 60.0)]
    df = spark.createDataFrame(rows, "`Transaction ID` string, `Date of Transfer` timestamp, Price double")
    got = S.rolling_median(S.monthly_series(df), "median_price", 2).orderBy("month").collect()
    assert [r.transactions for r in got] == [1, 1, 0, 0, 1, 2]
    want = pd.Series([10, 20, None, None, 30, 55.0]).rolling(2).median()
    assert [r.rolling for r in got] == [None if pd.isna(w) else w for w in want]
    assert S.monthly_series(df.where("Price < 0")).collect() == []


def test_winsorise_and_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "Price double")
    limits = Q.percentile_pair(df).first()
    clipped = Q.winsorise(df).agg(F.min("Price_w").alias("a"), F.max("Price_w").alias("b"), F.count("Price_w").alias("n")).first()
    assert (clipped.a, clipped.b, clipped.n) == (limits.lo, limits.hi, 100)
    assert sorted(r.Price for r in Q.outliers(df).collect()) == [1.0, 100.0]


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(99.0,)], "Price double")
    got = Q.histogram(df, bins=10).collect()
    assert [r.n for r in got] == [10] * 9 + [11]
    assert [r.n for r in Q.histogram(df.where("Price = 3"), bins=10).collect()] == [1]


def test_trend_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "x double, y double")
    row = S.trend_line(df, "x", "y").first()
    assert (round(row.slope, 9), round(row.intercept, 9), round(row.r2, 9)) == (2.0, 1.0, 1.0)


def test_hedonic_equals_least_squares(spark):
    import numpy as np

    from gableframe.operators.hedonic import hedonic

    rng = np.random.default_rng(3)
    kinds, ages = rng.choice(["a", "b", "c"], 300), rng.choice(["New", "Old"], 300)
    effect = {"a": 0.0, "b": 0.5, "c": -0.25}
    logs = 10 + np.array([effect[k] for k in kinds]) + 0.1 * (ages == "Old") + rng.normal(0, 0.01, 300)
    df = spark.createDataFrame(
        [(float(np.exp(y)), str(k), str(a)) for y, k, a in zip(logs, kinds, ages)],
        "Price double, `Property Type` string, `Old/New` string",
    )
    got = {(r.term, r.level): r.coefficient for r in hedonic(df, terms=("Property Type", "Old/New")).collect()}
    design = np.column_stack([np.ones(300), kinds == "b", kinds == "c", ages == "Old"]).astype(float)
    want = np.linalg.lstsq(design, logs, rcond=None)[0]
    names = [("intercept", ""), ("property_type", "b"), ("property_type", "c"), ("old_new", "Old")]
    assert set(got) == set(names)
    for name, w in zip(names, want):
        assert got[name] == pytest.approx(w, abs=1e-5)


def test_moments_by_shape(spark):
    from gableframe.functions.values import to_moment, to_number

    want = {
        "2024-02-29 00:00": "2024-02-29 00:00:00", "29/02/2024": "2024-02-29 00:00:00", "01/03/2024 10:30": "2024-03-01 10:30:00",
        "2024/2/9": "2024-02-09 00:00:00", "2024-1-2 10:30": "2024-01-02 10:30:00", "12:30": None, "garbage": None, "30/02/2024": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: r.m for r in df.select("t", F.date_format(to_moment(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("m")).collect()}
    assert got == want
    numbers = spark.createDataFrame([("100d",), (" 7.5 ",), ("1e3",), ("x",), ("5f",)], "t string")
    assert [r.n for r in numbers.select(to_number(F.col("t")).alias("n")).collect()] == [None, 7.5, 1000.0, None, None]


def test_hedonic_leaves_out_a_term_of_one_level(spark):
    from gableframe.operators.hedonic import hedonic

    rows = [(100.0 * (1 + i % 2), "D", "A" if i % 2 else "B") for i in range(20)]
    df = spark.createDataFrame(rows, ["Price", "Property Type", "Duration"])
    both, one = hedonic(df, terms=("Property Type", "Duration")), hedonic(df, terms=("Duration",))
    assert both.collect() == one.collect()
    assert [r.term for r in hedonic(df, terms=("Property Type",)).collect()] == ["intercept"]


def test_balanced_sample_with_null_strata(spark):
    from gableframe.operators.sampling import balanced_sample

    rows = [(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = balanced_sample(df, 300, "id", F.col("s")).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {None: 100, "a": 100, "b": 100}


def test_hedonic_with_many_levels(spark):
    """Ten thousand levels by steps, against least squares on the cells; the same on every run."""
    import numpy as np

    from gableframe.operators.hedonic import hedonic

    rng = np.random.default_rng(8)
    areas, kinds = np.repeat(np.arange(10_000), 4), np.tile(["D", "F", "S", "T"], 10_000)
    effects = dict(zip("DFST", (0.0, -0.4, 0.1, 0.3)))
    of_area = rng.normal(0, 0.5, 10_000)
    logs = 11 + of_area[areas] + np.array([effects[k] for k in kinds])
    rows = [(float(np.exp(y)), f"A{a:05d}", str(k)) for y, a, k in zip(logs, areas, kinds)]
    df = spark.createDataFrame(rows, "Price double, Outward string, `Property Type` string")
    got = {(r.term, r.level): r.coefficient for r in hedonic(df, terms=("Property Type", "Outward")).collect()}
    assert len(got) == 1 + 3 + 9_999
    for k in "FST":
        assert got["property_type", k] == pytest.approx(effects[k], abs=1e-6)
    found = np.array([got["outward", f"A{a:05d}"] for a in range(1, 10_000)])
    assert np.abs(found - (of_area[1:] - of_area[0])).max() < 1e-6


def test_hedonic_by_steps_equals_direct_and_repeats(spark):
    from gableframe.operators.hedonic import hedonic

    rows = [(100.0 + 7 * (i % 13) + i % 5, "ABC"[i % 3], str(i % 7), None if i == 9 else "x") for i in range(400)]
    df = spark.createDataFrame(rows, ["Price", "Property Type", "Outward", "Duration"])
    terms = ("Property Type", "Outward", "Duration")
    direct = sorted(hedonic(df, terms=terms).collect())
    steps = sorted(hedonic(df, terms=terms, direct=0).collect())
    assert [r[:2] for r in direct] == [r[:2] for r in steps]
    assert [r.coefficient for r in steps] == pytest.approx([r.coefficient for r in direct], abs=1e-8)
    assert all(sorted(hedonic(df.repartition(n), terms=terms).collect()) == direct for n in (1, 3, 8))
    none = spark.createDataFrame([], df.schema)
    assert hedonic(none, terms=terms).collect() == []


def test_certificate_dates_are_what_formatters_read(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-2-9", "2024-13-01", "0000-01-01", "2024-01-01 5:7", "2024-01-01 24:00", "2024-01-01 23:60",
             "2024-01-01 23:59:59", "2024-01-01 23:59:60", "2024-01-01 1:2:3", "2024-01-01\n", "2024-01-01 ", " 2024-01-01", "2024-01-01T10:00",
             "01/02/2024", "31/02/2024", "n/a", "", "12024-01-01", "2024-00-10", "2024-01-01 10", "2024-01-01 10:30:59.5", "2024-1-1 007:5", None]
    shapes = {"yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d H:m": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$",
              "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$"}

    def read(c, *formats):
        return F.coalesce(*[F.when(c.rlike(shapes[f]), F.try_to_timestamp(c, F.lit(f))) for f in formats]).cast("date")

    c, head = F.col("c"), F.split_part(F.col("c"), F.lit(" "), F.lit(1))
    got = spark.createDataFrame([(t,) for t in texts], "c string").select(
        "c", V.certificate_date(F.lit(None), c).alias("a"), read(c, "yyyy-M-d", "yyyy-M-d H:m", "yyyy-M-d H:m:s").alias("b"),
        V.sale_date(c).alias("d"), read(head, "yyyy-M-d", "d/M/yyyy").alias("e"),
    )
    for r in got.select(*[F.col(n).cast("string") for n in "cabde"]).collect():  # Python has no year 0
        assert (r.a, r.d) == (r.b, r.e), r
    alone = got.select(V.certificate_date(c, c))._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in alone
