"""Dataset access and writers."""

import pytest
from pyspark.sql import functions as F

from gableframe.plans.certificates import enrich_certificates, year_bounds
from gableframe.sources import csv as C
from gableframe.sources import dataset as D
from gableframe.sources import lake as L


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "ann", 3.0), (2, "bob", None), (3, None, 5.0), (4, "o'neil", 9.0)], "id long, full__name string, score double"
    )


@pytest.mark.parametrize(
    "where, ids",
    [
        ({"id": 2}, [2]),
        ({"id__eq": 2}, [2]),
        ({"id__ne": 2}, [1, 3, 4]),
        ({"id__gt": 1, "score__lte": 5.0}, [3]),
        ({"full__name": "bob"}, [2]),
        ({"full__name__like": "%n%"}, [1, 4]),
        ({"full__name__in": ["ann", "o'neil"]}, [1, 4]),
        ({"full__name": None}, [3]),
        ({"score__ne": None}, [1, 3, 4]),
        ({}, [1, 2, 3, 4]),
        (None, [1, 2, 3, 4]),
    ],
)
def test_predicates(people, where, ids):
    assert [r.id for r in D.select(people, ["id"], where, "id").collect()] == ids


def test_bad_predicates(people):
    with pytest.raises(ValueError):
        D.select(people, where={"id__near": 3})
    with pytest.raises(ValueError):
        D.select(people, where={"id__in": "3"})
    with pytest.raises(ValueError):
        D.distinct_values(people, [])


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception):
        D.open_parquet(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        D.open_parquet(spark, [])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = D.select(D.open_parquet(spark, f"{sf_dir}/orders.parquet"), ["o_orderkey"], {"o_totalprice__gt": 400_000})
    text = plan(df)
    assert "GreaterThan(o_totalprice,400000" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_partitions_are_pruned(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("sale_year"), F.lit("GL").alias("outcode2"))
    L.write_lake(df, str(tmp_path / "lake"), "outcode2_year")
    read = D.select(D.open_parquet(spark, str(tmp_path / "lake")), ["id"], {"sale_year": 1})
    assert "PartitionFilters: [isnotnull(sale_year" in plan(read)
    assert read.count() == 33


def test_one_file_per_leaf_and_more_for_a_hot_leaf(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "ZZ").otherwise(F.concat(F.lit("A"), F.col("id") % 5)).alias("outcode2"))
    path = str(tmp_path / "leaves")
    L.write_partitioned(df.repartition(4), path, ["outcode2"], rows_per_file=300)
    per_file = D.open_parquet(spark, path, file_name=True).groupBy("outcode2", "filename").count().collect()
    hot = [r["count"] for r in per_file if r.outcode2 == "ZZ"]
    assert sum(hot) == 900 and len(hot) >= 2 and max(hot) <= 600
    assert sorted((r.outcode2, r["count"]) for r in per_file if r.outcode2 != "ZZ") == [(f"A{i}", 20) for i in range(5)]


def test_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "x")
    L.write_lake(spark.range(3), path, "none")
    with pytest.raises(Exception):
        L.write_lake(spark.range(3), path, "none")
    L.write_lake(spark.range(5), path, "none", mode="overwrite")
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError):
        L.write_lake(spark.range(3), path, "none", compression="lzma")


def test_missing_partition_value_is_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, outcode2 string")
    L.write_partitioned(df, str(tmp_path / "n"), ["outcode2"])
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_csv_tree_skips_unreadable_files(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    (source / "a.csv").write_text("x,y\n1,2\n")
    (source / "deep" / "b.txt").write_text("x,z\n3,q\n")
    (source / "c.csv.gz").write_bytes(b"this is not gzip")
    (source / "d.json").write_text("{}")
    done = {r.path.rsplit("/", 1)[1]: r.error for r in L.convert_csv_tree(spark, str(source), str(tmp_path / "out")).collect()}
    assert set(done) == {"a.csv", "b.txt", "c.csv.gz"}
    assert spark.read.parquet(str(tmp_path / "out" / "deep" / "b.parquet")).count() == 1
    assert done["a.csv"] is None and done["b.txt"] is None and done["c.csv.gz"]
    assert spark.read.parquet(str(tmp_path / "out" / "a.parquet")).collect()[0].asDict() == {"x": 1, "y": 2}


def certificate(spark, **fields):
    names = ["LMK_KEY", "POSTCODE", "ADDRESS1", "ADDRESS2", "LODGEMENT_DATE", "INSPECTION_DATE"]
    return spark.createDataFrame([tuple(fields.get(n) for n in names)], ", ".join(f"{n} string" for n in names))


def test_certificate_fields(spark):
    row = enrich_certificates(
        certificate(spark, POSTCODE="gl52 2qz", ADDRESS1="Flat 3,", ADDRESS2="19 High-St", LODGEMENT_DATE="x", INSPECTION_DATE="2020-05-06 07:08")
    ).first()
    assert (row.postcode_norm, row.outcode, row.outcode2) == ("GL522QZ", "GL52", "GL")
    assert (str(row.lodgement_dt), row.lodgement_year, row.addr_key) == ("2020-05-06", "2020", "FLAT319HIGHST")


def test_year_bounds_fail_without_dates(spark):
    with pytest.raises(Exception, match="no date"):
        year_bounds(enrich_certificates(certificate(spark, LMK_KEY="1"))).collect()


def test_globs_keep_partition_columns(spark, tmp_path):
    from gableframe.sources import dataset as D

    df = spark.createDataFrame([(i, i % 2, f"v{i % 3}") for i in range(12)], "x long, a int, b string")
    df.write.partitionBy("a", "b").parquet(f"{tmp_path}/t")
    for path in (f"{tmp_path}/t/a=*/b=*/*.parquet", f"{tmp_path}/t/*/*", f"{tmp_path}/t/a=1", f"{tmp_path}/t"):
        got = D.open_parquet(spark, path)
        assert set(got.columns) == {"x", "a", "b"} and got.where("a = 1").count() == 6
    assert [tuple(r) for r in D.distinct_values(df, ["a", "b"], limit=2).collect()] == [(0, "v0"), (0, "v1")]


def test_links_need_an_address_and_keep_rows_without_an_id(spark):
    from gableframe.operators.linkage import link

    sales = spark.createDataFrame(
        [(None, "GL1 1AA", None, "1", "HIGH ST", "2024-01-10"), (None, "GL1 1AA", None, None, None, "2024-01-10"), ("c", "GL9 9AA", None, "5", "X", "2024-01-10")],
        "`Transaction ID` string, Postcode string, SAON string, PAON string, Street string, d string",
    ).withColumn("Date of Transfer", F.to_date("d"))
    certificates = spark.createDataFrame(
        [("k", "GL1 1AA", "1", "HIGH ST", None, "2024-1-2 10:30", None), ("l", "GL1 1AA", None, None, None, "2024-01-02", None)],
        "LMK_KEY string, POSTCODE string, ADDRESS1 string, ADDRESS2 string, ADDRESS3 string, INSPECTION_DATE string, LODGEMENT_DATE string",
    )
    counts = {how: link(sales, certificates, how=how, match_empty=False).count() for how in ("inner", "left", "full")}
    assert counts == {"inner": 1, "left": 3, "full": 4}
    assert link(sales, certificates, match_empty=True).count() == 2
    assert link(sales, certificates).first().days_diff == 8


WIDE = ["Transaction ID", "Price", "Date of Transfer", "Postcode", "County"]


def write_lines(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_columns_beyond_the_fortieth_are_found_by_name(spark, tmp_path):
    fill = [f"x{i}" for i in range(45)]
    late = ["Price", "Date of Transfer", "Postcode", "County", *fill, "Transaction ID"]
    write_lines(tmp_path, "late.csv", [",".join([*fill, *WIDE]), ",".join([*["-"] * 45, "a", "1", "2024-01-02", "GL1", "KENT"])])
    write_lines(tmp_path, "end.csv", [",".join(late), ",".join(["2", "2024-01-03", "GL2", '"KENT, EAST"', *["-"] * 45, "b"])])
    write_lines(tmp_path, "none.csv", ["c,3,2024-01-04 00:00,GL3"])
    got = {r["Transaction ID"]: (r["Price"], r["Postcode"], r["County"]) for r in C.read_sales_csv(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {"a": (1.0, "GL1", "KENT"), "b": (2.0, "GL2", "KENT, EAST"), "c": (3.0, "GL3", None)}


def test_plan_does_not_grow_with_the_headers(spark, tmp_path):
    sizes = []
    for n in (2, 200):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            head = [*WIDE[i % 5 :], *WIDE[: i % 5], f"more {i}"]
            row = dict(zip(WIDE, [f"t{i}", str(i), "2024-01-02", "GL1", "KENT"]))
            write_lines(folder, f"{i}.csv", [",".join(head), ",".join(row.get(h, "-") for h in head)])
        df = C.read_sales_csv(spark, str(folder))
        assert sorted((r["Transaction ID"], r["Price"]) for r in df.collect()) == sorted((f"t{i}", float(i)) for i in range(n))
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_writers_scan_their_input_once(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    laid = plan(L.one_file_per_leaf(orders, ["o_orderstatus"]))
    assert laid.count("FileScan") == 1 and "REBALANCE_PARTITIONS_BY_COL" in laid
