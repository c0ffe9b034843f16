"""Cleaning, sources, sinks and the dataset layer: written to shared storage and read back."""

from pyspark.sql import functions as F

from gableframe.functions import values as V
from gableframe.plans import certificates as K
from gableframe.plans.sales import clean_sales, enrich_sales
from gableframe.scratch import shared_folder
from gableframe.sources import csv as C
from gableframe.sources import dataset as D
from gableframe.sources import lake as L
from workload.registry import certificates, lake, on_sales, register
from workload.twins import CERTS, LAKE, SALES
from workload.views import raw_certificates, raw_sales, table

SALE_COLS = (
    "Transaction ID", "Price", "Date of Transfer", "Postcode", "Property Type", "Old/New", "Duration", "PAON", "SAON",
    "Street", "Locality", "Town/City", "District", "County", "PPD Category Type", "Record Status", "Year", "Month",
    "Quarter", "Month Name", "Day", "Outward", "Sector", "Postcode Sector", "ADDRESS_ID",
)
LAKE_COLS = ("sale_year", "sale_month", "Outward", "Sector", "Postcode Sector", "outcode2")


def fields(names, dates=("Date of Transfer",)):
    return ", ".join(f'"{n}"::date as "{n}"' if n in dates else f'"{n}"' for n in names)


# --- cleaning ----------------------------------------------------------------------

on_sales("clean_sales", lambda df: df, f"select {fields(SALE_COLS)} from sales")


def csv_round_trip(header):
    """Raw sales written as CSV, read back by the loader and cleaned."""

    def run(spark, sf_dir):
        path = shared_folder(spark, "sales-csv")
        raw_sales(spark, sf_dir).write.csv(path, header=header)
        return clean_sales(C.read_sales_csv(spark, path)).select(
            "Transaction ID", "Price", "Date of Transfer", "Outward", "ADDRESS_ID", "Duration"
        )

    return run


_CSV_BACK = SALES + """select "Transaction ID", "Price", "Date of Transfer"::date as "Date of Transfer", "Outward",
    "ADDRESS_ID", "Duration" from sales"""
register("load_csv_with_header", csv_round_trip(True), _CSV_BACK)
register("load_csv_without_header", csv_round_trip(False), _CSV_BACK)


def load_mixed_folders(spark, sf_dir):
    """Files without a header beside files with one, whose columns stand in another order."""
    path = shared_folder(spark, "sales-mixed")
    raw = raw_sales(spark, sf_dir)
    odd = F.col("`Transaction ID`").cast("bigint") % 2 == 1
    raw.where(odd).select(*[F.col(f"`{c}`") for c in reversed(raw.columns)]).write.csv(f"{path}/named", header=True)
    raw.where(~odd).write.csv(f"{path}/bare")
    return clean_sales(C.read_sales_csv(spark, [f"{path}/bare", f"{path}/named"])).select(
        "Transaction ID", "Price", "Date of Transfer", "Outward", "ADDRESS_ID", "Duration"
    )


register("load_csv_mixed_folders", load_mixed_folders, _CSV_BACK)


def written_csv(spark, sf_dir):
    """CSV with a header, written and read back."""
    path = shared_folder(spark, "plain-csv")
    L.write_csv(table(spark, sf_dir, "part"), path)
    return C.read_delimited(spark, path, all_text=True)


register("write_csv", written_csv, """select p_partkey::varchar as p_partkey, p_name, p_brand, p_type,
    p_size::varchar as p_size, p_retailprice::varchar as p_retailprice from part""")


def load_alias_headers(spark, sf_dir):
    """CSV under other header names and with fewer columns."""
    path = shared_folder(spark, "sales-alias")
    raw_sales(spark, sf_dir).select(
        F.col("Transaction ID").alias("Transaction Unique Identifier"),
        F.col("Price").alias(" AMOUNT"),
        F.col("`Date of Transfer`").alias("Transfer Date"),
        F.col("Postcode").alias("Post Code"),
        F.col("`Town/City`").alias("City"),
        F.col("District").alias("Local Authority"),
    ).write.csv(path, header=True)
    return C.coerce_schema(C.read_sales_csv(spark, path))


register(
    "load_csv_alias_headers",
    load_alias_headers,
    f"""with raw as ({SALES.split('with raw as (', 1)[1].split('), parsed as (', 1)[0]})
    select "Transaction ID", try_cast("Price" as double) as "Price",
    cast(try_cast("Date of Transfer" as timestamp) as date) as "Date of Transfer", rtrim("Postcode") as "Postcode",
    null::varchar as "Property Type", null::varchar as "Old/New", null::varchar as "Duration", null::varchar as "PAON",
    null::varchar as "SAON", null::varchar as "Street", null::varchar as "Locality", "Town/City", "District",
    null::varchar as "County", null::varchar as "PPD Category Type", null::varchar as "Record Status" from raw""",
)


def declared_csv(spark, sf_dir):
    path = shared_folder(spark, "sales-declared")
    raw = raw_sales(spark, sf_dir)
    whole = F.floor(F.col("Price").try_cast("double"))
    raw.withColumn("Price", whole).write.option("sep", "|").csv(path)
    return C.read_declared_csv(spark, path, "|").select("Transaction ID", "Price", "Record Status")


register(
    "declared_csv",
    declared_csv,
    LAKE
    + """select "Transaction ID", cast(floor(try_cast("Price" as double)) as bigint) as "Price", "Record Status"
    from raw""",
)


def inferred_csv(spark, sf_dir):
    path = shared_folder(spark, "typed-csv")
    table(spark, sf_dir, "customer").write.option("compression", "gzip").csv(path, header=True)
    return C.read_delimited(spark, path)


register("inferred_csv_gz", inferred_csv, """select c_custkey::bigint as c_custkey, c_name,
    c_nationkey::bigint as c_nationkey, round(c_acctbal, 6) as c_acctbal, c_mktsegment from customer""")


def text_csv(spark, sf_dir):
    path = shared_folder(spark, "text-csv")
    table(spark, sf_dir, "supplier").write.csv(path, header=True)
    return C.read_delimited(spark, path, all_text=True)


register("all_text_csv", text_csv, """select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey,
    s_acctbal::varchar as s_acctbal from supplier""")
register(
    "union_by_name",
    lambda s, d: C.union_by_name(
        [
            table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
            table(s, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")),
        ]
    ),
    """select c_name as name, c_nationkey::bigint as nation, null::double as balance from customer union all
    select s_name, null, round(s_acctbal, 6) from supplier""",
)


def convert_tree(spark, sf_dir):
    """Two CSV folders turned to Parquet per input file, then read as one dataset."""
    source, target = shared_folder(spark, "csv-tree"), shared_folder(spark, "parquet-tree")
    for name in ("nation", "region"):
        table(spark, sf_dir, name).write.csv(f"{source}/{name}", header=True)
    done = L.convert_csv_tree(spark, source, target)
    ok = done.where(F.col("error").isNull()).select("output")
    outputs = [r.output for r in ok.toLocalIterator()]
    read = spark.read.option("mergeSchema", True).parquet(*outputs)
    return read.select(F.coalesce("n_name", "r_name").alias("name"), "n_regionkey")


register(
    "convert_csv_tree",
    convert_tree,
    """select n_name as name, n_regionkey::bigint as n_regionkey from nation union all select r_name, null from region""",
)


def listed_files(spark, sf_dir):
    source = shared_folder(spark, "listing")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string"))
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").csv(source)
    files = C.list_files(spark, source, ("*.csv", "*.txt.gz"))
    return files.select(F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("status")).distinct()


register("list_files", listed_files, "select distinct o_orderstatus as status from orders")


def lookup_csv(spark, sf_dir):
    """Region names of nations as a lookup with blanks and a missing pair."""
    path = shared_folder(spark, "lookup")
    table(spark, sf_dir, "nation").select(
        F.concat(F.lit("  "), "n_name").alias("from"),
        F.when(F.col("n_regionkey") != 2, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit(" "))).alias("to"),
    ).write.csv(path, header=True)
    return C.read_lookup(spark, path, ["from", "to"])


register(
    "lookup_csv",
    lookup_csv,
    """select n_name as "from", 'R' || n_regionkey as "to" from nation where n_regionkey <> 2""",
)


def centroid_csv(spark, sf_dir):
    from workload.market import centroids

    path = shared_folder(spark, "centroids")
    centroids(spark, sf_dir).write.csv(path, header=True)
    return C.read_centroids(spark, path)


def _centroid_twin():
    from workload.market import _centroids_sql

    return SALES + _centroids_sql() + 'select "Postcode Sector", lat, lon from cent'


register("centroid_csv", centroid_csv, _centroid_twin())

# --- lake --------------------------------------------------------------------------

register(
    "enrich_sales",
    lambda s, d: lake(s, d).select("Transaction ID", "Price", "Date of Transfer", "Postcode", *LAKE_COLS),
    LAKE + f"select {fields(('Transaction ID', 'Price', 'Date of Transfer', 'Postcode') + LAKE_COLS)} from lake",
)


def positional_sales(spark, sf_dir):
    """Sixteen columns under foreign names, taken by position."""
    raw = raw_sales(spark, sf_dir)
    return enrich_sales(raw.toDF(*[f"column{i}" for i in range(16)])).select("Transaction ID", "County", *LAKE_COLS)


register(
    "positional_sales",
    positional_sales,
    LAKE + f"select {fields(('Transaction ID', 'County') + LAKE_COLS)} from lake",
)


def dated_by_month(spark, sf_dir):
    """No date column: the first of the month given by year and month columns."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_totalprice").alias("Price"),
        F.year("o_orderdate").cast("string").alias("Yr"),
        F.when(F.col("o_orderkey") % 41 == 0, F.lit("13"))
        .otherwise(F.month("o_orderdate").cast("string"))
        .alias("Mon"),
        F.lit("sw1a 1aa").alias("PCDS"),
    )
    return enrich_sales(orders, year_col="yr", month_col="mon")


register(
    "enrich_from_year_and_month",
    dated_by_month,
    """select o_orderkey as "ID", round(o_totalprice, 6) as "Price", strftime(o_orderdate, '%Y') as "Yr",
    month(o_orderdate)::varchar as "Mon", 'SW1A1AA' as "PCDS", date_trunc('month', o_orderdate)::date as "Date of Transfer",
    strftime(o_orderdate, '%Y') as sale_year, strftime(o_orderdate, '%m') as sale_month, 'SW1A' as "Outward",
    '1' as "Sector", 'SW1A 1' as "Postcode Sector", 'SW' as outcode2 from orders where o_orderkey % 41 <> 0""",
)


def lake_layout(layout, compression):
    def run(spark, sf_dir):
        path = shared_folder(spark, f"lake-{layout}")
        rows = lake(spark, sf_dir).select(
            "Transaction ID", "Price", "Date of Transfer", "Postcode", "sale_year", "sale_month", "outcode2"
        )
        L.write_lake(rows, path, layout, compression=compression)
        # Partition values come back as numbers where they look like such.
        return D.open_parquet(spark, path).withColumns(
            {c: F.col(c).cast("int") for c in ("sale_year", "sale_month")}
        )

    return run


_LAYOUT = LAKE + """select "Transaction ID", "Price", "Date of Transfer", "Postcode", sale_year::bigint as sale_year,
    sale_month::bigint as sale_month, outcode2 from lake"""
for _layout, _codec in (
    ("outcode2_year_month", "zstd"),
    ("year_month_outcode2", "zstd"),
    ("outcode2_year", "snappy"),
    ("year_month", "gzip"),
    ("outcode2_only", "uncompressed"),
    ("none", "zstd"),
):
    register(f"lake_{_layout}", lake_layout(_layout, _codec), _LAYOUT)


def leaf_files(spark, sf_dir):
    """Number of files per partition folder after writing."""
    path = shared_folder(spark, "lake-leaves")
    L.write_lake(lake(spark, sf_dir).select("Transaction ID", "sale_year", "outcode2"), path, "outcode2_year")
    read = D.open_parquet(spark, path, file_name=True)
    return read.groupBy("outcode2", F.col("sale_year").cast("int").alias("sale_year")).agg(
        F.count_distinct("filename").alias("files"), F.count(F.lit(1)).alias("n")
    )


register(
    "lake_files_per_leaf",
    leaf_files,
    LAKE + "select outcode2, sale_year::bigint as sale_year, 1::bigint as files, count(*) as n from lake group by 1, 2",
)


def bounded_files(spark, sf_dir):
    """A lake whose tasks write files of their own, of bounded size: rows per folder and the largest file."""
    path = shared_folder(spark, "lake-bounded")
    rows = lake(spark, sf_dir).select("Transaction ID", "sale_year", "outcode2")
    L.write_lake(rows, path, "outcode2_only", rows_per_file=500, single_file_leaves=False)
    files = D.open_parquet(spark, path, file_name=True).groupBy("outcode2", "filename").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("outcode2").agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("bounded"))


register(
    "lake_bounded_files",
    bounded_files,
    LAKE + "select outcode2, count(*) as n, true as bounded from lake group by outcode2",
)


def single_file(spark, sf_dir):
    path = shared_folder(spark, "single")
    counts = lake(spark, sf_dir).groupBy("sale_year").agg(F.count(F.lit(1)).alias("n"))
    L.write_single_file(counts, path)
    return D.open_parquet(spark, path)


register("single_file", single_file, LAKE + "select sale_year, count(*) as n from lake group by 1")


def exported_addresses(spark, sf_dir):
    path = shared_folder(spark, "addresses")
    L.write_address_export(lake(spark, sf_dir), path)
    return D.open_parquet(spark, path)


register(
    "address_export",
    exported_addresses,
    LAKE
    + """select "Property Type" as property_type, "Postcode" as postcode, "PAON" as paon, "SAON" as saon,
    "Street" as street, "Locality" as locality, "Town/City" as town_city, "District" as district,
    "County" as county, sale_year::bigint as sale_year from lake""",
)
register(
    "distinct_sale_years",
    lambda s, d: lake(s, d).select("sale_year").distinct().orderBy("sale_year"),
    LAKE + "select distinct sale_year from lake",
)

# --- certificates ------------------------------------------------------------------

CERT_COLS = (
    "LMK_KEY", "POSTCODE", "ADDRESS1", "ADDRESS2", "ADDRESS3", "POSTTOWN", "PROPERTY_TYPE", "CURRENT_ENERGY_RATING",
    "TOTAL_FLOOR_AREA", "LODGEMENT_DATE", "INSPECTION_DATE", "postcode_norm", "lodgement_dt", "outcode", "outcode2",
    "lodgement_year", "addr_key",
)
register("enrich_certificates", certificates, CERTS + f"select {fields(CERT_COLS)} from certs")
register(
    "certificate_year_bounds",
    lambda s, d: K.year_bounds(certificates(s, d)),
    CERTS + "select year(min(lodgement_dt)) as first_year, year(max(lodgement_dt)) as last_year from certs",
)
register(
    "certificate_year_range",
    lambda s, d: K.year_range(certificates(s, d), 1997, 1999).select("LMK_KEY", "lodgement_dt"),
    CERTS
    + """select "LMK_KEY", lodgement_dt from certs where lodgement_dt >= date '1997-01-01'
    and lodgement_dt < date '2000-01-01'""",
)


def certificate_lake(part):
    def run(spark, sf_dir):
        path = shared_folder(spark, "certificates")
        L.write_certificates(raw_certificates(spark, sf_dir), path)
        if part == "certificates":
            read = D.open_dataset(spark, path, "epc_certs")
            return read.select(
                "LMK_KEY", "lodgement_dt", "addr_key", "outcode2", F.col("lodgement_year").cast("int")
            )
        return D.open_parquet(spark, f"{path}/link_keys").withColumn("lodgement_year", F.col("lodgement_year").cast("int"))

    return run


register(
    "certificate_lake",
    certificate_lake("certificates"),
    CERTS
    + """select "LMK_KEY", lodgement_dt, addr_key, outcode2, lodgement_year::bigint as lodgement_year from certs
    where lodgement_dt is not null""",
)
register(
    "certificate_link_keys",
    certificate_lake("link_keys"),
    CERTS
    + """select "LMK_KEY", postcode_norm, addr_key, outcode2, lodgement_year::bigint as lodgement_year from certs
    where lodgement_dt is not null""",
)

# --- dataset layer -----------------------------------------------------------------

WHERE = {
    "o_orderstatus__in": ["F", "O"],
    "o_totalprice__gte": 100_000,
    "o_totalprice__lt": 400_000,
    "o_orderpriority__like": "%-H%",
    "o_orderkey__ne": 42,
}
WHERE_SQL = """o_orderstatus in ('F', 'O') and o_totalprice >= 100000 and o_totalprice < 400000
    and o_orderpriority like '%-H%' and o_orderkey <> 42"""


def orders(spark, sf_dir):
    return D.open_parquet(spark, f"{sf_dir}/orders.parquet")


register(
    "dataset_select",
    lambda s, d: D.select(orders(s, d), ["o_orderkey", "o_totalprice", "o_orderstatus"], WHERE),
    f"select o_orderkey, round(o_totalprice, 6) as o_totalprice, o_orderstatus from orders where {WHERE_SQL}",
)
register(
    "dataset_order_and_limit",
    lambda s, d: D.select(orders(s, d), ["o_orderkey", "o_totalprice"], WHERE, [F.desc("o_totalprice"), "o_orderkey"], 25),
    f"""select o_orderkey, round(o_totalprice, 6) as o_totalprice from orders where {WHERE_SQL}
    order by orders.o_totalprice desc, o_orderkey limit 25""",
)
register(
    "dataset_head",
    # Any rows will do for a preview, so it is of one value, and the twin counts as many.
    lambda s, d: D.head(orders(s, d), 20, ["o_orderstatus"], {"o_orderstatus": "F"}),
    "select o_orderstatus from orders where o_orderstatus = 'F' limit 20",
)
register(
    "dataset_count",
    lambda s, d: D.count(orders(s, d), WHERE),
    f"select count(*) as n from orders where {WHERE_SQL}",
)
register(
    "dataset_distinct_values",
    lambda s, d: D.distinct_values(orders(s, d), ["o_orderstatus", "o_orderpriority"], {"o_totalprice__lte": 300_000}),
    "select distinct o_orderstatus, o_orderpriority from orders where o_totalprice <= 300000",
)
register(
    "dataset_value_counts",
    lambda s, d: D.value_counts(D.open_parquet(s, f"{d}/events.parquet"), "event_type", {"value__gt": 10}, 3),
    "select event_type as value, count(*) as n from events where value > 10 group by 1 order by 2 desc, 1 limit 3",
)
register(
    "dataset_value_counts_with_missing",
    lambda s, d: D.value_counts(
        table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
            F.col("quality").cast("string").alias("quality")
        ),
        "quality",
    ),
    """select quality::varchar as value, count(*) as n from documents left join labels using (doc_id)
    group by 1 order by 2 desc limit 50""",
)


def summary_of_partitions(spark, sf_dir):
    path = shared_folder(spark, "summary")
    rows = lake(spark, sf_dir).select("Transaction ID", "sale_year", "sale_month", "outcode2")
    L.write_lake(rows, path, "year_month_outcode2")
    return D.partition_summary(D.open_parquet(spark, path), n=6)


register(
    "partition_summary",
    summary_of_partitions,
    LAKE
    + " union all ".join(
        f"""(select '{c}' as "partition", v as value from (select distinct {e} as v from lake) order by v limit 6)"""
        for c, e in (
            ("outcode2", "outcode2"),
            ("sale_year", "sale_year"),
            ("sale_month", "(sale_month::int)::varchar"),
        )
    ),
)
register(
    "schema_listing",
    lambda s, d: D.schema_listing(s, orders(s, d)),
    """select column_name as name, case column_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string'
    when 'DOUBLE' then 'double' when 'DATE' then 'date' else 'timestamp_ntz' end as "type" from (describe orders)""",
)


def opened_by_glob(spark, sf_dir):
    """A lake opened by a pattern over its files, with the keys of the folders."""
    path = shared_folder(spark, "globbed")
    L.write_lake(lake(spark, sf_dir).select("Transaction ID", "sale_year", "outcode2"), path, "outcode2_year")
    return D.open_parquet(spark, f"{path}/outcode2=*/sale_year=*/*.parquet").select("Transaction ID", "outcode2")


register("dataset_by_glob", opened_by_glob, LAKE + """select "Transaction ID", outcode2 from lake""")


def partition_filter(spark, sf_dir):
    """Filter on partition keys of a written lake, so that other folders are not read."""
    path = shared_folder(spark, "pruned")
    L.write_lake(lake(spark, sf_dir).select("Transaction ID", "sale_year", "outcode2"), path, "outcode2_year")
    return D.select(D.open_parquet(spark, path), ["Transaction ID"], {"sale_year": 1998, "outcode2": "GL"})


register(
    "partition_filter",
    partition_filter,
    LAKE + """select "Transaction ID" from lake where sale_year = '1998' and outcode2 = 'GL'""",
)


def sql_over_view(spark, sf_dir):
    view = D.register_view(lake(spark, sf_dir), "sales lake")
    return D.run_sql(
        spark,
        f"""select outcode2, sale_year, count(*) as n from {view}
        where outcode2 in (:first, :second) and sale_year >= :year group by outcode2, sale_year""",
        {"first": "GL", "second": "SW", "year": "1998"},
    )


register(
    "sql_over_view",
    sql_over_view,
    LAKE
    + """select outcode2, sale_year, count(*) as n from lake where outcode2 in ('GL', 'SW') and sale_year >= '1998'
    group by 1, 2""",
)


def file_names(spark, sf_dir):
    df = D.open_parquet(spark, [f"{sf_dir}/nation.parquet"], hive_partitioning=False, file_name=True)
    return df.groupBy(F.element_at(F.split("filename", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


register("source_file_name", file_names, "select 'nation.parquet' as file, count(*) as n from nation")


def detected_format(spark, sf_dir):
    """Orders opened as what their path is found to hold."""
    path = f"{sf_dir}/orders.parquet"
    kind = D.detect_format(spark, path)
    df = D.open_parquet(spark, path) if kind == "parquet" else C.read_delimited(spark, path)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(kind).alias("format"))


register("detect_format", detected_format, "select count(*) as n, 'parquet' as format from orders")


def resolved(spark, sf_dir):
    df = orders(spark, sf_dir).withColumnRenamed("o_orderdate", "TRANSFER DATE")
    from gableframe.schema import DATE_NAMES

    name = V.resolve_column(df.columns, DATE_NAMES)
    return df.groupBy(F.year(F.col(f"`{name}`")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


register("resolve_column", resolved, "select year(o_orderdate) as year, count(*) as n from orders group by 1")
