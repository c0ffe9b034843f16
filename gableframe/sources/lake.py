"""Writers: partitioned Parquet with sized files, exports, CSV conversion."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gableframe.plans.certificates import enrich_certificates, link_keys, year_range
from gableframe.schema import LAYOUTS
from gableframe.sources.csv import TEXT_FILES, list_files, read_delimited

# The codecs on offer.
COMPRESSIONS = ("zstd", "snappy", "gzip", "uncompressed")
ROWS_PER_FILE = 5_000_000


def _codec(compression: str) -> str:
    if compression not in COMPRESSIONS:
        raise ValueError(f"unknown compression: {compression}")
    return compression


def one_file_per_leaf(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows shuffled once so that each partition folder is written by one task (K6).

    The planner sees the sizes when the rows have been dealt out: small folders share a task, and one
    that is far larger than others, such as the sentinel for unknown postcodes, is cut into several. Nothing is
    counted beforehand, the input is computed once.
    """
    return df.hint("rebalance", *[F.col(f"`{k}`") for k in keys])


def write_lake(
    df: DataFrame,
    path: str,
    layout: str = "year_month_outcode2",
    mode: str = "errorifexists",
    compression: str = "zstd",
    rows_per_file: int = ROWS_PER_FILE,
    single_file_leaves: bool = True,
) -> None:
    """Enriched sales as Parquet in one of the named layouts (K2-K6)."""
    write_partitioned(df, path, list(LAYOUTS[layout]), mode, compression, rows_per_file, single_file_leaves)


def write_partitioned(
    df: DataFrame,
    path: str,
    keys: list[str],
    mode: str = "errorifexists",
    compression: str = "zstd",
    rows_per_file: int = ROWS_PER_FILE,
    single_file_leaves: bool = True,
) -> None:
    """Parquet partitioned by the keys, or files of bounded size when there are none (K4)."""
    if not keys:
        # Tasks write their own files; joining them in one task would not scale.
        out = df.write.option("maxRecordsPerFile", rows_per_file)
    else:
        laid = one_file_per_leaf(df, keys) if single_file_leaves else df
        out = laid.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*keys)
    out.mode(mode).option("compression", _codec(compression)).parquet(path)


def write_single_file(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """One unpartitioned file (K4). For results: all rows pass one task."""
    df.coalesce(1).write.mode(mode).option("compression", _codec(compression)).parquet(path)


def write_certificates(
    raw: DataFrame,
    path: str,
    mode: str = "errorifexists",
    compression: str = "zstd",
    start_year: int | None = None,
    end_year: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Certificates by outcode2 and lodgement year in one pass (K7), then their key table (K8)."""
    spark = raw.sparkSession
    kept = year_range(enrich_certificates(raw), start_year, end_year)
    keys = ["outcode2", "lodgement_year"]
    write_partitioned(kept, f"{path}/certificates", keys, mode, compression, rows_per_file)
    written = spark.read.parquet(f"{path}/certificates")
    link_keys(written).write.mode(mode).option("compression", _codec(compression)).parquet(
        f"{path}/link_keys"
    )


def address_export(sales: DataFrame) -> DataFrame:
    """The nine address columns under short names (P19), with the sale year."""
    # Short name of each exported column.
    short = {
        "property_type": "Property Type",
        "postcode": "Postcode",
        "paon": "PAON",
        "saon": "SAON",
        "street": "Street",
        "locality": "Locality",
        "town_city": "Town/City",
        "district": "District",
        "county": "County",
    }
    return sales.select(*[F.col(f"`{c}`").alias(a) for a, c in short.items()], "sale_year")


def write_address_export(
    sales: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Address columns, one folder per sale year (K9)."""
    laid = one_file_per_leaf(address_export(sales), ["sale_year"])
    out = laid.write.option("maxRecordsPerFile", rows_per_file).partitionBy("sale_year")
    out.mode(mode).option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header."""
    df.write.mode(mode).csv(path, header=True)


def convert_csv_tree(
    spark: SparkSession,
    source: str,
    target: str,
    patterns: tuple[str, ...] = TEXT_FILES,
    compression: str = "zstd",
    all_text: bool = False,
    mode: str = "overwrite",
    at_once: int = 8,
) -> DataFrame:
    """Parquet per input file, in the folders of the input; a file that fails is reported and skipped (K1).

    Files have schemas of their own, so each is a job. Jobs run side by side and each splits
    its file over the executors. Returns (path, output, error).
    """
    paths = [r.path for r in list_files(spark, source, patterns).toLocalIterator()]
    inside = [p.rpartition(f"{PurePosixPath(source)}/")[2] for p in paths]
    stems = [name.rsplit(".", 1)[0] for name in inside]
    # Files that differ by their ending alone keep it.
    outputs = {
        p: f"{target}/{name if stems.count(stem) > 1 else stem}.parquet"
        for p, name, stem in zip(paths, inside, stems, strict=True)
    }

    def convert(path: str) -> tuple[str, str, str | None]:
        out = outputs[path]
        try:
            read_delimited(spark, path, all_text).write.mode(mode).option(
                "compression", _codec(compression)
            ).parquet(out)
        except (PySparkException, Py4JJavaError) as e:
            return path, out, str(e).splitlines()[0]
        return path, out, None

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(convert, paths))
    return spark.createDataFrame(results, "path string, output string, error string")
