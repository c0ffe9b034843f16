"""Access to Hive-partitioned Parquet: scan, filter, count, summarise."""

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gableframe.schema import KNOWN_PARTITIONS

# Where each named dataset lies under its root.
DATASET_FOLDERS = {"epc_certs": "certificates", "epc_recs": "recommendations", "ppd": ""}


def _before_keys(path: str) -> str:
    """The part of a path before the first wildcard or key=value, below which partitions lie."""
    return re.split(r"/[^/]*[*?\[{=]", path, maxsplit=1)[0]


def open_parquet(
    spark: SparkSession,
    paths: str | Sequence[str],
    hive_partitioning: bool = True,
    file_name: bool = False,
    merge_schema: bool = False,
) -> DataFrame:
    """One scan over folders, globs or files (S8, U1); missing input raises.

    Partition columns are exposed unless switched off (S9), also those that a glob or a path to
    one partition names; `file_name` adds the source file of each row (S10).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no path given")
    reader = spark.read.option("mergeSchema", merge_schema)
    roots = {_before_keys(p) for p in paths}
    if hive_partitioning and len(roots) == 1 and roots != set(paths):
        reader = reader.option("basePath", roots.pop())
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    df = reader.parquet(*paths)
    return df.withColumn("filename", F.col("_metadata.file_path")) if file_name else df


def open_dataset(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Named dataset under its root: certificates, recommendations or sales."""
    if kind not in DATASET_FOLDERS:
        raise ValueError(f"unknown dataset: {kind}")
    folder = DATASET_FOLDERS[kind]
    return open_parquet(spark, f"{root}/{folder}" if folder else root)


def register_view(df: DataFrame, name: str) -> str:
    """Registers the dataset for SQL and returns the view name."""
    view = "v_" + "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in name)
    df.createOrReplaceTempView(view)
    return view


def run_sql(spark: SparkSession, query: str, args: Any = None) -> DataFrame:
    """SQL over registered views with bound parameters."""
    return spark.sql(query, args=args) if args else spark.sql(query)


def detect_format(spark: SparkSession, path: str, choice: str = "auto") -> str:
    """csv or parquet, by file name or by what a folder holds."""
    if choice != "auto":
        return choice
    if path.lower().endswith(".parquet"):
        names = [path]
    else:
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(path)
        )
        names = found.select("path").take(1)
    return "parquet" if names else "csv"


# --- predicates --------------------------------------------------------------------


def _in(c: Column, values: Any) -> Column:
    if not isinstance(values, (list, tuple, set, frozenset)):
        raise ValueError("in expects an iterable")
    return c.isin(list(values))


def _eq(c: Column, value: Any) -> Column:
    return c.isNull() if value is None else c == value


def _ne(c: Column, value: Any) -> Column:
    return c.isNotNull() if value is None else c != value


COMPARISONS = {
    "eq": _eq,
    "ne": _ne,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "in": _in,
}


def where_column(where: Mapping[str, Any] | None, columns: Iterable[str]) -> Column | None:
    """Conjunction of `column` or `column__op` entries.

    A key that is itself a column is never split, so that names may hold double underscores.
    """
    names = set(columns)
    tests = []
    for key, value in (where or {}).items():
        name, _, op = (key, "", "eq") if key in names else key.rpartition("__")
        if not name:
            name, op = key, "eq"
        if op not in COMPARISONS:
            raise ValueError(f"unsupported operator: {op}")
        tests.append(COMPARISONS[op](F.col(f"`{name}`"), value))
    return reduce(and_, tests) if tests else None


def _filtered(df: DataFrame, where: Mapping[str, Any] | None) -> DataFrame:
    test = where_column(where, df.columns)
    return df if test is None else df.where(test)


def select(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: Mapping[str, Any] | None = None,
    order_by: Sequence[str | Column] | str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Projection, filter, order and limit (P1, T9); all reach the Parquet scan."""
    out = _filtered(df, where)
    if order_by is not None:
        out = out.orderBy(*([order_by] if isinstance(order_by, (str, Column)) else order_by))
    if columns:
        out = out.select(*[F.col(f"`{c}`") for c in columns])
    return out.limit(limit) if limit and limit > 0 else out


def head(
    df: DataFrame,
    n: int = 5,
    columns: Sequence[str] | None = None,
    where: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Preview (P3)."""
    return select(df, columns, where, limit=n)


def count(df: DataFrame, where: Mapping[str, Any] | None = None) -> DataFrame:
    """Number of matching rows in one row `n`."""
    return _filtered(df, where).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(
    df: DataFrame,
    columns: Sequence[str],
    where: Mapping[str, Any] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Distinct combinations (A21), with a limit the first in order of the columns."""
    if not columns:
        raise ValueError("columns must not be empty")
    out = _filtered(df, where).select(*[F.col(f"`{c}`") for c in columns]).distinct()
    return out.orderBy(*out.columns).limit(limit) if limit else out


def value_counts(
    df: DataFrame, column: str, where: Mapping[str, Any] | None = None, limit: int = 50
) -> DataFrame:
    """Most frequent values with their counts, the missing value included."""
    return (
        _filtered(df, where)
        .groupBy(F.col(f"`{column}`").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(limit)
    )


def partition_summary(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = 50
) -> DataFrame:
    """First `n` values of each known partition column as (partition, value).

    One pass finds the combinations that occur, which are no more than there are folders.
    """
    columns = columns or [c for c in KNOWN_PARTITIONS if c in df.columns]
    if not columns:
        raise ValueError("no partition column known")
    pairs = F.array(*[F.struct(F.lit(c).alias("partition"), F.col(c).cast("string").alias("value")) for c in columns])
    found = df.select(*columns).distinct().select(F.inline(pairs)).distinct()
    turn = F.row_number().over(Window.partitionBy("partition").orderBy("value"))
    return found.withColumn("__turn", turn).where(F.col("__turn") <= n).drop("__turn")


def schema_listing(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column names and types, from metadata alone."""
    return spark.createDataFrame(df.dtypes, "name string, type string")
