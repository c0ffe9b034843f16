"""Where queries and their twins are collected."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gableframe.plans.sales import clean_sales, enrich_sales
from gableframe.plans.certificates import enrich_certificates
from workload.views import raw_certificates, raw_sales

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}

ROUNDED = 6


def tidy(df: DataFrame) -> DataFrame:
    """Result types both engines share: bigint, rounded double, date."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), ROUNDED)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, query: Query, twin: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"registered twice: {name}")
    QUERIES[name] = lambda spark, sf_dir: tidy(query(spark, sf_dir))
    if twin is not None:
        TWINS[name] = twin


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_sales(raw_sales(spark, sf_dir))


def lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sales(raw_sales(spark, sf_dir))


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_certificates(raw_certificates(spark, sf_dir))


def on_sales(name: str, step: Callable[[DataFrame], DataFrame], twin: str | None = None) -> None:
    """Registers a query over cleaned sales."""
    from workload.twins import SALES

    register(name, lambda s, d: step(sales(s, d)), None if twin is None else SALES + twin)
