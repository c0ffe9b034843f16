"""Readers for price-paid CSV, lookups and centroids."""

import csv
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gableframe.functions.values import to_moment, to_number, trimmed
from gableframe.schema import (
    CANONICAL,
    CANONICAL_OF,
    MIN_HEADER_HITS,
    declared_schema,
)
from gableframe.scratch import settle

# File names taken for delimited text.
TEXT_FILES = ("*.csv", "*.txt", "*.csv.gz", "*.txt.gz")

def normalise_headers(columns: Sequence[str]) -> list[str] | None:
    """Canonical names for a header line, or None when it is no header."""
    mapped = [CANONICAL_OF.get(c.strip().lower()) for c in columns]
    if sum(m is not None for m in mapped) < MIN_HEADER_HITS:
        return None
    return [m or c for m, c in zip(mapped, columns)]


def _canonical_place(cells: Sequence[str]) -> dict[str, int]:
    """Where a header line has each canonical column; the first of several counts."""
    place: dict[str, int] = {}
    for i, name in enumerate(normalise_headers(cells) or []):
        place.setdefault(name, i)
    return place


def _is_heading(cells: Column) -> Column:
    """Whether a line names enough of the known columns."""
    named = F.transform(cells, lambda c: F.lower(F.btrim(c, F.lit(' \t"'))))
    return F.size(F.array_intersect(named, F.array(*map(F.lit, CANONICAL_OF)))) >= MIN_HEADER_HITS


def _layouts(spark: SparkSession, path: str | list[str], delimiter: str) -> tuple[DataFrame, int]:
    """(file, places) of files with a header, and the largest number of columns that a line may have.

    places says where each canonical column stands, -1 where it does not. Only distinct header lines
    come to the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    cells = F.split("value", re.escape(delimiter))
    width, head = F.max(F.size(cells)).alias("width"), F.min(F.when(_is_heading(cells), F.col("value"))).alias("head")
    facts = settle(lines.groupBy("file").agg(width, head), "headers")
    known = []
    for row in facts.where("head is not null").select("head").distinct().toLocalIterator():
        place = _canonical_place(next(csv.reader([row["head"]], delimiter=delimiter)))
        known.append((row["head"], [place.get(name, -1) for name in CANONICAL]))
    placed = spark.createDataFrame(known, "head string, places array<int>")
    widest = facts.agg(F.max("width")).first()[0] or 0
    return settle(facts.join(placed, "head").select("file", "places"), "layouts"), max(widest, len(CANONICAL))


def read_sales_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """Price-paid CSV as the sixteen columns, price and date parsed.

    Each file has a header of its own, in any order and spelling and among any number of columns, or
    none. Lines that are headers by what they hold are taken out wherever they stand; the rows of a
    file with one are matched by name, those of others by position, short lines padded with nulls
    and long ones cut. Rows get their places from a join with the layouts of the files, so that the
    plan is the same for one header and for hundreds.
    """
    layouts, width = _layouts(spark, path, delimiter)
    names = [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.schema(schema).csv(path, header=False, sep=delimiter, quote='"')
    raw = read.select(F.array(*names).alias("cells"), F.col("_metadata.file_path").alias("file"))
    rows = raw.where(~_is_heading(F.col("cells"))).join(layouts, "file", "left")
    out = [F.get("cells", F.coalesce(F.get("places", F.lit(i)), F.lit(i))).alias(name) for i, name in enumerate(CANONICAL)]
    return coerce_schema(rows.select(*out))


def read_declared_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """Headerless price-paid file with declared types."""
    return spark.read.schema(declared_schema()).csv(path, header=False, sep=delimiter, quote='"')


def coerce_schema(df: DataFrame) -> DataFrame:
    """The sixteen columns in order, missing ones null, price and date parsed."""
    present: dict[str, str] = {}
    for c in df.columns:
        present.setdefault(CANONICAL_OF.get(c.strip().lower(), c), c)
    out = []
    for name in CANONICAL:
        c = F.col(f"`{present[name]}`") if name in present else F.lit(None).cast("string")
        if name == "Price":
            c = to_number(c)
        elif name == "Date of Transfer":
            c = to_moment(c)
        out.append(c.alias(name))
    return df.select(*out)


def read_delimited(
    spark: SparkSession, path: str | list[str], all_text: bool = False, delimiter: str = ","
) -> DataFrame:
    """Delimited text with types inferred over whole files, or all as text (S6); .gz is native."""
    return spark.read.csv(
        path, header=True, inferSchema=not all_text, sep=delimiter, quote='"', enforceSchema=False
    )


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, missing ones null."""
    frames = list(frames)
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def list_files(
    spark: SparkSession, path: str, patterns: Sequence[str] = TEXT_FILES
) -> DataFrame:
    """Files under a folder that match any pattern, sorted and distinct.

    Works on every file system Spark reads; only names are listed, no content is read.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}")
        .load(path)
        .select("path")
        .distinct()
        .orderBy("path")
    )


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Postcode-sector centroids."""
    schema = T.StructType(
        [
            T.StructField("Postcode Sector", T.StringType()),
            T.StructField("lat", T.DoubleType()),
            T.StructField("lon", T.DoubleType()),
        ]
    )
    named = spark.read.csv(path, header=True, inferSchema=False)
    return named.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_lookup(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named lookup columns, trimmed, rows with a missing part dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return clean.dropna(subset=list(columns)).select(
        *[trimmed(F.col(f"`{c}`")).alias(c) for c in columns]
    )
