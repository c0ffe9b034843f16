"""Address cohort and place lists."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions import cohort as C
from gableframe.functions.address import up


def address_cohort(addresses: DataFrame) -> DataFrame:
    """Addresses whose parts have accepted shapes, split into building parts.

    Takes the nine columns of the address export. A flat must have a flat name or number of
    an accepted shape, any other property none (P14).
    """
    df = addresses.select(
        *[
            F.trim(F.col(c)).alias(c)
            for c in ("property_type", "paon", "saon", "street", "locality", "town_city")
        ],
        F.upper(F.trim("postcode")).alias("postcode"),
    )
    paon, saon, postcode = F.col("paon"), F.col("saon"), F.col("postcode")
    kind = F.col("property_type")

    def any_of(flags: dict[str, Column]) -> Column:
        first, *rest = flags.values()
        for f in rest:
            first = first | f
        return first

    saon_ok = any_of(C.saon_flags(saon))
    out, inc = C.outcode(postcode), C.incode(postcode)
    return df.where(
        any_of(C.paon_flags(paon))
        & postcode.rlike(C.UK_POSTCODE)
        & (
            ((kind == "F") & saon_ok)
            | ((kind != "F") & (saon.isNull() | (saon == "")))
        )
    ).select(
        "property_type",
        C.paon_building_name(paon).alias("BuildingName"),
        C.paon_building_number(paon).alias("BuildingNumber"),
        F.when(saon_ok, saon).alias("SubBuildingName"),
        F.col("street").alias("StreetName"),
        F.col("locality").alias("Locality"),
        F.col("town_city").alias("TownName"),
        F.concat(out, F.lit(" "), inc).alias("Postcode"),
        out.alias("Outcode"),
        inc.alias("Incode"),
    )


def named_and_numbered(cohort: DataFrame) -> DataFrame:
    """Cohort rows with both a building name and number."""
    return cohort.where(F.col("BuildingName").isNotNull() & F.col("BuildingNumber").isNotNull())


def has_signal(*columns: Column) -> Column:
    """Whether any of the columns holds text."""
    tests = [F.coalesce(F.trim(c) != "", F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def place_names(df: DataFrame, column: str) -> DataFrame:
    """Distinct normalised names of a place column, sorted."""
    text = F.col(f"`{column}`")
    return (
        df.where(text.isNotNull() & (F.trim(text) != ""))
        .select(up(text).alias(column))
        .distinct()
        .orderBy(column)
    )


def address_patterns(
    df: DataFrame, needle: str | None = None, column: str = "paon", limit: int | None = None
) -> DataFrame:
    """Distinct type, house and flat text of non-flats, optionally with a word in a column."""
    c = F.col(column)
    found = df.where(c.isNotNull() & (F.col("property_type") != "F"))
    if needle:
        found = found.where((F.trim(c) != "") & F.lower(c).contains(needle.lower()))
    out = found.select("property_type", "paon", "saon").distinct()
    return out.limit(limit) if limit else out


def without_copies(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed."""
    return df.dropDuplicates()
