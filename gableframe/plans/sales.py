"""Load-and-clean and lake enrichment of price-paid sales."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gableframe.functions import values as V
from gableframe.schema import CANONICAL, CODES, DATE_NAMES, POSTCODE_NAMES, STANDARDISED
from gableframe.sources.csv import coerce_schema


def add_date_parts(df: DataFrame, date: str = "Date of Transfer") -> DataFrame:
    """Adds the calendar columns that are not there yet (F2)."""
    parts = V.date_parts(F.col(f"`{date}`"))
    return df.withColumns({k: c for k, c in parts.items() if k not in df.columns})


def expand_codes(df: DataFrame) -> DataFrame:
    """Codes to display names in the coded columns that are present (F16)."""
    return df.withColumns(
        {c: V.expand_code(F.col(f"`{c}`"), names) for c, names in CODES.items() if c in df.columns}
    )


def standardise_strings(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: V.standardise(F.col(f"`{c}`")) for c in STANDARDISED if c in df.columns}
    )


def clean_sales(raw: DataFrame) -> DataFrame:
    """Canonical, cleaned sales with date parts, postcode parts and address id.

    One projection and one filter: nothing here shuffles, and columns a query does not use
    are pruned away together with their expressions.
    """
    df = expand_codes(standardise_strings(add_date_parts(coerce_schema(raw))))
    postcode = F.col("Postcode")
    return df.withColumns(
        {
            "Outward": V.outward(postcode),
            "Sector": V.sector(postcode),
            "Postcode Sector": V.postcode_sector(postcode),
            "ADDRESS_ID": V.address_id(
                F.col("PAON"), F.col("SAON"), F.col("Street"), F.col("Postcode")
            ),
        }
    ).dropna(subset=["Price", "Date of Transfer"])


def positional(df: DataFrame, force: bool = False) -> DataFrame:
    """Renames by position to the canonical names when sixteen columns are named otherwise."""
    foreign = {c.lower() for c in df.columns} != {c.lower() for c in CANONICAL}
    if force or (len(df.columns) == len(CANONICAL) and foreign):
        picked = [F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, CANONICAL, strict=False)]
        return df.select(*picked)
    return df


def enrich_sales(
    df: DataFrame,
    date_col: str | None = None,
    postcode_col: str | None = None,
    year_col: str | None = None,
    month_col: str | None = None,
    missing_outcode: str = "ZZ",
    force_positional: bool = False,
) -> DataFrame:
    """Adds the lake columns to raw sales and keeps rows with a date and a price.

    A price given as text becomes a number; text that is none counts as missing.
    The date comes from `date_col` or a column known to hold it, else from year and month
    columns (F4, F5); postcode likewise (S14).
    """
    df = positional(df, force_positional)
    if dict(df.dtypes).get("Price") == "string":
        df = df.withColumn("Price", V.to_number(F.col("Price")))
    date_name = date_col or V.resolve_column(df.columns, DATE_NAMES)
    postcode_name = postcode_col or V.resolve_column(df.columns, POSTCODE_NAMES)
    if date_name:
        when = V.sale_date(F.col(f"`{date_name}`"))
    else:
        y = V.resolve_column(df.columns, [year_col]) if year_col else None
        m = V.resolve_column(df.columns, [month_col]) if month_col else None
        if not (y and m):
            raise ValueError("no date column found: name one, or a year and a month column")
        when = V.month_start(F.col(f"`{y}`"), F.col(f"`{m}`"))
    postcode = (
        V.postcode_norm(F.col(f"`{postcode_name}`"))
        if postcode_name
        else F.lit(None).cast("string")
    )
    # Under its own name the source column is replaced.
    df = df.withColumns({date_name or "Date of Transfer": when, postcode_name or "Postcode": postcode})
    date, code = F.col(f"`{date_name or 'Date of Transfer'}`"), F.col(f"`{postcode_name or 'Postcode'}`")
    return df.withColumns(
        {
            "sale_year": F.date_format(date, "yyyy"),
            "sale_month": F.date_format(date, "MM"),
            "Outward": V.outward(code),
            "Sector": V.sector(code),
            "Postcode Sector": V.postcode_sector(code),
            "outcode2": V.outcode2(V.outward(code), missing_outcode),
        }
    ).where(date.isNotNull() & F.col("Price").isNotNull())
