"""Energy-certificate enrichment, layout and key table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gableframe.functions import values as V
from gableframe.schema import CERTIFICATE_ADDRESS_NAMES, CERTIFICATE_POSTCODE_NAMES


def enrich_certificates(df: DataFrame) -> DataFrame:
    """All source columns with normalised postcode, lodgement date and address key.

    The parsed date is called lodgement_dt: its source differs from lodgement_date only in
    letter case, which Spark does not tell apart.
    """
    postcode_name = V.resolve_column(df.columns, CERTIFICATE_POSTCODE_NAMES)
    names = (V.resolve_column(df.columns, [n]) for n in CERTIFICATE_ADDRESS_NAMES)
    present = [n for n in names if n]
    postcode = V.postcode_norm(F.col(postcode_name)) if postcode_name else F.lit(None).cast("string")
    # A missing line counts as an empty one.
    key = (
        V.address_key([F.coalesce(F.col(n).cast("string"), F.lit("")) for n in present])
        if present
        else F.lit(None).cast("string")
    )
    norm = F.col("postcode_norm")
    return (
        df.withColumns(
            {
                "postcode_norm": postcode,
                "lodgement_dt": V.certificate_date(
                    F.col("LODGEMENT_DATE"), F.col("INSPECTION_DATE")
                ),
            }
        )
        .withColumns(
            {
                "outcode": V.certificate_outcode(norm),
                "outcode2": V.certificate_outcode2(norm),
                "lodgement_year": F.date_format("lodgement_dt", "yyyy"),
                "addr_key": key,
            }
        )
    )


def year_bounds(df: DataFrame, date: str = "lodgement_dt") -> DataFrame:
    """First and last year of a date column (A31); fails when it holds no date at all."""
    span = df.agg(F.year(F.min(date)).alias("first_year"), F.year(F.max(date)).alias("last_year"))
    empty = F.raise_error(F.lit("no date could be read")).cast("int")
    return span.select(
        F.when(F.col("first_year").isNull(), empty).otherwise(F.col("first_year")).alias("first_year"),
        F.col("last_year"),
    )


def year_range(
    df: DataFrame,
    start_year: int | None = None,
    end_year: int | None = None,
    date: str = "lodgement_dt",
) -> DataFrame:
    """Rows dated from the start year to the end year inclusive, as half-open dates.

    Rows without a date are left out, as in the year-wise layout.
    """
    out = df.where(F.col(date).isNotNull())
    if start_year is not None:
        out = out.where(F.col(date) >= F.lit(f"{start_year}-01-01").cast("date"))
    if end_year is not None:
        out = out.where(F.col(date) < F.lit(f"{end_year + 1}-01-01").cast("date"))
    return out


def link_keys(certificates: DataFrame) -> DataFrame:
    """The columns needed to link certificates (K8)."""
    wanted = ["postcode_norm", "addr_key", "outcode2", "lodgement_year"]
    lmk = V.resolve_column(certificates.columns, ["LMK_KEY"])
    return certificates.select(*([lmk] if lmk else []), *wanted)
