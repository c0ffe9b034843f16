"""Address shapes: validity of parts, postcode split, sampling strata."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gableframe.functions.address import words
from gableframe.functions.values import blank_to_null, trimmed

# Accepted shapes of house names and numbers, flats and postcodes.
NUMBER_ONLY = r"^\s*(\d+[A-Za-z]?(?:\s*-\s*\d+[A-Za-z]?)?)\s*$"
NAME_NUMBER = r"^([A-Za-z][A-Za-z\s'&\.-]*?)\s*(?:,?\s*)(\d+[A-Za-z]?)\s*$"
NAME_ONLY = r"^\s*([A-Za-z][A-Za-z\s'&\.-]*)\s*$"
FLAT_SHAPE = (
    r"(?i)^\s*(flat|apartment|apt|appts|room|unit|annexe?|block|blk|studio)\s+[0-9]+[A-Za-z]?\s*$"
)
FLAT_NUMBER_SHAPE = r"^\s*\d+[A-Za-z]?\s*$"
FLAT_NAME_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9\s'&\.-]*$"
UK_POSTCODE = (
    r"(?i)^\s*((?:GIR\s?0AA)|(?:[A-PR-UWYZ][0-9][0-9A-HJKMNPR-Y]?)"
    r"|(?:[A-PR-UWYZ][A-HK-Y][0-9][0-9A-HJKMNPR-Y]?))\s*([0-9][ABD-HJLNP-UW-Z]{2})\s*$"
)
FLAT_START = (
    r"(?i)^\s*(APARTMENT|ANNEXE|STUDIO|APPTS|ANNEX|BLOCK|FLAT|ROOM|UNIT|APT|BLK)\b"
)
ALNUM = r"^(?:\d+[A-Za-z]|[A-Za-z]\d+)\w*$"


def paon_flags(paon: Column) -> dict[str, Column]:
    """Shape of a house name or number."""
    return {
        "paon_is_num_only": paon.rlike(NUMBER_ONLY),
        "paon_is_name_num": paon.rlike(NAME_NUMBER),
        "paon_is_name_only": paon.rlike(NAME_ONLY),
    }


def saon_flags(saon: Column) -> dict[str, Column]:
    """Shape of a flat name or number."""
    return {
        "saon_is_flat_pat": saon.rlike(FLAT_SHAPE),
        "saon_is_num_only": saon.rlike(FLAT_NUMBER_SHAPE),
        "saon_is_name_like": saon.rlike(FLAT_NAME_SHAPE),
    }


def part(c: Column, pattern: str, group: int) -> Column:
    """Capture group, null when the text does not match."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def paon_building_name(paon: Column) -> Column:
    """Name part of a house name or number."""
    return F.coalesce(part(paon, NAME_NUMBER, 1), part(paon, NAME_ONLY, 1))


def paon_building_number(paon: Column) -> Column:
    """Number part of a house name or number."""
    return F.coalesce(part(paon, NAME_NUMBER, 2), part(paon, NUMBER_ONLY, 1))


def outcode(postcode: Column) -> Column:
    """Outward half of a valid postcode."""
    return part(postcode, UK_POSTCODE, 1)


def incode(postcode: Column) -> Column:
    """Inward half of a valid postcode."""
    return part(postcode, UK_POSTCODE, 2)


def to_text(c: Column, upper: bool = False) -> Column:
    """Text of any scalar: missing is empty, 12.0 is 12."""
    text = F.regexp_replace(trimmed(F.coalesce(c.cast("string"), F.lit(""))), r"^(\d+)\.0$", "$1")
    return F.upper(text) if upper else text


def scalar_words(c: Column) -> Column:
    """Words of a scalar."""
    return words(to_text(c))


def postcode_tokens(postcode: Column, out: Column, inc: Column) -> Column:
    """Both halves of a postcode when known, else its two words, else the whole."""
    o, i, whole = to_text(out, True), to_text(inc, True), to_text(postcode, True)
    pieces = words(whole)
    none = F.array().cast("array<string>")
    return (
        F.when((o != "") & (i != ""), F.array(o, i))
        .when(whole == "", none)
        .when(F.size(pieces) == 2, pieces)
        .otherwise(F.array(whole))
    )


def paon_pattern(name: Column, number: Column) -> Column:
    """Which of building name and number are there."""
    has_name, has_number = to_text(name) != "", to_text(number) != ""
    return (
        F.when(has_name & has_number, "name+number")
        .when(has_number, "number")
        .when(has_name, "name")
        .otherwise("none")
    )


def saon_pattern(saon: Column) -> Column:
    """Kind of sub-building text."""
    s = to_text(saon)
    return (
        F.when(s == "", "none")
        .when(s.rlike(FLAT_START), "flat")
        .when(s.rlike(r"^\d+$"), "num")
        .when(s.rlike(ALNUM), "alnum")
        .otherwise("name")
    )


def stratum(name: Column, number: Column, saon: Column, kind: Column | None = None) -> Column:
    """Sampling stratum of an address."""
    parts = [paon_pattern(name, number), saon_pattern(saon)]
    if kind is not None:
        text = F.upper(trimmed(F.coalesce(kind, F.lit(""))))
        parts.append(F.when(text == "", "NA").otherwise(text))
    return F.concat_ws("|", *parts)
