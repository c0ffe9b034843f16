"""Dates, numbers, codes and postcodes as columns."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def literal_map(pairs: Mapping[str, str]) -> Column:
    """A constant lookup; Catalyst folds it into one literal."""
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


# --- numbers and dates -------------------------------------------------------------


def to_number(c: Column) -> Column:
    """Number or null (F3). A type letter after the digits, as in 100d, makes it no number."""
    text = trimmed(c.cast("string"))
    return F.when(~text.rlike(r"[\d.][dDfF]$"), text.try_cast("double"))


# Shapes of moments. A text of another shape, such as a time without a day, is none.
ISO_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?)?$"
CLOCK = r"( \d{1,2}:\d{1,2}(:\d{1,2})?)?"
# Times are optional parts of a pattern: a pattern for each makes the planner's code long wherever a date is used,
# and the virtual machine does not compile methods that are too long.
OTHER_MOMENTS = [
    ("d/M/yyyy[ H:m[:s]]", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{CLOCK}$"),
    ("yyyy/M/d[ H:m[:s]]", rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{CLOCK}$"),
]


def to_moment(c: Column) -> Column:
    """Timestamp or null (F1): an ISO day or a slashed one, day or year first, with or without a time."""
    text = trimmed(c.cast("string"))
    found = F.when(text.rlike(ISO_MOMENT), text.try_cast("timestamp"))
    for pattern, shape in OTHER_MOMENTS:
        found = found.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
    return found


def date_parts(c: Column) -> dict[str, Column]:
    """Calendar parts of a date (F2); the month name is the full English one."""
    return {
        "Year": F.year(c),
        "Month": F.month(c),
        "Quarter": F.quarter(c),
        "Month Name": F.date_format(c, "MMMM"),
        "Day": F.day(c),
    }


# Shapes of accepted dates. A text of no accepted shape is not parsed, as a failing
# parse costs far more than a test. The time of an ISO moment only has to be one.
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}\z"
ISO_DAY_OR_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}(?: (?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d)?)?\z"
DAY_FIRST = r"^\d{1,2}/\d{1,2}/\d{4}$"


def iso_date(c: Column, shape: str = ISO_DAY_OR_MOMENT) -> Column:
    """Date of a text of an ISO shape, null when it is none; a cast, as a formatter costs several times as much."""
    return F.when(c.rlike(shape), c.try_cast("date"))


def sale_date(c: Column) -> Column:
    """ISO or day-first date taken from the text before the first space."""
    head = F.split_part(c.cast("string"), F.lit(" "), F.lit(1))
    slashed = F.when(head.rlike(DAY_FIRST), F.try_to_timestamp(head, F.lit("d/M/yyyy")).cast("date"))
    return F.coalesce(iso_date(head, ISO_DAY), slashed)


def month_start(year: Column, month: Column) -> Column:
    """First day of a year and month given as text or number (F5); null if not a month."""
    y, m = year.cast("string").try_cast("int"), month.cast("string").try_cast("int")
    return F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))


def certificate_date(lodged: Column, inspected: Column) -> Column:
    """Lodgement date in any of three formats, else the inspection date."""
    return F.coalesce(iso_date(lodged.cast("string")), iso_date(inspected.cast("string")))


def months_between_sales(start: Column, end: Column) -> Column:
    """Days over the mean month of 30.44 days."""
    return F.datediff(end, start) / F.lit(30.44)


def percent_change(now: Column, before: Column) -> Column:
    """Change in per cent, null when the base is zero."""
    return (F.try_divide(now, before) - F.lit(1.0)) * F.lit(100.0)


# --- strings and codes -------------------------------------------------------------


def standardise(c: Column) -> Column:
    """Trimmed upper-case text, the word NAN being a missing value."""
    return F.nullif(F.upper(trimmed(c)), F.lit("NAN"))


def address_id(*parts: Column) -> Column:
    """Parts joined by a bar with blanks collapsed, missing parts empty."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def expand_code(c: Column, names: Mapping[str, str]) -> Column:
    """Code to display name, unknown codes kept (F16)."""
    return F.coalesce(F.try_element_at(literal_map(names), F.upper(c)), c)


# --- postcodes ---------------------------------------------------------------------

# A complete postcode is split from its end; other text falls back to the prefix that looks
# like an outward code. Each is one pattern, so that the column is read once.
OUTWARD = r"^(?:[A-Z]{1,2}[0-9][0-9A-Z]?(?= ?[0-9][A-Z]{2}$)|[A-Z]{1,2}\d{1,2}[A-Z]?)"
SECTOR = r"^(?:[A-Z]{1,2}[0-9][0-9A-Z]? ?(?=[0-9][A-Z]{2}$)|[A-Z]{1,2}\d{1,2}[A-Z]?\s*)(\d)"


def postcode_norm(c: Column) -> Column:
    """Upper case without spaces."""
    return F.replace(F.upper(c.cast("string")), F.lit(" "), F.lit(""))


def outward(c: Column) -> Column:
    """Outward code, null when the text does not start like one."""
    return F.regexp_substr(c, F.lit(OUTWARD))


def sector(c: Column) -> Column:
    """Sector digit."""
    return blank_to_null(F.regexp_extract(c, SECTOR, 1))


def postcode_sector(c: Column) -> Column:
    """Outward code and sector digit, empty when neither is known."""
    return F.trim(F.concat_ws(" ", outward(c), sector(c)))


def outcode2(c: Column, missing: str = "ZZ") -> Column:
    """First two letters of an outward code, with a sentinel."""
    return F.coalesce(F.when(F.length(c) >= 2, F.substring(c, 1, 2)), F.lit(missing))


def certificate_outcode(norm: Column) -> Column:
    """All but the last three characters of a normalised postcode."""
    return F.when(F.length(norm) >= 4, F.substring(norm, F.lit(1), F.length(norm) - 3))


def certificate_outcode2(norm: Column) -> Column:
    return F.when(F.length(norm) >= 2, F.substring(norm, 1, 2))


def address_key(parts: Sequence[Column]) -> Column:
    """Letters and digits of the joined parts, upper-cased first."""
    joined = F.concat_ws(" ", *[p.cast("string") for p in parts])
    return F.regexp_replace(F.upper(joined), "[^A-Z0-9]+", "")


def first_of(*columns: Column) -> Column:
    """First known value: stored key before derived (F25), inspection before lodgement."""
    return F.coalesce(*columns)


def resolve_column(actual: Sequence[str], wanted: Sequence[str]) -> str | None:
    """First wanted name present in any letter case."""
    by_lower = {name.lower(): name for name in actual}
    return next((by_lower[w.lower()] for w in wanted if w.lower() in by_lower), None)
