"""Address strings for linkage (F32-F43), all as columns."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gableframe.functions.values import blank_to_null, literal_map

# Street abbreviations, without the dotted spellings that punctuation
# removal leaves nothing of.
STREET_WORDS = {
    "ST": "STREET",
    "RD": "ROAD",
    "AVE": "AVENUE",
    "AV": "AVENUE",
    "CRES": "CRESCENT",
    "CR": "CRESCENT",
    "LN": "LANE",
    "PL": "PLACE",
    "CT": "COURT",
    "DR": "DRIVE",
    "GDNS": "GARDENS",
    "GR": "GROVE",
}
# Words that mark a building name.
HOUSE_WORDS = (
    "HOUSE",
    "LODGE",
    "COTTAGE",
    "HALL",
    "COURT",
    "MANSION",
    "MANSIONS",
    "APARTMENTS",
    "APARTMENT",
    "FLATS",
    "BLOCK",
    "TOWER",
    "BUILDING",
)
# Words that mark the street line of a certificate address.
ROAD_LINE = (
    r"\b(ROAD|ST|STREET|RD|DRIVE|AV|AVE|AVENUE|LANE|CRES|CRESCENT|COURT|GARDENS|PLACE|GROVE)\b"
)
FLAT_NUMBER = r"\b(?:FLAT|APT|APARTMENT)\s*(\d{1,4})\b"
FIRST_INT = r"\b(\d{1,5})\b"
ABBREVIATED = f"(?<![^ ])(?:{'|'.join(STREET_WORDS)})(?![^ ])"
# A number standing alone among words with single blanks, with the blank behind it.
NUMBER_WORD = r"(?<![^ ])\d+(?: |\z)"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def up(c: Column) -> Column:
    """Upper case, trimmed, blanks collapsed (F33); also place names (F32)."""
    return collapse(F.upper(c))


def de_punct(c: Column) -> Column:
    """Everything but letters, digits and slashes to single blanks."""
    return F.trim(F.regexp_replace(c, r"(?U)[^\w/]+", " "))


def normal(c: Column) -> Column:
    """Upper case without punctuation."""
    return de_punct(F.upper(c))


def words(c: Column) -> Column:
    """Blank-separated words; no words for empty or missing text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def join_words(tokens: Column) -> Column:
    """Words joined by blanks, null when there are none."""
    return blank_to_null(F.array_join(tokens, " "))


def expand_street(c: Column) -> Column:
    """Normalised text with the abbreviated words of streets written out, null when there are no words."""
    full = literal_map(STREET_WORDS)
    expanded = F.transform(words(c), lambda w: F.coalesce(F.try_element_at(full, w), w))
    return F.when(c.rlike(ABBREVIATED), join_words(expanded)).otherwise(blank_to_null(c))


def norm_street(c: Column) -> Column:
    """Street with its abbreviated words written out."""
    return expand_street(F.upper(de_punct(c)))


def first_int(c: Column) -> Column:
    """First number of one to five digits standing alone."""
    return blank_to_null(F.regexp_extract(c, FIRST_INT, 1)).try_cast("int")


def flat_number(c: Column) -> Column:
    """Number after a flat word; the first part of a fraction."""
    return blank_to_null(F.regexp_extract(c, FLAT_NUMBER, 1)).try_cast("int")


def without_numbers(c: Column) -> Column:
    """The words of normalised text that are not numbers, null when there are none."""
    return blank_to_null(F.rtrim(F.regexp_replace(c, NUMBER_WORD, "")))


def has_house_word(tokens: Column) -> Column:
    """Whether any word marks a building."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in HOUSE_WORDS]))


def number_name(c: Column) -> Column:
    """Number first, then the name: THE POND HOUSE, 19 becomes 19 THE POND HOUSE."""
    text = F.upper(de_punct(c))
    return blank_to_null(F.concat_ws(" ", first_int(text).cast("string"), without_numbers(text)))


def name_only(c: Column) -> Column:
    """A number-first name without its number."""
    return blank_to_null(F.regexp_replace(c, r"^\d+(\s+|$)", ""))


def building_name(*parts: Column) -> Column:
    """All words of the parts that are not numbers."""
    return without_numbers(F.upper(de_punct(join_known(*parts))))


def join_known(*parts: Column) -> Column:
    """Parts that are there, joined by blanks."""
    return blank_to_null(F.trim(F.concat_ws(" ", *[blank_to_null(p) for p in parts])))


def join_strict(*parts: Column) -> Column:
    """Parts joined by blanks, null when any is missing."""
    pieces: list[Column] = []
    for p in parts:
        pieces += [F.lit(" "), p] if pieces else [p]
    return F.concat(*pieces)


def street_line(lines: Sequence[Column]) -> Column:
    """Last line with a road word, else the longest, the first one on a tie."""
    marked = [F.when(c.rlike(ROAD_LINE), c) for c in reversed(lines)]
    sized = F.array(
        *[
            F.struct(
                F.length(F.coalesce(c, F.lit(""))).alias("size"),
                F.lit(-i).alias("rank"),
                c.alias("line"),
            )
            for i, c in enumerate(lines)
        ]
    )
    return F.coalesce(*marked, F.array_max(sized)["line"])
