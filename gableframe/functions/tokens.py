"""Address tokens: county removal, tokenising and token features."""

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions.address import words
from gableframe.functions.values import literal_map

# Word sets that token features and county removal look at.
DIRECTIONS = (
    "N", "S", "E", "W", "NE", "NW", "SE", "SW", "NORTH", "SOUTH", "EAST", "WEST",
    "NORTHEAST", "NORTHWEST", "SOUTHEAST", "SOUTHWEST",
)
FLAT = (
    "FLAT", "FLT", "APARTMENT", "APPTS", "APPT", "APTS", "APT", "ROOM", "ANNEX", "ANNEXE",
    "UNIT", "BLOCK", "BLK",
)
COMPANY = (
    "CIC", "CIO", "LLP", "LP", "LTD", "LIMITED", "CYF", "PLC", "CCC", "UNLTD", "ULTD",
)
ROAD = (
    "ROAD", "RAOD", "RD", "DRIVE", "DR", "STREET", "STRT", "AVENUE", "AVENEU", "SQUARE", "LANE",
    "LNE", "LN", "COURT", "CRT", "CT", "PARK", "PK", "GRDN", "GARDEN", "CRESCENT", "CLOSE", "CL",
    "WALK", "WAY", "TERRACE", "BVLD", "HEOL", "FFORDD", "PLACE", "GARDENS", "GROVE", "VIEW",
    "HILL", "GREEN",
)
RESIDENTIAL = (
    "HOUSE", "HSE", "FARM", "LODGE", "COTTAGE", "COTTAGES", "VILLA", "VILLAS", "MAISONETTE", "MEWS",
)
BUSINESS = (
    "OFFICE", "HOSPITAL", "CARE", "CLUB", "BANK", "BAR", "UK", "SOCIETY", "PRISON", "HMP", "RC",
    "UWE", "UEA", "LSE", "KCL", "UCL", "UNI", "UNIV", "UNIVERSITY", "UNIVERISTY",
)
LOCATIONAL = (
    "BASEMENT", "GROUND", "UPPER", "ABOVE", "TOP", "LOWER", "FLOOR", "HIGHER", "ATTIC", "LEFT",
    "RIGHT", "FRONT", "BACK", "REAR", "WHOLE", "PART", "SIDE",
)
ORDINAL = (
    "0TH", "ZEROTH", "0ED", "SERO", "SEROFED", "DIM", "DIMFED",
    "1ST", "FIRST", "1AF", "CYNTA", "CYNTAF", "GYNTAF",
    "2ND", "SECOND", "2AIL", "AIL", "AILFED",
    "3RD", "THIRD", "3YDD", "TRYDYDD", "TRYDEDD",
    "4TH", "FOURTH", "4YDD", "PEDWERYDD", "PEDWAREDD",
    "5TH", "FIFTH", "5ED", "PUMED",
    "6TH", "SIXTH", "6ED", "CHWECHED",
    "7TH", "SEVENTH", "7FED", "SEITHFED",
    "8TH", "EIGHTH", "8FED", "WYTHFED",
    "9TH", "NINTH", "9FED", "NAWFED",
    "10TH", "TENTH", "10FED", "DEGFED",
    "11TH", "ELEVENTH", "11FED", "UNFED", "DDEG",
    "12TH", "TWELFTH", "12FED", "DEUDDEGFED",
)
# A county name before one of these is part of another name.
KEPT_BEFORE = (
    "OFFICE", "HOSPITAL", "CARE", "CLUB", "BANK", "BAR", "SOCIETY", "PRISON", "HMP", "UNI",
    "UNIV", "UNIVERSITY", "UNIVERISTY",
)
# A county name after one of these is part of another name; so is one after a digit.
KEPT_AFTER = ("ON", "DINAS", "UPON")
# What makes a token, ranges to hyphenate, and pieces to drop.
TOKEN = r"(?U)\(*\b[^\s,;#&()]+[.,;)\n]*|[#&]"
RANGES = (
    r"(?U)(\d+[A-Z]?) *- *(\d+[A-Z]?)",
    r"(?U)(\d+)/(\d+)",
    r"(?U)(\d+) *TO *(\d+)",
)
DROPPED = (" IN ", " CO ", " - ", ",", "\\")
FLAGS = {
    "directional": DIRECTIONS,
    "flat": FLAT,
    "company": COMPANY,
    "road": ROAD,
    "residential": RESIDENTIAL,
    "business": BUSINESS,
    "locational": LOCATIONAL,
    "ordinal": ORDINAL,
}


@dataclass(frozen=True)
class Lookups:
    """Place lists and synonyms supplied by the user; each may be empty."""

    counties: Sequence[str] = ()
    synonyms: Mapping[str, str] = field(default_factory=dict)
    outcodes: Sequence[str] = ()
    posttowns: Sequence[str] = ()


def _branches(names: list[tuple[int, str]]) -> str:
    """Alternatives for names in their order, put together by their letters.

    A name that ends where others go on stands between those listed before and those listed after it.
    """
    ends = [i for i, rest in names if not rest]
    if ends:
        sides = [[n for n in names if n[0] < ends[0]], [n for n in names if n[0] > ends[0] and n[1]]]
        before, after = (_branches(side) if side else "" for side in sides)
        return "(?:" + "|".join([*([before] if sides[0] else []), "", *([after] if sides[1] else [])]) + ")"
    groups: dict[str, list[tuple[int, str]]] = {}
    for i, rest in names:
        groups.setdefault(rest[0], []).append((i, rest[1:]))
    parts = [re.escape(letter) + (_branches(rest) if rest != [(rest[0][0], "")] else "") for letter, rest in groups.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def county_pattern(counties: Sequence[str]) -> str:
    """Pattern of a removable county name; of two that start alike the first listed wins.

    Names form a trie of letters, so that the work at a place of the text depends on the letters met
    there and not on how many names there are; a look at the first letter comes before all else.
    """
    names = [(i, n) for i, n in enumerate(dict.fromkeys(counties)) if n]
    first = "".join(sorted({re.escape(n[0]) for _, n in names}))
    after = "|".join([*KEPT_AFTER, "[0-9]"])
    before = "|".join(dict.fromkeys([*KEPT_BEFORE, *COMPANY, *FLAT, *RESIDENTIAL, *ROAD]))
    return rf"(?U)(?=[{first}])(?<!\b(?:{after})\s){_branches(names)}(?!\s(?:{before})\b)"


def remove_counties(c: Column, counties: Sequence[str]) -> Column:
    """Text without county names, unless they are part of a town or street name."""
    return F.regexp_replace(c, county_pattern(counties), "") if any(counties) else c


def synonym_words(tokens: Column, synonyms: Mapping[str, str]) -> Column:
    """Tokens replaced by their synonym, letter case mattering.

    The lookup is a map of maps by first letter, as a map literal is searched from its start.
    """
    if not synonyms:
        return tokens
    groups: dict[str, dict[str, str]] = {}
    for word, target in synonyms.items():
        if word:
            groups.setdefault(word[0], {})[word] = target
    nested = F.create_map(*[x for k, m in groups.items() for x in (F.lit(k), literal_map(m))])
    return F.transform(
        tokens,
        lambda t: F.coalesce(F.try_element_at(F.try_element_at(nested, F.left(t, F.lit(1))), t), t),
    )


def tokenize(raw: Column, lookups: Lookups = Lookups()) -> Column:
    """Tokens of an address: counties removed, number ranges hyphenated, synonyms replaced."""
    text = remove_counties(F.upper(F.coalesce(raw, F.lit(""))), lookups.counties)
    for pattern in RANGES:
        text = F.regexp_replace(text, pattern, "$1-$2")
    for piece in DROPPED:
        text = F.replace(text, F.lit(piece), F.lit(" "))
    replaced = F.array_join(synonym_words(words(text), lookups.synonyms), " ")
    return F.regexp_extract_all(
        remove_counties(replaced, lookups.counties), F.lit(TOKEN), F.lit(0)
    )


def digits(token: Column) -> Column:
    """Whether a token is all, partly or not made of digits."""
    return (
        F.when(token.rlike(r"(?U)^\d+$"), "all_digits")
        .when(token.rlike("[0-9]"), "some_digits")
        .otherwise("no_digits")
    )


def _features(token: Column, clean: Column, kind: Column, lookups: Lookups, listed: Column | None = None) -> Column:
    """Features of a token, its upper case and what digits it has.

    `listed` tells whether any word set holds the token: no set is searched for one that none holds.
    """
    is_number = kind == "all_digits"
    size = F.length(clean).cast("string")

    def among(names: Sequence[str]) -> Column:
        if not names:
            return F.lit(False)
        held = clean.isin(list(names))
        return held if listed is None else F.when(~listed, F.lit(False)).otherwise(held)

    fields = {
        "digits": kind,
        "word": F.when(~is_number, clean),
        "length": F.concat(F.when(is_number, "d:").otherwise("w:"), size),
        "endsinpunc": F.when(token.contains(".") & token.rlike(r"^.+\.$"), F.right(token, F.lit(1))),
        "directional": among(DIRECTIONS),
        "outcode": among(lookups.outcodes),
        "posttown": among(lookups.posttowns),
        "has_vowels": clean.rlike("[AEIOU]"),
        **{k: among(v) for k, v in FLAGS.items() if k != "directional"},
        "hyphenations": F.length(clean) - F.length(F.replace(clean, F.lit("-"), F.lit(""))),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def token_features(token: Column, lookups: Lookups = Lookups()) -> Column:
    """Sixteen features of one token (C15). A feature that does not apply is null."""
    clean = F.upper(token)
    return _features(token, clean, digits(clean), lookups)


def array_features(tokens: Column, lookups: Lookups = Lookups()) -> Column:
    """token_features of each token of an array.

    Inside of a lambda function nothing is shared: an expression used for several features is made anew
    for each of them. So upper case and digits are made by a function before, once per token.
    """
    names = [n for v in (*FLAGS.values(), lookups.outcodes, lookups.posttowns) for n in v]
    upper = F.transform(tokens, lambda t: F.struct(t.alias("token"), F.upper(t).alias("clean")))
    known = F.transform(
        upper,
        lambda t: F.struct(t["token"], t["clean"], digits(t["clean"]).alias("kind"), t["clean"].isin(names).alias("listed")),
    )
    return F.transform(known, lambda t: _features(t["token"], t["clean"], t["kind"], lookups, t["listed"]))


def sequence_features(
    df: DataFrame, tokens: str, lookups: Lookups = Lookups(), out: str = "features"
) -> DataFrame:
    """Features of each token with those of its neighbours and its place in the text.

    Neighbours are read from the array of the row: no shuffle.
    """
    last = F.size(tokens) - 1
    several = last > 0

    def with_neighbours(own: Column, i: Column) -> Column:
        return F.struct(
            own.alias("own"),
            F.get("__own", i - 1).alias("previous"),
            F.get("__own", i + 1).alias("next"),
            ((i == 0) & several).alias("rawstring_start"),
            ((i == last) & several).alias("rawstring_end"),
            (~several).alias("singleton"),
            (i == 1).alias("previous_is_start"),
            ((i == last - 1) & several).alias("next_is_end"),
        )

    return (
        df.withColumn("__own", array_features(F.col(tokens), lookups))
        .withColumn(out, F.transform("__own", with_neighbours))
        .drop("__own")
    )
