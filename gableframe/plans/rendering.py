"""Labelled training addresses: order of parts, tokens with labels, XML shards."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions import cohort as C
from gableframe.operators.linkage import dense_ids
from gableframe.operators.sampling import uniform
from gableframe.schema import RENDER_LABELS
from gableframe.scratch import settle

# Orders of premises and street with their chances, by what an address has.
FLAT_ORDERS = (
    (0.35, ("SubBuildingName", "BuildingNumber", "BuildingName", "StreetName")),
    (0.25, ("SubBuildingName", "BuildingName", "BuildingNumber", "StreetName")),
    (0.15, ("BuildingNumber", "BuildingName", "SubBuildingName", "StreetName")),
    (0.10, ("BuildingName", "BuildingNumber", "SubBuildingName", "StreetName")),
    (0.08, ("SubBuildingName", "StreetName", "BuildingNumber", "BuildingName")),
    (0.07, ("BuildingNumber", "StreetName", "SubBuildingName", "BuildingName")),
)
NAMED_NUMBER_ORDERS = (
    (0.40, ("BuildingNumber", "BuildingName", "StreetName")),
    (0.35, ("BuildingName", "BuildingNumber", "StreetName")),
    (0.20, ("BuildingNumber", "StreetName", "BuildingName")),
    (0.05, ("BuildingName", "StreetName", "BuildingNumber")),
)
NUMBER_ORDERS = ((0.90, ("BuildingNumber", "StreetName")), (0.10, ("StreetName", "BuildingNumber")))
NAME_ORDERS = ((0.85, ("BuildingName", "StreetName")), (0.15, ("StreetName", "BuildingName")))
NO_STREET_ORDER = ("SubBuildingName", "BuildingName", "BuildingNumber", "StreetName")
PLACE_ORDERS = ((0.90, ("Locality", "TownName")), (0.10, ("TownName", "Locality")))
# Chances that the street moves next to the building, and that this is the number.
STREET_NEXT_TO_BUILDING = 0.7
STREET_NEXT_TO_NUMBER = 0.6


def _labels(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def weighted_choice(u: Column, options: tuple) -> Column:
    """The option whose share of [0, 1) holds the draw."""
    reached, out = 0.0, None
    for chance, names in options[:-1]:
        reached += chance
        test = u < F.lit(round(reached, 6))
        out = F.when(test, _labels(names)) if out is None else out.when(test, _labels(names))
    return out.otherwise(_labels(options[-1][1]))


def field_tokens() -> dict[str, Column]:
    """Tokens of each part of a cohort row, by label."""
    parts = {n: C.scalar_words(F.col(n)) for n in RENDER_LABELS if n != "Postcode"}
    parts["Postcode"] = C.postcode_tokens(F.col("Postcode"), F.col("Outcode"), F.col("Incode"))
    return parts


def front_order(has: dict[str, Column], kind: Column, u: Column) -> Column:
    """Order of premises and street for a realistic address (C11)."""
    flat = (C.to_text(kind, True) == "F") | has["SubBuildingName"]
    name, number, street = has["BuildingName"], has["BuildingNumber"], has["StreetName"]
    return (
        F.when(flat & street, weighted_choice(u, FLAT_ORDERS))
        .when(name & number & street, weighted_choice(u, NAMED_NUMBER_ORDERS))
        .when(number & street, weighted_choice(u, NUMBER_ORDERS))
        .when(name & street, weighted_choice(u, NAME_ORDERS))
        .otherwise(_labels(NO_STREET_ORDER))
    )


def back_order(u: Column) -> Column:
    """Order of locality, town and postcode, the postcode last."""
    return F.concat(weighted_choice(u, PLACE_ORDERS), _labels(("Postcode",)))


def random_order(has: dict[str, Column], key: Column, seed: object, postcode_last: bool = True) -> Column:
    """Any order of the present labels, the street often moved behind a building part."""
    free = [n for n in RENDER_LABELS if not (postcode_last and n == "Postcode")]
    drawn = F.array(
        *[
            F.struct(uniform(key, seed, f"order {n}").alias("u"), F.lit(n).alias("label"))
            for n in free
        ]
    )
    present = F.map_from_arrays(_labels(tuple(free)), F.array(*[has[n] for n in free]))
    shuffled = F.transform(
        F.array_sort(F.filter(drawn, lambda d: F.element_at(present, d["label"]))), lambda d: d["label"]
    )
    number, name = has["BuildingNumber"], has["BuildingName"]
    pick_number = uniform(key, seed, "target") < STREET_NEXT_TO_NUMBER
    target = (
        F.when(number & name, F.when(pick_number, "BuildingNumber").otherwise("BuildingName"))
        .when(number, "BuildingNumber")
        .when(name, "BuildingName")
    )
    moved = F.flatten(
        F.transform(
            F.array_remove(shuffled, "StreetName"),
            lambda n: F.when(n == target, F.array(n, F.lit("StreetName"))).otherwise(F.array(n)),
        )
    )
    move = has["StreetName"] & target.isNotNull() & (
        uniform(key, seed, "move") < STREET_NEXT_TO_BUILDING
    )
    order = F.when(move, moved).otherwise(shuffled)
    if not postcode_last:
        return order
    return F.concat(
        order, F.when(has["Postcode"], _labels(("Postcode",))).otherwise(F.array().cast("array<string>"))
    )


def render_labelled(
    cohort: DataFrame, key: str, seed: object = 42, realistic: bool = True, out: str = "labelled"
) -> DataFrame:
    """Adds the ordered (token, label) pairs of each cohort row (C14).

    The order depends on seed and key alone, so that a recomputed row is rendered alike.
    """
    k = F.col(f"`{key}`")
    tokens = {n: F.col(f"__t_{n}") for n in RENDER_LABELS}
    has = {n: F.size(t) > 0 for n, t in tokens.items()}
    if realistic:
        order = F.concat(
            front_order(has, F.col("property_type"), uniform(k, seed, "front")),
            back_order(uniform(k, seed, "back")),
        )
    else:
        order = random_order(has, k, seed)
    by_label = F.map_from_arrays(_labels(RENDER_LABELS), F.array(*tokens.values()))

    def pairs_of(known: Column) -> Column:
        return F.flatten(
            F.transform(
                F.col("__order"),
                lambda n: F.transform(F.element_at(known, n), lambda t: F.struct(t.alias("token"), n.alias("label"))),
            )
        )

    # The map is an element that the inner function is given: as a column it would be made anew for each label.
    pairs = F.get(F.transform(F.array(F.col("__by_label")), pairs_of), 0)
    return (
        cohort.withColumns({f"__t_{n}": t for n, t in field_tokens().items()})
        .withColumns({"__order": order, "__by_label": by_label})
        .withColumn(out, pairs)
        .drop("__order", "__by_label", *[f"__t_{n}" for n in RENDER_LABELS])
    )


# --- XML text ----------------------------------------------------------------------

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
ELEMENT = r"<(\w+)>([^<]*)</\1>"


def _escaped(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _unescaped(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def to_xml(labelled: Column) -> Column:
    """One line of XML per address: a child element per token, named by its label."""
    children = F.transform(
        labelled,
        lambda p: F.concat(
            F.lit("<"), p["label"], F.lit(">"), _escaped(p["token"]), F.lit("</"), p["label"], F.lit(">")
        ),
    )
    return F.concat(
        F.lit("<AddressString>"), F.array_join(children, ""), F.lit("</AddressString>")
    )


def write_labelled_xml(
    df: DataFrame,
    path: str,
    key: str,
    labelled: str = "labelled",
    rows_per_shard: int = 200_000,
    compress: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Well-formed XML files, one per split and shard of `rows_per_shard` addresses.

    Rows are numbered within their split to fill shards evenly. A shard is one partition of
    the shuffle, its opening and closing tag sorted to its ends; it is as large as asked for.
    Addresses are rendered once and numbered once; counts and tags read what was written.
    """
    rendered = df.select(F.col(f"`{key}`").alias("__key"), "split", to_xml(F.col(labelled)).alias("value"))
    numbered = dense_ids(settle(rendered, "xml-lines"), "__key", out="__at", by=("split",))
    shard = F.floor((F.col("__at") - 1) / F.lit(rows_per_shard)).cast("int")
    lines = settle(numbered.select("split", "__at", "value", shard.alias("shard")), "xml-numbered")
    ends = (
        lines.select("split", "shard")
        .distinct()
        .select(
            "split",
            "shard",
            F.inline(
                F.array(
                    F.struct(F.lit(0).cast("bigint").alias("__at"), F.lit("<AddressCollection>").alias("value")),
                    F.struct(F.lit(2**62).alias("__at"), F.lit("</AddressCollection>").alias("value")),
                )
            ),
        )
    )
    whole = lines.select("split", "shard", "__at", "value").unionByName(ends)
    (
        whole.repartition("split", "shard")
        .sortWithinPartitions("split", "shard", "__at")
        .select("split", "shard", "value")
        .write.partitionBy("split", "shard")
        .option("compression", "gzip" if compress else "none")
        .mode(mode)
        .text(path)
    )


def read_labelled_xml(spark, path: str) -> DataFrame:
    """Addresses of labelled XML files: raw text and ordered (token, label) pairs.

    Takes one address per line, as the writer lays them out; partition columns are kept.
    """
    lines = spark.read.text(path).where(F.trim("value").startswith("<AddressString>"))
    labels = F.regexp_extract_all("value", F.lit(ELEMENT), F.lit(1))
    tokens = F.regexp_extract_all("value", F.lit(ELEMENT), F.lit(2))
    pairs = F.zip_with(
        labels, tokens, lambda n, t: F.struct(_unescaped(t).alias("token"), n.alias("label"))
    )
    return (
        lines.withColumn("labelled", pairs)
        .withColumn("raw_text", F.array_join(F.transform("labelled", lambda p: p["token"]), ""))
        .drop("value")
    )
