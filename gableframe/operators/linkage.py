"""Linking sales to certificates (C4-C6, J4-J6, J10) and preparing both sides."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gableframe.functions import address as A
from gableframe.functions import values as V
from gableframe.operators.skew import ROWS_PER_TASK, skew_join
from gableframe.scratch import settle

# Hash buckets used to spread rows; their number bounds every histogram over them.
HASH_DIGITS = 4


def hash_order(key: Column, seed: object = 0) -> Column:
    """Pseudo-random order as a pure function of seed and key: the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def dense_ids(df: DataFrame, key: str, out: str = "unique_id", start: int = 1, by: tuple = ()) -> DataFrame:
    """Numbers rows without gaps in hash order of a unique key.

    A row's number is its place within its hash bucket plus the rows of the buckets before,
    so that no task orders more than a bucket. With `by` each group is numbered by itself.
    """
    groups = [F.col(c) for c in by]
    hashed = df.withColumn("__h", hash_order(F.col(f"`{key}`"))).withColumn(
        "__p", F.substring("__h", 1, HASH_DIGITS)
    )
    before = (
        Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        hashed.groupBy(*groups, "__p")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*groups, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    )
    inside = Window.partitionBy(*groups, "__p").orderBy("__h", F.col(f"`{key}`"))
    return (
        hashed.withColumn("__r", F.row_number().over(inside))
        .join(offsets, [*by, "__p"])
        .withColumn(out, F.col("__o") + F.col("__r") + F.lit(start - 1))
        .drop("__h", "__p", "__r", "__o")
    )


# --- preparation -------------------------------------------------------------------


def prep_sales_addresses(df: DataFrame, key: str | None = None) -> DataFrame:
    """Street, number, name and flat of a sale address, normalised (C4).

    With `key` a dense unique_id from 1 is added.
    """
    paon, saon = A.normal(F.col("PAON")), A.normal(F.col("SAON"))
    name = F.col("paon_name")
    out = (
        df.withColumns(
            {"Street_norm": A.norm_street(F.col("Street")), "PAON_raw_norm": paon, "SAON_norm": saon}
        )
        .withColumn("PAON_number_name", A.number_name(F.col("PAON_raw_norm")))
        .withColumns(
            {
                "paon_num": F.split_part(
                    F.col("PAON_number_name"), F.lit(" "), F.lit(1)
                ).try_cast("int"),
                "paon_name": A.name_only(F.col("PAON_number_name")),
                "flat_num": A.flat_number(F.col("SAON_norm")),
            }
        )
        .withColumns(
            {
                "building_name": F.when(
                    name.isNotNull() & A.has_house_word(A.words(name)), name
                ).otherwise(A.building_name(F.col("PAON_raw_norm"), F.col("SAON_norm"))),
                "full_norm": A.join_known(
                    F.col("SAON_norm"), F.col("PAON_number_name"), F.col("Street_norm")
                ),
                "source_dataset": F.lit("ppd"),
            }
        )
    )
    return dense_ids(out, key) if key else out


def prep_certificate_addresses(df: DataFrame, key: str | None = None) -> DataFrame:
    """Street, number, name and flat of a certificate address, normalised.

    With `key` a dense unique_id from 1,000,001 is added.
    """
    names = ["ADDRESS1", "ADDRESS2", "ADDRESS3"]
    lines = [F.col(f"{n}_norm") for n in names]
    out = (
        df.withColumns({f"{n}_norm": A.normal(F.col(n)) for n in names})
        # The lines are normalised, and so is what is made of them.
        .withColumns(
            {
                "Street_norm": A.street_line(lines),
                "alpha_blob": A.join_known(*lines[:2]),
                "full_norm": A.join_known(*lines),
            }
        )
        .withColumns(
            {
                "Street_norm": A.expand_street(F.col("Street_norm")),
                "building_name": A.without_numbers(F.col("full_norm")),
                "paon_num": A.first_int(F.col("alpha_blob")),
                "flat_num": A.flat_number(F.col("full_norm")),
                "source_dataset": F.lit("epc"),
            }
        )
        .withColumn(
            "PAON_number_name",
            V.blank_to_null(
                F.concat_ws(
                    " ",
                    F.when(F.col("paon_num") != 0, F.col("paon_num").cast("string")),
                    F.col("building_name"),
                )
            ),
        )
    )
    return dense_ids(out, key, start=1_000_001) if key else out


# --- linkage -----------------------------------------------------------------------


def sale_side(df: DataFrame) -> DataFrame:
    """Adds the keys of a sale: normalised postcode and address key."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("SAON", "PAON", "Street")]
    return df.withColumns(
        {
            "postcode_norm": V.postcode_norm(F.col("Postcode")),
            "derived_addr_key": V.address_key(parts),
        }
    )


def certificate_side(df: DataFrame) -> DataFrame:
    """Certificates under epc_ names with their keys and date.

    The stored address key is taken when there is one, else it is derived from the lines.
    """
    lines = [
        F.coalesce(F.col(c).cast("string"), F.lit(""))
        for c in ("ADDRESS1", "ADDRESS", "ADDRESS2", "ADDRESS3")
        if c in df.columns
    ]
    stored = [F.col("addr_key")] if "addr_key" in df.columns else []
    keys = {
        "epc_postcode_norm": V.postcode_norm(F.col("POSTCODE")),
        "addr_key_std": V.first_of(*stored, V.address_key(lines)),
        "epc_date": V.certificate_date(F.col("INSPECTION_DATE"), F.col("LODGEMENT_DATE")),
    }
    own = [F.col(c).alias(f"epc_{c.lower()}") for c in df.columns if c != "postcode_norm"]
    return df.select(*own, *[c.alias(n) for n, c in keys.items()])


def _carried(side: DataFrame, columns: Sequence[str] | None, *needed: str) -> DataFrame:
    """A side with the columns of the result that it has and those that linking needs."""
    if columns is None:
        return side
    wanted = {c.lower() for c in (*columns, *needed)}
    return side.select(*[F.col(f"`{c}`") for c in side.columns if c.lower() in wanted])


def link(
    sales: DataFrame,
    certificates: DataFrame,
    before: int = 365,
    after: int = 180,
    how: str = "inner",
    date: str = "Date of Transfer",
    match_empty: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Sales joined to certificates of the same address and about the same time.

    A certificate matches from `before` days before the sale to `after` days after it. The
    time line is cut into windows as long as that range; a certificate lies in one window and
    a sale looks into the two its range can touch, so the window becomes part of the join key.
    That splits a hot address, such as one without parts, by time, and pairs too far apart
    in time are hardly ever formed.

    An address key without letters and digits equals other such keys of its postcode; without
    `match_empty` it matches none. `how` is inner, left (all sales) or full (all of both sides); for
    the latter two, rows are numbered and the pairs settled, so that a row that found no partner comes
    once, whether its id is null or repeated. `columns` names the columns of the result, all if it is None;
    others are not written on the way.

    Both sides are settled: keys and dates are made once per row. From a join on them the planner would
    infer tests of theirs, and make them again for each test below the joins behind a side.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"unknown join: {how}")
    width = before + after + 1
    day = F.unix_date(F.to_date(F.col(f"`{date}`")))

    def window(d: Column) -> Column:
        return F.floor(d / width).cast("int")

    left = _carried(sale_side(sales), columns, "postcode_norm", "derived_addr_key", date)
    right = _carried(certificate_side(certificates), columns, "epc_postcode_norm", "addr_key_std", "epc_date")
    if how != "inner":
        left = left.withColumn("__sale", F.monotonically_increasing_id())
        right = right.withColumn("__certificate", F.monotonically_increasing_id())
    left, right = settle(left, "sales"), settle(right, "certificates")
    known = left if match_empty else left.where(F.col("derived_addr_key") != "")
    looking = known.withColumn(
        "__w", F.explode(F.sequence(window(day - before), window(day + after)))
    )
    placed = right.withColumn("__w", window(F.unix_date("epc_date"))).withColumnRenamed(
        "epc_postcode_norm", "postcode_norm"
    )
    gap = F.datediff(F.to_date(F.col(f"`{date}`")), F.col("epc_date"))
    pairs = (
        looking.join(
            placed.withColumnRenamed("addr_key_std", "derived_addr_key"),
            ["postcode_norm", "derived_addr_key", "__w"],
        )
        .where(gap.between(-after, before))
        .withColumn("days_diff", F.abs(gap))
        .drop("__w")
    )
    out = [F.col(f"`{c}`") for c in columns or pairs.columns if c not in ("__sale", "__certificate")]
    if how == "inner":
        return pairs.select(*out)
    pairs = settle(pairs.select(*out, "__sale", "__certificate"), "pairs")
    rest = left.join(pairs.select("__sale").distinct(), "__sale", "left_anti")
    found = pairs.unionByName(rest, allowMissingColumns=True)
    if how == "full":
        lone = right.join(pairs.select("__certificate").distinct(), "__certificate", "left_anti").drop(
            "epc_postcode_norm", "addr_key_std"
        )
        found = found.unionByName(lone, allowMissingColumns=True)
    return found.select(*out)


def by_sale_month(linked: DataFrame) -> DataFrame:
    """Linked rows in order of sale year and month (T10), then of sale and certificate.

    They are settled, as a sort draws its ranges from the rows first and would link them twice.
    """
    return settle(linked, "linked").orderBy("sale_year", "sale_month", F.col("`Transaction ID`"), "epc_lmk_key")


def closest_links(linked: DataFrame, n: int = 20) -> DataFrame:
    """Links with the fewest days between sale and certificate."""
    return linked.orderBy("days_diff", F.col("`Transaction ID`"), "epc_lmk_key").limit(n)


# --- containment -------------------------------------------------------------------

# Property types of certificates that a flat may have.
FLAT_TYPES = ("FLAT", "MAISONETTE")


def _listed(parts: list[Column]) -> Column:
    """Distinct words of some text in order, letters and digits alone."""
    text = F.upper(F.concat_ws(" ", *parts))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z0-9]+"), F.lit(0)))
    return F.array_sort(found)


def containing_lists(needed: DataFrame, offered: DataFrame) -> DataFrame:
    """Pairs (postcode_norm, needs, has) of distinct word lists where has holds every word of needs.

    An inverted index finds them: a list looks only under that of its words which the fewest lists of
    its postcode hold, and not at all if one of its words is in none; what it finds there is then
    compared in full. So a street whose houses differ by their numbers forms no pairs.
    """
    words = settle(offered.select("postcode_norm", "has", F.explode("has").alias("word")), "words")
    sizes = words.groupBy("postcode_norm", "word").agg(F.count(F.lit(1)).alias("n"))
    asked = needed.select("postcode_norm", "needs", F.explode("needs").alias("word")).join(sizes, ["postcode_norm", "word"])
    found = asked.groupBy("postcode_norm", "needs").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word")).alias("rarest"))
    looking = found.where(F.col("known") == F.size("needs")).select("postcode_norm", "needs", F.col("rarest.word").alias("word"))
    candidates = looking.join(words, ["postcode_norm", "word"])
    return candidates.where(F.size(F.array_except("needs", "has")) == 0).select("postcode_norm", "needs", "has")


def link_contained(
    sales: DataFrame,
    certificates: DataFrame,
    before: int = 365,
    after: int = 180,
    date: str = "Date of Transfer",
    rows_per_task: int = ROWS_PER_TASK,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Sales joined to certificates of the postcode whose address holds every word of the sale's.

    The words of SAON, PAON and Street may stand in any order and among others. A flat is linked
    only to certificates of flats and maisonettes. Dates are compared as in link. `tier` is 1 where the
    address keys are equal as well, so that link finds the pair, and 2 where only the words agree. A sale
    without words, and one without a postcode, is linked to nothing.

    Word lists are matched once per distinct list. Rows then meet by list and window of time; a list of
    a hot address is dealt to several tasks. `columns` names the columns of the result, as in link.
    """
    width = before + after + 1
    day = F.unix_date(F.to_date(F.col(f"`{date}`")))

    def window(d: Column) -> Column:
        return F.floor(d / width).cast("int")

    lines = [F.col(c).cast("string") for c in ("ADDRESS1", "ADDRESS", "ADDRESS2", "ADDRESS3") if c in certificates.columns]
    own = certificate_side(certificates.withColumn("__has", _listed(lines))).withColumnRenamed("epc___has", "has")
    own = own.withColumnRenamed("epc_postcode_norm", "postcode_norm").withColumn("__w", window(F.unix_date("epc_date")))
    keys = ("postcode_norm", "has", "addr_key_std", "epc_date", "epc_property_type", "__w")
    own = settle(_carried(own, columns, *keys).where(F.col("postcode_norm").isNotNull() & (F.size("has") > 0)), "certificates")
    asked = sale_side(sales).withColumn("needs", _listed([F.col("SAON"), F.col("PAON"), F.col("Street")]))
    asked = _carried(asked, columns, "postcode_norm", "needs", "derived_addr_key", date, "Property Type")
    asked = settle(asked.where(F.col("postcode_norm").isNotNull() & (F.size("needs") > 0)), "sales")

    lists = containing_lists(asked.select("postcode_norm", "needs").distinct(), own.select("postcode_norm", "has").distinct())
    lists = settle(lists, "lists")
    looking = asked.withColumn("__w", F.explode(F.sequence(window(day - before), window(day + after))))
    met = skew_join(looking, lists, ["postcode_norm", "needs"], rows_per_task=rows_per_task)
    gap = F.datediff(F.to_date(F.col(f"`{date}`")), F.col("epc_date"))
    is_flat = F.upper(F.coalesce(F.col("`Property Type`"), F.lit(""))) == "F"
    fits = ~is_flat | F.upper(F.coalesce(F.col("epc_property_type"), F.lit(""))).isin(*FLAT_TYPES)
    tier = F.when(F.col("derived_addr_key") == F.col("addr_key_std"), 1).otherwise(2).cast("long")
    pairs = skew_join(met, own, ["postcode_norm", "has", "__w"], rows_per_task=rows_per_task)
    found = (
        pairs.where(gap.between(-after, before) & fits)
        .withColumns({"days_diff": F.abs(gap), "tier": tier})
        .drop("__w", "needs", "has")
    )
    return found.select(*[F.col(f"`{c}`") for c in columns]) if columns else found
