"""Mixing sources to target weights: a random order per source, cut at the source's budget."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gableframe.llm.quality import words_of
from gableframe.llm.text import word_count
from gableframe.scratch import settle

WEIGHTS = (3, 1, 2)
# The mix holds NUMERATOR / DENOMINATOR of all words, and a source at most EPOCHS times its own.
NUMERATOR, DENOMINATOR = 3, 2
EPOCHS = 2
HEX = 15


def random_key(id_col: Column, seed: str = "mix") -> Column:
    """A number below 2**60 that depends on the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HEX), 16, 10).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, n_rows, source_size, target) per source.

    Sources by code point, null last, take the weights in turn. Shares of the mix go by weight; a
    source stops at twice its size and the excess is shared out again. In the order of size by
    weight those that stop come first: one stops if its share of what the earlier ones leave is
    above its limit. The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * EPOCHS).cast("double")
    rows = per.withColumns({"weight": weight, "cap": cap})
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), "source").rowsBetween(
        W.unboundedPreceding, -1
    )
    whole = F.sum("source_size").over(everything).cast("double") * NUMERATOR / DENOMINATOR
    left = whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumns({"whole": whole, "stops": left / heavy * F.col("weight") > F.col("cap")})
    rest = F.col("whole") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0.0))
    sharing = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(rest / sharing * F.col("weight"))
    return rows.select("source", "n_rows", "source_size", target.alias("target"))


def _range(key: Column, n_rows: Column) -> Column:
    """As many ranges as rows in a range: keys are random, so equal ranges will do.

    So neither the sums of a source nor the rows of one range are more than about the root of its rows.
    """
    return F.floor(key / F.lit(float(16**HEX)) * F.ceil(F.sqrt(n_rows))).cast("long")


def cuts(sized: DataFrame) -> DataFrame:
    """Per source: its target, the rounds taken whole, and where in the random order the last one stops.

    Documents before (cut_key, cut_id, cut_size) are taken once more; those at it give cut_words.
    Sums per range of keys and their prefix sums find the range in which the budget ends, and only
    that range is ordered.
    """
    budget = settle(targets(sized), "targets")
    budget = budget.withColumns(
        {
            "rounds": F.when(
                F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))
            ).otherwise(0).cast("long"),
        }
    ).withColumn("rest", F.floor("target") - F.col("rounds") * F.col("source_size"))
    own = budget.withColumnRenamed("source", "__source")
    ranged = sized.join(own, F.col("source").eqNullSafe(F.col("__source"))).select(
        "source", "key", "doc_id", "size", "rest", _range(F.col("key"), F.col("n_rows")).alias("range")
    )
    sums = ranged.groupBy("source", "range", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("range"))
    ending = (
        sums.withColumn("upto", upto)
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .select(F.col("source").alias("__source"), F.col("range").alias("__range"), (F.col("upto") - F.col("words")).alias("past"))
    )
    at_end = ranged.join(
        ending, F.col("source").eqNullSafe(F.col("__source")) & (F.col("range") == F.col("__range"))
    ).where("size > 0")
    alike = at_end.groupBy("source", "key", "doc_id", "size", "rest", "past").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("source").orderBy("key", "doc_id", "size")
    passed = F.col("past") + F.sum(F.col("size") * F.col("n")).over(order)
    stop = (
        alike.withColumn("passed", passed)
        .where((F.col("passed") > F.col("rest")) & (F.col("passed") - F.col("size") * F.col("n") <= F.col("rest")))
        .select(
            F.col("source").alias("__source"),
            F.col("key").alias("cut_key"),
            F.col("doc_id").alias("cut_id"),
            F.col("size").alias("cut_size"),
            F.floor((F.col("rest") - F.col("passed") + F.col("size") * F.col("n")) / F.col("n")).alias("cut_words"),
        )
    )
    return budget.join(stop, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _taken() -> Column:
    """Words taken of a document, from its place in the order and the cut of its source."""

    def place(key: str, ident: str, size: str) -> Column:
        return F.struct(F.col(key).alias("a"), F.coalesce(F.col(ident), F.lit(-(2**63))).alias("b"), F.col(size).alias("c"))

    here, cut = place("key", "doc_id", "size"), place("cut_key", "cut_id", "cut_size")
    more = F.when(here < cut, F.col("size")).when(here == cut, F.col("cut_words")).otherwise(0)
    return (F.col("rounds") * F.col("size") + F.when(F.col("cut_key").isNull(), 0).otherwise(more)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        random_key(F.col(f"`{id_col}`")).alias("key"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target of its source, and taken.

    A null source is a source of its own; null and empty texts have no words and give none. The last
    document of a source is taken in part, so that a source gives the whole words of its target
    exactly. Rows equal in id and size share what the cut leaves to them evenly.
    """
    sized = settle(_sized(docs, id_col, text_col, source_col), "sized")
    cut = settle(cuts(sized), "cuts").withColumnRenamed("source", "__source")
    return sized.join(cut, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "size", "source_size", "target", _taken().alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with their columns, one row for each time a document is taken.

    Texts meet only the one row of their source and are not shuffled for it. The document at which
    the budget of a source ends comes with as many of its words as are left to it.
    """
    sized = settle(_sized(docs, id_col, text_col, source_col), "sized")
    cut = settle(cuts(sized), "cuts").select(
        F.col("source").alias("__source"), "rounds", "cut_key", "cut_id", "cut_size", "cut_words"
    )
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    work = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"),
        ident.alias("doc_id"),
        F.col(f"`{source_col}`").alias("__of"),
        word_count(text).alias("size"),
        random_key(F.col(f"`{id_col}`")).alias("key"),
    )
    met = work.join(cut, F.col("__of").eqNullSafe(F.col("__source"))).withColumn("taken", _taken())
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))
    rows = met.where("taken > 0").select("__doc", "size", "taken", F.explode(copies).alias("copy"))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    body = F.col("__doc").getField(text_col)
    short = F.array_join(F.slice(words_of(body), F.lit(1), left.cast("int")), " ")
    out = {c: F.col("__doc").getField(c) for c in docs.columns}
    out[text_col] = F.when(left < F.col("size"), short).otherwise(body)
    return rows.select(*[c.alias(n) for n, c in out.items()])
