"""Scores of predicted label sequences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_accuracy(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Share of rows whose label arrays are equal."""
    equal = (F.col(true) == F.col(predicted)).cast("double")
    return df.agg(F.avg(equal).alias("sequence_accuracy"), F.count(F.lit(1)).alias("sequences"))


def confusion(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Tokens per (true, predicted) label: at most the square of the number of labels."""
    pairs = F.arrays_zip(F.col(true).alias("true"), F.col(predicted).alias("predicted"))
    return df.select(F.inline(pairs).alias("true", "predicted")).groupBy("true", "predicted").agg(
        F.count(F.lit(1)).alias("n")
    )


def label_report(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per label (A39); a score that is undefined is zero."""
    cells = confusion(df, true, predicted)
    # Each cell counts once for its true and once for its predicted label.
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("claimed")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("claimed")),
            )
        ),
        F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
    )
    totals = sides.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("support").alias("support"),
        F.sum("claimed").alias("claimed"),
        (F.sum("hit") / 2).alias("hits"),
    )
    zero = F.lit(0.0)
    scored = totals.select(
        "label",
        F.coalesce(F.try_divide("hits", "claimed"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(
            F.try_divide(2 * F.col("hits"), F.col("claimed") + F.col("support")), zero
        ).alias("f1"),
        "support",
    )
    # The customary order of labels: by their name from the second letter on.
    return scored.orderBy(F.expr("substring(label, 2)"), F.substring("label", 1, 1))


def weighted_f1(df: DataFrame, true: str = "true", predicted: str = "predicted") -> DataFrame:
    """Mean F1 of the labels weighted by their support."""
    report = label_report(df, true, predicted)
    return report.agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").alias("tokens"),
    )
