"""Monthly series, seasonality, repeat sales and trend lines."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gableframe.functions.values import months_between_sales, percent_change
from gableframe.operators.market import col
from gableframe.operators.quantiles import grouped_median
from gableframe.operators.skew import ROWS_PER_TASK, skew_join
from gableframe.scratch import settle


def monthly_series(
    df: DataFrame, price: str = "Price", date: str = "Date of Transfer"
) -> DataFrame:
    """Median, mean and number of sales for every month from first to last sale.

    Months without sales have no price and a count of zero.
    """
    dated = df.withColumn("month", F.trunc(col(date), "MM"))
    found = grouped_median(dated, ["month"], price, "median_price", mean="mean_price", count="n")
    span = dated.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    calendar = span.select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return (
        calendar.join(found, "month", "left")
        .withColumn("transactions", F.coalesce(F.col("n"), F.lit(0).cast("bigint")))
        .drop("n")
        .orderBy("month")
    )


def rolling_median(series: DataFrame, value: str, window: int, order: str = "month") -> DataFrame:
    """Median of the last `window` rows, null until they are there and all known.

    Meant for a monthly series: its length is the number of months, whatever the data size,
    so that one task can hold it.
    """
    frame = Window.orderBy(order).rowsBetween(1 - window, Window.currentRow)
    full = F.count(col(value)).over(frame) == window
    return series.withColumn(
        "rolling", F.when(full, F.percentile(col(value), F.lit(0.5)).over(frame))
    )


def seasonal_pivot(df: DataFrame, price: str = "Price") -> DataFrame:
    """Median per year (rows) and month 1 to 12 (columns m1 to m12)."""
    medians = grouped_median(df, ["Year", "Month"], price)
    cells = [F.max(F.when(F.col("Month") == m, F.col("median"))).alias(f"m{m}") for m in range(1, 13)]
    return medians.groupBy("Year").agg(*cells).orderBy("Year")


def repeated_addresses(df: DataFrame, address: str = "ADDRESS_ID", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Sales of addresses that occur more than once (J7, W2), with the number of occurrences.

    The sales of a hot address, such as one without parts, meet their count in several tasks.
    """
    counts = df.groupBy(col(address)).agg(F.count(F.lit(1)).alias("occurrences"))
    counts = settle(counts.where(F.col("occurrences") > 1), "occurrences")
    return skew_join(df, counts, [address], rows_per_task=rows_per_task, counts=counts, n="occurrences")


def next_sale(
    df: DataFrame,
    price: str = "Price",
    date: str = "Date of Transfer",
    address: str = "ADDRESS_ID",
    tie: str = "Transaction ID",
) -> DataFrame:
    """Adds next_price and next_date of the same address, null for its last sale.

    An address can be hot: all sales without address parts share one id. The plain
    `lead` over an address would bring them into one task, so it is taken per address
    and day; the day's last sale takes the first sale of the next day that has one, out
    of a table with one row per address and day, in which an address is small.
    """
    keys = [col(address), F.col("__day")]
    rows = df.withColumn("__day", F.to_date(col(date)))
    sale = F.struct(
        col(date).alias("at"), col(tie).alias("tie"), col(price).cast("double").alias("price")
    )
    first = rows.groupBy(*keys).agg(F.min(sale).alias("__first"))
    days = Window.partitionBy(col(address)).orderBy("__day")
    following = first.select(*keys, F.lead("__first").over(days).alias("__next_day"))
    within = Window.partitionBy(*keys).orderBy(col(date), col(tie))
    upcoming = F.coalesce(F.col("__same_day"), F.col("__next_day"))
    return (
        rows.withColumn("__same_day", F.lead(sale).over(within))
        .join(following, [address, "__day"])
        .withColumns({"next_price": upcoming["price"], "next_date": upcoming["at"]})
        .drop("__day", "__same_day", "__next_day")
    )


def repeat_sales(
    df: DataFrame,
    price: str = "Price",
    date: str = "Date of Transfer",
    address: str = "ADDRESS_ID",
    tie: str = "Transaction ID",
) -> DataFrame:
    """Pairs of consecutive sales of an address with return and months between.

    A row without a price still takes its place in the order of its address, but forms no pair.
    """
    paired = next_sale(df, price, date, address, tie)
    return paired.where(F.col("next_price").isNotNull() & F.col("next_date").isNotNull()).withColumns(
        {
            "ret_pct": percent_change(F.col("next_price"), col(price)),
            "months": months_between_sales(col(date), F.col("next_date")),
        }
    )


def repeat_listing(pairs: DataFrame, columns: list[str], tie: str = "Transaction ID") -> DataFrame:
    """Pairs by return, highest first."""
    return pairs.select(*[col(c) for c in columns]).orderBy(F.desc("ret_pct"), col(tie))


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Ordinary least squares line through (x, y)."""
    ys, xs = col(y), col(x)
    return df.agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_count(ys, xs).alias("n"),
    )
