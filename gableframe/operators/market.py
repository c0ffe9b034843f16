"""Headline figures, area comparisons and filters over cleaned sales.

Every function takes a sales DataFrame and returns a lazy DataFrame. `price` names the price
column, so that a winsorised one can be used in its place. Rows without the grouping key are
left out; ties are broken by the key.
"""

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.functions.values import percent_change
from gableframe.operators.quantiles import grouped_median
from gableframe.schema import FILTER_DIMENSIONS
from gableframe.scratch import settle


def col(name: str) -> Column:
    return F.col(f"`{name}`")


# --- filters -----------------------------------------------------------------------


def filter_sales(
    df: DataFrame,
    dates: tuple | None = None,
    prices: tuple | None = None,
    **choices: Sequence[str],
) -> DataFrame:
    """Sales between two dates and two prices, both inclusive, and in the chosen values.

    `choices` maps a dimension, written with underscores for blanks and slashes, to values;
    an empty choice does not filter.
    """
    by_keyword = {d.lower().replace(" ", "_").replace("/", "_"): d for d in FILTER_DIMENSIONS}
    tests = []
    if dates:
        tests.append(col("Date of Transfer").between(*[F.lit(d).cast("timestamp") for d in dates]))
    if prices:
        tests.append(col("Price").between(*prices))
    for keyword, values in choices.items():
        if keyword not in by_keyword:
            raise ValueError(f"unknown dimension: {keyword}")
        if values:
            tests.append(col(by_keyword[keyword]).isin(list(values)))
    return df.where(reduce(and_, tests)) if tests else df


def filter_options(df: DataFrame, dimensions: Sequence[str] = FILTER_DIMENSIONS) -> DataFrame:
    """Distinct known values of each dimension, one (dimension, value) row each (P5).

    All dimensions come out of one scan.
    """
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), col(d).alias("value")) for d in dimensions]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dimension", "value")
    )


def filter_bounds(df: DataFrame, price: str = "Price") -> DataFrame:
    """Row count, date range, and price range widened to whole numbers."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(col("Date of Transfer")).cast("date").alias("first_date"),
        F.max(col("Date of Transfer")).cast("date").alias("last_date"),
        F.floor(F.min(col(price))).cast("double").alias("min_price"),
        F.ceil(F.max(col(price))).cast("double").alias("max_price"),
    )


def contains(c: str, needle: str, regex: bool = False) -> Column:
    """Case-insensitive search in a column."""
    if regex:
        return col(c).rlike(f"(?i){needle}")
    return F.lower(col(c)).contains(needle.lower())


def lookup_area(df: DataFrame, needle: str) -> DataFrame:
    """Sales whose street or postcode contains the needle."""
    wanted = needle.strip().upper()
    return df.where(col("Street").contains(wanted) | col("Postcode").contains(wanted))


def streets_of(df: DataFrame, postcode: str) -> DataFrame:
    """Sorted streets met under a postcode fragment (P10)."""
    found = df.where(contains("Postcode", postcode) & col("Street").isNotNull())
    return found.select("Street").distinct().orderBy("Street")


def select_area(df: DataFrame, postcode: str, streets: Iterable[str] = ()) -> DataFrame:
    """Sales under a postcode fragment, in the chosen streets when any are given."""
    found = df.where(contains("Postcode", postcode))
    streets = list(streets)
    return found.where(col("Street").isin(streets)) if streets else found


# --- headline figures --------------------------------------------------------------


def kpis(df: DataFrame, price: str = "Price") -> DataFrame:
    """Median, mean and number of sales (A1)."""
    return grouped_median(df, [], price, "median_price", mean="mean_price", count="n")


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, written once: figures that need several passes do not clean the sales anew for each."""
    return settle(df.select(*[col(c) for c in dict.fromkeys(columns)]), "sales")


def last_years(df: DataFrame, years: int = 2) -> DataFrame:
    """Sales of the latest years only, tagged with the latest year."""
    latest = df.agg(F.max("Year")).scalar()
    return df.where(F.col("Year") > latest - years).withColumn("__latest", latest)


def latest_two(medians: DataFrame, keys: Sequence[str], value: str) -> list[Column]:
    """Latest-year and previous-year value out of per-year rows that carry `__latest`."""
    gap = F.col("__latest") - F.col("Year")
    return [F.max(F.when(gap == back, col(value))) for back in (0, 1)]


def yoy_median(df: DataFrame, price: str = "Price") -> DataFrame:
    """Change of the median from the year before the latest year to the latest (A2).

    Null when either year has no sales or the earlier median is not positive.
    """
    medians = grouped_median(last_years(settled(df, "Year", price)), ["Year", "__latest"], price)
    now, before = latest_two(medians, [], "median")
    return (
        medians.agg(
            F.max("__latest").cast("bigint").alias("latest_year"),
            now.alias("median_latest"),
            before.alias("median_previous"),
        )
        .withColumn(
            "yoy",
            F.when(
                F.col("median_previous") > 0,
                F.col("median_latest") / F.col("median_previous") - 1.0,
            ),
        )
    )


def median_by_type(df: DataFrame, price: str = "Price", kind: str = "Property Type") -> DataFrame:
    """Median per property type, dearest first (A4)."""
    return grouped_median(df, [kind], price, "median_price").orderBy(
        F.desc("median_price"), col(kind)
    )


def top_type(df: DataFrame, price: str = "Price", kind: str = "Property Type") -> DataFrame:
    """Property type with the highest median (A3)."""
    return median_by_type(df, price, kind).limit(1)


def has_several_years(df: DataFrame) -> Column:
    """Whether more than one year is present (A28), as a scalar subquery."""
    return df.agg(F.min("Year") < F.max("Year")).scalar()


def year_count(df: DataFrame) -> DataFrame:
    """Number of distinct years."""
    return df.agg(F.count_distinct("Year").alias("years"))


def monthly_medians(
    df: DataFrame, price: str = "Price", always: bool = False
) -> DataFrame:
    """Median per year and month in calendar order.

    Unless `always` is set the result is empty when there is only one year to show.
    """
    shown = df if always else df.where(has_several_years(df))
    return grouped_median(shown, ["Year", "Month", "Month Name"], price, "median_price").orderBy(
        "Year", "Month"
    )


def monthly_counts(df: DataFrame) -> DataFrame:
    """Sales per year and month in calendar order, when several years are present."""
    return (
        df.where(has_several_years(df))
        .groupBy("Year", "Month", col("Month Name"))
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy("Year", "Month")
    )


def yearly_counts(df: DataFrame) -> DataFrame:
    """Sales per year."""
    return (
        df.where(F.col("Year").isNotNull())
        .groupBy("Year")
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy("Year")
    )


# --- areas -------------------------------------------------------------------------


def location_stats(df: DataFrame, level: str, price: str = "Price") -> DataFrame:
    """Mean, median and number of sales per area."""
    return grouped_median(df, [level], price, "median_price", mean="mean_price", count="n")


def top_or_all(
    df: DataFrame, key: str, by: str, n: int = 20, threshold: int = 25
) -> DataFrame:
    """Highest `n` rows when there are more than `threshold`, else all, lowest first."""
    ordered = [F.desc(by), col(key)]
    # Only threshold + 1 rows are needed to tell whether all are to be shown.
    head = df.orderBy(*ordered).limit(max(n, threshold + 1))
    numbered = head.selectExpr(
        "*",
        f"row_number() over (order by `{by}` desc, `{key}`) as __rank",
        "count(1) over () as __seen",
    )
    keep = (F.col("__seen") <= threshold) | (F.col("__rank") <= n)
    return numbered.where(keep).drop("__rank", "__seen").orderBy(F.asc(by), F.desc(f"`{key}`"))


def location_growth(
    df: DataFrame, level: str, price: str = "Price", every_year: bool = True
) -> DataFrame:
    """Growth of the yearly median per area, in per cent.

    With `every_year` an area is kept only when it has sales in every year of the data;
    otherwise the latest two years suffice. The result is empty when the year before the
    latest is missing altogether.
    """
    placed = settled(df, level, "Year", price).where(col(level).isNotNull() & F.col("Year").isNotNull())
    if every_year:
        span = placed.agg(F.max("Year").alias("last"), F.count_distinct("Year").alias("years"))
        tagged = placed.withColumn("__latest", span.select("last").scalar())
        needed = span.select("years").scalar()
    else:
        tagged, needed = last_years(placed), F.lit(2)
    medians = grouped_median(tagged, [level, "Year", "__latest"], price)
    now, before = latest_two(medians, [level], "median")
    return (
        medians.groupBy(col(level))
        .agg(
            now.alias("median_latest"),
            before.alias("median_previous"),
            F.count(F.lit(1)).alias("__years"),
        )
        .where((F.col("__years") == needed) & F.col("median_previous").isNotNull())
        .drop("__years")
        .withColumn(
            "growth_pct", percent_change(F.col("median_latest"), F.col("median_previous"))
        )
    )


def area_by_year(df: DataFrame, level: str, price: str = "Price") -> DataFrame:
    """Median and number of sales per area and year."""
    return grouped_median(df, [level, "Year"], price, "median_price", count="volume")


def area_ranking(df: DataFrame, level: str, price: str = "Price") -> DataFrame:
    """Areas by latest-year median with the change on the year before.

    Only the last two years are read into the medians, and both years of an area meet in one
    aggregate in place of a self-join.
    """
    recent = last_years(settled(df, level, "Year", price).where(col(level).isNotNull()))
    yearly = grouped_median(recent, [level, "Year", "__latest"], price, count="n")
    now, before = latest_two(yearly, [level], "median")
    volume, _ = latest_two(yearly, [level], "n")
    return (
        yearly.groupBy(col(level))
        .agg(
            F.max("__latest").alias("Year"),
            now.alias("median_price"),
            volume.alias("volume"),
            before.alias("median_prev"),
        )
        .where(F.col("median_price").isNotNull())
        .withColumn("yoy_pct", percent_change(F.col("median_price"), F.col("median_prev")))
        .orderBy(F.desc("median_price"), col(level))
    )


def top_movers(df: DataFrame, level: str, price: str = "Price", n: int = 20) -> DataFrame:
    """Areas with the highest change of the median (T5)."""
    return (
        area_ranking(df, level, price)
        .where(F.col("yoy_pct").isNotNull())
        .orderBy(F.desc("yoy_pct"), col(level))
        .limit(n)
    )


def outward_top(df: DataFrame, price: str = "Price", n: int = 30) -> DataFrame:
    """Outward codes with the highest median."""
    return (
        grouped_median(df, ["Outward"], price, "median_price")
        .orderBy(F.desc("median_price"), "Outward")
        .limit(n)
    )


def sector_stats(df: DataFrame, price: str = "Price") -> DataFrame:
    """Median and number of sales per postcode sector."""
    return grouped_median(df, ["Postcode Sector"], price, "median_price", count="volume")


def sector_map(df: DataFrame, centroids: DataFrame, price: str = "Price") -> DataFrame:
    """Sector figures with the coordinates of their centroid.

    Both sides have one row per sector, so the join needs no hint.
    """
    return sector_stats(df, price).join(centroids, "Postcode Sector")


# --- one area ----------------------------------------------------------------------


def most_common(df: DataFrame, column: str) -> DataFrame:
    """Most frequent known value, the smallest one on a tie."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col(column))
        .limit(1)
    )


def highest_sale(
    df: DataFrame,
    columns: Sequence[str],
    price: str = "Price",
    tie: str = "Transaction ID",
) -> DataFrame:
    """The sale with the highest price, the lowest identifier on a tie."""
    return df.select(*[col(c) for c in dict.fromkeys([tie, price, *columns])]).orderBy(
        F.desc(f"`{price}`"), col(tie)
    ).limit(1)


def listing(
    df: DataFrame, columns: Sequence[str], newest_first: bool = True, tie: str = "Transaction ID"
) -> DataFrame:
    """Sales in date order, newest first or as a timeline."""
    date = F.col("`Date of Transfer`")
    order = date.desc() if newest_first else date.asc()
    return df.select(*[col(c) for c in columns]).orderBy(order, col(tie))


def area_summary(df: DataFrame, price: str = "Price") -> DataFrame:
    """Key figures of a selected area in one row."""
    df = settled(df, "Property Type", "Year", price)
    common = most_common(df, "Property Type").select(col("Property Type")).scalar()
    yoy = yoy_median(df, price)
    change = yoy.select(
        percent_change(F.col("median_latest"), F.col("median_previous"))
    ).scalar()
    return kpis(df, price).withColumns({"yoy_pct": change, "common_type": common})
