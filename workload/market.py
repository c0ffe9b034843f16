"""Market figures, areas, series, repeat sales and quality over cleaned sales."""

from pyspark.sql import functions as F

from gableframe.operators import market as M
from gableframe.operators import quality as Q
from gableframe.operators import series as S
from workload.registry import on_sales, register, sales
from workload.twins import SALES
from workload.views import table

LISTED = [
    "Transaction ID", "Date of Transfer", "Price", "Property Type", "Duration", "Old/New",
    "PAON", "SAON", "Street", "Postcode", "District", "Town/City",
]
LISTED_SQL = ", ".join(
    f'cast("{c}" as date) as "{c}"' if c == "Date of Transfer" else f'"{c}"' for c in LISTED
)
PAIRS = """, repeats as (
  select *, lead("Price") over w as next_price, lead("Date of Transfer") over w as next_date
  from sales window w as (partition by "ADDRESS_ID" order by "Date of Transfer", "Transaction ID")), pairs as (
  select *, (next_price / "Price" - 1.0) * 100 as ret_pct,
    date_diff('day', "Date of Transfer", next_date) / 30.44::double as months
  from repeats where next_price is not null and next_date is not null)
"""
MONTHLY = """, m as (select date_trunc('month', "Date of Transfer")::date as month, median("Price") as mp,
    avg("Price") as ap, count(*) as n from sales group by 1), cal as (
  select unnest(generate_series((select min(month) from m)::timestamp, (select max(month) from m)::timestamp,
    interval 1 month))::date as month), series as (
  select cal.month, mp, ap, coalesce(n, 0) as n from cal left join m using (month))
"""
RANKING = """, g as (select "{level}", "Year", median("Price") as median_price, count(*) as volume
  from sales where "{level}" is not null group by 1, 2), ranking as (
  select a."{level}", a."Year", a.median_price, a.volume, b.median_price as median_prev,
    (a.median_price / b.median_price - 1.0) * 100 as yoy_pct
  from (select * from g where "Year" = (select max("Year") from g)) a
  left join (select * from g where "Year" = (select max("Year") - 1 from g)) b using ("{level}"))
"""
GROWTH = """, g as (select "{level}", "Year", median("Price") as m from sales where "{level}" is not null group by 1, 2),
  l as (select max("Year") as y, count(distinct "Year") as n from g), growth as (
  select "{level}", max(case when "Year" = y then m end) as median_latest,
    max(case when "Year" = y - 1 then m end) as median_previous from g, l group by "{level}", n
  having count(*) = n), grown as (select *, (median_latest / median_previous - 1.0) * 100 as growth_pct
  from growth where median_previous is not null)
"""
SEVERAL = '(select count(distinct "Year") from sales) > 1'
TOP = """, total as (select count(*) as c from {src}), ordered as (
  select *, row_number() over (order by {by} desc, "{key}") as r from {src})
  select {cols} from ordered, total where c <= 25 or r <= 20"""


def top(src: str, key: str, by: str, cols: str) -> str:
    return TOP.format(src=src, key=key, by=by, cols=cols)


# --- filters -----------------------------------------------------------------------

on_sales(
    "filter_sales",
    lambda df: M.filter_sales(
        df,
        dates=("1996-01-15", "1999-06-30"),
        prices=(50_000, 300_000),
        county=["ASIA", "EUROPE", "AFRICA"],
        property_type=["Detached", "Flat/Maisonette"],
        duration=[],
    ).select("Transaction ID", "Price", "Date of Transfer", "County", "Property Type"),
    """select "Transaction ID", round("Price", 6) as "Price", "Date of Transfer"::date as "Date of Transfer",
    "County", "Property Type" from sales
    where "Date of Transfer" between timestamp '1996-01-15' and timestamp '1999-06-30'
    and "Price" between 50000 and 300000 and "County" in ('ASIA', 'EUROPE', 'AFRICA')
    and "Property Type" in ('Detached', 'Flat/Maisonette')""",
)
on_sales(
    "filter_options",
    M.filter_options,
    " union ".join(
        f"""select '{d}' as dimension, "{d}" as value from sales where "{d}" is not null"""
        for d in ("County", "District", "Town/City", "Outward", "Property Type", "Old/New", "Duration")
    ),
)
on_sales(
    "filter_bounds",
    M.filter_bounds,
    """select count(*) as n, min("Date of Transfer")::date as first_date, max("Date of Transfer")::date as last_date,
    floor(min("Price")) as min_price, ceil(max("Price")) as max_price from sales""",
)
on_sales(
    "postcode_contains",
    lambda df: df.where(M.contains("Postcode", "gl1")).select("Transaction ID", "Postcode"),
    """select "Transaction ID", "Postcode" from sales where contains(lower("Postcode"), 'gl1')""",
)
on_sales(
    "street_or_postcode_lookup",
    lambda df: M.lookup_area(df, " church ").select("Transaction ID", "Street", "Postcode"),
    """select "Transaction ID", "Street", "Postcode" from sales
    where contains("Street", 'CHURCH') or contains("Postcode", 'CHURCH')""",
)
on_sales(
    "streets_of_postcode",
    lambda df: M.streets_of(df, "sw"),
    """select distinct "Street" from sales where contains(lower("Postcode"), 'sw') and "Street" is not null""",
)
AREA_STREETS = ["HIGH STREET", "CHURCH RD", "MILL LANE"]
IN_AREA = """, area as (select * from sales where contains(lower("Postcode"), 'gl')
    and "Street" in ('HIGH STREET', 'CHURCH RD', 'MILL LANE'))
"""


def area(df):
    return M.select_area(df, "GL", AREA_STREETS)


on_sales(
    "area_detail_listing",
    lambda df: M.listing(area(df), LISTED),
    IN_AREA + f"select {LISTED_SQL} from area",
)
on_sales(
    "area_timeline",
    lambda df: M.listing(area(df), ["Transaction ID", "Date of Transfer", "Price"], newest_first=False),
    IN_AREA + 'select "Transaction ID", "Date of Transfer"::date as "Date of Transfer", "Price" from area',
)
on_sales(
    "area_summary",
    lambda df: M.area_summary(area(df)),
    IN_AREA + """, y as (select max("Year") as y from area)
    select round(median("Price"), 6) as median_price, round(avg("Price"), 6) as mean_price, count(*) as n,
    round((median("Price") filter (where "Year" = y) / median("Price") filter (where "Year" = y - 1) - 1) * 100, 6)
      as yoy_pct,
    (select "Property Type" from area where "Property Type" is not null group by 1 order by count(*) desc, 1 limit 1)
      as common_type
    from area, y""",
)
on_sales(
    "most_common_type",
    lambda df: M.most_common(df, "Property Type"),
    """select "Property Type", count(*) as n from sales where "Property Type" is not null
    group by 1 order by 2 desc, 1 limit 1""",
)
on_sales(
    "highest_sale",
    lambda df: M.highest_sale(df, ["Property Type", "Street", "Postcode"]),
    """select "Transaction ID", "Price", "Property Type", "Street", "Postcode" from sales
    order by "Price" desc, "Transaction ID" limit 1""",
)

# --- headline figures --------------------------------------------------------------

on_sales(
    "kpis",
    M.kpis,
    """select round(median("Price"), 6) as median_price, round(avg("Price"), 6) as mean_price, count(*) as n from sales""",
)
on_sales(
    "kpis_winsorised",
    lambda df: M.kpis(Q.winsorise(df), "Price_w"),
    """, q as (select quantile_cont("Price", 0.01) as lo, quantile_cont("Price", 0.99) as hi from sales),
    w as (select least(greatest("Price", lo), hi) as p from sales, q)
    select round(median(p), 6) as median_price, round(avg(p), 6) as mean_price, count(*) as n from w""",
)
on_sales(
    "yoy_median",
    M.yoy_median,
    """, y as (select max("Year") as y from sales), v as (
    select y as latest_year, median("Price") filter (where "Year" = y) as median_latest,
    median("Price") filter (where "Year" = y - 1) as median_previous from sales, y group by y)
    select latest_year, round(median_latest, 6) as median_latest, round(median_previous, 6) as median_previous,
    round(case when median_previous > 0 then median_latest / median_previous - 1 end, 6) as yoy from v""",
)
on_sales(
    "top_property_type",
    M.top_type,
    """select "Property Type", round(median("Price"), 6) as median_price from sales where "Property Type" is not null
    group by 1 order by 2 desc, 1 limit 1""",
)
on_sales(
    "median_by_type",
    M.median_by_type,
    """select "Property Type", round(median("Price"), 6) as median_price from sales
    where "Property Type" is not null group by 1""",
)
on_sales(
    "monthly_medians",
    M.monthly_medians,
    f"""select "Year", "Month", "Month Name", round(median("Price"), 6) as median_price from sales
    where {SEVERAL} group by 1, 2, 3""",
)
on_sales(
    "monthly_counts",
    M.monthly_counts,
    f"""select "Year", "Month", "Month Name", count(*) as transactions from sales where {SEVERAL} group by 1, 2, 3""",
)
on_sales(
    "area_monthly_trend",
    lambda df: M.monthly_medians(area(df), always=True),
    IN_AREA
    + """select "Year", "Month", "Month Name", round(median("Price"), 6) as median_price from area group by 1, 2, 3""",
)
on_sales(
    "transactions_per_year",
    M.yearly_counts,
    """select "Year", count(*) as transactions from sales group by 1""",
)
on_sales(
    "distinct_years",
    M.year_count,
    """select count(distinct "Year") as years from sales""",
)

# --- areas -------------------------------------------------------------------------

for _level in ("District", "County", "Town/City"):
    on_sales(
        f"location_stats_{_level.lower().replace('/', '_')}",
        lambda df, level=_level: M.location_stats(df, level),
        f"""select "{_level}", round(median("Price"), 6) as median_price, round(avg("Price"), 6) as mean_price,
        count(*) as n from sales where "{_level}" is not null group by 1""",
    )
STATS = """, stats as (select "{level}", median("Price") as median_price, avg("Price") as mean_price, count(*) as n
    from sales where "{level}" is not null group by 1)"""
STATS_COLS = """"{level}", round(median_price, 6) as median_price, round(mean_price, 6) as mean_price, n"""
on_sales(
    "top_locations_by_median",
    lambda df: M.top_or_all(M.location_stats(df, "District"), "District", "median_price"),
    STATS.format(level="District")
    + top("stats", "District", "median_price", STATS_COLS.format(level="District")),
)
on_sales(
    "top_outwards_by_count",
    lambda df: M.top_or_all(M.location_stats(df, "Outward"), "Outward", "n"),
    STATS.format(level="Outward") + top("stats", "Outward", "n", STATS_COLS.format(level="Outward")),
)
on_sales(
    "location_growth",
    lambda df: M.location_growth(df, "District"),
    GROWTH.format(level="District")
    + """select "District", round(median_latest, 6) as median_latest, round(median_previous, 6) as median_previous,
    round(growth_pct, 6) as growth_pct from grown""",
)
on_sales(
    "top_outwards_by_growth",
    lambda df: M.top_or_all(M.location_growth(df, "Outward"), "Outward", "growth_pct"),
    GROWTH.format(level="Outward")
    + top(
        "grown", "Outward", "growth_pct",
        """"Outward", round(median_latest, 6) as median_latest, round(median_previous, 6) as median_previous,
        round(growth_pct, 6) as growth_pct""",
    ),
)
on_sales(
    "area_by_year",
    lambda df: M.area_by_year(df, "District"),
    """select "District", "Year", round(median("Price"), 6) as median_price, count(*) as volume
    from sales where "District" is not null group by 1, 2""",
)
RANKED = """select "{level}", "Year", round(median_price, 6) as median_price, volume,
    round(median_prev, 6) as median_prev, round(yoy_pct, 6) as yoy_pct from {src}"""
for _level in ("District", "Town/City", "Outward", "Postcode Sector"):
    on_sales(
        f"area_ranking_{_level.lower().replace('/', '_').replace(' ', '_')}",
        lambda df, level=_level: M.area_ranking(df, level),
        RANKING.format(level=_level) + RANKED.format(level=_level, src="ranking"),
    )
on_sales(
    "top_movers",
    lambda df: M.top_movers(df, "Outward"),
    RANKING.format(level="Outward")
    + RANKED.format(level="Outward", src="ranking")
    + ' where yoy_pct is not null order by ranking.yoy_pct desc, "Outward" limit 20',
)
on_sales(
    "outward_top_30",
    M.outward_top,
    """select "Outward", round(median("Price"), 6) as median_price from sales where "Outward" is not null
    group by 1 order by median("Price") desc, 1 limit 30""",
)
on_sales(
    "sector_stats",
    M.sector_stats,
    """select "Postcode Sector", round(median("Price"), 6) as median_price, count(*) as volume from sales group by 1""",
)


def centroids(spark, sf_dir):
    """One centroid per postcode sector of a customer."""
    from gableframe.functions.values import postcode_sector, standardise
    from workload.views import POSTCODE

    sectors = table(spark, sf_dir, "customer").select(
        postcode_sector(standardise(F.expr(POSTCODE))).alias("Postcode Sector"), "c_custkey"
    )
    return (
        sectors.where(F.col("Postcode Sector") != "")
        .groupBy("Postcode Sector")
        .agg(
            (F.lit(50.0) + F.min("c_custkey") % 10).alias("lat"),
            (F.lit(-3.0) + F.min("c_custkey") % 7).alias("lon"),
        )
    )


def _centroids_sql() -> str:
    from workload.twins import outward, sector, standard
    from workload.views import POSTCODE

    return f""", cpc as (select {standard(POSTCODE)} as p, c_custkey from customer), cent as (
    select trim(concat_ws(' ', {outward('p')}, {sector('p')})) as "Postcode Sector",
      50.0::double + min(c_custkey) % 10 as lat, -3.0::double + min(c_custkey) % 7 as lon
    from cpc group by 1 having "Postcode Sector" <> '')
    """


register(
    "sector_map",
    lambda s, d: M.sector_map(sales(s, d), centroids(s, d)),
    SALES
    + _centroids_sql()
    + """, st as (select "Postcode Sector", median("Price") as m, count(*) as volume from sales group by 1)
    select "Postcode Sector", round(m, 6) as median_price, volume, lat, lon from st join cent using ("Postcode Sector")""",
)

# --- series ------------------------------------------------------------------------

on_sales(
    "monthly_series",
    S.monthly_series,
    MONTHLY
    + "select month, round(mp, 6) as median_price, round(ap, 6) as mean_price, n as transactions from series",
)
# Without March 1997, so that the calendar has a gap to fill.
GAP = """, s0 as (select * from sales), sales2 as (
    select * from s0 where not ("Year" = 1997 and "Month" = 3))"""
on_sales(
    "rolling_median",
    lambda df: S.rolling_median(
        S.monthly_series(df.where(~((F.col("Year") == 1997) & (F.col("Month") == 3)))), "median_price", 6
    ),
    GAP
    + MONTHLY.replace("from sales group", "from sales2 group")
    + """select month, round(mp, 6) as median_price, round(ap, 6) as mean_price, n as transactions,
    round(case when count(mp) over w = 6 then quantile_cont(mp, 0.5) over w end, 6) as rolling
    from series window w as (order by month rows between 5 preceding and current row)""",
)
on_sales(
    "seasonal_pivot",
    S.seasonal_pivot,
    'select "Year", '
    + ", ".join(f'round(median("Price") filter (where "Month" = {m}), 6) as m{m}' for m in range(1, 13))
    + ' from sales group by "Year"',
)
on_sales(
    "repeated_addresses",
    lambda df: S.repeated_addresses(df).select("Transaction ID", "ADDRESS_ID", "occurrences"),
    """, c as (select *, count(*) over (partition by "ADDRESS_ID") as occurrences from sales)
    select "Transaction ID", "ADDRESS_ID", occurrences from c where occurrences > 1""",
)
PAIR_COLS = [
    "Transaction ID", "Date of Transfer", "next_date", "Price", "next_price", "ret_pct", "months",
    "Street", "Postcode", "Property Type",
]
on_sales(
    "repeat_sales",
    lambda df: S.repeat_listing(S.repeat_sales(df), PAIR_COLS),
    PAIRS
    + """select "Transaction ID", "Date of Transfer"::date as "Date of Transfer", next_date::date as next_date,
    "Price", next_price, round(ret_pct, 6) as ret_pct, round(months, 6) as months, "Street", "Postcode", "Property Type"
    from pairs""",
)
on_sales(
    "repeat_sales_trend",
    lambda df: S.trend_line(S.repeat_sales(df), "months", "ret_pct"),
    PAIRS
    + """select round(regr_slope(ret_pct, months), 6) as slope, round(regr_intercept(ret_pct, months), 6) as intercept,
    round(regr_r2(ret_pct, months), 6) as r2, count(*) as n from pairs""",
)

# --- quality -----------------------------------------------------------------------

on_sales(
    "percentile_pair",
    Q.percentile_pair,
    """select round(quantile_cont("Price", 0.01), 6) as lo, round(quantile_cont("Price", 0.99), 6) as hi from sales""",
)
on_sales(
    "winsorise",
    lambda df: Q.winsorise(df).select("Transaction ID", "Price", "Price_w"),
    """, q as (select quantile_cont("Price", 0.01) as lo, quantile_cont("Price", 0.99) as hi from sales)
    select "Transaction ID", "Price", round(least(greatest("Price", lo), hi), 6) as "Price_w" from sales, q""",
)
OUTLIER_COLS = [
    "Transaction ID", "Date of Transfer", "Price", "Property Type", "Street", "Postcode", "District", "Town/City",
]
on_sales(
    "outliers",
    lambda df: Q.outliers(df).select(*[f"`{c}`" for c in OUTLIER_COLS]),
    """, q as (select quantile_cont("Price", 0.01) as lo, quantile_cont("Price", 0.99) as hi from sales)
    select "Transaction ID", "Date of Transfer"::date as "Date of Transfer", "Price", "Property Type", "Street",
    "Postcode", "District", "Town/City" from sales, q where "Price" < lo or "Price" > hi""",
)
_ALL = [
    "Transaction ID", "Price", "Date of Transfer", "Postcode", "Property Type", "Old/New", "Duration", "PAON", "SAON",
    "Street", "Locality", "Town/City", "District", "County", "PPD Category Type", "Record Status", "Year", "Month",
    "Quarter", "Month Name", "Day", "Outward", "Sector", "Postcode Sector", "ADDRESS_ID",
]
on_sales(
    "missingness",
    Q.missingness,
    " union all ".join(
        f"""select '{c}' as "column", round(avg(case when "{c}" is null then 1.0 else 0.0 end), 6) as missing from sales"""
        for c in _ALL
    ),
)
for _name, _column in (
    ("category_mix", "PPD Category Type"),
    ("status_mix", "Record Status"),
    ("tenure_mix", "Duration"),
    ("old_new_mix", "Old/New"),
):
    on_sales(
        _name,
        lambda df, column=_column: Q.value_mix(df, column),
        f"""select "{_column}", count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share
        from sales group by 1""",
    )
HIST = """, v as (select {value} as v from sales), l as (select min(v) as lo, max(v) as hi from v)
    select cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1) as bigint) as bin,
    round(lo + (hi - lo) / {bins} * cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins} - 1) as bigint), 6) as start,
    count(*) as n from v, l group by 1, 2"""
on_sales("histogram", Q.histogram, HIST.format(value='"Price"', bins=60))
on_sales("histogram_log", lambda df: Q.histogram(df, log=True), HIST.format(value='ln("Price")', bins=60))
on_sales(
    "box_stats",
    Q.box_stats,
    """, q as (select "Property Type", quantile_cont("Price", 0.25) as q1, median("Price") as med,
    quantile_cont("Price", 0.75) as q3 from sales where "Property Type" is not null group by 1), b as (
    select s."Property Type", q1, med, q3, "Price" as p,
      "Price" between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside
    from sales s join q on s."Property Type" = q."Property Type")
    select "Property Type", round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
    min(p) filter (where inside) as lower_whisker, max(p) filter (where inside) as upper_whisker,
    count(*) filter (where not inside) as outliers from b group by "Property Type", q1, med, q3""",
)
on_sales(
    "density_by_type",
    Q.density,
    """, l as (select "Property Type", min("Price") as lo, max("Price") as hi, count(*) as total from sales
    where "Property Type" is not null group by 1), b as (
    select s."Property Type", lo, hi, total,
      cast(least(floor(("Price" - lo) / (hi - lo) * 40), 39) as bigint) as bin
    from sales s join l on s."Property Type" = l."Property Type")
    select "Property Type", bin, round(lo + (hi - lo) / 40 * bin, 6) as start, count(*) as n,
    round(count(*) / total, 6) as share from b group by "Property Type", lo, hi, total, bin""",
)
on_sales(
    "complete_model_rows",
    lambda df: Q.drop_incomplete(df, ["Price", "Property Type", "Old/New", "Duration", "Year", "Month"]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ln("Price")).alias("log_price")
    ),
    """select count(*) as n, round(sum(ln("Price")), 6) as log_price from sales where "Price" is not null
    and "Property Type" is not null and "Old/New" is not null and "Duration" is not null""",
)
