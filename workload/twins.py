"""DuckDB SQL shared by the twins: cleaned sales, enriched sales and certificates."""

from gableframe.schema import CODES
from workload.views import raw_certificates_sql, raw_sales_sql

BLANKS = r"E' \t\n\r\x0b\x0c'"
PREFIX = r"'^([A-Z]{1,2}\d{1,2}[A-Z]?)'"
PREFIX_SECTOR = r"'^([A-Z]{1,2}\d{1,2}[A-Z]?)\s*(\d)'"
WHOLE = r"'^([A-Z]{1,2}[0-9][0-9A-Z]?) ?([0-9])[A-Z]{2}$'"


def standard(c: str) -> str:
    return f"nullif(upper(trim({c}, {BLANKS})), 'NAN')"


def expanded(c: str) -> str:
    name = c.strip('"')
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in CODES[name].items())
    return f"case upper({c}) {whens} else {c} end"


def outward(c: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({c}, {WHOLE}, 1), ''), "
        f"nullif(regexp_extract({c}, {PREFIX}, 1), ''))"
    )


def sector(c: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({c}, {WHOLE}, 2), ''), "
        f"nullif(regexp_extract({c}, {PREFIX_SECTOR}, 2), ''))"
    )


# Common table expressions up to `sales`, the cleaned table.
SALES = f"""with raw as ({raw_sales_sql()}), parsed as (
  select "Transaction ID", try_cast(trim("Price") as double) as "Price",
    try_cast(trim("Date of Transfer") as timestamp) as "Date of Transfer",
    {standard('"Postcode"')} as "Postcode",
    {expanded('"Property Type"')} as "Property Type", {expanded('"Old/New"')} as "Old/New",
    {expanded('"Duration"')} as "Duration",
    {standard('"PAON"')} as "PAON", {standard('"SAON"')} as "SAON", {standard('"Street"')} as "Street",
    {standard('"Locality"')} as "Locality", {standard('"Town/City"')} as "Town/City",
    {standard('"District"')} as "District", {standard('"County"')} as "County",
    {expanded('"PPD Category Type"')} as "PPD Category Type", {expanded('"Record Status"')} as "Record Status"
  from raw), sales as (
  select *, year("Date of Transfer") as "Year", month("Date of Transfer") as "Month",
    quarter("Date of Transfer") as "Quarter", monthname("Date of Transfer") as "Month Name",
    day("Date of Transfer") as "Day", {outward('"Postcode"')} as "Outward", {sector('"Postcode"')} as "Sector",
    trim(concat_ws(' ', {outward('"Postcode"')}, {sector('"Postcode"')})) as "Postcode Sector",
    trim(regexp_replace(coalesce("PAON", '') || '|' || coalesce("SAON", '') || '|' || coalesce("Street", '')
      || '|' || coalesce("Postcode", ''), '\\s+', ' ', 'g')) as "ADDRESS_ID"
  from parsed where "Price" is not null and "Date of Transfer" is not null)
"""

# Common table expressions up to `lake`, the sales with lake columns.
LAKE = f"""with raw as ({raw_sales_sql()}), keyed as (
  select * exclude ("Date of Transfer", "Postcode", "Price"), try_cast(trim("Price") as double) as "Price",
    coalesce(try_strptime(split_part("Date of Transfer", ' ', 1), '%Y-%m-%d'),
      try_strptime(split_part("Date of Transfer", ' ', 1), '%d/%m/%Y'))::date as "Date of Transfer",
    replace(upper("Postcode"), ' ', '') as "Postcode" from raw), split as (
  select *, strftime("Date of Transfer", '%Y') as sale_year, strftime("Date of Transfer", '%m') as sale_month,
    {outward('"Postcode"')} as "Outward", {sector('"Postcode"')} as "Sector" from keyed), lake as (
  select *, trim(concat_ws(' ', "Outward", "Sector")) as "Postcode Sector",
    coalesce(case when length("Outward") >= 2 then substr("Outward", 1, 2) end, 'ZZ') as outcode2
  from split where "Date of Transfer" is not null and "Price" is not null)
"""

ADDR_KEY = (
    "regexp_replace(upper(coalesce(\"ADDRESS1\", '') || ' ' || coalesce(\"ADDRESS2\", '') || ' ' || "
    "coalesce(\"ADDRESS3\", '')), '[^A-Z0-9]', '', 'g')"
)
_TRIES = ", ".join(
    f"try_strptime({c}, '{f}')"
    for c in ("LODGEMENT_DATE", "INSPECTION_DATE")
    for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S")
)
# Common table expressions up to `certs`, the enriched certificates.
CERTS = f"""with rawc as ({raw_certificates_sql()}), certs as (
  select *, replace(upper("POSTCODE"), ' ', '') as postcode_norm, cast(coalesce({_TRIES}) as date) as lodgement_dt,
    case when length(replace(upper("POSTCODE"), ' ', '')) >= 4
      then substr(replace(upper("POSTCODE"), ' ', ''), 1, length(replace(upper("POSTCODE"), ' ', '')) - 3) end as outcode,
    case when length(replace(upper("POSTCODE"), ' ', '')) >= 2
      then substr(replace(upper("POSTCODE"), ' ', ''), 1, 2) end as outcode2,
    strftime(cast(coalesce({_TRIES}) as date), '%Y') as lodgement_year, {ADDR_KEY} as addr_key
  from rawc)
"""


def both(first: str, second: str) -> str:
    """One list of common table expressions out of two."""
    return first.rstrip() + ", " + second.removeprefix("with ")
