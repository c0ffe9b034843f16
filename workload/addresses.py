"""Linkage of sales and certificates, and address cohorts."""

from pyspark.sql import functions as F

from gableframe.functions import address as A
from gableframe.operators import linkage as K
from gableframe.plans import cohort as C
from gableframe.sources.lake import address_export
from workload.registry import certificates, lake, register
from workload.twins import CERTS, LAKE, both
from workload.views import raw_sales

SALE_KEY = (
    "regexp_replace(upper(coalesce(\"SAON\", '') || ' ' || coalesce(\"PAON\", '') || ' ' || "
    "coalesce(\"Street\", '')), '[^A-Z0-9]', '', 'g')"
)
_DATES = ", ".join(
    f"try_strptime({c}, '{f}')"
    for c in ('"INSPECTION_DATE"', '"LODGEMENT_DATE"')
    for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S")
)
LINK = both(LAKE, CERTS) + f""", p as (select *, {SALE_KEY} as k from lake), e as (
  select *, coalesce({_DATES})::date as epc_date from certs), linked as (
  select p."Transaction ID", e."LMK_KEY" as epc_lmk_key, p."Date of Transfer", e.epc_date,
    abs(date_diff('day', e.epc_date, p."Date of Transfer")) as days_diff, p.sale_year, p.sale_month
  from p join e on p."Postcode" = e.postcode_norm and p.k = e.addr_key
  where date_diff('day', e.epc_date, p."Date of Transfer") between -180 and 365)
"""
LINKED = ["Transaction ID", "epc_lmk_key", "Date of Transfer", "epc_date", "days_diff", "sale_year", "sale_month"]
LINKED_SQL = ", ".join(f'"{c}"' for c in LINKED)


def linked(spark, sf_dir, how="inner"):
    return K.link(lake(spark, sf_dir), certificates(spark, sf_dir), how=how, columns=LINKED)


register("link", lambda s, d: K.by_sale_month(linked(s, d)), LINK + f"select {LINKED_SQL} from linked")
register(
    "link_left",
    lambda s, d: linked(s, d, "left"),
    LINK
    + f"""select {LINKED_SQL} from linked union all select "Transaction ID", null, "Date of Transfer", null, null,
    sale_year, sale_month from lake where "Transaction ID" not in (select "Transaction ID" from linked)""",
)
register(
    "link_full",
    lambda s, d: linked(s, d, "full"),
    LINK
    + f"""select {LINKED_SQL} from linked union all select "Transaction ID", null, "Date of Transfer", null, null,
    sale_year, sale_month from lake where "Transaction ID" not in (select "Transaction ID" from linked)
    union all select null, "LMK_KEY", null, epc_date, null, null, null from e
    where "LMK_KEY" not in (select epc_lmk_key from linked)""",
)
register(
    "closest_links",
    lambda s, d: K.closest_links(linked(s, d)),
    LINK + f"""select {LINKED_SQL} from linked order by days_diff, "Transaction ID", epc_lmk_key limit 20""",
)

CONTAINED = ["Transaction ID", "epc_lmk_key", "days_diff", "tier"]


def word_list(*columns):
    text = "upper(concat_ws(' ', " + ", ".join(f'"{c}"' for c in columns) + "))"
    return f"list_sort(list_distinct(regexp_extract_all({text}, '[A-Z0-9]+')))"


register(
    "link_contained",
    lambda s, d: K.link_contained(lake(s, d), certificates(s, d), columns=CONTAINED),
    both(LAKE, CERTS)
    + f""", p as (select *, {SALE_KEY} as k, {word_list("SAON", "PAON", "Street")} as needs from lake), e as (
    select *, coalesce({_DATES})::date as epc_date, {word_list("ADDRESS1", "ADDRESS2", "ADDRESS3")} as has from certs)
    select p."Transaction ID", e."LMK_KEY" as epc_lmk_key, abs(date_diff('day', e.epc_date, p."Date of Transfer")) as days_diff,
      case when p.k = e.addr_key then 1 else 2 end::bigint as tier
    from p join e on p."Postcode" = e.postcode_norm and list_has_all(e.has, p.needs) and len(p.needs) > 0
    where date_diff('day', e.epc_date, p."Date of Transfer") between -180 and 365
      and (upper(coalesce(p."Property Type", '')) <> 'F' or upper(coalesce(e."PROPERTY_TYPE", '')) in ('FLAT', 'MAISONETTE'))""",
)

# --- preparation of both sides -----------------------------------------------------

UP = r"trim(regexp_replace(upper({c}), '\s+', ' ', 'g'))"
DEP = r"trim(regexp_replace(regexp_replace({c}, '[^\w\s/]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm(c):
    return DEP.format(c=UP.format(c=c))


STREETS_FULL = " ".join(f"when '{k}' then '{v}'" for k, v in A.STREET_WORDS.items())


def street(c):
    parts = f"list_filter(string_split(coalesce({c}, ''), ' '), lambda w: w <> '')"
    return f"nullif(array_to_string(list_transform({parts}, lambda w: case w {STREETS_FULL} else w end), ' '), '')"


def names(c):
    parts = f"string_split(coalesce({c}, ''), ' ')"
    return rf"nullif(array_to_string(list_filter({parts}, lambda w: w <> '' and not regexp_full_match(w, '\d+')), ' '), '')"


def first(c):
    return rf"try_cast(nullif(regexp_extract({c}, '\b(\d{{1,5}})\b', 1), '') as bigint)"


FLAT = r"try_cast(nullif(regexp_extract({c}, '\b(?:FLAT|APT|APARTMENT)\s*(\d{{1,4}})\b', 1), '') as bigint)"
HOUSE = "|".join(A.HOUSE_WORDS)
SALE_PREP = f"""with raw as ({LAKE.split('with raw as (', 1)[1].split('), keyed as (', 1)[0]}), a as (
  select "Transaction ID", {street(norm('"Street"'))} as "Street_norm", {norm('"PAON"')} as paon, {norm('"SAON"')} as "SAON_norm"
  from raw), b as (
  select *, {first('paon')} as num, {names('paon')} as name from a), c as (
  select *, nullif(concat_ws(' ', num::varchar, name), '') as "PAON_number_name" from b), d as (
  select *, case when num is not null then try_cast(num as bigint)
    else try_cast(split_part("PAON_number_name", ' ', 1) as bigint) end as paon_num,
    nullif(regexp_replace("PAON_number_name", '^\\d+(\\s+|$)', ''), '') as paon_name,
    {FLAT.format(c='"SAON_norm"')} as flat_num,
    nullif(trim(concat_ws(' ', nullif("SAON_norm", ''), nullif("PAON_number_name", ''), nullif("Street_norm", ''))), '') as full_norm,
    {names("concat_ws(' ', paon, " + '"SAON_norm")')} as any_name from c)
"""
register(
    "prep_sales_addresses",
    lambda s, d: K.prep_sales_addresses(raw_sales(s, d)).select(
        "Transaction ID", "Street_norm", "SAON_norm", "PAON_number_name", "paon_num", "paon_name", "flat_num",
        "building_name", "full_norm", "source_dataset",
    ),
    SALE_PREP
    + rf"""select "Transaction ID", "Street_norm", "SAON_norm", "PAON_number_name", paon_num, paon_name, flat_num,
    case when regexp_matches(paon_name, '(^| )({HOUSE})( |$)') then paon_name else any_name end as building_name,
    full_norm, 'ppd' as source_dataset from d""",
)
ROAD = r"\b(ROAD|ST|STREET|RD|DRIVE|AV|AVE|AVENUE|LANE|CRES|CRESCENT|COURT|GARDENS|PLACE|GROVE)\b"
CERT_PREP = CERTS + f""", a as (
  select "LMK_KEY", {norm('"ADDRESS1"')} as a1, {norm('"ADDRESS2"')} as a2, {norm('"ADDRESS3"')} as a3 from certs), b as (
  select *, case when regexp_matches(a3, '{ROAD}') then a3 when regexp_matches(a2, '{ROAD}') then a2
    when regexp_matches(a1, '{ROAD}') then a1
    when coalesce(length(a1), 0) >= greatest(coalesce(length(a2), 0), coalesce(length(a3), 0)) then a1
    when coalesce(length(a2), 0) >= coalesce(length(a3), 0) then a2 else a3 end as guess,
    nullif(trim(concat_ws(' ', nullif(a1, ''), nullif(a2, ''))), '') as blob,
    nullif(trim(concat_ws(' ', nullif(a1, ''), nullif(a2, ''), nullif(a3, ''))), '') as full_norm from a)
"""
register(
    "prep_certificate_addresses",
    lambda s, d: K.prep_certificate_addresses(certificates(s, d)).select(
        "LMK_KEY", "Street_norm", "paon_num", "building_name", "PAON_number_name", "flat_num", "full_norm", "source_dataset"
    ),
    CERT_PREP
    + f"""select "LMK_KEY", {street('guess')} as "Street_norm", {first('blob')} as paon_num, {names('full_norm')} as building_name,
    nullif(concat_ws(' ', nullif({first('blob')}, 0)::varchar, {names('full_norm')}), '') as "PAON_number_name",
    {FLAT.format(c='full_norm')} as flat_num, full_norm, 'epc' as source_dataset from b""",
)
register(
    "dense_row_ids",
    lambda s, d: K.dense_ids(lake(s, d).select("Transaction ID", "Price"), "Transaction ID"),
    LAKE
    + """select "Transaction ID", "Price", row_number() over (order by md5('0|' || "Transaction ID")) as unique_id
    from lake""",
)
register(
    "joined_address_lines",
    lambda s, d: certificates(s, d)
    .select("LMK_KEY", A.join_strict(F.col("ADDRESS1"), F.col("ADDRESS2"), F.col("ADDRESS3")).alias("lines"))
    .where("lines is not null"),
    CERTS + """select "LMK_KEY", "ADDRESS1" || ' ' || "ADDRESS2" || ' ' || "ADDRESS3" as lines from certs
    where "ADDRESS1" || ' ' || "ADDRESS2" || ' ' || "ADDRESS3" is not null""",
)

# --- cohort ------------------------------------------------------------------------

ADDRESSES = LAKE + """, addr as (select "Transaction ID" as id, trim("Property Type") as property_type,
  upper(trim("Postcode")) as postcode, trim("PAON") as paon, trim("SAON") as saon, trim("Street") as street,
  trim("Locality") as locality, trim("Town/City") as town_city from lake)
"""
NUM = r"'^\s*(\d+[A-Za-z]?(?:\s*-\s*\d+[A-Za-z]?)?)\s*$'"
NAME_NUM = r"'^([A-Za-z][A-Za-z\s''&\.-]*?)\s*(?:,?\s*)(\d+[A-Za-z]?)\s*$'"
NAME = r"'^\s*([A-Za-z][A-Za-z\s''&\.-]*)\s*$'"
FLATS = r"'(?i)^\s*(flat|apartment|apt|appts|room|unit|annexe?|block|blk|studio)\s+[0-9]+[A-Za-z]?\s*$'"
PC = (
    r"'(?i)^\s*((?:GIR\s?0AA)|(?:[A-PR-UWYZ][0-9][0-9A-HJKMNPR-Y]?)|(?:[A-PR-UWYZ][A-HK-Y][0-9][0-9A-HJKMNPR-Y]?))"
    r"\s*([0-9][ABD-HJLNP-UW-Z]{2})\s*$'"
)
COHORT = ADDRESSES + rf""", pat as (
  select *, regexp_matches(paon, {NUM}) as pn, regexp_matches(paon, {NAME_NUM}) as pnn, regexp_matches(paon, {NAME}) as pna,
    regexp_matches(saon, {FLATS}) or regexp_matches(saon, '^\s*\d+[A-Za-z]?\s*$')
      or regexp_matches(saon, '^[A-Za-z0-9][A-Za-z0-9\s''&\.-]*$') as sok,
    nullif(regexp_extract(postcode, {PC}, 1), '') as oc, nullif(regexp_extract(postcode, {PC}, 2), '') as ic from addr), cohort as (
  select property_type, case when pnn then regexp_extract(paon, {NAME_NUM}, 1) when pna then regexp_extract(paon, {NAME}, 1) end
    as "BuildingName",
    case when pnn then regexp_extract(paon, {NAME_NUM}, 2) when pn then regexp_extract(paon, {NUM}, 1) end as "BuildingNumber",
    case when sok then saon end as "SubBuildingName", street as "StreetName", locality as "Locality", town_city as "TownName",
    oc || ' ' || ic as "Postcode", oc as "Outcode", ic as "Incode"
  from pat where (pn or pnn or pna) and oc is not null and ic is not null
    and ((property_type = 'F' and sok) or (property_type <> 'F' and (saon is null or saon = ''))))
"""


def addresses(spark, sf_dir):
    return address_export(lake(spark, sf_dir)).drop("sale_year")


def cohort(spark, sf_dir):
    return C.address_cohort(addresses(spark, sf_dir))


register("address_cohort", cohort, COHORT + "select * from cohort")
register(
    "cohort_without_copies",
    lambda s, d: C.without_copies(cohort(s, d)),
    COHORT + "select distinct * from cohort",
)
register(
    "cohort_named_and_numbered",
    lambda s, d: C.named_and_numbered(cohort(s, d)),
    COHORT + 'select * from cohort where "BuildingName" is not null and "BuildingNumber" is not null',
)
register(
    "rows_with_signal",
    lambda s, d: addresses(s, d).where(C.has_signal(F.col("saon"), F.col("locality"))).select("paon", "saon", "locality"),
    LAKE
    + """select "PAON" as paon, "SAON" as saon, "Locality" as locality from lake
    where coalesce(trim("SAON"), '') <> '' or coalesce(trim("Locality"), '') <> ''""",
)
for _column in ("county", "locality"):
    register(
        f"distinct_{_column}",
        lambda s, d, c=_column: C.place_names(addresses(s, d), c),
        LAKE
        + rf"""select distinct upper(regexp_replace(trim("{_column.title()}"), '\s+', ' ', 'g')) as {_column} from lake
        where trim("{_column.title()}") <> ''""",
    )
register(
    "address_patterns_house",
    lambda s, d: C.address_patterns(addresses(s, d), "house"),
    LAKE
    + """select distinct "Property Type" as property_type, "PAON" as paon, "SAON" as saon from lake
    where "PAON" is not null and trim("PAON") <> '' and lower("PAON") like '%house%' and "Property Type" <> 'F'""",
)
register(
    "address_patterns_flats",
    lambda s, d: C.address_patterns(addresses(s, d), column="saon"),
    LAKE
    + """select distinct "Property Type" as property_type, "PAON" as paon, "SAON" as saon from lake
    where "SAON" is not null and "Property Type" <> 'F'""",
)
