"""Sales-like and certificate-like raw tables, stated once for Spark and for DuckDB.

The expressions are plain SQL that both engines read, so that the input of a query and of its
twin is the same. They hold the flaws that cleaning has to deal with: codes in either case,
padded text, missing parts, prices and dates that are none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# House numbers, and letters for houses that have a name alone, are made of the whole key: addresses
# grow with the customers.
NUMBER = "cast(c_custkey + 1 as string)"
LETTERS = "translate(cast(c_custkey as string), '0123456789', 'abcdefghij')"
NAME = "(case c_custkey % 4 when 0 then 'Pond' when 1 then 'Rose' when 2 then 'Mill' else 'Oak' end)"
# Two letters and one or two digits, a closing letter for one area in six.
OUT = (
    "replace(substr('GLSWB EXM EC', cast(c_custkey % 6 as int) * 2 + 1, 2) || "
    "cast(c_custkey % 20 + 1 as string) || substr('     A', cast(c_custkey % 6 as int) + 1, 1), ' ', '')"
)
IN = (
    "cast(c_custkey % 10 as string) || substr('ABDEFGHJabdefghj', cast(c_custkey % 16 as int) + 1, 1) "
    "|| substr('LNPQRST', cast(c_custkey % 7 as int) + 1, 1)"
)
POSTCODE = (
    "case when c_custkey % 53 = 0 then null when c_custkey % 61 = 0 then 'UNKNOWN' else "
    f"{OUT} || case when c_custkey % 7 = 0 then '' else ' ' end || {IN} || "
    "case when c_custkey % 13 = 0 then '  ' else '' end end"
)
PAON = (
    f"case c_custkey % 6 when 0 then {NUMBER} when 1 then 'The ' || {NAME} || ' House, ' || {NUMBER} "
    f"when 2 then {NUMBER} || 'a' when 3 then {NAME} || ' ' || {LETTERS} || ' Cottage' "
    f"when 4 then {NUMBER} || ' - ' || cast(c_custkey + 3 as string) else {NAME} || ' ' || {LETTERS} || ' lodge' end"
)
SAON = (
    "case when c_custkey % 5 = 3 then (case c_custkey % 3 when 0 then 'Flat ' || cast(c_custkey % 12 + 1 as string) "
    "when 1 then 'APT 3/' || cast(c_custkey % 4 + 1 as string) else 'Studio' end) "
    "when c_custkey % 23 = 0 then 'Annexe' when c_custkey % 2 = 0 then '' else null end"
)
STREET = (
    "case when c_custkey % 43 = 0 then 'nan' else "
    "(case c_custkey % 5 when 0 then 'High' when 1 then 'Church' when 2 then '  Station' "
    "when 3 then 'Victoria' else 'Mill' end) || ' ' || "
    "(case c_custkey % 7 when 0 then 'Street' when 1 then 'RD' when 2 then 'Ave.' when 3 then 'Lane' "
    "when 4 then 'gdns' when 5 then 'Close ' else 'St' end) end"
)
LOCALITY = (
    "case c_custkey % 4 when 0 then null when 1 then 'nan' "
    "else 'Locality  ' || cast(c_custkey % 9 as string) end"
)
TYPE = (
    "case when c_custkey % 17 = 0 then 'x' when c_custkey % 19 = 0 then "
    "lower(substr('DSTFO', cast(c_custkey % 5 as int) + 1, 1)) "
    "else substr('DSTFO', cast(c_custkey % 5 as int) + 1, 1) end"
)

RAW_SALES = {
    "Transaction ID": "cast(o_orderkey as string)",
    "Price": "case when o_orderkey % 97 = 0 then 'abc' when o_orderkey % 101 = 0 then '' "
    "else cast(o_totalprice as string) end",
    "Date of Transfer": "case when o_orderkey % 89 = 0 then 'garbage' "
    "else cast(cast(o_orderdate as date) as string) || ' 00:00' end",
    "Postcode": POSTCODE,
    "Property Type": TYPE,
    "Old/New": "case o_orderstatus when 'F' then 'N' when 'O' then 'y' else 'P' end",
    "Duration": "case when o_orderkey % 29 = 0 then null when o_orderkey % 3 = 0 then 'L' else 'F' end",
    "PAON": PAON,
    "SAON": SAON,
    "Street": STREET,
    "Locality": LOCALITY,
    "Town/City": "c_mktsegment",
    "District": "n_name",
    "County": "r_name",
    "PPD Category Type": "case when o_orderkey % 10 = 0 then 'B' else 'A' end",
    "Record Status": "case when o_orderkey % 50 = 0 then 'C' when o_orderkey % 77 = 0 then 'D' else 'A' end",
}

SHIPPED = "cast(cast(l_shipdate as date) as string)"
RAW_CERTIFICATES = {
    "LMK_KEY": "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || "
    "cast(l_partkey as string) || '-' || cast(l_suppkey as string)",
    "POSTCODE": POSTCODE,
    "ADDRESS1": f"coalesce(nullif({SAON}, '') || ', ', '') || {PAON}",
    "ADDRESS2": f"case when c_custkey % 43 = 0 then null else {STREET} end",
    "ADDRESS3": f"case when c_custkey % 3 = 0 then {LOCALITY} else null end",
    "POSTTOWN": "c_mktsegment",
    "PROPERTY_TYPE": "case when c_custkey % 5 = 3 then 'Flat' else 'House' end",
    "CURRENT_ENERGY_RATING": "substr('ABCDEFG', cast(l_partkey % 7 as int) + 1, 1)",
    "TOTAL_FLOOR_AREA": "l_quantity",
    "LODGEMENT_DATE": f"case l_linenumber % 4 when 0 then {SHIPPED} when 1 then {SHIPPED} || ' 10:30' "
    f"when 2 then {SHIPPED} || ' 10:30:59' else 'n/a' end",
    "INSPECTION_DATE": f"case when l_linenumber % 5 = 0 then null else {SHIPPED} end",
}

SALES_FROM = (
    "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey "
    "join region on n_regionkey = r_regionkey"
)
CERTIFICATES_FROM = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_customers(spark: SparkSession, sf_dir: str, fields: dict[str, str]) -> tuple[DataFrame, list]:
    """Customers with the fields that need nothing else, and the select list for all fields.

    Address parts are made once per customer, before its orders are joined.
    """
    own = {n: e for n, e in fields.items() if "c_" in e and "o_" not in e and "l_" not in e}
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", *[F.expr(e).alias(n) for n, e in own.items()]
    )
    return customers, [
        F.col(f"`{n}`") if n in own else F.expr(e).alias(n) for n, e in fields.items()
    ]


def _customer_of_order() -> Column:
    """The key of both sides, not as a plain equality of columns.

    From one the planner infers that each test of a customer's text, made of the key, holds for the order's
    key as well, and makes the text again for every order to test it there.
    """
    return F.bitwise_not("o_custkey") == F.bitwise_not("c_custkey")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders seen as raw price-paid records."""
    customers, fields = _on_customers(spark, sf_dir, RAW_SALES)
    return (
        table(spark, sf_dir, "orders")
        .join(customers, _customer_of_order())
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(*fields)
    )


def raw_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items seen as raw energy certificates of the customer's address."""
    customers, fields = _on_customers(spark, sf_dir, RAW_CERTIFICATES)
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, _customer_of_order())
        .select(*fields)
    )


def raw_sales_sql() -> str:
    return "select " + ", ".join(f'{e} as "{n}"' for n, e in RAW_SALES.items()) + f" from {SALES_FROM}"


def raw_certificates_sql() -> str:
    fields = ", ".join(f'{e} as "{n}"' for n, e in RAW_CERTIFICATES.items())
    return f"select {fields} from {CERTIFICATES_FROM}"
