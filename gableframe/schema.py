"""Canonical price-paid schema and its fixed vocabularies."""

from pyspark.sql import types as T

# The sixteen price-paid columns in file order.
CANONICAL = (
    "Transaction ID",
    "Price",
    "Date of Transfer",
    "Postcode",
    "Property Type",
    "Old/New",
    "Duration",
    "PAON",
    "SAON",
    "Street",
    "Locality",
    "Town/City",
    "District",
    "County",
    "PPD Category Type",
    "Record Status",
)

# Header spellings and the canonical columns they stand for.
CANONICAL_OF = {
    "transaction unique identifier": "Transaction ID",
    "transaction id": "Transaction ID",
    "price": "Price",
    "amount": "Price",
    "date of transfer": "Date of Transfer",
    "transfer date": "Date of Transfer",
    "date": "Date of Transfer",
    "postcode": "Postcode",
    "post code": "Postcode",
    "property type": "Property Type",
    "property_type": "Property Type",
    "old/new": "Old/New",
    "new build": "Old/New",
    "is new": "Old/New",
    "duration": "Duration",
    "tenure": "Duration",
    "paon": "PAON",
    "primary addressable object name": "PAON",
    "saon": "SAON",
    "secondary addressable object name": "SAON",
    "street": "Street",
    "thoroughfare": "Street",
    "locality": "Locality",
    "town/city": "Town/City",
    "town": "Town/City",
    "city": "Town/City",
    "district": "District",
    "local authority": "District",
    "county": "County",
    "ppd category type": "PPD Category Type",
    "record status - monthly file only": "Record Status",
    "record status": "Record Status",
}
# Fixed value: so many known columns make a line a header.
MIN_HEADER_HITS = 4

# Register codes and their display names.
CODES = {
    "Property Type": {
        "D": "Detached",
        "S": "Semi-Detached",
        "T": "Terraced",
        "F": "Flat/Maisonette",
        "O": "Other",
    },
    "Old/New": {"Y": "New", "N": "Old"},
    "Duration": {"F": "Freehold", "L": "Leasehold"},
    "PPD Category Type": {
        "A": "Standard price paid entry",
        "B": "Additional price paid entry",
    },
    "Record Status": {"A": "Addition", "C": "Change", "D": "Delete"},
}

# Columns whose text is trimmed and upper-cased when sales are cleaned.
STANDARDISED = (
    "Postcode",
    "Street",
    "Locality",
    "Town/City",
    "District",
    "County",
    "PAON",
    "SAON",
)

# Dimensions offered as filters.
FILTER_DIMENSIONS = (
    "County",
    "District",
    "Town/City",
    "Outward",
    "Property Type",
    "Old/New",
    "Duration",
)

# Lake layouts by name.
LAYOUTS = {
    "outcode2_year_month": ("outcode2", "sale_year", "sale_month"),
    "year_month_outcode2": ("sale_year", "sale_month", "outcode2"),
    "outcode2_year": ("outcode2", "sale_year"),
    "year_month": ("sale_year", "sale_month"),
    "outcode2_only": ("outcode2",),
    "none": (),
}

# Partition columns that a summary looks for.
KNOWN_PARTITIONS = ("outcode2", "lodgement_year", "sale_year", "sale_month")

# Column names under which a date or a postcode may arrive.
DATE_NAMES = (
    "Date of Transfer",
    "date_of_transfer",
    "Date",
    "Sale Date",
    "Transaction Date",
    "TransferDate",
    "Transfer Date",
)
POSTCODE_NAMES = ("Postcode", "PCDS", "Post Code")
CERTIFICATE_POSTCODE_NAMES = ("POSTCODE", "POST_CODE", "POSTAL_CODE", "POSTCODE_TEXT")
CERTIFICATE_ADDRESS_NAMES = (
    "ADDRESS1",
    "ADDRESS2",
    "ADDRESS3",
    "ADDRESS_LINE1",
    "ADDRESS_LINE2",
    "ADDRESS_LINE3",
    "BUILDING_NUMBER",
    "BUILDING_NAME",
    "FLAT_NUMBER",
    "STREET",
)

# Label vocabularies for tagging and for rendering.
TAG_LABELS = (
    "OrganisationName",
    "DepartmentName",
    "SubBuildingName",
    "BuildingName",
    "BuildingNumber",
    "StreetName",
    "Locality",
    "TownName",
    "Postcode",
)
RENDER_LABELS = TAG_LABELS[2:]


def text_schema() -> T.StructType:
    """All sixteen columns as strings."""
    return T.StructType([T.StructField(c, T.StringType()) for c in CANONICAL])


def declared_schema() -> T.StructType:
    """Declared types for headerless price-paid files: a whole-number price, text otherwise."""
    return T.StructType(
        [
            T.StructField(c, T.LongType() if c == "Price" else T.StringType())
            for c in CANONICAL
        ]
    )
