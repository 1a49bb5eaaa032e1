"""Declared schemas of the canonical tables."""

from pyspark.sql import types as T

_TYPES = {
    "S": T.StringType(),
    "D": T.DateType(),
    "F": T.DoubleType(),
    "B": T.BooleanType(),
    "I": T.IntegerType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[code]) for name, code in columns.items()])


TRANSACTIONS = _schema(
    parcel_id="S", market="S", sale_date="D", sale_price="F", adjusted_sale_price="F",
    qualified="B", property_type_code="S", dor_code="S", improved="B", instrument_type="S",
    year_built="F", effective_year_built="F", living_area_sqft="F", gross_area_sqft="F",
    beds="F", baths="F", stories="F", pool="B", neighborhood="S", subdivision="S",
    census_block_group="S", buyer_operator="S", seller_operator="S",
)

ACQUISITION_ATTRIBUTES = (
    "qualified", "property_type_code", "dor_code", "improved", "year_built",
    "effective_year_built", "living_area_sqft", "gross_area_sqft", "beds", "baths", "stories",
    "pool", "neighborhood", "subdivision", "census_block_group",
)

EPISODES = T.StructType(
    [
        *_schema(
            parcel_id="S", market="S", operator="S", acquisition_date="D", acquisition_price="F",
            resale_date="D", resale_price="F", hold_days="I", event_observed="B",
            linkage_status="S", gross_spread="F", gross_return="F",
        ).fields,
        *[TRANSACTIONS[name] for name in ACQUISITION_ATTRIBUTES],
    ]
)


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns read as text, so that codes keep their leading zeros."""
    return T.StructType([T.StructField(field.name, T.StringType()) for field in schema])
