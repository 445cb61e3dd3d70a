"""Declared schemas. Nothing is inferred: a table either has its schema or is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlens import constants as C


class SchemaMismatch(ValueError):
    """A table's columns or types differ from the declared ones."""


def strings(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


COMPLAINT_SOURCE = strings(C.COMPLAINT_COLUMNS)
RECALL_SOURCE = strings(C.RECALL_COLUMNS)
COMMUNICATION_SOURCE = strings(C.COMMUNICATION_COLUMNS)
COMPACT_SOURCE = strings(C.COMPACT_COLUMNS)


# The layout of a production report and of a clean complaint.
PRODUCTION_DOCUMENT = (
    T.StructType()
    .add("meta", T.StructType().add("pagination", T.StructType().add("nextUrl", T.StringType()).add("total", T.LongType())))
    .add(
        "results",
        T.ArrayType(
            T.StructType()
            .add("fuelPropulsionSystem", T.StringType())
            .add("make", T.StringType())
            .add("model", T.StringType())
            .add("modelYear", T.StringType())
            .add("platform", T.StringType())
            .add("reportCategory", T.StringType())
            .add("totalProduction", T.LongType())
            .add("typeCode", T.StringType())
        ),
    )
)

CLEAN_COMPLAINT = (
    T.StructType()
    .add("event_id", T.StringType())
    .add("source_type", T.StringType())
    .add("source_record_id", T.StringType())
    .add("source_reference_id", T.StringType())
    .add("broad_vehicle_id", T.StringType())
    .add("known_configuration_id", T.StringType())
    .add("source_make", T.StringType())
    .add("normalized_make", T.StringType())
    .add("source_model", T.StringType())
    .add("normalized_model", T.StringType())
    .add("source_model_year", T.StringType())
    .add("model_year", T.IntegerType())
    .add("component", T.StringType())
    .add("source_component", T.StringType())
    .add("severity", T.StringType())
    .add("death_count", T.LongType())
    .add("injury_count", T.LongType())
    .add("crash", T.BooleanType())
    .add("fire", T.BooleanType())
    .add("mileage", T.LongType())
    .add("mileage_unit", T.StringType())
    .add("occurrence_date", T.DateType())
    .add("report_date", T.DateType())
    .add("narrative", T.StringType())
    .add("quality_flags", T.ArrayType(T.StringType()))
)


def shape(schema: T.StructType) -> list[tuple[str, str]]:
    """Ordered names and types, without nullability."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """The same table, or an error that names the first difference."""
    found, wanted = shape(df.schema), shape(expected)
    if found != wanted:
        for position, pair in enumerate(wanted):
            if position >= len(found) or found[position] != pair:
                got = found[position] if position < len(found) else "nothing"
                raise SchemaMismatch(f"column {position}: expected {pair}, found {got}")
        raise SchemaMismatch(f"unexpected columns {found[len(wanted):]}")
    return df


def assert_columns(df: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """The same table when its column names have the declared order."""
    if tuple(df.columns) != tuple(expected):
        raise SchemaMismatch(f"expected columns {expected}, found {tuple(df.columns)}")
    return df
