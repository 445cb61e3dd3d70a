"""Registration of queries with their SQL checks, and the shared output form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.plans import sqltext
from cohortlens.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    """Dates as ISO text, arrays joined by ``|``, doubles rounded; other types as they are."""
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StructType):
            column = F.array_join(F.transform(column, lambda v: v.cast("string")), "|")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            column = F.round(column, DIGITS)
        out.append(column.alias(f.name))
    return df.select(*out)


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None, *, shown: bool = True):
    """Add a query; ``sql`` is the final SELECT of its check, if there is one."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(prepare(spark), folder)
            return present(df) if shown else df

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sqltext.query(sql, extra)
        return fn

    return wrap


# Output forms for the SQL side, matching ``present``.
def day(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS VARCHAR) AS {name or x}"


def arr(x: str, name: str | None = None) -> str:
    return f"array_to_string({x}, '|') AS {name or x}"


def num(x: str, name: str | None = None) -> str:
    rounded = f"round(CAST({x} AS DOUBLE), {DIGITS})"
    # Rounding can leave a negative zero, which is the same number.
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END AS {name or x}"


_ARRAYS = (
    "production_source_record_ids", "production_reporting_periods", "source_record_ids",
    "reporting_periods", "reporting_entity_ids",
)
_DOUBLES = ("_share", "_of_observed", "_per_10k_units", "_per_10k_produced", "_median", "_median_miles", "_median_days", "_years_observed")


def pretty(columns) -> str:
    """SELECT list in the shared output form, by the naming rules of the columns."""
    out = []
    for n in columns:
        if n.endswith("_date") or n.startswith("future_window_"):
            out.append(day(n))
        elif n in _ARRAYS:
            out.append(arr(n))
        elif n.endswith(_DOUBLES):
            out.append(num(n))
        else:
            out.append(n)
    return ", ".join(out)
