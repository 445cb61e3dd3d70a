"""Guards that no reader of a table can get around.

A guard is a filter, so column pruning cannot drop it: it is evaluated for every row, whatever columns a reader
asks for. Rows either pass or stop the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hold(df: DataFrame, rule: Column, said: Column) -> DataFrame:
    """``df`` if ``rule`` is true for every row; otherwise the run stops with ``said``. A null rule is not true."""
    return df.where(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def unique(df: DataFrame, key: str, table: str) -> DataFrame:
    """``df`` if no value of ``key`` occurs twice.

    The count is a window over the key, so a join on the key that follows uses the same partitioning and order.
    """
    n = "_times"
    counted = df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(key)))
    said = F.concat(F.lit(f"{table} has more than one row of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return hold(counted, F.col(n) == 1, said).drop(n)
