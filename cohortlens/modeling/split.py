"""Stratified 70/15/15 split with exact sizes and a repeatable membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import ordered


def class_quotas(df: DataFrame, label: str) -> DataFrame:
    """Train and validation rows per class, by largest remainder (one row per class).

    The hold-out takes the ceiling of 30 percent, and the test part the ceiling of half
    of it.
    """
    c = F.col
    every = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count("*").alias("class_rows"))

    def allot(table: DataFrame, size: str, total, name: str) -> DataFrame:
        table = table.withColumn("_total", total)
        exact = c("_total") * c(size) / F.sum(size).over(every)
        table = table.withColumns({"_base": F.floor(exact), "_rest": exact - F.floor(exact)})
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), F.col(label).cast("int")))
        spare = c("_total") - F.sum("_base").over(every)
        return table.withColumn(name, c("_base") + F.when(rank <= spare, 1).otherwise(0)).drop(
            "_total", "_base", "_rest"
        )

    n = F.sum("class_rows").over(every)
    trained = allot(counts, "class_rows", n - F.ceil(n * 3 / 10), "train_rows")
    held = trained.withColumn("_held", c("class_rows") - c("train_rows"))
    h = F.sum("_held").over(every)
    return allot(held, "_held", h - F.ceil(h / 2), "validation_rows").drop("_held")


def stratified_split(df: DataFrame, *, key: str = C.COHORT_ID, label: str, seed: int = C.SEED) -> DataFrame:
    """``key`` and ``split`` for every row, in the order of a hash within each class.

    Positions come from hash buckets, so a class is never ordered in one task. The
    quota table has one row per class.
    """
    hashed = df.select(key, label, ordered.hash_key(seed, F.col(key)).alias("_hash"))
    placed = ordered.positions(hashed, [label], "_hash", "_position")
    quotas = F.broadcast(class_quotas(df, label))
    joined = placed.join(quotas, label)
    position = F.col("_position")
    part = (
        F.when(position < F.col("train_rows"), "TRAIN")
        .when(position < F.col("train_rows") + F.col("validation_rows"), "VALIDATION")
        .otherwise("TEST")
    )
    return joined.select(key, part.alias("split"))


def split_summary(rows: DataFrame, label: str) -> DataFrame:
    """Rows, positives and prevalence of each split."""
    positive = F.count_if(F.col(label).cast("int") == 1)
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"),
        positive.alias("positives"),
        (positive / F.count("*")).alias("positive_prevalence"),
    )
