"""Rows of conversations put in order, however many rows one conversation holds.

No group is ever pulled into one task: rows are range-partitioned and sorted by (conversation, order), so a
conversation with a third of all rows spans many tasks, and a position is the place inside the task plus the
rows of the tasks before. Rows travel as hashes; a text is only moved where two different rows of one
conversation have the same turn, as only there it decides the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare, stage

#: Rows of a conversation that share one key in joins with a row for each conversation.
SPREAD = 4096


def ids_of(role: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a turn by its role and text, as two numbers."""
    return F.xxhash64(F.lit(1), role, text), F.xxhash64(F.lit(2), role, text)


def placed(rows: DataFrame, keep: dict[str, Column], label: str) -> DataFrame:
    """(conv_id, pos, t1, t2, *keep) for each row of ``rows(conv_id, turn, role, text)``, staged.

    ``pos`` counts a conversation's rows from 0 by turn (null first), then role, then text, both by their UTF-8
    bytes. Equal rows keep their number and follow each other. Role and text must not be null; a null conv_id
    is a conversation of its own. ``keep`` are expressions on the columns of ``rows``.
    """
    prepare(rows.sparkSession)
    t1, t2 = ids_of(F.col("role"), F.col("text"))
    named = rows.select("conv_id", "turn", "role", "text", t1.alias("t1"), t2.alias("t2"), *[c.alias(n) for n, c in keep.items()])
    # Turns that different rows share. The table is written first, so that the join below knows its size.
    tied = stage(
        named.groupBy("conv_id", "turn")
        .agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("t1", "t2") for f in (F.min, F.max)])
        .where("min_t1 != max_t1 or min_t2 != max_t2")
        .select(F.col("conv_id").alias("tied_id"), F.col("turn").alias("tied_turn"), F.lit(True).alias("tied")),
        f"{label}-ties",
    )
    same = F.col("conv_id").eqNullSafe(F.col("tied_id")) & F.col("turn").eqNullSafe(F.col("tied_turn"))
    # Equal rows are spread by their place in the input.
    narrow = named.join(tied, same, "left").select(
        "conv_id", "turn", "role", F.when(F.col("tied"), F.col("text")).alias("tie_text"), "t1", "t2", *keep,
        F.monotonically_increasing_id().alias("spread"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie_text", "spread")]
    ordered = stage(
        narrow.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "t1", "t2", *keep, F.monotonically_increasing_id().alias("at")),
        f"{label}-order",
    ).withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # At most one row for each task that holds rows of the conversation.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("conv_id").alias("s_id"), F.col("part").alias("s_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    joined = ordered.join(starts, F.col("conv_id").eqNullSafe(F.col("s_id")) & (F.col("part") == F.col("s_part")))
    return stage(joined.select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2", *keep), label)


def spread(table: DataFrame, size: str) -> DataFrame:
    """A row for each conversation repeated for every `SPREAD` of its ``size`` rows, with the number in ``part``."""
    last = F.floor((F.greatest(F.col(size), F.lit(1)) - 1) / SPREAD).cast("long")
    return table.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def part_of(pos: Column) -> Column:
    return F.floor(pos / SPREAD).cast("long")
