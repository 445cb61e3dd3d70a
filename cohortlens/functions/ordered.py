"""Global order without one giant partition.

Ranks, running totals and exact quantiles need a total order. A window over a whole
group would pull that group into one task, so every helper here works in two steps:
sum per coarse bucket (a bounded number per group), then order only inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def value_bucket(value: Column) -> Column:
    """Monotone bucket of any number: 4096 steps per power of two, both signs, zero apart.

    The steps are relative to the value itself, so shares below one and time stamps of one year
    spread over many buckets alike.
    """
    size = F.abs(value.cast("double"))
    # Doubles start at 2^-1074; the shift keeps every magnitude positive.
    magnitude = F.when(size > 0, F.floor(F.log2(size) * 4096) + 1100 * 4096).otherwise(0)
    return F.when(value < 0, -magnitude).otherwise(magnitude).cast("long")


def score_bucket(score: Column) -> Column:
    """Monotone bucket of a number in [0, 1]."""
    return F.floor(score * 16384).cast("long")


def hash_key(seed: int | str, *parts: Column) -> Column:
    """Hexadecimal md5 that gives rows a repeatable random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_bucket(key: Column) -> Column:
    """Monotone bucket of a hexadecimal hash: its first four digits."""
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("long")


#: Tasks that share the rows of one key after ``spread``.
PARTS = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key together, but in up to ``PARTS`` tasks where many tasks have read them: ``_part`` tells which.

    What is grouped by the key and ``_part`` next needs no shuffle, and meets under the key in a second, smaller one.
    """
    return df.withColumn("_part", F.spark_partition_id() % PARTS).repartition(key, "_part")


def totals_before(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Column,
    totals: dict[str, str | Column],
    *,
    descending: bool = False,
) -> DataFrame:
    """Add, for each row, the totals over the rows that come strictly before it.

    ``order`` must not tie inside a group. ``totals`` maps the new column to the
    summed column.
    """
    groups = list(groups)
    sums = {f"_s_{name}": (F.col(c) if isinstance(c, str) else c) for name, c in totals.items()}
    rows = df.withColumn("_bucket", bucket).withColumns(sums)

    def ascending(key: Column) -> Column:
        return key.desc() if descending else key.asc()

    per_bucket = rows.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    over_buckets = (
        Window.partitionBy(*groups).orderBy(ascending(F.col("_bucket"))).rowsBetween(*_BEFORE)
    )
    base = per_bucket.select(
        *groups,
        "_bucket",
        *[F.coalesce(F.sum(s).over(over_buckets), F.lit(0)).alias(f"{s}_base") for s in sums],
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(ascending(order)).rowsBetween(*_BEFORE)
    joined = rows.join(base, [*groups, "_bucket"])
    added = {
        name: F.col(f"_s_{name}_base") + F.coalesce(F.sum(f"_s_{name}").over(inside), F.lit(0))
        for name in totals
    }
    return joined.withColumns(added).drop("_bucket", *sums, *[f"{s}_base" for s in sums])


def positions(
    df: DataFrame, groups: Sequence[str], key: str, name: str = "position"
) -> DataFrame:
    """Zero-based position of every row in the order of a hexadecimal hash column."""
    return totals_before(
        df, groups, hash_bucket(F.col(key)), F.col(key), {name: F.lit(1).cast("long")}
    )


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Tie-averaged rank of each distinct non-null value (one row per value)."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranked = totals_before(
        values, [], value_bucket(F.col(column)), F.col(column), {"_before": "_n"}
    )
    return ranked.select(column, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    measures: dict[str, Column],
    probabilities: Sequence[float],
) -> DataFrame:
    """Exact, linearly interpolated quantiles of several measures in one pass.

    One row per group and measure with columns ``measure``, ``n`` and ``q`` (an array
    in the order of ``probabilities``). Values are counted first, so repeated values
    are combined before the shuffle; then only the buckets holding a wanted position
    are ordered.
    """
    groups = list(groups)
    long = df.select(
        *groups,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value"))
                    for k, v in measures.items()
                ]
            )
        ).alias("m"),
    ).select(*groups, "m.measure", "m.value")
    keys = [*groups, "measure"]
    values = (
        long.where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("c"))
        .withColumn("b", value_bucket(F.col("value")))
    )
    per_bucket = values.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
    running = Window.partitionBy(*keys).orderBy("b").rowsBetween(*_BEFORE)
    whole = Window.partitionBy(*keys)
    counted = per_bucket.withColumns(
        {"base": F.coalesce(F.sum("bc").over(running), F.lit(0)), "n": F.sum("bc").over(whole)}
    )
    spots = []
    for index, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        low = F.floor(place)
        spots.append(
            F.struct(
                F.lit(index).alias("i"),
                low.alias("lo"),
                F.least(low + 1, F.col("n") - 1).alias("hi"),
                (place - low).alias("part"),
            )
        )

    def within(spot: Column) -> Column:
        end = F.col("base") + F.col("bc")
        return ((spot["lo"] >= F.col("base")) & (spot["lo"] < end)) | (
            (spot["hi"] >= F.col("base")) & (spot["hi"] < end)
        )

    wanted = counted.withColumn("spots", F.filter(F.array(*spots), within)).where(
        F.size("spots") > 0
    )
    inside = Window.partitionBy(*keys, "b").orderBy("value").rowsBetween(*_BEFORE)
    placed = values.join(wanted.select(*keys, "b", "base", "n", "spots"), [*keys, "b"]).withColumn(
        "start", F.col("base") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    )
    end = F.col("start") + F.col("c")
    hits = placed.select(*keys, "n", "value", "start", end.alias("end"), F.explode("spots").alias("s"))

    def at(position: Column) -> Column:
        return F.max(
            F.when((position >= F.col("start")) & (position < F.col("end")), F.col("value"))
        )

    picked = hits.groupBy(*keys, "n", "s.i", "s.part").agg(
        at(F.col("s.lo")).alias("low"), at(F.col("s.hi")).alias("high")
    )
    return picked.groupBy(*keys, "n").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct("i", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("v"))
                )
            ),
            lambda item: item["v"],
        ).alias("q")
    )


def grouped_medians(
    df: DataFrame, groups: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """One row per group with the exact median of each measure (null when empty)."""
    long = quantiles(df, groups, measures, [0.5])
    return long.groupBy(*groups).agg(
        *[F.max(F.when(F.col("measure") == name, F.col("q")[0])).alias(name) for name in measures]
    )


def distinct_counts(
    df: DataFrame, groups: Sequence[str], columns: dict[str, Column]
) -> DataFrame:
    """Exact distinct counts of several columns per group.

    The pairs (group, value) are made distinct first, so a large group is spread over
    its values, and the rows carry nothing but the pair.
    """
    pairs = df.select(
        *groups,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
                    for k, v in columns.items()
                ]
            )
        ).alias("p"),
    ).select(*groups, "p.k", "p.v")
    distinct = pairs.where(F.col("v").isNotNull()).distinct()
    return distinct.groupBy(*groups).agg(
        *[F.count_if(F.col("k") == name).alias(name) for name in columns]
    )


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row tables into one row, without a join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])
