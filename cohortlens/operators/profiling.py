"""Profiles of a table: one function per question, each one aggregate plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import ordered

PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)


def profile_ids(df: DataFrame, record: str, reference: str) -> DataFrame:
    """Rows, distinct ids, rows under repeated ids and references, exact copies."""
    parts = [df.agg(F.count("*").alias("rows"))]
    for name, label in ((record, "record"), (reference, "reference")):
        sizes = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
        parts.append(
            sizes.agg(
                F.count("*").alias(f"unique_{label}s"),
                F.count_if(F.col("_n") > 1).alias(f"repeated_{label}s"),
                F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(
                    f"rows_under_repeated_{label}"
                ),
                F.max("_n").alias(f"largest_{label}"),
            )
        )
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    parts.append(
        copies.agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("exact_copies")
        )
    )
    return ordered.side_by_side(*parts)


def profile_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing rows and percent per column."""
    counts = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(n).isNull()).alias(n) for n in columns]
    )
    long = counts.unpivot(["_n"], list(columns), "column", "missing_count")
    return long.select(
        "column", "missing_count", (100.0 * F.col("missing_count") / F.col("_n")).alias("missing_percent")
    )


def profile_coverage(df: DataFrame, keys: Sequence[str], accepted: Column) -> DataFrame:
    """Accepted and other rows, distinct values per key and of their combination."""
    base = df.agg(
        F.count_if(accepted).alias("accepted_rows"),
        F.count_if(~F.coalesce(accepted, F.lit(False))).alias("other_rows"),
    )
    combos = df.where(accepted).select(*keys).distinct()
    singles = [
        combos.where(F.col(k).isNotNull()).select(k).distinct().agg(F.count("*").alias(f"unique_{k}"))
        for k in keys
    ]
    return ordered.side_by_side(base, *singles, combos.agg(F.count("*").alias("unique_combinations")))


def profile_numeric(
    df: DataFrame, source: str, parsed: Column, limits: dict[str, int | float]
) -> DataFrame:
    """Availability, malformed text, zeros, rows above limits, quantiles (one row)."""
    value = parsed.cast("double")
    present = F.col(source).isNotNull()
    base = df.agg(
        F.count_if(present).alias("available"),
        F.count_if(~present).alias("missing"),
        F.count_if(present & value.isNull()).alias("malformed"),
        F.count_if(value == 0).alias("zero"),
        *[F.count_if(value > limit).alias(name) for name, limit in limits.items()],
        F.max(value).alias("maximum"),
        F.avg(value).alias("mean"),
    )
    return ordered.side_by_side(base, _named_quantiles(df, value))


def _named_quantiles(df: DataFrame, value: Column, prefix: str = "p") -> DataFrame:
    table = ordered.quantiles(df, [], {"v": value}, PERCENTILES)
    return table.select(
        *[F.col("q")[i].alias(f"{prefix}{round(p * 100)}") for i, p in enumerate(PERCENTILES)]
    )


def profile_dates(
    df: DataFrame, first_text: str, second_text: str, first: Column, second: Column, long_delay: int
) -> DataFrame:
    """Availability and range of two dates, and the delay between them (one row)."""
    delay = F.date_diff(second, first)

    def one(name: str, source: str, day: Column) -> list[Column]:
        return [
            F.count(day).alias(f"{name}_available"),
            F.count_if(F.col(source).isNull()).alias(f"{name}_missing"),
            F.count_if(F.col(source).isNotNull() & day.isNull()).alias(f"{name}_malformed"),
            F.min(day).alias(f"{name}_min"),
            F.max(day).alias(f"{name}_max"),
        ]

    base = df.agg(
        *one("first", first_text, first),
        *one("second", second_text, second),
        F.count(delay).alias("paired_valid_dates"),
        F.count_if(delay < 0).alias("negative_delays"),
        F.count_if(delay > long_delay).alias("long_delays"),
    )
    return ordered.side_by_side(base, _named_quantiles(df, delay, "delay_p"))


def profile_groups(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of the total per value."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*")).scalar()
    return counts.select("value", "rows", (100.0 * F.col("rows") / total).alias("percent"))


def profile_measure_by_group(df: DataFrame, group: str, value: Column) -> DataFrame:
    """Count, mean, median and maximum of a measure per group."""
    measured = df.withColumn("_v", value.cast("double"))
    base = measured.groupBy(group).agg(
        F.count("_v").alias("observed"), F.avg("_v").alias("mean"), F.max("_v").alias("maximum")
    )
    return base.join(ordered.grouped_medians(measured, [group], {"median": F.col("_v")}), group, "left")


def profile_combinations(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    """The most frequent combinations of several columns."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), *[F.col(c).asc_nulls_first() for c in columns]).limit(k)


def profile_text(df: DataFrame, column: str, short: int, long: int) -> DataFrame:
    """Lengths of a text column in characters (one row)."""
    n = F.length(column)
    base = df.agg(
        F.count_if(F.col(column).isNull()).alias("missing"),
        F.count(column).alias("available"),
        F.count_if(n == 0).alias("length_zero"),
        F.count_if(n.between(1, short)).alias("short"),
        F.count_if(n > long).alias("oversized"),
        F.max(n).cast("long").alias("maximum_length"),
    )
    return ordered.side_by_side(base, _named_quantiles(df, n))


def profile_repeats(df: DataFrame, reference: str, component: str, combination: Sequence[str]) -> DataFrame:
    """Repeated references, references with several components, repeated combinations."""
    c = F.col
    sizes = (
        df.where(c(reference).isNotNull()).groupBy(reference, component).agg(F.count("*").alias("_n"))
        .groupBy(reference)
        .agg(F.sum("_n").alias("_n"), F.count(component).alias("components"))
    )
    references = sizes.agg(
        F.count_if(c("_n") > 1).alias("repeated_references"),
        F.coalesce(F.sum(F.when(c("_n") > 1, c("_n"))), F.lit(0)).alias("rows_under_repeated_reference"),
        F.max("_n").alias("largest_reference"),
        F.count_if(c("components") > 1).alias("references_with_several_components"),
    )
    combos = df.groupBy(*combination).agg(F.count("*").alias("_n")).agg(
        F.count_if(c("_n") > 1).alias("repeated_combinations")
    )
    return ordered.side_by_side(references, combos)


def profile_monthly(df: DataFrame, day: Column) -> DataFrame:
    """Rows per year and month."""
    month = F.date_format(day, "yyyy-MM")
    return df.groupBy(month.alias("month")).agg(F.count("*").alias("rows"))


def profile_lag(df: DataFrame, lag: Column, long_lag: int = 30) -> DataFrame:
    """Years between the model year and the report (one row)."""
    base = df.agg(
        F.count(lag).alias("observed"),
        F.count_if(lag < 0).alias("negative"),
        F.count_if(lag > long_lag).alias("long"),
    )
    return ordered.side_by_side(base, _named_quantiles(df, lag, "lag_p"))


def profile_histogram(df: DataFrame, value: Column, low: Column | float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin of [low, high]; the last bin is closed."""
    v = value.cast("double")
    kept = df.where(v.between(low, high))
    width = (high - low) / bins
    index = F.least(F.floor((v - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return kept.groupBy(index.alias("bin")).agg(F.count("*").alias("rows")).withColumns(
        {"lower": F.lit(float(low)) + F.col("bin") * F.lit(width)}
    )


def profile_histogram_to_quantile(
    df: DataFrame, value: Column, low: float, probability: float, bins: int
) -> DataFrame:
    """The same up to a quantile of the column, which is one number."""
    row = ordered.quantiles(df, [], {"v": value}, [probability]).first()
    if row is None:
        return profile_histogram(df.limit(0), value, low, low + 1.0, bins)
    return profile_histogram(df, value, low, float(row["q"][0]), bins)


def headline(mapped: DataFrame) -> DataFrame:
    """Headline shares of a mapped table (one row)."""
    c = F.col
    ok = c("reason").isNull()
    n = F.count_if(ok)

    def percent(part: Column) -> Column:
        return 100.0 * F.count_if(ok & part) / n

    return mapped.agg(
        F.count("*").alias("records"),
        n.alias("mapped"),
        F.count_if(~ok).alias("rejected"),
        (100.0 * n / F.count("*")).alias("mapping_success_percent"),
        percent(c("component") == "other").alias("component_other_percent"),
        percent(c("component") == "unknown").alias("component_unknown_percent"),
        percent(c("severity") == "unknown").alias("severity_unknown_percent"),
    )


