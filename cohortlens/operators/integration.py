"""The integrated cohort table and its review."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers, text
from cohortlens.operators import guards

CUTOFFS = (dt.date(2021, 12, 31), dt.date(2022, 12, 31), dt.date(2023, 12, 31))


def complaint_name(name: str) -> str:
    """Column name of a cohort feature inside the integrated table."""
    if name in (C.COHORT_ID, *C.KEY, "complaint_event_count"):
        return name
    for suffix in ("count", "share"):
        ending = f"_complaint_{suffix}"
        if name.endswith(ending):
            return f"complaint_{name[: -len(ending)]}_{suffix}"
    return f"complaint_{name}"


# Target name -> source name for each gated source.
PRODUCTION_NAMES = {
    "production_total_units": "production_count",
    "production_source_record_count": "production_source_record_count",
    "production_source_record_ids": "production_source_record_ids",
    "production_reporting_periods": "production_reporting_periods",
    "production_ambiguity_candidate_count": "ambiguity_candidate_count",
    "production_complaints_per_10k_units": "complaints_per_10k_produced",
}
COMMUNICATION_NAMES = {
    "communication_unique_count": "unique_communication_count",
    "communication_applicability_row_count": "communication_applicability_row_count",
    "communication_source_expanded_row_count": "source_expanded_row_count",
    "communication_unique_manufacturer_document_id_count": "unique_manufacturer_document_id_count",
    "communication_first_date": "first_communication_date",
    "communication_last_date": "last_communication_date",
    "communication_summary_observed_count": "summary_observed_communication_count",
    "communication_manufacturer_component_observed_count": (
        "manufacturer_component_observed_communication_count"
    ),
    **{
        f"communication_type_{n.lower()}_count": f"communication_type_{n.lower()}_count"
        for n in C.COMMUNICATION_TYPES
    },
    **{
        f"communication_component_{n}_count": f"component_{n}_communication_count"
        for n in C.COMPONENTS
    },
}
RECALL_NAMES = {
    "recall_unique_campaign_count": "unique_recall_campaign_count",
    "recall_applicability_row_count": "recall_applicability_row_count",
    "recall_first_report_date": "first_recall_date",
    "recall_last_report_date": "last_recall_date",
    "recall_noncompliance_campaign_count": "noncompliance_campaign_count",
    "recall_known_affected_population_campaign_count": "known_affected_population_campaign_count",
    "recall_remedy_observed_campaign_count": "remedy_observed_campaign_count",
    **{
        f"recall_type_{n.lower()}_campaign_count": f"recall_type_{n.lower()}_campaign_count"
        for n in C.RECALL_TYPES
    },
    **{
        f"recall_component_{n}_campaign_count": f"component_{n}_recall_campaign_count"
        for n in C.COMPONENTS
    },
}


def _gate(
    table: DataFrame,
    available: Column,
    flag: str,
    names: dict[str, str],
    status: tuple[str, str],
    method: str,
) -> DataFrame:
    """Keep a source's values only where it matched; elsewhere they are null, not zero."""
    return table.select(
        C.COHORT_ID,
        available.alias(flag),
        F.col(status[1]).alias(status[0]),
        F.col("match_method").alias(method),
        *[F.when(available, F.col(old)).alias(new) for new, old in names.items()],
    )


def integrate(
    cohorts: DataFrame, production: DataFrame, communications: DataFrame, recalls: DataFrame
) -> DataFrame:
    """One row per cohort with the values of all four sources (168 columns).

    Every table must have the same cohorts, each once: one that a table lacks or has twice stops the run,
    whichever columns are read.
    """
    c = F.col
    base = cohorts.select(*[c(n).alias(complaint_name(n)) for n in C.COHORT_FEATURE_COLUMNS])
    parts = [
        _gate(
            production, c("production_count").isNotNull(), "has_production_match",
            PRODUCTION_NAMES, ("production_match_status", "production_match_status"),
            "production_match_method",
        ),
        _gate(
            communications, c("unique_communication_count") > 0, "has_manufacturer_communications",
            COMMUNICATION_NAMES,
            ("communication_match_status", "manufacturer_communication_match_status"),
            "communication_match_method",
        ),
        _gate(
            recalls, c("unique_recall_campaign_count") > 0, "has_recall", RECALL_NAMES,
            ("recall_match_status", "recall_match_status"), "recall_match_method",
        ),
    ]
    base = guards.unique(base.withColumn("_row", F.lit(True)), C.COHORT_ID, "the cohort table")
    for part, name in zip(parts, ("production", "communications", "recalls"), strict=True):
        base = base.join(guards.unique(part, C.COHORT_ID, name), C.COHORT_ID, "full")
    flags = ("has_production_match", "has_manufacturer_communications", "has_recall")
    # The flags are never null in their own table, so a null is a row without partner.
    whole = c("_row") & c(flags[0]).isNotNull() & c(flags[1]).isNotNull() & c(flags[2]).isNotNull()
    said = F.concat(F.lit("a source has no or another cohort "), C.COHORT_ID)
    base = guards.hold(base, whole, said).drop("_row")
    sources = F.lit(1)
    for flag in flags:
        sources = sources + c(flag).cast("int")
    label = F.concat_ws(
        "+",
        F.lit("complaints"),
        *[
            F.when(c(flag), name)
            for flag, name in zip(flags, ("production", "communications", "recalls"), strict=True)
        ],
    )
    return base.withColumns(
        {
            "source_count_available": sources,
            "has_all_four_sources": sources == 4,
            "source_coverage_category": label,
        }
    )


def identity_mismatches(tables: dict[str, DataFrame], key: str = C.COHORT_ID) -> DataFrame:
    """Ids that are not in every table exactly once; must be empty before joining 1:1."""
    parts = [t.select(F.col(key), F.lit(name).alias("table")) for name, t in tables.items()]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    counts = [F.count_if(F.col("table") == name).alias(name) for name in tables]
    wrong = F.lit(False)
    for name in tables:
        wrong = wrong | (F.col(name) != 1)
    return long.groupBy(key).agg(*counts).where(wrong)


def coverage_categories(integrated: DataFrame) -> DataFrame:
    """Six measures per coverage category, model year and make, in one pass."""
    measures = [
        F.count("*").alias("cohorts"),
        F.sum("complaint_event_count").alias("complaint_events"),
        F.count_if("has_production_match").alias("production"),
        F.count_if("has_manufacturer_communications").alias("communications"),
        F.count_if("has_recall").alias("recalls"),
        F.count_if("has_all_four_sources").alias("all_four"),
    ]
    keys = ["source_coverage_category", "model_year", "normalized_make"]
    grouped = integrated.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_set"), *measures
    )
    # grouping_id has one bit per key that is rolled up; a single key is kept in each set.
    kept = {0b011: keys[0], 0b101: keys[1], 0b110: keys[2]}
    dimension, value = F.lit(None), F.lit(None).cast("string")
    for bits, name in kept.items():
        dimension = F.when(F.col("_set") == bits, name).otherwise(dimension)
        value = F.when(F.col("_set") == bits, F.col(name).cast("string")).otherwise(value)
    names = ("cohorts", "complaint_events", "production", "communications", "recalls", "all_four")
    return grouped.select(dimension.alias("dimension"), value.alias("value"), *names)


def support_thresholds(integrated: DataFrame) -> DataFrame:
    """Cohorts at or above each complaint and source-count threshold."""
    n, s = F.col("complaint_event_count"), F.col("source_count_available")
    rules = {f"minimum_{t}_complaints": n >= t for t in C.SUPPORT_THRESHOLDS}
    rules |= {
        "at_least_two_sources": s >= 2,
        "at_least_three_sources": s >= 3,
        "all_four_sources": s == 4,
        "at_least_5_complaints_and_3_sources": (n >= 5) & (s >= 3),
    }
    counts = integrated.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "threshold", "cohorts")


def review_summary(integrated: DataFrame) -> DataFrame:
    """Headline counts of the integrated table (one row)."""
    return integrated.agg(
        F.count("*").alias("integrated_cohort_count"),
        F.countDistinct("normalized_make").alias("unique_make_count"),
        F.countDistinct("normalized_model").alias("unique_model_count"),
        F.min("model_year").alias("first_model_year"),
        F.max("model_year").alias("last_model_year"),
        F.count_if("has_production_match").alias("production_available_count"),
        F.count_if("has_manufacturer_communications").alias("communication_available_count"),
        F.count_if("has_recall").alias("recall_available_count"),
        F.count_if(F.col("complaint_mileage_observed_count") == 0).alias(
            "cohorts_with_no_observed_mileage"
        ),
        F.count_if(F.col("complaint_event_count") == 1).alias("one_complaint_cohort_count"),
    )


def earliest_dates(matched: DataFrame, docs: DataFrame, document: str, first: Column) -> DataFrame:
    """Earliest document date per matched cohort."""
    pairs = (
        matched.where(F.col("matched_broad_vehicle_id").isNotNull())
        .select(F.col("matched_broad_vehicle_id").alias(C.COHORT_ID), document)
        .distinct()
    )
    dated = docs.select(document, first.alias("_day")).where(F.col("_day").isNotNull())
    return pairs.join(dated, document).groupBy(C.COHORT_ID).agg(F.min("_day").alias("earliest_date"))


def temporal_feasibility(
    events: DataFrame,
    integrated: DataFrame,
    communication_dates: DataFrame,
    recall_dates: DataFrame,
    *,
    cutoffs: Sequence[dt.date] = CUTOFFS,
    horizons: Sequence[int] = (12, 24),
) -> DataFrame:
    """What each cutoff would leave to learn from: history, future windows, sources.

    All cutoffs are counted in one pass over the events: a fixed set of conditional
    counts per cohort, which combine on the map side. Windows that end after the last
    event are incomplete, and their future counts are null.
    """
    c = F.col
    day = c("report_date")
    counts = []
    for i, cutoff in enumerate(cutoffs):
        counts.append(F.count_if(day <= F.lit(cutoff)).alias(f"prior_{i}"))
        for m in horizons:
            end = numbers.window_end(cutoff, m)
            counts.append(
                F.count_if((day > F.lit(cutoff)) & (day <= F.lit(end))).alias(f"future_{m}_{i}")
            )
    per_cohort = events.groupBy(C.COHORT_ID).agg(F.max("report_date").alias("_last"), *counts)
    known = (
        per_cohort.join(
            integrated.select(C.COHORT_ID, "production_reporting_periods"), C.COHORT_ID, "left"
        )
        .join(communication_dates.withColumnRenamed("earliest_date", "_comm"), C.COHORT_ID, "left")
        .join(recall_dates.withColumnRenamed("earliest_date", "_recall"), C.COHORT_ID, "left")
    )
    totals = [F.max("_last").alias("_last")]
    for i, cutoff in enumerate(cutoffs):
        prior = c(f"prior_{i}")
        has = prior > 0
        totals += [
            F.count_if(has).alias(f"a{i}"),
            F.sum(prior).alias(f"b{i}"),
            F.count_if(prior >= 5).alias(f"c{i}"),
            F.count_if(prior >= 10).alias(f"d{i}"),
            F.count_if(
                has & text.any_period_by(c("production_reporting_periods"), cutoff.year)
            ).alias(f"e{i}"),
            F.count_if(has & (c("_comm") <= F.lit(cutoff))).alias(f"f{i}"),
            F.count_if(has & (c("_recall") <= F.lit(cutoff))).alias(f"g{i}"),
        ]
        for m in horizons:
            future = c(f"future_{m}_{i}")
            totals += [
                F.count_if(has & (future > 0)).alias(f"h{m}_{i}"),
                F.coalesce(F.sum(F.when(has, future)), F.lit(0)).alias(f"k{m}_{i}"),
            ]
    one = known.agg(*totals)
    rows = []
    for i, cutoff in enumerate(cutoffs):
        fields = [
            F.lit(cutoff).alias("cutoff"),
            c(f"a{i}").alias("prior_cohorts"),
            c(f"b{i}").alias("prior_events"),
            c(f"c{i}").alias("cohorts_with_5_prior"),
            c(f"d{i}").alias("cohorts_with_10_prior"),
        ]
        for m in horizons:
            end = F.lit(numbers.window_end(cutoff, m))
            complete = c("_last") >= end
            fields += [
                end.alias(f"window_end_{m}m"),
                complete.alias(f"window_complete_{m}m"),
                F.when(complete, c(f"a{i}")).otherwise(0).alias(f"cohorts_observed_{m}m"),
                F.when(complete, c(f"h{m}_{i}")).alias(f"cohorts_active_{m}m"),
                F.when(complete, c(f"k{m}_{i}")).alias(f"events_{m}m"),
            ]
        fields += [
            c(f"e{i}").alias("cohorts_with_production_period"),
            c(f"f{i}").alias("cohorts_with_communications"),
            c(f"g{i}").alias("cohorts_with_recalls"),
        ]
        rows.append(F.struct(*fields))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
