"""Features known at the cutoff: nothing dated later may enter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers, ordered, text


def complaint_features(events: DataFrame, targets: DataFrame, cutoff: dt.date) -> DataFrame:
    """History of each target cohort: counts, shares, recency, evidence, mileage.

    Events are reduced to cohort grain before they meet the targets, so the semi-join
    never moves event rows.
    """
    c = F.col
    past = events.where(c("report_date") <= F.lit(cutoff))
    n = F.count("*")
    aggregates = [
        n.alias("historical_complaint_count"),
        F.min("report_date").alias("historical_first_report_date"),
        F.max("report_date").alias("historical_last_report_date"),
        (F.date_diff(F.max("report_date"), F.min("report_date")) / 365.25).alias(
            "historical_years_observed"
        ),
        F.date_diff(F.lit(cutoff), F.max("report_date")).alias(
            "days_since_last_historical_complaint"
        ),
        *[
            F.count_if(c("report_date") >= F.lit(numbers.recency_start(cutoff, m))).alias(
                f"complaints_last_{m}m"
            )
            for m in C.RECENCY_MONTHS
        ],
        *[F.count_if(c(f"{e}_positive")).alias(f"historical_{e}_positive_count") for e in C.EVIDENCE],
        F.count("mileage").alias("historical_mileage_observed_count"),
        (F.count("mileage") / n).alias("historical_mileage_observed_share"),
    ]
    for field, names in (("component", C.COMPONENTS), ("severity", C.SEVERITIES)):
        for name in names:
            hits = F.count_if(c(field) == name)
            stem = f"historical_complaint_{field}_{name}"
            aggregates += [hits.alias(f"{stem}_count"), (hits / n).alias(f"{stem}_share")]
    base = past.groupBy(C.COHORT_ID).agg(*aggregates)
    distinct = ordered.distinct_counts(
        past, [C.COHORT_ID], {"historical_unique_odino_count": c("source_reference_id")}
    )
    medians = ordered.grouped_medians(past, [C.COHORT_ID], {"historical_mileage_median": c("mileage")})
    wanted = targets.select(C.COHORT_ID)
    joined = (
        base.join(wanted, C.COHORT_ID, "left_semi")
        .join(distinct, C.COHORT_ID, "left")
        .join(medians, C.COHORT_ID, "left")
    )
    return joined.withColumn(
        "historical_unique_odino_count", F.coalesce("historical_unique_odino_count", F.lit(0))
    )


def _document_features(
    matched: DataFrame,
    targets: DataFrame,
    facts: DataFrame,
    cutoff: dt.date,
    *,
    document: str,
    stem: str,
    counter: str,
    extra: list[Column],
) -> DataFrame:
    """Distinct documents of each target cohort dated by the cutoff, and a status.

    ``facts`` has one row per document with its date in ``_day``. Pairs are made
    distinct before the join, so a document with very many applications is spread. Where
    ``matched`` and ``facts`` both lie by ``document``, neither moves again.
    """
    c = F.col
    pairs = (
        matched.where(c("matched_broad_vehicle_id").isNotNull())
        .select(c("matched_broad_vehicle_id").alias(C.COHORT_ID), document)
        .distinct()
        .join(targets.select(C.COHORT_ID), C.COHORT_ID, "left_semi")
        .join(facts, document)
    )
    known = c("_day") <= F.lit(cutoff)
    flagged = pairs.withColumn("_known", F.coalesce(known, F.lit(False)))
    per_cohort = flagged.groupBy(C.COHORT_ID).agg(
        F.count("*").alias("_any"),
        F.count_if("_known").alias(counter),
        F.min(F.when(c("_known"), c("_day"))).alias(f"historical_first_{stem}_date"),
        F.max(F.when(c("_known"), c("_day"))).alias(f"historical_last_{stem}_date"),
        *extra,
    )
    rows = targets.select(C.COHORT_ID).join(per_cohort, C.COHORT_ID, "left")
    counts = [n for n in per_cohort.columns if n.endswith("_count")]
    observed = c(counter) > 0
    return rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts}).withColumns(
        {
            f"{stem}_observed_by_cutoff": observed,
            f"{stem}_asof_status": F.when(observed, "OBSERVED_RECORDS")
            .when(c("_any") > 0, "MATCHED_RECORDS_AFTER_CUTOFF_ONLY")
            .otherwise("NO_MATCHED_RECORD"),
            f"days_since_last_{stem}": F.date_diff(F.lit(cutoff), c(f"historical_last_{stem}_date")),
        }
    ).drop("_any")


#: Document and campaign columns that the features read.
COMMUNICATION_FACTS = ("date_added", "communication_type", "canonical_components")
RECALL_FACTS = (
    "report_received_dates", "canonical_components", "fmvss_numbers", "regulation_part_numbers", "do_not_drive_values",
    "park_outside_values",
)
#: The same of their ``signals``.
COMMUNICATION_SIGNALS = ("date_added", "communication_type", "component_bits")
RECALL_SIGNALS = ("first_report_date", "component_bits", "has_rule", "has_stop", "has_park")
#: Event columns that targets and features read.
EVENT_COLUMNS = (
    C.COHORT_ID, *C.KEY, "report_date", "component", "severity", "mileage", "source_reference_id",
    *[f"{e}_positive" for e in C.EVIDENCE],
)


def _component_hit(facts: DataFrame, family: str) -> Column:
    """Facts hold families as an array, or as the bits that the ``signals`` of documents and campaigns have."""
    if "component_bits" in facts.columns:
        return text.has_component(F.col("component_bits"), family)
    return F.array_contains("canonical_components", family)


def communication_features(
    matched: DataFrame, documents: DataFrame, targets: DataFrame, cutoff: dt.date, document: str = "communication_id"
) -> DataFrame:
    """Communications added to the file by the cutoff. ``documents`` are documents or their ``signals``."""
    c = F.col
    coded = "component_bits" in documents.columns
    components = "component_bits" if coded else "canonical_components"
    facts = documents.select(document, c("date_added").alias("_day"), "communication_type", components)
    extra = [
        F.count_if(c("_known") & (c("communication_type") == (i if coded else n))).alias(
            f"historical_communication_type_{n.lower()}_count"
        )
        for i, n in enumerate(C.COMMUNICATION_TYPES)
    ] + [
        F.count_if(c("_known") & _component_hit(facts, n)).alias(
            f"historical_communication_component_{n}_count"
        )
        for n in C.COMPONENTS
    ]
    rows = _document_features(
        matched, targets, facts, cutoff, document=document, stem="communication",
        counter="historical_unique_communication_count", extra=extra,
    )
    return rows.select(C.COHORT_ID, *C.COMMUNICATION_FEATURES)


def recall_features(
    matched: DataFrame, campaigns: DataFrame, targets: DataFrame, cutoff: dt.date, campaign: str = "campaign_id"
) -> DataFrame:
    """Campaigns whose earliest report date lies by the cutoff. ``campaigns`` are campaigns or their ``signals``.

    Noncompliance here means a safety-standard number or a regulation part. The last
    date is the latest of the campaigns' earliest dates.
    """
    c = F.col
    if "component_bits" in campaigns.columns:
        facts = campaigns.select(
            campaign, c("first_report_date").alias("_day"), "component_bits", c("has_rule").alias("_rule"),
            c("has_stop").alias("_stop"), c("has_park").alias("_park"),
        )
    else:
        facts = campaigns.select(
            campaign,
            F.array_min("report_received_dates").alias("_day"),
            "canonical_components",
            (numbers.has_any(c("fmvss_numbers")) | numbers.has_any(c("regulation_part_numbers"))).alias(
                "_rule"
            ),
            F.array_contains("do_not_drive_values", "Yes").alias("_stop"),
            F.array_contains("park_outside_values", "Yes").alias("_park"),
        )
    extra = [
        F.count_if(c("_known") & c("_rule")).alias("historical_recall_noncompliance_count"),
        F.count_if(c("_known") & c("_stop")).alias("historical_recall_do_not_drive_count"),
        F.count_if(c("_known") & c("_park")).alias("historical_recall_park_outside_count"),
    ] + [
        F.count_if(c("_known") & _component_hit(facts, n)).alias(
            f"historical_recall_component_{n}_count"
        )
        for n in C.COMPONENTS
    ]
    rows = _document_features(
        matched, targets, facts, cutoff, document=campaign, stem="recall",
        counter="historical_unique_recall_campaign_count", extra=extra,
    )
    return rows.select(C.COHORT_ID, *C.RECALL_FEATURES)


def feature_matrix(
    targets: DataFrame,
    complaints: DataFrame,
    communications: DataFrame,
    recalls: DataFrame,
    cutoff: dt.date,
) -> DataFrame:
    """The target-aligned feature table, 114 columns in declared order."""
    base = targets.select(
        C.COHORT_ID,
        *C.KEY,
        (F.lit(cutoff.year) - F.col("model_year")).alias("cohort_age_at_cutoff"),
        F.lit(cutoff).alias("feature_cutoff_date"),
    )
    for part in (complaints, communications, recalls):
        base = base.join(part, C.COHORT_ID, "left")
    return base.select(*C.FEATURE_COLUMNS)


def history_mismatches(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Cohorts whose rebuilt history differs from the target's; must be empty."""
    left = features.select(C.COHORT_ID, F.col("historical_complaint_count").alias("rebuilt"))
    right = targets.select(C.COHORT_ID, F.col("historical_complaint_count").alias("target"))
    return left.join(right, C.COHORT_ID, "full").where(~F.col("rebuilt").eqNullSafe(F.col("target")))
