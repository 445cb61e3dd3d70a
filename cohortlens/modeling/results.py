"""Result documents: one nested row per cohort, ready to serve or to write as JSON."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers

CONTRACT = "complaint-activity-result-1.0"


def limitation_flags() -> Column:
    c = F.col
    rules = (
        (
            c("historical_complaint_count") == 1, "SPARSE_HISTORICAL_SUPPORT",
            "Sparse historical support",
        ),
        (
            c("cohort_age_at_cutoff") >= 21, "OLD_COHORT_WEAK_EVALUATION",
            "Old cohort evaluation limitation",
        ),
    )
    return F.array_compact(
        F.array(
            *[
                F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(title).alias("title")))
                for rule, code, title in rules
            ]
        )
    )


def result_documents(
    explanations: DataFrame, features: DataFrame, *, cutoff: dt.date, window_end: dt.date,
    model_id: str, k: int = 5,
) -> DataFrame:
    """Identity, prediction, class, explanation, evidence, limits and provenance."""
    c = F.col
    evidence = features.select(
        C.COHORT_ID, "historical_years_observed", "days_since_last_historical_complaint",
        "communication_asof_status", "recall_asof_status",
    )
    rows = explanations.join(evidence, C.COHORT_ID)
    decision = numbers.classify(c("probability"), C.THRESHOLD)
    return rows.select(
        c(C.COHORT_ID).alias("cohort_id"),
        F.struct(*C.KEY).alias("identity"),
        F.struct(
            c("probability"),
            (c("probability") * 100.0).alias("percentage"),
            F.lit(cutoff).alias("history_cutoff"),
            F.lit(cutoff + dt.timedelta(days=1)).alias("future_window_start"),
            F.lit(window_end).alias("future_window_end"),
        ).alias("prediction"),
        F.struct(
            F.lit(C.THRESHOLD).alias("threshold"),
            decision["classification"].alias("predicted_classification"),
            decision["label"].alias("presentation_label"),
        ).alias("classification"),
        F.struct(
            "method", "baseline_probability",
            F.slice("top_positive_contributors", 1, k).alias("top_positive_contributors"),
            F.slice("top_negative_contributors", 1, k).alias("top_negative_contributors"),
            "family_contributions", "source_contributions", "reconstructed_probability",
            "reconstruction_absolute_error",
        ).alias("explanation"),
        F.struct(
            c("historical_complaint_count").alias("historical_complaint_support"),
            c("cohort_age_at_cutoff").alias("cohort_age_years"),
            "historical_years_observed",
            c("days_since_last_historical_complaint").alias("days_since_most_recent_complaint"),
            c("communication_observed_by_cutoff").alias("has_manufacturer_communications"),
            c("communication_asof_status").alias("manufacturer_communication_status"),
            c("recall_observed_by_cutoff").alias("has_recall_evidence"),
            c("recall_asof_status").alias("recall_status"),
        ).alias("evidence"),
        limitation_flags().alias("limitation_flags"),
        F.struct(
            F.lit(CONTRACT).alias("result_contract_version"),
            F.lit(model_id).alias("model_identifier"),
            F.lit(C.TARGET_VERSION).alias("target_version"),
        ).alias("provenance"),
    )


def inconsistent_results(documents: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Rule counts of a result table (one row); all must be zero."""
    p = F.col("prediction.probability")
    decision = numbers.classify(p, C.THRESHOLD)
    return documents.agg(
        F.count_if(F.col("prediction.percentage") != p * 100.0).alias("percentage"),
        F.count_if(
            F.col("classification.predicted_classification") != decision["classification"]
        ).alias("classification"),
        F.count_if(F.col("classification.presentation_label") != decision["label"]).alias("label"),
        F.count_if(F.col("explanation.reconstruction_absolute_error") > tolerance).alias(
            "reconstruction"
        ),
    )


def cohort_page(features: DataFrame, *, limit: int, offset: int = 0) -> DataFrame:
    """One ordered page of cohorts. The order is total, so pages do not overlap."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset must not be negative")
    columns = (*C.KEY, C.COHORT_ID, "historical_complaint_count")
    ordered_rows = features.select(*columns).orderBy(*C.KEY, C.COHORT_ID)
    return ordered_rows.offset(offset).limit(limit)
