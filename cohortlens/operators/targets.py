"""Future-activity targets at a calendar cutoff, and their diagnostics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers, ordered
from cohortlens.operators import statistics


def event_counts(events: DataFrame, cutoff: dt.date, months: int) -> DataFrame:
    """History (up to the cutoff) and future window counts per cohort.

    The future window is (cutoff, end]; everything combines on the map side.
    """
    day = F.col("report_date")
    past = day <= F.lit(cutoff)
    ahead = (day > F.lit(cutoff)) & (day <= F.lit(numbers.window_end(cutoff, months)))
    return events.groupBy(C.COHORT_ID).agg(
        F.count_if(past).alias("historical_complaint_count"),
        F.min(F.when(past, day)).alias("first_historical_date"),
        F.count_if(ahead).alias("future_complaint_count"),
        F.count_if(ahead & F.col("severity").isin(*C.SEVERE)).alias("future_severe_complaint_count"),
        *[
            F.count_if(ahead & (F.col("component") == name)).alias(
                f"future_component_{name}_complaint_count"
            )
            for name in C.SELECTED_COMPONENTS
        ],
    )


def eligibility_reason(cutoff: dt.date, historical: Column, complete: bool | Column = True) -> Column:
    """The single eligibility status of a cohort, first failed rule first."""
    c = F.col
    blank = F.lit(False)
    for name in (C.COHORT_ID, "normalized_make", "normalized_model"):
        blank = blank | (F.coalesce(c(name), F.lit("")) == "")
    whole = F.lit(complete) if isinstance(complete, bool) else complete
    return (
        F.when(~whole, "INCOMPLETE_FUTURE_WINDOW")
        .when(blank | c("model_year").isNull(), "INVALID_COHORT_IDENTITY")
        .when(c("model_year") > cutoff.year, "MODEL_YEAR_AFTER_CUTOFF")
        .when(historical < 1, "NO_HISTORICAL_COMPLAINT")
        .otherwise("ELIGIBLE")
    )


def labelled_cohorts(
    events: DataFrame, cohorts: DataFrame, *, cutoff: dt.date, months: int, corpus_end: dt.date
) -> DataFrame:
    """All cohorts with counts, reason, age bucket and observed days."""
    if numbers.window_end(cutoff, months) > corpus_end:
        raise ValueError("the future window ends after the corpus; no labels can be given")
    c = F.col
    counts = event_counts(events, cutoff, months)
    numeric = [n for n in counts.columns if n.endswith("_count")]
    extra = [n for n in ("production_total_units",) if n in cohorts.columns]
    joined = cohorts.select(C.COHORT_ID, *C.KEY, *extra).join(counts, C.COHORT_ID, "left")
    filled = joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in numeric})
    age = F.lit(cutoff.year) - c("model_year")
    return filled.withColumns(
        {
            "eligibility_reason": eligibility_reason(cutoff, c("historical_complaint_count")),
            "cohort_age_at_cutoff": age,
            "age_bucket": numbers.age_at_cutoff_bucket(age),
            "historical_observation_days": F.date_diff(F.lit(cutoff), c("first_historical_date")),
        }
    )


def reason_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("eligibility_reason").agg(F.count("*").alias("cohorts"))


def target_table(labelled: DataFrame, *, cutoff: dt.date, months: int) -> DataFrame:
    """Eligible cohorts only, 26 columns in declared order."""
    c = F.col
    future = c("future_complaint_count")
    rows = labelled.where(c("eligibility_reason") == "ELIGIBLE").withColumns(
        {
            "target_definition_version": F.lit(C.TARGET_VERSION),
            "cutoff_date": F.lit(cutoff),
            "horizon_months": F.lit(months),
            "future_window_start": F.lit(cutoff + dt.timedelta(days=1)),
            "future_window_end": F.lit(numbers.window_end(cutoff, months)),
            "target_eligible": F.lit(True),
            "future_any_complaint": future >= 1,
            **{f"future_complaint_at_least_{n}": future >= n for n in (2, 3, 5, 10)},
            "future_severe_complaint_activity": c("future_severe_complaint_count") >= 1,
        }
    )
    return rows.select(*C.TARGET_COLUMNS)


def threshold_support(rows: DataFrame) -> DataFrame:
    """Positive and negative cohorts at each future-count threshold."""
    counts = rows.agg(
        F.count("*").alias("_n"),
        *[
            F.count_if(F.col("future_complaint_count") >= t).alias(str(t))
            for t in C.TARGET_THRESHOLDS
        ],
    )
    long = counts.unpivot(["_n"], [str(t) for t in C.TARGET_THRESHOLDS], "threshold", "positive_count")
    p, n = F.col("positive_count"), F.col("_n")
    return long.select(
        F.col("threshold").cast("int").alias("threshold"),
        "positive_count",
        (n - p).alias("negative_count"),
        numbers.share(p, n).alias("positive_rate"),
        numbers.share(n - p, n).alias("negative_rate"),
    )


def group_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cohorts, future events, positives and positive rate per value of each key."""
    positive = F.count_if(F.col("future_complaint_count") >= 1)
    long = rows.select(
        "future_complaint_count",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value"))
                    for k in keys
                ]
            )
        ).alias("g"),
    )
    return long.groupBy("g.dimension", "g.value").agg(
        F.count("*").alias("cohort_count"),
        F.sum("future_complaint_count").alias("future_complaint_total"),
        positive.alias("future_any_complaint_count"),
        (positive / F.count("*")).alias("future_any_complaint_rate"),
    )


def component_support(rows: DataFrame) -> DataFrame:
    names = [f"future_component_{n}_complaint_count" for n in C.SELECTED_COMPONENTS]
    long = rows.unpivot([], names, "component", "n")
    cut = F.regexp_extract("component", "^future_component_(.*)_complaint_count$", 1)
    return long.groupBy(cut.alias("component")).agg(
        F.sum("n").alias("future_event_count"), F.count_if(F.col("n") > 0).alias("active_cohort_count")
    )


def concentration(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.01, 0.10)) -> DataFrame:
    """Share of all events that the top share of cohorts holds.

    The counts are turned into a histogram first; equal counts are interchangeable, so
    the boundary value contributes only as many cohorts as still fit.
    """
    c = F.col
    histogram = rows.groupBy(c(column).alias("x")).agg(F.count("*").alias("n"))
    placed = ordered.totals_before(
        histogram, [], ordered.value_bucket(c("x")), c("x"), {"above": "n"}, descending=True
    )
    total = rows.agg(F.count("*").alias("_n"), F.sum(column).alias("_total"))
    rule = F.explode(
        F.array(*[F.struct(F.lit(p).alias("share"), F.lit(str(p)).alias("label")) for p in shares])
    )
    sized = total.select("_n", "_total", rule.alias("r")).select(
        c("r.share").alias("top_share"),
        F.greatest(F.lit(1), F.ceil(c("_n") * c("r.share"))).alias("top_cohort_count"),
        "_total",
    )
    taken = placed.join(F.broadcast(sized), c("above") < c("top_cohort_count"))
    used = F.least(c("n"), c("top_cohort_count") - c("above")) * c("x")
    return taken.groupBy("top_share", "top_cohort_count", "_total").agg(F.sum(used).alias("_held")).select(
        "top_share", "top_cohort_count", numbers.share(c("_held"), c("_total")).alias("event_share")
    )


def production_sensitivity(labelled_eligible: DataFrame) -> DataFrame:
    """Future counts against production, on cohorts whose production is known."""
    known = labelled_eligible.where(F.col("production_total_units").isNotNull())
    rated = known.withColumn(
        "future_per_10k",
        F.when(
            F.col("production_total_units") > 0,
            F.col("future_complaint_count") / F.col("production_total_units") * 10000.0,
        ),
    )
    return statistics.distributions(
        rated,
        {
            "future_complaint_count": F.col("future_complaint_count"),
            "future_per_10k": F.col("future_per_10k"),
        },
    )


