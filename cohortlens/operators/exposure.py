"""Production filings: canonical rows, latest-per-configuration sums, matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import identity, numbers, ordered, text
from cohortlens.operators import guards

FILING_FIELDS = (
    "manufacturer_id", "manufacturer_name", "report_id", "reporting_year", "reporting_quarter",
    "fuel_propulsion_system", "make", "model", "model_year", "platform", "report_category",
    "total_production", "type_code", "source_row_number",
)
CONFIGURATION = (
    "manufacturer_id", *C.KEY, "platform", "vehicle_type_code", "fuel_propulsion_system",
)


def canonical_filings(
    filings: DataFrame, normalize: Callable[[Column], Column] = text.normalize_identity
) -> DataFrame:
    """Typed filing rows; a year that does not round-trip or is out of range is null."""
    c = F.col
    year = text.model_year(c("model_year"))
    return filings.select(
        identity.filing_id({name: c(name) for name in FILING_FIELDS}).alias("source_record_id"),
        "manufacturer_id",
        c("manufacturer_name").alias("reporting_entity"),
        "report_id",
        "reporting_year",
        "reporting_quarter",
        c("make").alias("original_make"),
        c("model").alias("original_model"),
        normalize(c("make")).alias("normalized_make"),
        normalize(c("model")).alias("normalized_model"),
        year.alias("model_year"),
        "platform",
        c("type_code").alias("vehicle_type_code"),
        "fuel_propulsion_system",
        c("total_production").alias("production_count"),
    )


def _latest_period(records: DataFrame) -> DataFrame:
    """The rows of the latest (year, quarter, report) of each configuration.

    The latest period is a maximum, so it combines on the map side; a configuration
    with very many filings is never gathered in one task.
    """
    period = F.struct("reporting_year", "reporting_quarter", "report_id")
    latest = records.groupBy(*CONFIGURATION).agg(F.max(period).alias("_latest"))
    condition = F.lit(True)
    for name in CONFIGURATION:
        condition = condition & F.col(f"r.{name}").eqNullSafe(F.col(f"l.{name}"))
    for name in ("reporting_year", "reporting_quarter", "report_id"):
        condition = condition & (F.col(f"r.{name}") == F.col(f"l._latest.{name}"))
    return records.alias("r").join(latest.alias("l"), condition).select("r.*")


def period_conflicts(records: DataFrame) -> DataFrame:
    """Configurations whose latest period holds rows that differ beyond their id."""
    payload = [n for n in records.columns if n not in ("source_record_id", *CONFIGURATION)]
    distinct = _latest_period(records).select(*CONFIGURATION, *payload).distinct()
    return distinct.groupBy(*CONFIGURATION).agg(F.count("*").alias("variants")).where("variants > 1")


def latest_filings(records: DataFrame) -> DataFrame:
    """One row per configuration: latest period, smallest id among equal periods.

    Rows of a latest period that differ beyond their id stop the run; ``period_conflicts`` lists such
    configurations beforehand. Hashes of the rows tell, the least and the greatest from the same grouping.
    """
    rest = [n for n in records.columns if n not in CONFIGURATION]
    said_by = [F.col(n) for n in rest if n != "source_record_id"]
    # Hashes skip nulls, so which columns are null is hashed as well.
    payload = F.xxhash64(*said_by, *[n.isNull() for n in said_by]).alias("payload")
    latest = [F.col(n) for n in ("reporting_year", "reporting_quarter", "report_id")]
    backwards = [(-n).alias(f"p{i}") for i, n in enumerate(latest)]
    best = records.groupBy(*CONFIGURATION).agg(
        F.min_by(F.struct(*rest), F.struct(*backwards, F.col("source_record_id").alias("id"))).alias("_row"),
        F.min(F.struct(*backwards, payload))["payload"].alias("_least"),
        F.max(F.struct(*[n.alias(f"p{i}") for i, n in enumerate(latest)], payload))["payload"].alias("_most"),
    )
    said = F.concat(F.lit("filings of one period differ: "), F.to_json(F.struct(*CONFIGURATION)))
    return guards.hold(best, F.col("_least") == F.col("_most"), said).select(*CONFIGURATION, "_row.*").select(*records.columns)


def aggregate_production(records: DataFrame) -> DataFrame:
    """Latest filing per configuration, summed to (make, model, year)."""
    latest = latest_filings(records)
    return latest.groupBy(*C.KEY).agg(
        F.sum("production_count").alias("production_count"),
        F.count("*").alias("source_record_count"),
        F.array_sort(F.collect_list("source_record_id")).alias("source_record_ids"),
        F.array_sort(
            F.collect_set(text.period_label(F.col("reporting_year"), F.col("reporting_quarter")))
        ).alias("reporting_periods"),
        F.array_sort(F.collect_set("manufacturer_id")).alias("reporting_entity_ids"),
    )


def _candidates(production: DataFrame, prefix: str, *, values: tuple[str, ...]) -> DataFrame:
    """Per key: how many production rows there are, and one of them."""
    picked = [F.min(F.struct(*values)).alias(f"{prefix}_row")]
    return production.groupBy(*C.KEY).agg(F.count("*").alias(f"{prefix}_n"), *picked)


def match_production(
    cohorts: DataFrame, production: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Left match of cohorts to production by exact key, then by explicit alias.

    ``aliases`` has (make, model, alias_make, alias_model). Several candidates give
    ``AMBIGUOUS`` and null values; no candidate is not a zero.
    """
    c, key = F.col, list(C.KEY)
    values = ("production_count", "source_record_count", "source_record_ids", "reporting_periods")
    found = _candidates(production, "exact", values=values)
    rows = cohorts.select(C.COHORT_ID, *key, "complaint_event_count").join(found, key, "left")
    if aliases is None:
        rows = rows.withColumns({"alias_n": F.lit(None).cast("bigint"), "alias_row": F.lit(None)})
        row = c("exact_row")
    else:
        named = aliases.select(
            c("make").alias("normalized_make"), c("model").alias("normalized_model"),
            "alias_make", "alias_model",
        )
        via = _candidates(production, "alias", values=values).select(
            c("normalized_make").alias("alias_make"), c("normalized_model").alias("alias_model"),
            "model_year", "alias_n", "alias_row",
        )
        rows = rows.join(named, ["normalized_make", "normalized_model"], "left").join(
            via, ["alias_make", "alias_model", "model_year"], "left"
        )
        row = F.coalesce("exact_row", "alias_row")
    n = F.coalesce("exact_n", "alias_n", F.lit(0))
    method = F.when(c("exact_n").isNotNull(), "exact_normalized").when(
        c("alias_n").isNotNull(), "explicit_alias"
    )
    status = (
        F.when(n > 1, "AMBIGUOUS")
        .when(method == "explicit_alias", "EXPLICIT_ALIAS")
        .when(n == 1, "EXACT")
        .otherwise("NO_PRODUCTION_RECORD")
    )
    single = rows.withColumn("_row", F.when(n == 1, row))
    empty = F.array().cast("array<string>")
    return single.select(
        C.COHORT_ID,
        *key,
        "complaint_event_count",
        status.alias("production_match_status"),
        method.alias("match_method"),
        c("_row.production_count").alias("production_count"),
        F.coalesce(c("_row.source_record_count"), F.lit(0)).alias("production_source_record_count"),
        F.coalesce(c("_row.source_record_ids"), empty).alias("production_source_record_ids"),
        F.coalesce(c("_row.reporting_periods"), empty).alias("production_reporting_periods"),
        F.when(n > 1, n).otherwise(0).alias("ambiguity_candidate_count"),
        numbers.rate_per_10k(c("complaint_event_count"), c("_row.production_count")).alias(
            "complaints_per_10k_produced"
        ),
    )


def match_summary(matches: DataFrame) -> DataFrame:
    """One row of match accounting.

    An ambiguous cohort counts as matched in the cohort percentage and as unmatched in
    the event percentage, as in the published definition.
    """
    c = F.col
    missing = c("production_match_status") == "NO_PRODUCTION_RECORD"
    matched = c("production_count").isNotNull()
    events = F.sum("complaint_event_count")
    base = matches.agg(
        F.count("*").alias("complaint_cohort_count"),
        events.alias("complaint_event_count"),
        (100.0 * F.count_if(~missing) / F.count("*")).alias("matched_cohort_percentage"),
        (100.0 * F.sum(F.when(matched, c("complaint_event_count")).otherwise(0)) / events).alias(
            "matched_event_percentage"
        ),
        F.count_if(c("production_count") == 0).alias("zero_production_cohort_count"),
        F.count_if(missing).alias("missing_production_cohort_count"),
        F.count("complaints_per_10k_produced").alias("diagnostic_rate_cohort_count"),
        F.min("complaints_per_10k_produced").alias("rate_minimum"),
        F.max("complaints_per_10k_produced").alias("rate_maximum"),
        F.sum("production_count").alias("matched_production_count_sum"),
    )
    median = ordered.quantiles(matches, [], {"rate": c("complaints_per_10k_produced")}, [0.5])
    return ordered.side_by_side(base, median.select(c("q")[0].alias("rate_median")))


def status_counts(matches: DataFrame, status: str) -> DataFrame:
    return matches.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("rows"))


