"""Application-to-cohort matching, unmatched classes and coverage tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import text
from cohortlens.session import stage


def cohort_index(cohorts: DataFrame) -> DataFrame:
    """One row per (make, model, year): candidate count and an id when it is unique."""
    return cohorts.groupBy(*C.KEY).agg(
        F.count("*").alias("_n"), F.min(C.COHORT_ID).alias("_id")
    )


def match_applications(
    applications: DataFrame, cohorts: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Match each application to a cohort: exact key first, then an explicit alias.

    Every application is kept, with one of five statuses. ``aliases`` has
    (make, model, alias_make, alias_model).
    """
    c = F.col
    index = cohort_index(cohorts)
    # The index has one row for each key; AQE broadcasts it or splits hot keys of the other side.
    exact = index.select(*C.KEY, c("_n").alias("_exact_n"), c("_id").alias("_exact_id"))
    rows = applications.join(exact, list(C.KEY), "left")
    if aliases is None:
        rows = rows.withColumns(
            {"_alias_n": F.lit(None).cast("bigint"), "_alias_id": F.lit(None).cast("string")}
        )
    else:
        # Resolve the alias on the small index side, so applications are joined once more only.
        named = aliases.select(
            c("make").alias("_from_make"), c("model").alias("_from_model"),
            c("alias_make").alias("normalized_make"), c("alias_model").alias("normalized_model"),
        )
        via = index.join(named, ["normalized_make", "normalized_model"]).select(
            c("_from_make").alias("normalized_make"), c("_from_model").alias("normalized_model"),
            "model_year", c("_n").alias("_alias_n"), c("_id").alias("_alias_id"),
        )
        rows = rows.join(via, list(C.KEY), "left")
    n = F.coalesce("_exact_n", "_alias_n", F.lit(0))
    method = F.when(c("_exact_n").isNotNull(), "exact_normalized").when(
        c("_alias_n").isNotNull(), "explicit_alias"
    )
    status = (
        F.when(c("model_year").isNull(), "INSUFFICIENT_VEHICLE_IDENTITY")
        .when(n > 1, "AMBIGUOUS")
        .when(method == "explicit_alias", "EXPLICIT_ALIAS")
        .when(n == 1, "EXACT")
        .otherwise("NO_MATCH")
    )
    return rows.select(
        *applications.columns,
        status.alias("complaint_match_status"),
        method.alias("match_method"),
        F.when(n == 1, F.coalesce("_exact_id", "_alias_id")).alias("matched_broad_vehicle_id"),
        F.when(n > 1, n).otherwise(0).alias("ambiguity_candidate_count"),
    )


def document_links(
    rows: DataFrame, document: str, products: DataFrame, key: str, product: Sequence[str], cohorts: DataFrame,
    normalize: Callable[[Column], Column],
) -> DataFrame:
    """Each document with each cohort that one of its products names, once: ``document`` and ``matched_broad_vehicle_id``.

    Rows name a product by its number ``key``; ``products`` has each number once, and ``product`` names its source columns of
    make, model and year. So labels are made, normalized and matched once for each product, not for each row. Matches are
    staged, so Catalyst sees the true size of what it joins. The result lies by ``document``.
    """
    c = F.col
    make, model, year = product
    named = products.select(
        key, normalize(c(make)).alias("normalized_make"), normalize(c(model)).alias("normalized_model"),
        text.model_year(c(year)).alias("model_year"),
    )
    known = match_applications(named, cohorts).where(c("matched_broad_vehicle_id").isNotNull())
    matched = stage(known.select(key, "matched_broad_vehicle_id"), "product-matches")
    found = rows.select(document, key).join(matched, key).select(document, "matched_broad_vehicle_id")
    return found.repartition(document).distinct()


def document_counts(cohorts: DataFrame, links: DataFrame, document: str, name: str, facts: DataFrame | None = None) -> DataFrame:
    """Number of linked documents of every cohort as ``name``, zero without any. ``facts``, if given, are one row a document."""
    known = links.where(F.col(document).isNotNull())
    if facts is not None:
        known = known.join(facts.select(document), document)
    counts = known.groupBy(F.col("matched_broad_vehicle_id").alias(C.COHORT_ID)).agg(F.count("*").alias(name))
    rows = cohorts.join(counts, C.COHORT_ID, "left")
    return rows.withColumn(name, F.coalesce(name, F.lit(0)))


def orphans(rows: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent does not exist; must be empty."""
    return rows.join(parent.select(key).distinct(), key, "left_anti")


def unmatched_class(
    unmatched: DataFrame, source: DataFrame, *, make_label: str, year_label: str
) -> DataFrame:
    """Say why a cohort found no partner: make, model, year or their combination.

    ``source`` holds the (make, model, year) rows the cohorts were matched against.
    """
    valid = source.where(F.col("model_year").isNotNull())
    # Distinct triples first: the three narrower lists come from that small table.
    keys = valid.select(*C.KEY).distinct()
    makes = keys.select("normalized_make").distinct().withColumn("_make", F.lit(True))
    models = (
        keys.select("normalized_make", "normalized_model").distinct().withColumn("_model", F.lit(True))
    )
    years = keys.select("model_year").distinct().withColumn("_year", F.lit(True))
    joined = (
        unmatched.join(makes, "normalized_make", "left")
        .join(models, ["normalized_make", "normalized_model"], "left")
        .join(years, "model_year", "left")
    )
    label = (
        F.when(F.col("_make").isNull(), make_label)
        .when(F.col("_model").isNull(), "model_absent_for_make")
        .when(F.col("_year").isNull(), year_label)
        .otherwise("make_model_year_combination_absent")
    )
    return joined.select(*unmatched.columns, label.alias("mismatch_class"))


def unmatched_production(matches: DataFrame, production: DataFrame) -> DataFrame:
    rows = matches.where(F.col("production_match_status") == "NO_PRODUCTION_RECORD")
    return unmatched_class(
        rows, production,
        make_label="make_absent_from_selected_source",
        year_label="model_year_outside_selected_source",
    )


def unmatched_documents(evidence: DataFrame, applications: DataFrame, count: str) -> DataFrame:
    return unmatched_class(
        evidence.where(F.col(count) == 0), applications,
        make_label="make_absent_from_vehicle_applicability",
        year_label="model_year_absent_from_vehicle_applicability",
    )


def top_counts(df: DataFrame, column: str | Column, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values; equal counts are ordered by value."""
    value = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "value").limit(k)


def coverage_by(evidence: DataFrame, field: str, matched: Column) -> DataFrame:
    """Cohorts, events and matched percentages per value of ``field``."""
    events = F.col("complaint_event_count")
    return evidence.groupBy(field).agg(
        F.count("*").alias("cohorts"),
        F.count_if(matched).alias("matched_cohorts"),
        (100.0 * F.count_if(matched) / F.count("*")).alias("matched_cohort_percentage"),
        F.sum(events).alias("events"),
        F.sum(F.when(matched, events).otherwise(0)).alias("matched_events"),
        (100.0 * F.sum(F.when(matched, events).otherwise(0)) / F.sum(events)).alias(
            "matched_event_percentage"
        ),
    )


def evidence_summary(evidence: DataFrame, count: str) -> DataFrame:
    """Matched cohorts and events of one evidence table (one row)."""
    hit = F.col(count) > 0
    events = F.col("complaint_event_count")
    matched_events = F.sum(F.when(hit, events).otherwise(0))
    return evidence.agg(
        F.count("*").alias("complaint_cohort_count"),
        F.sum(events).alias("complaint_event_count"),
        F.count_if(hit).alias("matched_cohort_count"),
        (100.0 * F.count_if(hit) / F.count("*")).alias("matched_cohort_percentage"),
        matched_events.alias("matched_event_count"),
        (100.0 * matched_events / F.sum(events)).alias("matched_event_percentage"),
    )


def cross_source_coverage(
    evidence: DataFrame,
    production: DataFrame,
    communications: DataFrame | None = None,
    recalls: DataFrame | None = None,
) -> DataFrame:
    """Which other sources cover each cohort, with a joined category label."""
    c = F.col
    out = evidence.select(C.COHORT_ID, *C.KEY, "complaint_event_count")
    flags = [
        ("production", "has_production", production, c("production_count").isNotNull()),
        (
            "manufacturer_communications", "has_manufacturer_communications", communications,
            c("unique_communication_count") > 0,
        ),
        ("recalls", "has_recalls", recalls, c("unique_recall_campaign_count") > 0),
    ]
    labels = []
    for label, name, table, condition in flags:
        if table is None:
            continue
        out = out.join(table.select(C.COHORT_ID, condition.alias(name)), C.COHORT_ID, "left")
        labels.append(F.when(c(name), label))
    joined = F.concat_ws("_", F.lit("complaint"), *labels)
    category = F.when(joined == "complaint", "complaint_only").otherwise(joined)
    return out.withColumn("coverage_category", category)


def category_totals(coverage: DataFrame, category: str = "coverage_category") -> DataFrame:
    return coverage.groupBy(category).agg(
        F.count("*").alias("cohorts"), F.sum("complaint_event_count").alias("events")
    )
