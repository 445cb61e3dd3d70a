"""Queries of the reports: baselines, match status, correlations, types, and guards on seeded faults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.modeling import metrics, models
from cohortlens.operators import asof, communications, complaints, exposure, integration, matching, statistics
from cohortlens.plans import bindings as B
from cohortlens.plans import catalogue_model
from cohortlens.plans import sqltext as S
from cohortlens.plans.catalogue_model import dataset
from cohortlens.plans.registry import num, register
from cohortlens.session import stage, stage_path
from cohortlens.sources import tables


@register(
    "majority_baseline",
    "SELECT split, m.predicted, count(*) AS \"rows\", "
    + num("avg(CASE WHEN target = m.predicted THEN 1.0 ELSE 0.0 END)", "accuracy")
    + " FROM mds, (SELECT CASE WHEN 2 * sum(target) >= count(*) THEN 1 ELSE 0 END AS predicted FROM mds WHERE split = 'TRAIN') m GROUP BY 1, 2",
)
def majority_baseline(spark, folder):
    """The class that most training rows have, and how often it is right in each split."""
    return metrics.majority(dataset(spark, folder))


_STATUS = (
    ("production", "pmatch", "production_match_status"),
    ("communications", "cev", "manufacturer_communication_match_status"),
    ("recalls", "rev", "recall_match_status"),
)


@register(
    "match_status_counts",
    " UNION ALL ".join(f"SELECT '{source}' AS source, {status} AS status, count(*) AS cohorts FROM {table} GROUP BY 2" for source, table, status in _STATUS),
)
def match_status_counts(spark, folder):
    """Cohorts by match status for each of the three sources."""
    e = B.Evidence(spark, folder)
    tables = (e.production, e.communications, e.recalls)
    parts = [
        exposure.status_counts(table, status).select(F.lit(source).alias("source"), "status", F.col("rows").alias("cohorts"))
        for (source, _, status), table in zip(_STATUS, tables, strict=True)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PAIRS = (("historical_complaint_count", "future_complaint_count"), ("production_total_units", "future_complaint_count"))


@register(
    "target_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS measure, count({a}) AS cohorts, {num(f'corr({a}, {b})', 'correlation')} FROM (SELECT l.historical_complaint_count, "
        "l.future_complaint_count, p.production_count AS production_total_units FROM lab l LEFT JOIN pmatch p USING (broad_vehicle_id) "
        "WHERE l.eligibility_reason = 'ELIGIBLE')"
        for a, b in _PAIRS
    ),
)
def target_correlations(spark, folder):
    """Pearson correlation of history and of units with the future count, on eligible cohorts."""
    rows = B.Evidence(spark, folder).labelled(with_production=True).where("eligibility_reason = 'ELIGIBLE'")
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("measure"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in _PAIRS
    ])).alias("p")).select("p.*")
    return long.groupBy("measure").agg(F.count("x").alias("cohorts"), statistics.pearson("x", "y").alias("correlation"))


@register("communication_type_counts", "SELECT communication_type, count(*) AS documents FROM docs GROUP BY 1")
def communication_type_counts(spark, folder):
    return communications.documents(B.communication_rows(spark, folder)).groupBy("communication_type").agg(F.count("*").alias("documents"))


@register(
    "communication_component_counts",
    "SELECT component, count(*) AS documents FROM (SELECT unnest(canonical_components) AS component FROM docs) GROUP BY 1",
)
def communication_component_counts(spark, folder):
    docs = communications.documents(B.communication_rows(spark, folder))
    return docs.select(F.explode("canonical_components").alias("component")).groupBy("component").agg(F.count("*").alias("documents"))


# --- guards on seeded faults: both sides must find what was put in ----------------------------------------------


@register(
    "metadata_conflicts_seeded",
    "SELECT source_id, 2::BIGINT AS variants FROM commrows WHERE ascii(right(source_id, 1)) % 10 = 1 GROUP BY 1",
)
def metadata_conflicts_seeded(spark, folder):
    """Every document whose id ends in a character of code 1 modulo 10 gets one more row with another summary."""
    rows = B.communication_rows(spark, folder)
    faulty = rows.where(F.ascii(F.substring("source_id", -1, 1)) % 10 == 1).withColumn("summary", F.lit("another summary"))
    return communications.metadata_conflicts(rows.unionByName(faulty))


@register(
    "orphans_seeded",
    "SELECT applicability_id, communication_id FROM capps WHERE ascii(right(communication_id, 1)) % 10 = 7",
)
def orphans_seeded(spark, folder):
    """Documents whose id ends in a character of code 7 modulo 10 are taken away."""
    rows = B.communication_rows(spark, folder)
    apps = communications.applications(rows, B.normalizer(spark, folder)).select("applicability_id", "communication_id")
    docs = communications.documents(rows).where(F.ascii(F.substring("communication_id", -1, 1)) % 10 != 7)
    return matching.orphans(apps, docs, "communication_id").select("applicability_id", "communication_id")


@register(
    "identity_mismatches_seeded",
    "SELECT broad_vehicle_id, 1::BIGINT AS cohorts, "
    "CASE WHEN ascii(right(broad_vehicle_id, 1)) % 5 = 2 THEN 0 ELSE 1 END::BIGINT AS production, "
    "CASE WHEN ascii(right(broad_vehicle_id, 1)) % 5 = 3 THEN 2 ELSE 1 END::BIGINT AS recalls FROM keys "
    "WHERE ascii(right(broad_vehicle_id, 1)) % 5 IN (2, 3)",
)
def identity_mismatches_seeded(spark, folder):
    """Some cohorts are missing in one table and others are twice in another."""
    e = B.Evidence(spark, folder)
    last = F.ascii(F.substring(C.COHORT_ID, -1, 1)) % 5
    return integration.identity_mismatches({
        "cohorts": e.keys,
        "production": e.production.where(last != 2),
        "recalls": e.recalls.unionByName(e.recalls.where(last == 3)),
    })


@register(
    "filing_conflicts_seeded",
    f"SELECT {S._CONF.replace('type_code', 'type_code AS vehicle_type_code')}, count(DISTINCT production_count) + 1 AS variants FROM "
    "(SELECT DISTINCT * EXCLUDE (source_record_id, source_row_number) FROM canon QUALIFY rank() OVER "
    f"(PARTITION BY {S._CONF} ORDER BY reporting_year DESC, reporting_quarter DESC, report_id DESC) = 1) "
    f"WHERE manufacturer_id = 3 GROUP BY {S._CONF}",
)
def filing_conflicts_seeded(spark, folder):
    """Every filing of one manufacturer is filed once more with other units."""
    rows = exposure.canonical_filings(B.filings(spark, folder), B.normalizer(spark, folder))
    faulty = rows.where("manufacturer_id = 3").withColumn("production_count", F.lit(-1).cast("long"))
    return exposure.period_conflicts(rows.unionByName(faulty))


def _last(modulus: int) -> Column:
    """Code of an id's last character, modulo a number."""
    return F.ascii(F.substring(C.COHORT_ID, -1, 1)) % modulus


@register(
    "alignment_check_seeded",
    "SELECT broad_vehicle_id FROM feat WHERE ascii(right(broad_vehicle_id, 1)) % 7 IN (1, 2, 3)",
)
def alignment_check_seeded(spark, folder):
    """Some cohorts have another year in the targets, no target, or no split."""
    rows = catalogue_model.dataset(spark, folder)
    tgt = catalogue_model.dataset_targets(spark, folder).where(_last(7) != 2)
    moved = tgt.withColumn("model_year", F.when(_last(7) == 1, F.col("model_year") + 1).otherwise(F.col("model_year")))
    return models.alignment_mismatches(rows, moved, rows.select(C.COHORT_ID, "split").where(_last(7) != 3)).select(C.COHORT_ID)


@register(
    "history_reconciliation_seeded",
    "SELECT broad_vehicle_id, CASE WHEN ascii(right(broad_vehicle_id, 1)) % 5 = 1 THEN historical_complaint_count + 1 "
    "WHEN ascii(right(broad_vehicle_id, 1)) % 5 = 3 THEN historical_complaint_count END AS rebuilt, "
    "CASE WHEN ascii(right(broad_vehicle_id, 1)) % 5 IN (1, 2) THEN historical_complaint_count END AS target FROM tgt "
    "WHERE ascii(right(broad_vehicle_id, 1)) % 5 IN (1, 2, 3)",
)
def history_reconciliation_seeded(spark, folder):
    """Some cohorts have a complaint more in the rebuilt history, no rebuilt history, or no target."""
    e = B.Evidence(spark, folder)
    count = F.col("historical_complaint_count")
    built = asof.complaint_features(e.events, e.targets, B.CUTOFF).where(_last(5) != 2)
    more = built.withColumn("historical_complaint_count", F.when(_last(5) == 1, count + 1).otherwise(count))
    return asof.history_mismatches(more, e.targets.where(_last(5) != 3))


@register(
    "pair_alignment_seeded",
    "SELECT cohort_id, CASE WHEN ascii(right(cohort_id, 1)) % 5 = 3 THEN NULL ELSE target END AS y_left, "
    "CASE WHEN ascii(right(cohort_id, 1)) % 5 = 1 THEN 1 - target WHEN ascii(right(cohort_id, 1)) % 5 = 2 THEN NULL ELSE target END AS y_right "
    "FROM pred WHERE ascii(right(cohort_id, 1)) % 5 IN (1, 2, 3)",
)
def pair_alignment_seeded(spark, folder):
    """Some predictions have another label in the second table or are in one of the two only."""
    rows = catalogue_model.predictions(spark, folder)
    last = F.ascii(F.substring("cohort_id", -1, 1)) % 5
    other = rows.where(last != 2).withColumn("target", F.when(last == 1, 1 - F.col("target")).otherwise(F.col("target")))
    return metrics.misaligned(metrics.paired(rows.where(last != 3), other)).select("cohort_id", "y_left", "y_right")


# --- stages of a run ------------------------------------------------------------------------------------------------

_VERSIONS = {"clean": "clean-1", "events": "events-1", "cohorts": "cohorts-1"}
_RUN = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)


def _run_of_stages(spark, folder) -> str:
    """Clean complaints, event features and cohorts, each written with its provenance and read by the next."""
    root = stage_path(spark, "run")
    known = {"version": _VERSIONS["clean"], "run_ts": _RUN}
    clean = tables.write_stage(B.clean(spark, folder), root, "clean", **known)
    events = tables.write_stage(
        complaints.event_features(clean), root, "events", version=_VERSIONS["events"], run_ts=_RUN, inputs=["clean"]
    )
    tables.write_stage(
        complaints.cohort_features(events), root, "cohorts", version=_VERSIONS["cohorts"], run_ts=_RUN, inputs=["events"],
        order=[*C.KEY, C.COHORT_ID],
    )
    return root


@register(
    "stage_chain",
    "SELECT 'clean' AS stage, count(*) AS \"rows\", NULL::VARCHAR AS made_from, count(DISTINCT event_id) AS ids FROM clean UNION ALL "
    "SELECT 'events', count(*), 'clean', count(DISTINCT event_id) FROM ev UNION ALL "
    "SELECT 'cohorts', count(*), 'events', count(DISTINCT broad_vehicle_id) FROM coh",
)
def stage_chain(spark, folder):
    """Three stages written, then opened through the last one's provenance."""
    root = _run_of_stages(spark, folder)
    parts = []
    for name, source, key in (("clean", None, "event_id"), ("events", "clean", "event_id"), ("cohorts", "events", C.COHORT_ID)):
        opened = tables.open_stage(spark, root, name, _VERSIONS)
        parts.append(opened.agg(
            F.lit(name).alias("stage"), F.count("*").alias("rows"), F.lit(source).cast("string").alias("made_from"), F.countDistinct(key).alias("ids")
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "stage_chain_changed",
    "SELECT * FROM (VALUES ('clean', false), ('events', true), ('cohorts', true)) v(stage, refused) WHERE EXISTS (SELECT 1 FROM ev)",
)
def stage_chain_changed(spark, folder):
    """One number of one event is changed in place: that stage and what was made from it are refused."""
    root = _run_of_stages(spark, folder)
    path = f"{root}/events/table"
    rows = spark.read.parquet(path)
    first = rows.agg(F.min("event_id").alias("id")).first()["id"]
    changed = stage(rows.withColumn("mileage", F.when(F.col("event_id") == first, F.coalesce("mileage", F.lit(0)) + 1).otherwise(F.col("mileage"))), "changed")
    changed.write.mode("overwrite").parquet(path)
    found = []
    for name in _VERSIONS:
        try:
            tables.open_stage(spark, root, name, _VERSIONS)
            found.append((name, False))
        except tables.SourceError:
            found.append((name, True))
    return spark.createDataFrame(found, "stage string, refused boolean")


# --- what must hold for fitted models ---------------------------------------------------------------------------


@register("contribution_check", "SELECT split, count(*) AS cohorts, 0::BIGINT AS unexplained FROM mds GROUP BY 1")
def contribution_check(spark, folder):
    """Cohorts by split, and those whose contributions don't add up to the forest's probability."""
    total = F.aggregate("contribution", F.lit(0.0), lambda a, b: a + b)
    gap = F.abs(F.col("baseline") + total - F.col("probability"))
    rows = catalogue_model._contributed(spark, folder, None)[0].join(
        catalogue_model._scored(spark, folder).select(C.COHORT_ID, "split", "probability"), C.COHORT_ID
    )
    return rows.groupBy("split").agg(F.count("*").alias("cohorts"), F.count_if(gap > 1e-12).alias("unexplained"))


@register(
    "prediction_check",
    "SELECT broad_vehicle_id AS cohort_id, split, target, true AS probability_in_range, true AS class_follows_threshold FROM mds WHERE split = 'TEST'",
)
def prediction_check(spark, folder):
    """Identity, label and validity of each row of the forest's prediction table."""
    rows = models.prediction_table(catalogue_model._scored(spark, folder).where("split = 'TEST'"), "random-forest", B.CUTOFF)
    p = F.col("probability")
    return rows.select(
        "cohort_id", "split", "target", p.between(0, 1).alias("probability_in_range"),
        (F.col("predicted_class") == (p >= 0.5).cast("int")).alias("class_follows_threshold"),
    )
