import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.operators import asof, communications, exposure, integration, matching, recalls, targets
from cohortlens.plans import bindings
from tests.helpers import rows
from tests.test_sources import recall

D = dt.date


# --- production ---------------------------------------------------------------------------

CANON = (
    "source_record_id string, manufacturer_id int, reporting_entity string, report_id int, reporting_year int, "
    "reporting_quarter int, original_make string, original_model string, normalized_make string, "
    "normalized_model string, model_year int, platform string, vehicle_type_code string, "
    "fuel_propulsion_system string, production_count bigint"
)


def filing(id_, year, units, *, quarter=4, report=10, fuel="SIF", model="f-150", platform="P702"):
    return (id_, 2, "Ford", report, year, quarter, "FÖRD", model, "förd", model, 2020, platform, "PU", fuel, units)


def test_latest_filing_wins_and_configurations_add_up(spark):
    table = [filing("a", 2014, 50), filing("b", 2024, 80), filing("c", 2024, 20, fuel=None, platform=None)]
    for order in (table, table[::-1]):
        got = exposure.aggregate_production(spark.createDataFrame(order, CANON)).collect()
        assert len(got) == 1
        assert (got[0]["production_count"], got[0]["source_record_count"]) == (100, 2)
        assert got[0]["source_record_ids"] == ["b", "c"] and got[0]["reporting_periods"] == ["2024Q4"]
        assert got[0]["reporting_entity_ids"] == [2]


def test_equal_periods(spark):
    same = spark.createDataFrame([filing("two", 2024, 123), filing("one", 2024, 123)], CANON)
    assert exposure.period_conflicts(same).isEmpty()
    got = exposure.aggregate_production(same).first()
    assert (got["production_count"], got["source_record_ids"]) == (123, ["one"])
    differ = spark.createDataFrame([filing("two", 2024, 123), filing("one", 2024, 124)], CANON)
    assert exposure.period_conflicts(differ).count() == 1
    old = spark.createDataFrame([filing("a", 2014, 1), filing("b", 2014, 2), filing("c", 2024, 3)], CANON)
    assert exposure.period_conflicts(old).isEmpty()


def test_canonical_year_must_round_trip(spark):
    names = exposure.FILING_FIELDS
    base = dict(zip(names, (2, "Ford", 10, 2024, 4, "SIF", "FÖRD", "  F-150 ", "2020", "P702", "L", 123, "PU", 1), strict=True))
    frame = spark.createDataFrame([base, {**base, "model_year": "9999"}, {**base, "model_year": "020"}])
    got = sorted(rows(exposure.canonical_filings(frame), "model_year", "normalized_model"), key=str)
    assert got == [(2020, "f-150"), (None, "f-150"), (None, "f-150")]


def cohort_rows(spark, table):
    return spark.createDataFrame(
        table, "broad_vehicle_id string, normalized_make string, normalized_model string, model_year int, complaint_event_count bigint"
    )


def test_production_matching(spark):
    production = exposure.aggregate_production(spark.createDataFrame([filing("a", 2024, 123)], CANON))
    cohorts = cohort_rows(spark, [("v1", "förd", "f-150", 2020, 4), ("v2", "förd", "other", 2020, 1)])
    got = {r[0]: r for r in exposure.match_production(cohorts, production).collect()}
    assert got["v1"]["production_match_status"] == "EXACT"
    assert got["v1"]["complaints_per_10k_produced"] == pytest.approx(325.203252, abs=1e-6)
    assert got["v2"]["production_match_status"] == "NO_PRODUCTION_RECORD"
    assert got["v2"]["production_count"] is None and got["v2"]["production_source_record_ids"] == []
    alias = spark.createDataFrame([("förd", "other", "förd", "f-150")], "make string, model string, alias_make string, alias_model string")
    got = {r[0]: r for r in exposure.match_production(cohorts, production, alias).collect()}
    assert got["v2"]["production_match_status"] == "EXPLICIT_ALIAS" and got["v2"]["production_count"] == 123
    twice = exposure.match_production(cohorts, production.unionByName(production)).where("broad_vehicle_id = 'v1'").first()
    assert (twice["production_match_status"], twice["match_method"]) == ("AMBIGUOUS", "exact_normalized")
    assert (twice["production_count"], twice["ambiguity_candidate_count"]) == (None, 2)
    zero = exposure.aggregate_production(spark.createDataFrame([filing("a", 2024, 0)], CANON))
    row = exposure.match_production(cohorts, zero).where("broad_vehicle_id = 'v1'").first()
    assert (row["production_count"], row["complaints_per_10k_produced"]) == (0, None)


# --- communications --------------------------------------------------------------------------


def communication(spark):
    base = ["10000001", None, "20210102", "TSB-1", "20201231", None, "Service Bulletin/Repair Instructions",
            " FÖRD ", " F-150 ", "2020", "STEERING", None, None, "Text"]

    def row(**over):
        values = dict(zip(C.COMMUNICATION_COLUMNS, base, strict=True)) | over
        return tuple(values[n] for n in C.COMMUNICATION_COLUMNS)

    table = [row(), row(year="2021"), row(component="SUSPENSION"),
             row(source_id="10000002", type="Other", year="9999", system="Body")]
    return spark.createDataFrame(table, ", ".join(f"{n} string" for n in C.COMMUNICATION_COLUMNS))


def test_communication_rollup_and_audit(spark):
    raw = communication(spark)
    docs = {r["source_id"]: r for r in communications.documents(raw).collect()}
    assert len(docs) == 2
    first = docs["10000001"]
    assert first["canonical_components"] == ["steering", "suspension"] and first["source_row_count"] == 3
    assert (first["date_added"], first["communication_date"]) == (D(2021, 1, 2), D(2020, 12, 31))
    assert docs["10000002"]["component_systems"] == ["Body"]
    apps = communications.applications(raw)
    assert apps.count() == 3
    status = dict(rows(apps, "original_model_year", "source_expanded_row_count"))
    assert status == {"2020": 2, "2021": 1, "9999": 1}
    compact = spark.createDataFrame(
        [("10000001", " FÖRD ", " F-150 ", "2020,2021"), ("10000002", " FÖRD ", " F-150 ", "9999")],
        "source_id string, make string, model string, years string",
    )
    audit = {r["grain"]: r for r in communications.audit_views(raw, communications.compact_products(compact)).collect()}
    assert audit["identifier"]["overlap_count"] == 2 and audit["product"]["overlap_count"] == 3
    assert communications.metadata_conflicts(raw).isEmpty()
    clash = raw.unionByName(raw.limit(1).withColumn("summary", F.lit("Else")))
    assert communications.metadata_conflicts(clash).count() == 1
    profile = communications.document_profile(communications.documents(raw)).first()
    assert profile["repeated_manufacturer_document_id_count"] == 1


def test_documents_of_some_columns(spark):
    raw = communication(spark)
    raw = raw.unionByName(raw).repartition(5)
    whole = communications.documents(raw)
    for names in (asof.COMMUNICATION_FACTS, communications.EVIDENCE_FACTS, ["source_row_count"], ["component_systems", "date_quality_flags"]):
        part = communications.documents(raw, columns=names)
        assert part.columns == ["communication_id", "source_id", *names]
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(*part.columns).collect()))
    clash = raw.unionByName(raw.limit(1).withColumn("summary", F.lit("Else")))
    with pytest.raises(Exception, match="differ within document"):
        communications.documents(clash, columns=["date_added"]).collect()


def test_links_and_facts_meet_without_moving_again(spark, folder):
    e = bindings.Evidence(spark, folder)
    for links, facts, key in (
        (e.communication_links, e.document_facts("date_added"), "source_id"),
        (e.recall_links, e.campaign_facts("report_received_dates"), "campaign_number"),
    ):
        pairs = links.select("matched_broad_vehicle_id", key).distinct()
        plan = pairs.join(facts.hint("shuffle_hash"), key)._jdf.queryExecution().executedPlan().toString()
        assert not re.findall(rf"hashpartitioning\({key}#\d+, \d+\), ENSURE_REQUIREMENTS", plan)
        assert "hashpartitioning(matched_broad_vehicle_id" not in plan


def test_communication_matching(spark):
    raw = communication(spark)
    docs, apps = communications.documents(raw), communications.applications(raw)
    cohorts = cohort_rows(
        spark, [("v20", "förd", "f-150", 2020, 5), ("v21", "förd", "f-150", 2021, 3), ("none", "x", "y", 2020, 2)]
    )
    matched = matching.match_applications(apps, cohorts)
    assert sorted(r[0] for r in rows(matched, "complaint_match_status")) == ["EXACT", "EXACT", "INSUFFICIENT_VEHICLE_IDENTITY"]
    evidence = communications.cohort_evidence(cohorts, matched, docs)
    got = {r[0]: r for r in evidence.collect()}
    assert got["v20"]["source_expanded_row_count"] == 2 and got["v20"]["unique_communication_count"] == 1
    assert got["none"]["unique_communication_count"] == 0 and got["none"]["first_communication_date"] is None
    production = spark.createDataFrame([("v20", 9), ("v21", None), ("none", None)], "broad_vehicle_id string, production_count bigint")
    cover = matching.cross_source_coverage(evidence, production, evidence)
    assert dict(rows(matching.category_totals(cover), "coverage_category", "cohorts")) == {
        "complaint_production_manufacturer_communications": 1, "complaint_manufacturer_communications": 1, "complaint_only": 1,
    }
    twins = cohort_rows(spark, [("a", "förd", "f-150", 2020, 1), ("b", "förd", "f-150", 2020, 1)])
    found = matching.match_applications(apps, twins).where("model_year = 2020").first()
    assert (found["complaint_match_status"], found["matched_broad_vehicle_id"], found["ambiguity_candidate_count"]) == ("AMBIGUOUS", None, 2)
    alias = spark.createDataFrame([("förd", "f-150", "x", "y")], "make string, model string, alias_make string, alias_model string")
    far = matching.match_applications(apps, cohort_rows(spark, [("none", "x", "y", 2020, 2)]), alias)
    assert dict(rows(far, "original_model_year", "complaint_match_status"))["2020"] == "EXPLICIT_ALIAS"


def test_unmatched_classes(spark):
    source = cohort_rows(spark, [("s1", "a", "m", 2020, 1), ("s2", "b", "n", 2021, 1), ("s3", "c", "m", None, 1)])
    lost = cohort_rows(
        spark, [("1", "c", "m", 2020, 1), ("2", "a", "n", 2020, 1), ("3", "a", "m", 1999, 1), ("4", "a", "m", 2021, 1)]
    )
    got = matching.unmatched_class(lost, source, make_label="make", year_label="year")
    assert dict(rows(got, "broad_vehicle_id", "mismatch_class")) == {
        "1": "make", "2": "model_absent_for_make", "3": "year", "4": "make_model_year_combination_absent",
    }


# --- recalls -----------------------------------------------------------------------------------


def recall_rows(spark, extra=()):
    post = "post.txt"
    table = [
        (*recall(RECORD_ID="1", CAMPNO="09V001000", YEARTXT="2009", POTAFF="20"), "pre.txt"), (*recall(), post),
        (*recall(RECORD_ID="123457", YEARTXT="2021"), post), (*recall(RECORD_ID="123458", COMPNAME="STEERING"), post),
        (*recall(RECORD_ID="123459", CAMPNO="22E177000", YEARTXT="9999", RCLTYPECD="E", POTAFF="7", COMPNAME="EQUIPMENT"), post),
        *extra,
    ]
    return spark.createDataFrame(table, ", ".join(f"{n} string" for n in (*C.RECALL_COLUMNS, "source_file")))


def test_campaigns_and_matching(spark):
    raw = recall_rows(spark)
    table = recalls.campaigns(raw)
    got = {r["campaign_number"]: r for r in table.collect()}
    assert len(got) == 3
    big = got["22V176000"]
    assert big["potential_units_affected"] == 100 and big["source_row_count"] == 3
    assert big["canonical_components"] == ["steering", "suspension"] and big["notes"] == []
    assert big["report_received_dates"] == [D(2022, 3, 23)] and big["quality_flags"] == []
    apps = recalls.applications(raw)
    assert apps.count() == 4
    cohorts = cohort_rows(spark, [("v1", "förd", "f-150", 2022, 10), ("v2", "unknown", "model", 2022, 2)])
    matched = matching.match_applications(apps, cohorts)
    evidence = {r[0]: r for r in recalls.cohort_evidence(cohorts, matched, table).collect()}
    assert (evidence["v1"]["unique_recall_campaign_count"], evidence["v1"]["recall_applicability_row_count"]) == (1, 2)
    assert evidence["v2"]["recall_match_status"] == "NO_MATCH" and evidence["v2"]["unique_recall_campaign_count"] == 0
    summary = matching.evidence_summary(recalls.cohort_evidence(cohorts, matched, table), "unique_recall_campaign_count").first()
    assert (summary["matched_cohort_count"], summary["matched_event_count"]) == (1, 10)
    assert recalls.campaign_profile(table).first()["campaigns_with_multiple_source_rows"] == 1


def test_population_conflict_and_bad_dates(spark):
    raw = recall_rows(spark, [(*recall(RECORD_ID="9", POTAFF="200", ODATE="soon"), "post.txt")])
    row = recalls.campaigns(raw).where("campaign_number = '22V176000'").first()
    assert row["potential_units_affected"] is None and row["potential_units_affected_values"] == [100, 200]
    assert row["quality_flags"] == ["multiple_potential_units_affected_values", "unparseable_date_value"]


def test_campaigns_of_some_columns(spark):
    raw = recall_rows(spark, [(*recall(RECORD_ID="9", CAMPNO="23V000001"), "post.txt")] * 40).repartition(5)
    whole = recalls.campaigns(raw)
    for names in (["report_received_dates"], ["notes"], ["potential_units_affected", "source_row_count"], [*recalls.PROFILED]):
        part = recalls.campaigns(raw, columns=names)
        assert part.columns == ["campaign_id", "campaign_number", *names]
        assert sorted(map(tuple, part.collect())) == sorted(rows(whole, *part.columns))
    assert recalls.campaigns(raw, columns=["notes"]).count() == 4
    # Rows move once as they are, and again as distinct values: no row becomes one for each field before it is moved.
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.rindex("Generate") < plan.rindex("Exchange hashpartitioning")


# --- integration, targets, as-of ------------------------------------------------------------------

EVENT = "broad_vehicle_id string, report_date date, severity string, component string"


def target_events(spark):
    table = [
        ("c1", D(2022, 12, 31), "low", "other"), ("c1", D(2023, 1, 1), "low", "engine"),
        ("c1", D(2023, 12, 31), "critical", "brakes"), ("c1", D(2024, 1, 1), "low", "electrical"),
        ("c1", D(2024, 12, 31), "low", "steering"), ("c2", D(2022, 1, 1), "low", "other"),
        ("c3", D(2022, 6, 1), "low", "other"), ("c4", D(2023, 6, 1), "low", "transmission"),
    ]
    return spark.createDataFrame(table, EVENT)


def target_cohorts(spark):
    return cohort_rows(
        spark, [("c1", "a", "m", 2020, 5), ("c2", "b", "m", 2020, 1), ("c3", "d", "m", 2023, 1), ("c4", "c", "m", 2020, 1)]
    )


def test_targets(spark):
    cutoff, end = D(2022, 12, 31), D(2024, 12, 31)
    lab = targets.labelled_cohorts(target_events(spark), target_cohorts(spark), cutoff=cutoff, months=12, corpus_end=end)
    assert dict(rows(lab, "broad_vehicle_id", "eligibility_reason")) == {
        "c1": "ELIGIBLE", "c2": "ELIGIBLE", "c3": "MODEL_YEAR_AFTER_CUTOFF", "c4": "NO_HISTORICAL_COMPLAINT",
    }
    got = {r[0]: r for r in targets.target_table(lab, cutoff=cutoff, months=12).collect()}
    c1 = got["c1"]
    assert len(c1) == 26
    assert (c1["historical_complaint_count"], c1["future_complaint_count"]) == (1, 2)
    assert c1["future_complaint_at_least_2"] and not c1["future_complaint_at_least_3"]
    assert (c1["future_severe_complaint_count"], c1["future_component_engine_complaint_count"]) == (1, 1)
    assert (c1["future_component_brakes_complaint_count"], c1["future_component_electrical_complaint_count"]) == (1, 0)
    assert (c1["future_window_start"], c1["future_window_end"]) == (D(2023, 1, 1), D(2023, 12, 31))
    assert got["c2"]["future_any_complaint"] is False
    longer = targets.labelled_cohorts(target_events(spark), target_cohorts(spark), cutoff=cutoff, months=24, corpus_end=end)
    assert longer.where("broad_vehicle_id = 'c1'").first()["future_complaint_count"] == 4
    with pytest.raises(ValueError):
        targets.labelled_cohorts(target_events(spark), target_cohorts(spark), cutoff=cutoff, months=25, corpus_end=end)
    blank = cohort_rows(spark, [("", "a", "m", 2020, 1), ("x", "a", None, 2020, 1)])
    reason = targets.eligibility_reason(cutoff, F.lit(1))
    assert [r[0] for r in rows(blank, reason)] == ["INVALID_COHORT_IDENTITY"] * 2
    assert rows(blank, targets.eligibility_reason(cutoff, F.lit(1), False))[0] == ("INCOMPLETE_FUTURE_WINDOW",)


def test_concentration_splits_a_tied_boundary(spark):
    df = spark.createDataFrame([(9,), (5,), (5,), (5,), *[(0,)] * 16], "x long")
    got = dict(rows(targets.concentration(df, "x", (0.01, 0.10)), "top_share", "event_share"))
    assert got == {0.01: pytest.approx(9 / 24), 0.10: pytest.approx(14 / 24)}


def test_temporal_feasibility(spark):
    events = spark.createDataFrame(
        [("c1", D(2021, 1, 1)), ("c1", D(2022, 6, 1)), ("c2", D(2023, 6, 1))], "broad_vehicle_id string, report_date date"
    )
    periods = spark.createDataFrame([("c1", ["2020Q4"]), ("c2", None)], "broad_vehicle_id string, production_reporting_periods array<string>")
    sent = spark.createDataFrame([("c1", D(2021, 6, 1))], "broad_vehicle_id string, earliest_date date")
    called = spark.createDataFrame([("c1", D(2021, 7, 1))], "broad_vehicle_id string, earliest_date date")
    got = integration.temporal_feasibility(events, periods, sent, called).orderBy("cutoff").collect()
    first, last = got[0], got[-1]
    assert (first["prior_cohorts"], first["cohorts_active_12m"], first["events_12m"]) == (1, 1, 1)
    assert (first["cohorts_with_production_period"], first["cohorts_with_communications"], first["cohorts_with_recalls"]) == (1, 1, 1)
    assert first["window_complete_24m"] is False and first["cohorts_active_24m"] is None
    assert last["prior_cohorts"] == 2 and last["cohorts_observed_12m"] == 0


def test_complaint_names():
    assert integration.complaint_name("component_engine_complaint_count") == "complaint_component_engine_count"
    assert integration.complaint_name("model_year") == "model_year"
    assert integration.complaint_name("mileage_observed_count") == "complaint_mileage_observed_count"


def test_identity_mismatches(spark):
    a = spark.createDataFrame([("1",), ("2",)], "broad_vehicle_id string")
    b = spark.createDataFrame([("1",), ("1",), ("3",)], "broad_vehicle_id string")
    assert sorted(r[0] for r in rows(integration.identity_mismatches({"a": a, "b": b}), "broad_vehicle_id")) == ["1", "2", "3"]
    assert integration.identity_mismatches({"a": a, "b": a}).isEmpty()


def test_asof_documents(spark):
    target = cohort_rows(spark, [("c1", "a", "m", 2000, 3), ("c2", "b", "m", 2000, 1), ("c3", "c", "m", 2000, 1)])
    cutoff = D(2022, 12, 31)
    docs = spark.createDataFrame(
        [("before", D(2022, 12, 31), "OTHER", ["engine"]), ("after", D(2023, 1, 1), "OTHER", ["brakes"])],
        "communication_id string, date_added date, communication_type string, canonical_components array<string>",
    )
    apps = spark.createDataFrame(
        [("before", "c1"), ("before", "c1"), ("after", "c1"), ("after", "c2"), ("before", None)],
        "communication_id string, matched_broad_vehicle_id string",
    )
    got = {r[0]: r for r in asof.communication_features(apps, docs, target, cutoff).collect()}
    assert got["c1"]["historical_unique_communication_count"] == 1
    assert got["c1"]["historical_communication_component_brakes_count"] == 0
    assert got["c2"]["communication_asof_status"] == "MATCHED_RECORDS_AFTER_CUTOFF_ONLY"
    assert got["c3"]["communication_asof_status"] == "NO_MATCHED_RECORD"
    camps = spark.createDataFrame(
        [("r1", [D(2022, 12, 31)], ["brakes"], ["135"], [], ["Yes"], []), ("r2", [D(2023, 1, 1)], [], [], ["573"], [], []),
         ("r3", [], [], [], [], [], [])],
        "campaign_id string, report_received_dates array<date>, canonical_components array<string>, fmvss_numbers array<string>, "
        "regulation_part_numbers array<string>, do_not_drive_values array<string>, park_outside_values array<string>",
    )
    apps = spark.createDataFrame(
        [("r1", "c1"), ("r1", "c1"), ("r2", "c1"), ("r2", "c2"), ("r3", "c3")], "campaign_id string, matched_broad_vehicle_id string"
    )
    got = {r[0]: r for r in asof.recall_features(apps, camps, target, cutoff).collect()}
    assert (got["c1"]["historical_unique_recall_campaign_count"], got["c1"]["historical_recall_do_not_drive_count"]) == (1, 1)
    assert got["c2"]["historical_unique_recall_campaign_count"] == 0
    assert got["c3"]["recall_asof_status"] == "MATCHED_RECORDS_AFTER_CUTOFF_ONLY"


def test_later_events_do_not_change_asof_features(spark, folder):
    from cohortlens.plans import bindings as B

    e = B.Evidence(spark, folder)
    whole = asof.complaint_features(e.events, e.targets, B.CUTOFF)
    history = e.events.where(F.col("report_date") <= F.lit(B.CUTOFF))
    cut = asof.complaint_features(history, e.targets, B.CUTOFF)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()
    assert asof.history_mismatches(whole, e.targets).isEmpty()


def test_feeds_share_lines_joined_once(spark, folder):
    evidence = bindings.Evidence(spark, folder)
    for rows, own in (
        (bindings.communication_rows(spark, folder, evidence.ordered_lines), bindings.communication_rows(spark, folder)),
        (bindings.recall_rows(spark, folder, evidence.lines), bindings.recall_rows(spark, folder)),
        (bindings.filings(spark, folder, evidence.lines), bindings.filings(spark, folder)),
    ):
        assert rows.count() > 0 and rows.exceptAll(own).isEmpty() and own.exceptAll(rows).isEmpty()
    for rows in (evidence.communication_documents, evidence.communication_applications, evidence.campaigns):
        assert rows.inputFiles() and not [f for f in rows.inputFiles() if f.endswith(("lineitem.parquet", "orders.parquet"))]


def test_links_and_signals_tell_what_documents_tell(spark, folder):
    e = bindings.Evidence(spark, folder, event_columns=asof.EVENT_COLUMNS)
    assert set(e.events.columns) == set(asof.EVENT_COLUMNS) and "p_name" not in e.lines.columns
    documents = bindings.communications.documents(bindings.communication_rows(spark, folder))
    signals = e.document_signals("date_added", "communication_type", "communication_date", "component_bits")
    rows = documents.join(signals.withColumnsRenamed({n: f"s_{n}" for n in signals.columns}), F.col("source_id") == F.col("s_source_id"))
    bits = sum(
        (F.array_contains("canonical_components", n).cast("bigint") * F.lit(1 << i).cast("bigint") for i, n in enumerate(C.COMPONENTS)),
        F.lit(0).cast("bigint"),
    )
    place = F.array_position(F.array(*[F.lit(n) for n in C.COMMUNICATION_TYPES]), F.col("communication_type")) - 1
    same = (
        F.col("date_added").eqNullSafe(F.col("s_date_added")) & F.col("communication_date").eqNullSafe(F.col("s_communication_date"))
        & (place == F.col("s_communication_type")) & (bits == F.col("s_component_bits"))
    )
    assert rows.count() == documents.count() == signals.count() and rows.where(~same).isEmpty()
    # Links name each document and cohort once, as matching every application does.
    links = e.named(e.communication_pairs.withColumnRenamed("matched_broad_vehicle_id", C.COHORT_ID)).select("source_id", C.COHORT_ID)
    every = e.communication_matches.where(F.col("matched_broad_vehicle_id").isNotNull()).select("source_id", "matched_broad_vehicle_id").distinct()
    assert links.count() == every.count() and links.exceptAll(every).isEmpty()


def test_lines_are_staged_once_by_product_number(spark, folder, tmp_path):
    """Lines hold no labels, and lines without an order stay for the feeds that need none."""
    for name in ("lineitem", "part", "orders"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        rows = rows.where("o_orderkey % 3 <> 0") if name == "orders" else rows
        if name == "part":  # labels may be null
            rows = rows.withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    e = bindings.Evidence(spark, str(tmp_path), event_columns=asof.EVENT_COLUMNS)
    assert "p_product" in e.product_lines.columns and not set(bindings.PRODUCT_COLUMNS) & set(e.product_lines.columns)
    assert e.products.count() == e.products.select(*bindings.PRODUCT_COLUMNS).distinct().count()
    for lines, orders in ((e.lines, False), (e.ordered_lines, True)):
        own = bindings._lines(spark, str(tmp_path), orders=orders).select(*lines.columns)
        assert lines.count() > 0 and lines.exceptAll(own).isEmpty() and own.exceptAll(lines).isEmpty()
    assert e.lines.count() > e.ordered_lines.count()
    signals = e.document_signals("date_added", "component_bits")
    own = bindings.communications.signals(bindings.communication_rows(spark, str(tmp_path)), ["date_added", "component_bits"])
    assert signals.count() > 0 and signals.exceptAll(own).isEmpty() and own.exceptAll(signals).isEmpty()


def test_signals_refuse_documents_whose_rows_disagree(spark):
    names = ("source_id", *communications.METADATA)
    rows = spark.createDataFrame(
        [("1", "", "20200101", "d", "20200101", "", "Other", "a"), ("1", "", "20200101", "d", "20200101", "", "Other", "b")],
        ", ".join(f"{n} string" for n in names),
    )
    with pytest.raises(Exception, match="document-level fields differ within document 1"):
        communications.signals(rows, ["date_added"]).collect()
