"""Queries over events, documents, matching, integration, targets and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import identity, numbers, text
from cohortlens.operators import (
    asof, communications, complaints, exposure, integration, matching, recalls, statistics, targets,
)
from cohortlens.plans import bindings as B
from cohortlens.plans import sqlstages as _sqlstages  # noqa: F401 - adds its stages
from cohortlens.plans import sqltext as S
from cohortlens.plans.registry import arr, day, num, pretty, register
from cohortlens.session import stage
from cohortlens.sources import readers, tables

c = F.col

# --- events -------------------------------------------------------------------------------


@register("cohort_rollup", f"SELECT {pretty(C.COHORT_FEATURE_COLUMNS)} FROM coh")
def cohort_rollup(spark, folder):
    """Raw rows to the 93-column cohort table."""
    return B.cohorts(spark, folder)


@register("event_features", f"SELECT {pretty(C.EVENT_FEATURE_COLUMNS)} FROM ev")
def event_features(spark, folder):
    return complaints.event_features(B.clean(spark, folder))


@register(
    "event_quality_flags",
    "SELECT event_id, source_reference_id, source_make, source_model, source_model_year, source_component, "
    "array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN quality_{n} THEN '{n}' END" for n in C.QUALITY_FLAGS)
    + "], lambda f: f IS NOT NULL), '|') AS quality_flags FROM clean",
)
def event_quality_flags(spark, folder):
    return B.clean(spark, folder).select(
        "event_id", "source_reference_id", "source_make", "source_model", "source_model_year",
        "source_component", "quality_flags",
    )


@register(
    "flag_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS flag, count(*) FILTER (quality_{n}) AS \"rows\" FROM clean" for n in C.QUALITY_FLAGS
    ),
)
def flag_counts(spark, folder):
    return complaints.flag_counts(B.clean(spark, folder))


@register(
    "map_reasons",
    "SELECT reason, count(*) AS \"rows\" FROM mapped WHERE reason IS NOT NULL GROUP BY 1",
)
def map_reasons(spark, folder):
    return complaints.reason_counts(B.mapped(spark, folder))


@register(
    "excluded_rows",
    "SELECT CMPLID AS source_record_id, ODINO AS source_reference_id, PROD_TYPE AS source_product_type, "
    "MAKETXT AS source_make, MODELTXT AS source_model, YEARTXT AS source_model_year, COMPDESC AS source_component, "
    "reason, detail AS message FROM mapped WHERE reason IS NOT NULL",
)
def excluded_rows(spark, folder):
    return complaints.excluded_complaints(B.mapped(spark, folder))


@register(
    "clean_vs_excluded",
    "SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS accepted_rows, "
    "count(*) FILTER (reason IS NOT NULL) AS rejected_rows, 0::BIGINT AS unaccounted_rows FROM mapped",
)
def clean_vs_excluded(spark, folder):
    return tables.conservation(B.mapped(spark, folder))


@register(
    "component_map",
    "SELECT COMPDESC AS source_component, component, count(*) AS \"rows\" FROM mapped GROUP BY 1, 2",
)
def component_map(spark, folder):
    mapped = B.mapped(spark, folder)
    return mapped.groupBy(c("COMPDESC").alias("source_component"), "component").agg(
        F.count("*").alias("rows")
    )


@register(
    "severity",
    "SELECT severity, DEATHS AS deaths, INJURED AS injured, CRASH AS crash, FIRE AS fire, count(*) AS \"rows\" "
    "FROM mapped GROUP BY ALL",
)
def severity(spark, folder):
    return B.mapped(spark, folder).groupBy(
        "severity", c("DEATHS").alias("deaths"), c("INJURED").alias("injured"),
        c("CRASH").alias("crash"), c("FIRE").alias("fire"),
    ).agg(F.count("*").alias("rows"))


@register(
    "cohort_guards",
    "SELECT (SELECT (count(*) - count(DISTINCT event_id))::BIGINT FROM ev) AS repeated_event_rows, "
    "(SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY normalized_make, normalized_model, model_year "
    "HAVING count(DISTINCT broad_vehicle_id) > 1)) AS cohorts_with_several_ids",
)
def cohort_guards(spark, folder):
    return complaints.cohort_guards(B.events(spark, folder))


_LABELS = "SELECT DISTINCT lower(p_brand) AS make, lower(p_type) AS model, 1950 + p_size AS year FROM part"


@register(
    "identity_hashes",
    f"SELECT make, model, year::INTEGER AS year, {S.association('make', 'model', 'year')} AS association_id, "
    f"{S.association('make', 'model', 'year', 'vehicle_')} AS vehicle_id, "
    f"{S.configuration('make', 'model', 'year', chr(39) + 'cvt' + chr(39), chr(39) + 'awd' + chr(39))} AS configuration_id, "
    "'nhtsa_mc_app_' || sha256('[\"1\",\"' || make || '\",\"' || model || '\",\"' || year || '\"]') AS application_id, "
    f"true AS well_formed FROM ({_LABELS})",
)
def identity_hashes(spark, folder):
    labels = B.table(spark, folder, "part").select(
        F.lower("p_brand").alias("make"), F.lower("p_type").alias("model"),
        (F.lit(1950) + c("p_size")).alias("year"),
    ).distinct()
    conf = identity.configuration_id(c("make"), c("model"), c("year"), F.lit("cvt"), F.lit("awd"))
    return labels.select(
        "make", "model", "year",
        identity.association_id(c("make"), c("model"), c("year")).alias("association_id"),
        identity.vehicle_id(c("make"), c("model"), c("year")).alias("vehicle_id"),
        conf.alias("configuration_id"),
        identity.application_id(
            C.COMMUNICATION_PREFIX, F.lit("1"), c("make"), c("model"), c("year").cast("string")
        ).alias("application_id"),
        identity.is_configuration_id(conf).alias("well_formed"),
    )


@register(
    "alias_lookup",
    f"SELECT TRANS_TYPE AS transmission_text, DRIVE_TRAIN AS drivetrain_text, "
    f"{S.alias_case('TRANS_TYPE', C.TRANSMISSION_ALIASES)} AS transmission, "
    f"{S.alias_case('DRIVE_TRAIN', C.DRIVETRAIN_ALIASES)} AS drivetrain, count(*) AS \"rows\" FROM raw GROUP BY ALL",
)
def alias_lookup(spark, folder):
    # Labels are few, so they are counted first and normalized once each.
    seen = B.raw_complaints(spark, folder).groupBy("TRANS_TYPE", "DRIVE_TRAIN").agg(F.count("*").alias("rows"))
    return seen.select(
        c("TRANS_TYPE").alias("transmission_text"), c("DRIVE_TRAIN").alias("drivetrain_text"),
        text.transmission(c("TRANS_TYPE")).alias("transmission"),
        text.drivetrain(c("DRIVE_TRAIN")).alias("drivetrain"), "rows",
    )


@register("normalize_identity_unicode")
def normalize_identity_unicode(spark, folder):
    """Full Unicode normalization of every free text; no SQL twin (NFKC)."""
    rows = B.text_columns(spark, folder)
    folded = text.normalize_identity(c("text"))
    return rows.select("origin", "id", "part", F.md5(folded).alias("digest"), F.length(folded).alias("length"))


@register(
    "normalize_by_dictionary",
    'SELECT normalized_make AS make, normalized_model AS model, count(*) AS "rows" FROM parsed GROUP BY 1, 2',
)
def normalize_by_dictionary(spark, folder):
    """The same rule through a staged dictionary of distinct labels."""
    labelled = B.raw_complaints(spark, folder).select("MAKETXT", "MODELTXT")
    done = text.normalize_by_dictionary(labelled, {"MAKETXT": "make", "MODELTXT": "model"})
    return done.groupBy("make", "model").agg(F.count("*").alias("rows"))


# --- parsers, dates, numbers -----------------------------------------------------------------

_ODD = (
    "CASE WHEN o_orderkey % 17 = 0 THEN '20230230' WHEN o_orderkey % 19 = 0 THEN '2020-01-01' "
    "WHEN o_orderkey % 23 = 0 THEN '00000101' WHEN o_orderkey % 29 = 0 THEN '18501231' "
    "WHEN o_orderkey % 31 = 0 THEN NULL ELSE {fmt} END"
)
_ODD_SQL = _ODD.replace("{fmt}", "strftime(o_orderdate, '%Y%m%d')")


def _odd_dates(spark, folder):
    rule = _ODD.replace("{fmt}", B.compact("o_orderdate"))
    return B.table(spark, folder, "orders").select(
        "o_orderkey", F.expr(rule).alias("value"), F.expr("substring(o_orderpriority, 1, 1)").alias("digit"),
        F.expr("cast(1880 + o_orderkey % 300 as string)").alias("year_text"),
    )


@register(
    "strict_lenient_dates",
    f"SELECT o_orderkey, value, {day('parsed')}, {S.year_of('year_text')} AS model_year, "
    "try_cast(digit AS BIGINT) AS number FROM "
    "(SELECT *, CASE WHEN year(d) >= 1 THEN d END AS parsed FROM (SELECT *, "
    f"{S.day_of('value')} AS d FROM (SELECT o_orderkey, {_ODD_SQL} AS value, substring(o_orderpriority, 1, 1) AS digit, "
    "cast(1880 + o_orderkey % 300 as VARCHAR) AS year_text FROM orders)))",
)
def strict_lenient_dates(spark, folder):
    return _odd_dates(spark, folder).select(
        "o_orderkey", "value", text.compact_date(c("value")).alias("parsed"),
        text.model_year(c("year_text")).alias("model_year"), text.unsigned(c("digit")).alias("number"),
    )


_FD, _FF = S.flagged("value", "date_added")


@register(
    "flagged_dates",
    f"SELECT o_orderkey, value, {day(f'({_FD})', 'parsed')}, {_FF} AS flag "
    f"FROM (SELECT o_orderkey, coalesce({_ODD_SQL}, '') AS value FROM orders)",
)
def flagged_dates(spark, folder):
    rows = _odd_dates(spark, folder).withColumn("value", F.coalesce("value", F.lit("")))
    parsed, flag = text.flagged_date(c("value"), "date_added")
    return rows.select("o_orderkey", "value", parsed.alias("parsed"), flag.alias("flag"))


@register(
    "period_labels",
    "SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS period, year(l_shipdate) <= 1998 AS by_1998, "
    "count(*) AS \"rows\" FROM lineitem GROUP BY ALL",
)
def period_labels(spark, folder):
    label = text.period_label(F.year("l_shipdate"), F.quarter("l_shipdate"))
    counted = B.table(spark, folder, "lineitem").groupBy(label.alias("period")).agg(F.count("*").alias("rows"))
    return counted.select("period", text.any_period_by(F.array("period"), 1998).alias("by_1998"), "rows")


@register(
    "date_windows",
    "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS next_month, "
    "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS next_year, "
    + ", ".join(
        f"o_orderdate >= DATE '{numbers.recency_start(B.CUTOFF, m).isoformat()}' AND o_orderdate <= {S.CUT} AS last_{m}m"
        for m in C.RECENCY_MONTHS
    )
    + " FROM orders",
)
def date_windows(spark, folder):
    d = F.to_date("o_orderdate")
    recent = [
        d.between(F.lit(numbers.recency_start(B.CUTOFF, m)), F.lit(B.CUTOFF)).alias(f"last_{m}m")
        for m in C.RECENCY_MONTHS
    ]
    return B.table(spark, folder, "orders").select(
        "o_orderkey", numbers.add_months(d, 1).alias("next_month"),
        numbers.add_months(d, 12).alias("next_year"), *recent,
    )


@register(
    "age_and_delay",
    "SELECT p_size, count(*) AS \"rows\", sum(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE))::BIGINT AS delay_days, "
    "count(*) FILTER (CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) AS negative_delays, "
    "sum(CASE WHEN year(l_shipdate) >= 1950 + p_size THEN year(l_shipdate) - 1950 - p_size END)::BIGINT AS age_years, "
    "count(*) FILTER (year(l_shipdate) < 1950 + p_size) AS before_model_year, "
    "sum(month(l_shipdate))::BIGINT AS months FROM line3 GROUP BY 1",
)
def age_and_delay(spark, folder):
    age, early = numbers.age(c("l_shipdate"), F.lit(1950) + c("p_size"))
    delay = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return B._lines(spark, folder, orders=True).groupBy("p_size").agg(
        F.count("*").alias("rows"), F.sum(delay).alias("delay_days"),
        F.count_if(delay < 0).alias("negative_delays"), F.sum(age).alias("age_years"),
        F.count_if(early).alias("before_model_year"), F.sum(F.month("l_shipdate")).alias("months"),
    )


@register(
    "share_and_rate",
    f"SELECT p_brand, {num('r / n::DOUBLE', 'returned_share')}, {num('e / nullif(f, 0)::DOUBLE', 'early_share_of_filled')}, "
    f"{num('CASE WHEN q > 0 THEN r * 10000.0::DOUBLE / q END', 'returns_per_10k_units')} FROM "
    "(SELECT p_brand, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'F' AND l_shipdate < TIMESTAMP '1995-03-01') AS e, "
    "count(*) FILTER (l_linestatus = 'F' AND p_size > 49) AS f, sum(CAST(l_quantity AS BIGINT)) FILTER (p_size <> 50) AS q FROM line2 GROUP BY 1)",
)
def share_and_rate(spark, folder):
    grouped = B._lines(spark, folder, orders=False).groupBy("p_brand").agg(
        F.count("*").alias("n"), F.count_if(c("l_returnflag") == "R").alias("r"),
        F.count_if((c("l_linestatus") == "F") & (c("l_shipdate") < "1995-03-01")).alias("e"),
        F.count_if((c("l_linestatus") == "F") & (c("p_size") > 49)).alias("f"),
        F.sum(F.when(c("p_size") != 50, c("l_quantity").cast("bigint"))).alias("q"),
    )
    return grouped.select(
        "p_brand", numbers.share(c("r"), c("n")).alias("returned_share"),
        numbers.share(c("e"), c("f")).alias("early_share_of_filled"),
        numbers.rate_per_10k(c("r"), c("q")).alias("returns_per_10k_units"),
    )


def _bucket_sql(x, pairs, last):
    return "CASE " + " ".join(f"WHEN {x} {op} THEN '{v}'" for op, v in pairs) + f" ELSE '{last}' END"


@register(
    "buckets",
    f"SELECT {_bucket_sql('p_size', [('= 0', '0'), ('<= 2', '1-2'), ('<= 5', '3-5'), ('<= 10', '6-10'), ('<= 20', '11-20')], '21+')} AS age_at_cutoff, "
    f"{_bucket_sql('p_size', [('<= 2', '0-2'), ('<= 5', '3-5'), ('<= 10', '6-10'), ('<= 20', '11-20')], '21+')} AS age, "
    f"{_bucket_sql('p_size', [('= 1', '1'), ('<= 4', '2-4'), ('<= 9', '5-9'), ('<= 49', '10-49')], '50+')} AS support, "
    "CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'communications_and_recalls' WHEN p_size % 2 = 0 THEN 'communications_only' "
    "WHEN p_size % 3 = 0 THEN 'recalls_only' ELSE 'complaints_only_or_limited' END AS coverage, "
    "CASE WHEN p_size / 50.0::DOUBLE >= 0.5 THEN 'OBSERVED_COMPLAINT_ACTIVITY_EXPECTED' ELSE 'NO_OBSERVED_COMPLAINT_ACTIVITY_EXPECTED' END AS classification, "
    "count(*) AS \"rows\" FROM part GROUP BY ALL",
)
def buckets(spark, folder):
    n = c("p_size")
    return B.table(spark, folder, "part").groupBy(
        numbers.age_at_cutoff_bucket(n).alias("age_at_cutoff"), numbers.age_bucket(n).alias("age"),
        numbers.support_bucket(n).alias("support"),
        numbers.coverage_bucket(n % 2 == 0, n % 3 == 0).alias("coverage"),
        numbers.classify(n / 50.0)["classification"].alias("classification"),
    ).agg(F.count("*").alias("rows"))


@register(
    "code_maps",
    f"SELECT RCLTYPECD AS code, {S.map_case('RCLTYPECD', C.RECALL_TYPE_CODES, 'OTHER')} AS recall_type, "
    "count(*) AS \"rows\" FROM recrows GROUP BY ALL",
)
def code_maps(spark, folder):
    seen = B.recall_rows(spark, folder).groupBy(c("RCLTYPECD").alias("code")).agg(F.count("*").alias("rows"))
    return seen.select("code", text.recall_type(c("code")).alias("recall_type"), "rows")


_TEXTS = (
    "SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL "
    "SELECT 'conversations', conv_id, turn, text FROM conversations UNION ALL SELECT 'pages', page_id, 0, html FROM pages"
)


@register(
    "text_flags",
    "SELECT origin, id, part, length(text)::INTEGER AS characters, "
    "coalesce(regexp_matches(text, '[' || chr(128) || '-' || chr(159) || ']'), false) AS has_control, "
    f"length(text) <= 10 AS short, length(text) > 2048 AS oversized FROM ({_TEXTS})",
)
def text_flags(spark, folder):
    n = F.length("text")
    return B.text_columns(spark, folder).select(
        "origin", "id", "part", n.alias("characters"),
        text.has_control_character(c("text")).alias("has_control"),
        (n <= C.SHORT_NARRATIVE).alias("short"), (n > C.LONG_NARRATIVE).alias("oversized"),
    )


@register(
    "year_list_explode",
    "SELECT make, model, year, count(*) AS \"rows\" FROM products GROUP BY ALL",
)
def year_list_explode(spark, folder):
    products = communications.compact_products(B.compact_rows(spark, folder))
    return products.groupBy("make", "model", "year").agg(F.count("*").alias("rows"))


# --- production --------------------------------------------------------------------------------


@register(
    "canonical_filings",
    "SELECT source_record_id, manufacturer_id, report_id, reporting_year, reporting_quarter, normalized_make, "
    "normalized_model, model_year, platform, type_code AS vehicle_type_code, fuel_propulsion_system, production_count FROM canon",
)
def canonical_filings(spark, folder):
    return exposure.canonical_filings(B.filings(spark, folder), B.normalizer(spark, folder)).drop(
        "reporting_entity", "original_make", "original_model"
    )


@register(
    "latest_filing_sum",
    f"SELECT {S.KEY}, production_count, source_record_count, {arr('source_record_ids')}, "
    f"{arr('reporting_periods')}, {arr('reporting_entity_ids')} FROM prod",
)
def latest_filing_sum(spark, folder):
    return B.production(spark, folder)


@register(
    "filing_conflicts",
    f"SELECT {S._CONF.replace('type_code', 'type_code AS vehicle_type_code')}, count(*) AS variants FROM "
    "(SELECT DISTINCT * EXCLUDE (source_record_id, source_row_number) FROM canon QUALIFY rank() OVER "
    f"(PARTITION BY {S._CONF} ORDER BY reporting_year DESC, reporting_quarter DESC, report_id DESC) = 1) "
    f"GROUP BY {S._CONF} HAVING count(*) > 1",
)
def filing_conflicts(spark, folder):
    return exposure.period_conflicts(exposure.canonical_filings(B.filings(spark, folder), B.normalizer(spark, folder)))


@register("production_match", f"SELECT {pretty(C.PRODUCTION_MATCH_COLUMNS)} FROM pmatch")
def production_match(spark, folder):
    return B.Evidence(spark, folder).production


@register(
    "production_match_summary",
    "SELECT count(*) AS complaint_cohort_count, sum(complaint_event_count)::BIGINT AS complaint_event_count, "
    + num("100.0 * count(*) FILTER (production_match_status <> 'NO_PRODUCTION_RECORD') / count(*)", "matched_cohort_percentage")
    + ", "
    + num("100.0 * sum(complaint_event_count) FILTER (production_count IS NOT NULL) / sum(complaint_event_count)", "matched_event_percentage")
    + ", count(*) FILTER (production_count = 0) AS zero_production_cohort_count, "
    "count(*) FILTER (production_match_status = 'NO_PRODUCTION_RECORD') AS missing_production_cohort_count, "
    "count(complaints_per_10k_produced) AS diagnostic_rate_cohort_count, "
    + num("min(complaints_per_10k_produced)", "rate_minimum") + ", " + num("max(complaints_per_10k_produced)", "rate_maximum")
    + ", sum(production_count)::BIGINT AS matched_production_count_sum, "
    + num("quantile_cont(complaints_per_10k_produced, 0.5)", "rate_median") + " FROM pmatch",
)
def production_match_summary(spark, folder):
    return exposure.match_summary(B.Evidence(spark, folder).production)


def _class_sql(unmatched, source, make_label, year_label, columns):
    return (
        f"SELECT {columns}, CASE WHEN normalized_make NOT IN (SELECT normalized_make FROM {source} WHERE model_year IS NOT NULL) THEN '{make_label}' "
        f"WHEN (normalized_make, normalized_model) NOT IN (SELECT (normalized_make, normalized_model) FROM {source} WHERE model_year IS NOT NULL) THEN 'model_absent_for_make' "
        f"WHEN model_year NOT IN (SELECT model_year FROM {source} WHERE model_year IS NOT NULL) THEN '{year_label}' "
        f"ELSE 'make_model_year_combination_absent' END AS mismatch_class FROM {unmatched}"
    )


_ID_KEY = f"broad_vehicle_id, {S.KEY}, complaint_event_count"
_PU = _class_sql(
    "(SELECT * FROM pmatch WHERE production_match_status = 'NO_PRODUCTION_RECORD')", "prod",
    "make_absent_from_selected_source", "model_year_outside_selected_source", _ID_KEY,
)


@register("production_unmatched", _PU)
def production_unmatched(spark, folder):
    e = B.Evidence(spark, folder)
    rows = matching.unmatched_production(e.production, B.production(spark, folder))
    return rows.select(C.COHORT_ID, *C.KEY, "complaint_event_count", "mismatch_class")


def _coverage_sql(field, table, matched):
    return (
        f"SELECT {field}, count(*) AS cohorts, count(*) FILTER ({matched}) AS matched_cohorts, "
        + num(f"100.0 * count(*) FILTER ({matched}) / count(*)", "matched_cohort_percentage")
        + ", sum(complaint_event_count)::BIGINT AS events, "
        f"coalesce(sum(complaint_event_count) FILTER ({matched}), 0)::BIGINT AS matched_events, "
        + num(f"100.0 * coalesce(sum(complaint_event_count) FILTER ({matched}), 0) / sum(complaint_event_count)", "matched_event_percentage")
        + f" FROM {table} GROUP BY {field}"
    )


@register("coverage_by_year", _coverage_sql("model_year", "pmatch", "production_count IS NOT NULL"))
def coverage_by_year(spark, folder):
    matches = B.Evidence(spark, folder).production
    return matching.coverage_by(matches, "model_year", c("production_count").isNotNull())


# --- communications ---------------------------------------------------------------------------------


@register(
    "document_rollup",
    "SELECT communication_id, source_id, manufacturer_document_id, replacement_document_id, "
    "manufacturer_campaign_or_software_id, original_communication_type, communication_type, original_date_added, "
    f"{day('date_added')}, original_communication_date, {day('communication_date')}, {arr('date_quality_flags')}, summary, "
    f"{arr('source_components')}, {arr('canonical_components')}, {arr('component_systems')}, {arr('component_subsystems')}, "
    "source_row_count FROM docs",
)
def document_rollup(spark, folder):
    return communications.documents(B.communication_rows(spark, folder)).drop("source_artifact_filename")


@register("application_dedupe", "SELECT * FROM capps")
def application_dedupe(spark, folder):
    return communications.applications(B.communication_rows(spark, folder), B.normalizer(spark, folder))


@register(
    "metadata_conflicts",
    "SELECT source_id, count(*) AS variants FROM (SELECT DISTINCT source_id, coalesce(replacement, ''), added, document, "
    "communicated, coalesce(campaign, ''), type, summary FROM commrows) GROUP BY 1 HAVING count(*) > 1",
)
def metadata_conflicts(spark, folder):
    return communications.metadata_conflicts(B.communication_rows(spark, folder))


@register(
    "two_view_audit",
    "SELECT 'identifier' AS grain, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS overlap_count, "
    "count(*) FILTER (b IS NULL) AS first_only_count, count(*) FILTER (a IS NULL) AS second_only_count FROM "
    "(SELECT DISTINCT source_id AS a FROM commrows) FULL JOIN (SELECT DISTINCT source_id AS b FROM late_products) ON a = b UNION ALL "
    "SELECT 'product', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (b IS NULL), count(*) FILTER (a IS NULL) FROM "
    "(SELECT DISTINCT (source_id, make, model, year) AS a FROM commrows) FULL JOIN (SELECT DISTINCT (source_id, make, model, year) AS b FROM late_products) ON a = b",
)
def two_view_audit(spark, folder):
    return communications.audit_views(
        B.communication_rows(spark, folder),
        communications.compact_products(B.compact_rows(spark, folder, since=B.COMPACT_FROM)),
    )


@register(
    "document_profile",
    "SELECT count(*) AS unique_communication_count, sum(source_row_count)::BIGINT AS source_row_count, "
    "count(communication_date) AS valid_communication_date_document_count, "
    "count(*) FILTER (list_contains(date_quality_flags, 'malformed_date_added')) AS malformed_date_added, "
    "count(*) FILTER (list_contains(date_quality_flags, 'malformed_communication_date')) AS malformed_communication_date, "
    f"{day('min(date_added)', 'first_date_added')}, {day('max(date_added)', 'last_date_added')}, "
    "count(*) FILTER (summary <> '') AS summary_document_count, "
    "count(*) FILTER (len(component_systems) > 0 OR len(component_subsystems) > 0) AS manufacturer_component_document_count, "
    "count(manufacturer_campaign_or_software_id) AS campaign_or_software_document_count, "
    "count(replacement_document_id) AS replacement_document_reference_count, "
    "count(DISTINCT manufacturer_document_id) AS unique_manufacturer_document_id_count, "
    "(SELECT count(*) FROM (SELECT 1 FROM docs GROUP BY manufacturer_document_id HAVING count(*) > 1)) AS repeated_manufacturer_document_id_count FROM docs",
)
def document_profile(spark, folder):
    return communications.document_profile(communications.documents(B.communication_rows(spark, folder)))


@register("application_match", "SELECT * FROM cmatch")
def application_match(spark, folder):
    return B.Evidence(spark, folder).communication_matches


@register(
    "cohort_evidence_documents",
    "SELECT " + pretty((
        C.COHORT_ID, *C.KEY, "complaint_event_count", "manufacturer_communication_match_status", "match_method",
        *C.COMMUNICATION_EVIDENCE_VALUES,
    )) + " FROM cev",
)
def cohort_evidence_documents(spark, folder):
    return B.Evidence(spark, folder).communications


@register(
    "unmatched_class",
    _class_sql("(SELECT * FROM cev WHERE unique_communication_count = 0)", "capps",
               "make_absent_from_vehicle_applicability", "model_year_absent_from_vehicle_applicability", _ID_KEY),
)
def unmatched_class(spark, folder):
    e = B.Evidence(spark, folder)
    rows = matching.unmatched_documents(
        e.communications, e.communication_applications, "unique_communication_count"
    )
    return rows.select(C.COHORT_ID, *C.KEY, "complaint_event_count", "mismatch_class")


@register(
    "top_unmatched",
    "SELECT normalized_make || ' / ' || normalized_model AS value, count(*) AS \"rows\" FROM cev "
    "WHERE unique_communication_count = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def top_unmatched(spark, folder):
    rows = B.Evidence(spark, folder).communications.where("unique_communication_count = 0")
    return matching.top_counts(rows, F.concat_ws(" / ", "normalized_make", "normalized_model"))


@register("coverage_by_make", _coverage_sql("normalized_make", "cev", "unique_communication_count > 0"))
def coverage_by_make(spark, folder):
    evidence = B.Evidence(spark, folder).communications
    return matching.coverage_by(evidence, "normalized_make", c("unique_communication_count") > 0)


# --- recalls ------------------------------------------------------------------------------------------

_CAMP_ARRAYS = (
    *recalls.VALUE_SETS, "recall_types", *recalls.DATE_SETS, "potential_units_affected_values",
    "canonical_components", "quality_flags", "source_artifact_filenames",
)


@register(
    "campaign_rollup",
    "SELECT campaign_id, campaign_number, potential_units_affected, source_row_count, "
    + ", ".join(arr(n) for n in _CAMP_ARRAYS) + " FROM camps",
)
def campaign_rollup(spark, folder):
    return recalls.campaigns(B.recall_rows(spark, folder))


@register(
    "campaign_profile",
    "SELECT count(*) AS unique_campaign_count, sum(source_row_count)::BIGINT AS source_row_count, "
    "max(source_row_count) AS maximum_source_rows_for_one_campaign, "
    "count(*) FILTER (source_row_count > 1) AS campaigns_with_multiple_source_rows, "
    "count(potential_units_affected) AS campaigns_with_known_affected_population, "
    "count(*) FILTER (len(potential_units_affected_values) > 1) AS campaigns_with_conflicting_affected_population_values, "
    "count(*) FILTER (len(original_components) > 1) AS campaigns_with_multiple_original_components, "
    "count(*) FILTER (len(defect_descriptions) > 1) AS campaigns_with_multiple_defect_descriptions, "
    "count(*) FILTER (len(report_received_dates) > 1) AS campaigns_with_multiple_report_received_dates, "
    "count(*) FILTER (len(corrective_actions) > 0) AS campaigns_with_corrective_action, "
    f"{day('min(report_received_dates[1])', 'first_recall_date')}, {day('max(report_received_dates[-1])', 'last_recall_date')}, "
    + ", ".join(
        f"count(*) FILTER (list_contains(recall_types, '{n}')) AS type_{n.lower()}_campaign_count" for n in C.RECALL_TYPES
    )
    + ", (SELECT count(DISTINCT MFGCAMPNO) FROM recrows) AS unique_manufacturer_campaign_number_count, "
    "(SELECT count(*) FROM (SELECT 1 FROM recrows WHERE MFGCAMPNO IS NOT NULL GROUP BY MFGCAMPNO HAVING count(DISTINCT CAMPNO) > 1)) AS manufacturer_campaign_numbers_reused "
    "FROM camps",
)
def campaign_profile(spark, folder):
    table = recalls.campaigns(B.recall_rows(spark, folder), columns=recalls.PROFILED)
    return recalls.campaign_profile(stage(table, "profiled-campaigns"))


@register(
    "recall_application_match",
    "SELECT applicability_id, campaign_id, source_record_number, normalized_make, normalized_model, model_year, canonical_component, "
    f"{day('manufacturing_begin_date')}, {day('manufacturing_end_date')}, source_artifact_filename, complaint_match_status, match_method, "
    "matched_broad_vehicle_id, ambiguity_candidate_count FROM rmatch",
)
def recall_application_match(spark, folder):
    return B.Evidence(spark, folder).recall_matches.select(
        "applicability_id", "campaign_id", "source_record_number", *C.KEY, "canonical_component",
        "manufacturing_begin_date", "manufacturing_end_date", "source_artifact_filename",
        "complaint_match_status", "match_method", "matched_broad_vehicle_id", "ambiguity_candidate_count",
    )


@register(
    "cohort_evidence_campaigns",
    "SELECT " + pretty((
        C.COHORT_ID, *C.KEY, "complaint_event_count", "recall_match_status", "match_method", *C.RECALL_EVIDENCE_VALUES,
    )) + " FROM rev",
)
def cohort_evidence_campaigns(spark, folder):
    return B.Evidence(spark, folder).recalls


@register(
    "evidence_summary",
    "SELECT count(*) AS complaint_cohort_count, sum(complaint_event_count)::BIGINT AS complaint_event_count, "
    "count(*) FILTER (unique_recall_campaign_count > 0) AS matched_cohort_count, "
    + num("100.0 * count(*) FILTER (unique_recall_campaign_count > 0) / count(*)", "matched_cohort_percentage")
    + ", sum(complaint_event_count) FILTER (unique_recall_campaign_count > 0)::BIGINT AS matched_event_count, "
    + num("100.0 * sum(complaint_event_count) FILTER (unique_recall_campaign_count > 0) / sum(complaint_event_count)", "matched_event_percentage")
    + " FROM rev",
)
def evidence_summary(spark, folder):
    return matching.evidence_summary(B.Evidence(spark, folder).recalls, "unique_recall_campaign_count")


_CROSS = (
    "SELECT r.broad_vehicle_id, r.normalized_make, r.normalized_model, r.model_year, r.complaint_event_count, "
    "p.production_count IS NOT NULL AS has_production, m.unique_communication_count > 0 AS has_manufacturer_communications, "
    "r.unique_recall_campaign_count > 0 AS has_recalls, "
    "CASE WHEN p.production_count IS NULL AND m.unique_communication_count = 0 AND r.unique_recall_campaign_count = 0 THEN 'complaint_only' "
    "ELSE 'complaint' || CASE WHEN p.production_count IS NOT NULL THEN '_production' ELSE '' END || "
    "CASE WHEN m.unique_communication_count > 0 THEN '_manufacturer_communications' ELSE '' END || "
    "CASE WHEN r.unique_recall_campaign_count > 0 THEN '_recalls' ELSE '' END END AS coverage_category "
    "FROM rev r JOIN pmatch p USING (broad_vehicle_id) JOIN cev m USING (broad_vehicle_id)"
)


def _cross(spark, folder):
    e = B.Evidence(spark, folder, event_columns=(C.COHORT_ID, *C.KEY))
    keys = e.numbered(e.keys)
    sent = matching.document_counts(keys, e.communication_pairs, "source_id", "unique_communication_count", e.document_signals())
    # A vehicle row has a value, so each linked campaign is one; nothing else of campaigns is read.
    called = matching.document_counts(keys, e.recall_pairs, "campaign_number", "unique_recall_campaign_count")
    return matching.cross_source_coverage(e.keys, e.production, e.named(sent), e.named(called))


@register("cross_source_coverage", _CROSS)
def cross_source_coverage(spark, folder):
    return _cross(spark, folder)


@register(
    "coverage_totals",
    f"SELECT coverage_category, count(*) AS cohorts, sum(complaint_event_count)::BIGINT AS events FROM ({_CROSS}) GROUP BY 1",
)
def coverage_totals(spark, folder):
    return matching.category_totals(_cross(spark, folder))


# --- integration ------------------------------------------------------------------------------------------

_INT_COLUMNS = (
    *(integration.complaint_name(n) for n in C.COHORT_FEATURE_COLUMNS),
    "has_production_match", "production_match_status", "production_match_method", *integration.PRODUCTION_NAMES,
    "has_manufacturer_communications", "communication_match_status", "communication_match_method",
    *integration.COMMUNICATION_NAMES, "has_recall", "recall_match_status", "recall_match_method",
    *integration.RECALL_NAMES, "source_count_available", "has_all_four_sources", "source_coverage_category",
)


@register("integrated_cohorts", f"SELECT {pretty(_INT_COLUMNS)} FROM integ")
def integrated_cohorts(spark, folder):
    return B.Evidence(spark, folder).integrated().select(*_INT_COLUMNS)


def _categories_sql():
    measures = (
        "count(*) AS cohorts, sum(complaint_event_count)::BIGINT AS complaint_events, count(*) FILTER (has_production_match) AS production, "
        "count(*) FILTER (has_manufacturer_communications) AS communications, count(*) FILTER (has_recall) AS recalls, "
        "count(*) FILTER (has_all_four_sources) AS all_four"
    )
    return " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, {k}::VARCHAR AS value, {measures} FROM integ GROUP BY {k}"
        for k in ("source_coverage_category", "model_year", "normalized_make")
    )


@register("coverage_categories", _categories_sql())
def coverage_categories(spark, folder):
    return integration.coverage_categories(B.Evidence(spark, folder).integrated())


_SUPPORT_RULES = {
    **{f"minimum_{t}_complaints": f"complaint_event_count >= {t}" for t in C.SUPPORT_THRESHOLDS},
    "at_least_two_sources": "source_count_available >= 2", "at_least_three_sources": "source_count_available >= 3",
    "all_four_sources": "source_count_available = 4",
    "at_least_5_complaints_and_3_sources": "complaint_event_count >= 5 AND source_count_available >= 3",
}


@register(
    "support_thresholds",
    " UNION ALL ".join(
        f"SELECT '{n}' AS threshold, count(*) FILTER ({rule}) AS cohorts FROM integ" for n, rule in _SUPPORT_RULES.items()
    ),
)
def support_thresholds(spark, folder):
    return integration.support_thresholds(B.Evidence(spark, folder).integrated())


@register(
    "review_summary",
    "SELECT count(*) AS integrated_cohort_count, count(DISTINCT normalized_make) AS unique_make_count, "
    "count(DISTINCT normalized_model) AS unique_model_count, min(model_year) AS first_model_year, max(model_year) AS last_model_year, "
    "count(*) FILTER (has_production_match) AS production_available_count, "
    "count(*) FILTER (has_manufacturer_communications) AS communication_available_count, count(*) FILTER (has_recall) AS recall_available_count, "
    "count(*) FILTER (complaint_mileage_observed_count = 0) AS cohorts_with_no_observed_mileage, "
    "count(*) FILTER (complaint_event_count = 1) AS one_complaint_cohort_count FROM integ",
)
def review_summary(spark, folder):
    return integration.review_summary(B.Evidence(spark, folder).integrated())


def _temporal_sql():
    rows = []
    for cutoff in B.REVIEW_CUTOFFS:
        lit = f"DATE '{cutoff.isoformat()}'"
        parts = [f"'{cutoff.isoformat()}' AS cutoff"]
        prior = f"(SELECT broad_vehicle_id, count(*) AS n FROM ev WHERE report_date <= {lit} GROUP BY 1)"
        parts += [
            f"(SELECT count(*) FROM {prior}) AS prior_cohorts", f"(SELECT sum(n)::BIGINT FROM {prior}) AS prior_events",
            f"(SELECT count(*) FROM {prior} WHERE n >= 5) AS cohorts_with_5_prior",
            f"(SELECT count(*) FROM {prior} WHERE n >= 10) AS cohorts_with_10_prior",
        ]
        for m in (12, 24):
            end = numbers.window_end(cutoff, m).isoformat()
            whole = f"(SELECT max(report_date) FROM ev) >= DATE '{end}'"
            ahead = (
                f"FROM ev WHERE report_date > {lit} AND report_date <= DATE '{end}' "
                f"AND broad_vehicle_id IN (SELECT broad_vehicle_id FROM {prior})"
            )
            parts += [
                f"'{end}' AS window_end_{m}m", f"{whole} AS window_complete_{m}m",
                f"CASE WHEN {whole} THEN (SELECT count(*) FROM {prior}) ELSE 0 END AS cohorts_observed_{m}m",
                f"CASE WHEN {whole} THEN (SELECT count(DISTINCT broad_vehicle_id) {ahead}) END AS cohorts_active_{m}m",
                f"CASE WHEN {whole} THEN (SELECT count(*) {ahead}) END AS events_{m}m",
            ]
        parts += [
            f"(SELECT count(*) FROM {prior} JOIN pmatch USING (broad_vehicle_id) WHERE production_count IS NOT NULL AND "
            f"len(list_filter(production_reporting_periods, lambda p: substring(p, 1, 4)::INTEGER <= {cutoff.year})) > 0) AS cohorts_with_production_period",
            f"(SELECT count(*) FROM {prior} WHERE broad_vehicle_id IN (SELECT broad_vehicle_id FROM cjoin WHERE date_added <= {lit})) AS cohorts_with_communications",
            f"(SELECT count(*) FROM {prior} WHERE broad_vehicle_id IN (SELECT broad_vehicle_id FROM rjoin WHERE report_received_dates[1] <= {lit})) AS cohorts_with_recalls",
        ]
        rows.append("SELECT " + ", ".join(parts))
    return " UNION ALL ".join(rows)


@register("temporal_feasibility", _temporal_sql())
def temporal_feasibility(spark, folder):
    e = B.Evidence(spark, folder, event_columns=(C.COHORT_ID, *C.KEY, "report_date"))
    gated = e.production.select(
        C.COHORT_ID,
        F.when(c("production_count").isNotNull(), c("production_reporting_periods")).alias("production_reporting_periods"),
    )
    sent = integration.earliest_dates(e.communication_pairs, e.document_signals("date_added"), "source_id", c("date_added"))
    called = integration.earliest_dates(
        e.recall_pairs, e.campaign_signals("first_report_date"), "campaign_number", c("first_report_date")
    )
    return integration.temporal_feasibility(e.events, gated, e.named(sent), e.named(called), cutoffs=B.REVIEW_CUTOFFS)


_PAIRS = [
    ("complaint_event_count", "communication_unique_count"),
    ("complaint_event_count", "recall_unique_campaign_count"),
    ("complaint_event_count", "production_total_units"),
    ("production_total_units", "production_complaints_per_10k_units"),
    ("model_year", "source_count_available"),
]


def _correlation_sql(table, a, b):
    both = f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    ranked = (
        "(SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, "
        f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM {both})"
    )
    return (
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS pair_count, "
        f"{num('corr(x, y)', 'pearson')}, {num('corr(rx, ry)', 'spearman')} FROM {ranked}"
    )


@register("pearson_spearman", " UNION ALL ".join(_correlation_sql("integ", a, b) for a, b in _PAIRS))
def pearson_spearman(spark, folder):
    from cohortlens.session import stage

    names = sorted({n for pair in _PAIRS for n in pair})
    table = stage(B.Evidence(spark, folder).integrated().select(*names), "review")
    return statistics.correlations(table, _PAIRS)


def _distribution_sql(table, measures):
    parts = []
    for name, x in measures.items():
        parts.append(
            f"SELECT '{name}' AS measure, count({x}) AS observed_count, count(*) - count({x}) AS missing_count, "
            f"{num(f'min({x})', 'minimum')}, {num(f'max({x})', 'maximum')}, {num(f'avg({x}::DOUBLE)', 'mean')}, "
            f"{num(f'var_pop({x}::DOUBLE)', 'population_variance')}, {num(f'stddev_pop({x}::DOUBLE)', 'population_standard_deviation')}, "
            + ", ".join(num(f"quantile_cont({x}::DOUBLE, {p})", f"p{p * 100:g}") for p in statistics.QUANTILES)
            + f" FROM {table}"
        )
    return " UNION ALL ".join(parts)


_COUNTS = {n: n for n in ("historical_complaint_count", "future_complaint_count", "historical_observation_days")}


@register(
    "count_distribution",
    _distribution_sql("(SELECT * FROM lab WHERE eligibility_reason = 'ELIGIBLE')", _COUNTS),
)
def count_distribution(spark, folder):
    rows = B.Evidence(spark, folder).labelled().where("eligibility_reason = 'ELIGIBLE'")
    return statistics.distributions(rows, {n: c(n) for n in _COUNTS})


# --- targets ----------------------------------------------------------------------------------------------


@register("target_labels", f"SELECT {pretty(C.TARGET_COLUMNS)} FROM tgt")
def target_labels(spark, folder):
    return B.Evidence(spark, folder).targets


@register("target_reasons", "SELECT eligibility_reason, count(*) AS cohorts FROM lab GROUP BY 1")
def target_reasons(spark, folder):
    return targets.reason_counts(B.Evidence(spark, folder).labelled())


_ELIGIBLE = "(SELECT * FROM lab WHERE eligibility_reason = 'ELIGIBLE')"


def _eligible(spark, folder, **options):
    return B.Evidence(spark, folder).labelled(**options).where("eligibility_reason = 'ELIGIBLE'")


@register(
    "threshold_support",
    " UNION ALL ".join(
        f"SELECT {t}::INTEGER AS threshold, count(*) FILTER (future_complaint_count >= {t}) AS positive_count, "
        f"count(*) FILTER (future_complaint_count < {t}) AS negative_count, "
        f"{num(f'count(*) FILTER (future_complaint_count >= {t}) / count(*)::DOUBLE', 'positive_rate')}, "
        f"{num(f'count(*) FILTER (future_complaint_count < {t}) / count(*)::DOUBLE', 'negative_rate')} FROM {_ELIGIBLE}"
        for t in C.TARGET_THRESHOLDS
    ),
)
def threshold_support(spark, folder):
    return targets.threshold_support(_eligible(spark, folder))


_GROUPS = ["model_year", "cohort_age_at_cutoff", "age_bucket"]


@register(
    "group_rates",
    " UNION ALL ".join(
        f"SELECT '{k}' AS dimension, {k}::VARCHAR AS value, count(*) AS cohort_count, sum(future_complaint_count)::BIGINT AS future_complaint_total, "
        "count(*) FILTER (future_complaint_count >= 1) AS future_any_complaint_count, "
        + num("count(*) FILTER (future_complaint_count >= 1) / count(*)::DOUBLE", "future_any_complaint_rate")
        + f" FROM {_ELIGIBLE} GROUP BY {k}"
        for k in _GROUPS
    ),
)
def group_rates(spark, folder):
    return targets.group_rates(_eligible(spark, folder), _GROUPS)


@register(
    "concentration",
    " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS top_share, greatest(1, ceil(count(*) * {p}::DOUBLE))::BIGINT AS top_cohort_count, "
        + num("sum(x) FILTER (r <= greatest(1, ceil(n * " + str(p) + "::DOUBLE))) / nullif(sum(x), 0)::DOUBLE", "event_share")
        + f" FROM (SELECT future_complaint_count AS x, row_number() OVER (ORDER BY future_complaint_count DESC) AS r, count(*) OVER () AS n FROM {_ELIGIBLE})"
        for p in (0.01, 0.1)
    ),
)
def concentration(spark, folder):
    return targets.concentration(_eligible(spark, folder), "future_complaint_count")


@register(
    "component_support",
    " UNION ALL ".join(
        f"SELECT '{n}' AS component, sum(future_component_{n}_complaint_count)::BIGINT AS future_event_count, "
        f"count(*) FILTER (future_component_{n}_complaint_count > 0) AS active_cohort_count FROM {_ELIGIBLE}"
        for n in C.SELECTED_COMPONENTS
    ),
)
def component_support(spark, folder):
    return targets.component_support(_eligible(spark, folder))


@register(
    "production_sensitivity",
    _distribution_sql(
        "(SELECT l.*, p.production_count, CASE WHEN p.production_count > 0 THEN l.future_complaint_count / p.production_count::DOUBLE * 10000.0::DOUBLE END AS future_per_10k "
        "FROM lab l JOIN pmatch p USING (broad_vehicle_id) WHERE l.eligibility_reason = 'ELIGIBLE' AND p.production_count IS NOT NULL)",
        {"future_complaint_count": "future_complaint_count", "future_per_10k": "future_per_10k"},
    ),
)
def production_sensitivity(spark, folder):
    return targets.production_sensitivity(_eligible(spark, folder, with_production=True))


# --- as-of features -------------------------------------------------------------------------------------------

_HISTORY = (
    C.COHORT_ID, *C.VOLUME_FEATURES, *C.RECENCY_FEATURES, *C.COMPONENT_FEATURES, *C.SEVERITY_FEATURES,
    *C.EVIDENCE_FEATURES, *C.MILEAGE_FEATURES,
)


@register("asof_event_features", f"SELECT {pretty(_HISTORY)} FROM ahist")
def asof_event_features(spark, folder):
    e = B.Evidence(spark, folder)
    return asof.complaint_features(e.events, e.targets, B.CUTOFF).select(*_HISTORY)


@register(
    "asof_document_features",
    f"SELECT {pretty((C.COHORT_ID, *C.COMMUNICATION_FEATURES))}, {pretty(C.RECALL_FEATURES)} "
    "FROM acomm JOIN arec USING (broad_vehicle_id)",
)
def asof_document_features(spark, folder):
    e = B.Evidence(spark, folder, event_columns=asof.EVENT_COLUMNS)
    return e.communication_features().join(e.recall_features(), C.COHORT_ID)


@register(
    "asof_status",
    "SELECT communication_asof_status, recall_asof_status, count(*) AS cohorts FROM acomm JOIN arec USING (broad_vehicle_id) GROUP BY ALL",
)
def asof_status(spark, folder):
    rows = asof_document_features(spark, folder)
    return rows.groupBy("communication_asof_status", "recall_asof_status").agg(F.count("*").alias("cohorts"))


@register("feature_matrix", f"SELECT {pretty(C.FEATURE_COLUMNS)} FROM feat")
def feature_matrix(spark, folder):
    return B.Evidence(spark, folder, event_columns=asof.EVENT_COLUMNS).features()


@register(
    "history_reconciliation",
    "SELECT broad_vehicle_id, h.historical_complaint_count AS rebuilt, t.historical_complaint_count AS target FROM ahist h "
    "FULL JOIN tgt t USING (broad_vehicle_id) WHERE h.historical_complaint_count IS DISTINCT FROM t.historical_complaint_count",
)
def history_reconciliation(spark, folder):
    e = B.Evidence(spark, folder)
    return asof.history_mismatches(asof.complaint_features(e.events, e.targets, B.CUTOFF), e.targets)


# --- table checks -------------------------------------------------------------------------------------------------


@register(
    "table_fingerprint",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS \"rows\", sum(('0x' || substr(sha256({row}), 1, 15))::BIGINT)::HUGEINT::VARCHAR AS checksum FROM {n}"
        for n, row in (
            ("supplier", "'{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || ',\"s_acctbal\":' || s_acctbal || '}'"),
            ("labels", "'{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}'"),
        )
    ),
)
def table_fingerprint(spark, folder):
    suppliers = tables.fingerprint(B.table(spark, folder, "supplier"))
    labels = tables.fingerprint(B.table(spark, folder, "labels"))
    return suppliers.select(F.lit("supplier").alias("name"), "*").unionByName(
        labels.select(F.lit("labels").alias("name"), "*")
    )


@register(
    "orphan_check",
    "SELECT applicability_id, communication_id FROM capps WHERE communication_id NOT IN (SELECT communication_id FROM docs)",
)
def orphan_check(spark, folder):
    rows = B.communication_rows(spark, folder)
    apps = communications.applications(rows, B.normalizer(spark, folder)).select("applicability_id", "communication_id")
    return matching.orphans(apps, communications.documents(rows), "communication_id").select(
        "applicability_id", "communication_id"
    )


@register(
    "unique_key_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS \"rows\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_key_check(spark, folder):
    return readers.repeated_keys(B.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "set_equality",
    "SELECT doc_id, CASE WHEN a THEN true END AS in_left, CASE WHEN b THEN true END AS in_right FROM "
    "(SELECT DISTINCT doc_id, true AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id, true AS b FROM labels) USING (doc_id) "
    "WHERE a IS NULL OR b IS NULL",
)
def set_equality(spark, folder):
    return tables.set_mismatches(B.table(spark, folder, "documents"), B.table(spark, folder, "labels"), "doc_id")


@register(
    "rollup_gap",
    "SELECT (SELECT count(*) FROM ev) AS event_rows, (SELECT sum(complaint_event_count)::BIGINT FROM keys) AS cohort_total, "
    "(SELECT count(*) FROM keys) AS cohorts, 0::BIGINT AS gap",
)
def rollup_gap(spark, folder):
    e = B.Evidence(spark, folder)
    return tables.rollup_gap(e.events, e.keys)


@register(
    "identity_mismatches",
    "SELECT broad_vehicle_id, 1::BIGINT AS cohorts, 1::BIGINT AS production, 1::BIGINT AS communications, 1::BIGINT AS recalls FROM keys "
    "WHERE broad_vehicle_id NOT IN (SELECT broad_vehicle_id FROM pmatch) OR broad_vehicle_id NOT IN (SELECT broad_vehicle_id FROM cev) "
    "OR broad_vehicle_id NOT IN (SELECT broad_vehicle_id FROM rev)",
)
def identity_mismatches(spark, folder):
    e = B.Evidence(spark, folder)
    return integration.identity_mismatches(
        {"cohorts": e.keys, "production": e.production, "communications": e.communications, "recalls": e.recalls}
    )


