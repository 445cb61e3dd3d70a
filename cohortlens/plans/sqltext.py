"""SQL for DuckDB that states the same stages independently of the Spark operators.

``CTES`` holds one common table expression per stage; ``query`` strings together the
ones a final SELECT needs. Only the source rules (fixed arithmetic on the shared tables)
come from the bindings.
"""

from __future__ import annotations

import re

from cohortlens import constants as C
from cohortlens.plans import bindings as B

CUT = f"DATE '{B.CUTOFF.isoformat()}'"
KEY = "normalized_make, normalized_model, model_year"


def _fmt(day: str) -> str:
    return f"strftime({day}, '%Y%m%d')"


def _rules(rules: dict[str, str]) -> str:
    return ",\n  ".join(f"{sql} AS {name}" for name, sql in rules.items()).replace("{s}", "VARCHAR")


def in_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def norm(x: str) -> str:
    return f"nullif(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), '')"


def year_of(x: str) -> str:
    y = f"try_cast({x} AS INTEGER)"
    return (
        f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}') AND {x} <> '9999' AND {y} BETWEEN 1886 AND 2100"
        f" THEN {y} END"
    )


def day_of(x: str) -> str:
    # There is no year 0 in the calendar the rules use.
    eight = f"regexp_full_match({x}, '[0-9]{{8}}') AND NOT starts_with({x}, '0000')"
    return f"CASE WHEN {eight} THEN CAST(try_strptime({x}, '%Y%m%d') AS DATE) END"


def component_of(x: str) -> str:
    t = f"upper(trim({x}))"
    whens = [f"WHEN {x} IS NULL OR trim({x}) = '' THEN 'unknown'"]
    for family, roots in C.COMPONENT_ROOTS:
        hit = " OR ".join(
            f"{t} = '{r}' OR starts_with({t}, '{r}:') OR starts_with({t}, '{r},')" for r in roots
        )
        whens.append(f"WHEN {hit} THEN '{family}'")
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


def q(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


def association(make: str, model: str, year: str, prefix: str = "vehicle_association_") -> str:
    return (
        f"'{prefix}' || sha256('{{\"generation\":null,\"make\":' || {q(make)} || ',\"model\":' || {q(model)}"
        f" || ',\"year\":' || {year} || '}}')"
    )


def configuration(make: str, model: str, year: str, trans: str, drive: str) -> str:
    return (
        f"'configuration_' || sha256('{{\"drivetrain\":' || {q(drive)} || ',\"engine\":null,\"generation\":null,"
        f"\"make\":' || {q(make)} || ',\"model\":' || {q(model)} || ',\"transmission\":' || {q(trans)}"
        f" || ',\"trim\":null,\"year\":' || {year} || '}}')"
    )


def alias_case(x: str, table: dict[str, str]) -> str:
    n = f"trim(regexp_replace(regexp_replace({norm(x)}, '[-_]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return "CASE " + n + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def map_case(x: str, table: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


CTES: dict[str, str] = {}

_JOIN2 = "FROM lineitem JOIN part ON l_partkey = p_partkey"
_JOIN3 = _JOIN2 + " JOIN orders ON l_orderkey = o_orderkey"

CTES["line2"] = f"SELECT *, l_orderkey * 8 + l_linenumber AS k {_JOIN2}"
CTES["line3"] = f"SELECT *, l_orderkey * 8 + l_linenumber AS k {_JOIN3}"
CTES["raw"] = f"SELECT k,\n  {_rules(B.complaint_rules(_fmt))}\nFROM line3"


def _bad(name: str, pattern: str) -> str:
    return f"{name} IS NOT NULL AND NOT regexp_full_match({name}, '{pattern}')"


CTES["parsed"] = f"""SELECT *,
  {norm('MAKETXT')} AS normalized_make, {norm('MODELTXT')} AS normalized_model,
  {year_of('YEARTXT')} AS model_year,
  CASE WHEN regexp_full_match(MILES, '[0-9]+') THEN try_cast(MILES AS BIGINT) END AS mileage,
  CASE WHEN regexp_full_match(DEATHS, '[0-9]+') THEN try_cast(DEATHS AS BIGINT) END AS death_count,
  CASE WHEN regexp_full_match(INJURED, '[0-9]+') THEN try_cast(INJURED AS BIGINT) END AS injury_count,
  CASE CRASH WHEN 'Y' THEN true WHEN 'N' THEN false END AS crash_seen,
  CASE FIRE WHEN 'Y' THEN true WHEN 'N' THEN false END AS fire_seen,
  {day_of('FAILDATE')} AS occurrence_date, {day_of('LDATE')} AS report_date,
  CASE TRANS_TYPE WHEN 'AUTO' THEN 'automatic' WHEN 'MAN' THEN 'manual' END AS trans,
  {alias_case('DRIVE_TRAIN', C.DRIVETRAIN_ALIASES)} AS drive
FROM raw"""

_CHECKS = (
    ("unsupported_product_type", "PROD_TYPE", "PROD_TYPE IS DISTINCT FROM 'V'"),
    ("missing_source_identifier", "CMPLID", "CMPLID IS NULL"),
    ("malformed_source_identifier", "CMPLID", _bad("CMPLID", "[0-9]{1,9}")),
    ("missing_source_identifier", "ODINO", "ODINO IS NULL"),
    ("malformed_source_identifier", "ODINO", _bad("ODINO", "[0-9]{1,9}")),
    ("missing_vehicle_identity", "MAKETXT", "normalized_make IS NULL"),
    ("missing_vehicle_identity", "MODELTXT", "normalized_model IS NULL"),
    ("invalid_model_year", "YEARTXT", "model_year IS NULL"),
    ("malformed_mileage", "MILES", _bad("MILES", "[0-9]+")),
    ("malformed_count", "DEATHS", _bad("DEATHS", "[0-9]+")),
    ("malformed_count", "INJURED", _bad("INJURED", "[0-9]+")),
    ("malformed_indicator", "CRASH", "CRASH IS NOT NULL AND crash_seen IS NULL"),
    ("malformed_indicator", "FIRE", "FIRE IS NOT NULL AND fire_seen IS NULL"),
    ("malformed_date", "FAILDATE", "FAILDATE IS NOT NULL AND occurrence_date IS NULL"),
    ("malformed_date", "LDATE", "LDATE IS NOT NULL AND report_date IS NULL"),
)
CTES["mapped"] = f"""SELECT *,
  CASE {' '.join(f"WHEN {bad} THEN '{reason}'" for reason, _, bad in _CHECKS)} END AS reason,
  CASE {' '.join(f"WHEN {bad} THEN '{name}=' || coalesce({name}, 'null')" for _, name, bad in _CHECKS)} END AS detail,
  {component_of('COMPDESC')} AS component,
  CASE WHEN death_count > 0 THEN 'critical' WHEN injury_count > 0 THEN 'high'
    WHEN crash_seen OR fire_seen THEN 'moderate'
    WHEN death_count = 0 AND injury_count = 0 AND NOT crash_seen AND NOT fire_seen THEN 'low'
    ELSE 'unknown' END AS severity,
  CASE WHEN trans IS NOT NULL AND drive IS NOT NULL THEN
    {configuration('normalized_make', 'normalized_model', 'model_year', 'trans', 'drive')} END AS known_configuration_id
FROM parsed"""

_CONTROL = "chr(128) || '-' || chr(159)"
_FLAGS = {
    "broad_other_component": "component = 'other'",
    "encoding_control_character": " OR ".join(
        f"coalesce(regexp_matches({n}, '[' || {_CONTROL} || ']'), false)"
        for n in ("MAKETXT", "MODELTXT", "COMPDESC", "CDESCR")
    ),
    "extreme_mileage": "mileage > 500000",
    "extreme_report_delay": "report_date - occurrence_date > 3652",
    "future_model_year": "model_year > year(report_date)",
    "missing_configuration_detail": "known_configuration_id IS NULL",
    "missing_mileage": "mileage IS NULL",
    "missing_narrative": "CDESCR IS NULL",
    "negative_report_delay": "report_date - occurrence_date < 0",
    "oversized_narrative": "length(CDESCR) > 2048",
    "short_narrative": "length(CDESCR) <= 10",
    "zero_mileage": "mileage = 0",
}
CTES["clean"] = f"""SELECT
  'event_' || sha256('{{"dataset":"{C.EVENT_DATASET}","organization":"{C.EVENT_ORGANIZATION}","source_record_id":"'
    || CMPLID || '","source_type":"{C.EVENT_SOURCE_TYPE}"}}') AS event_id,
  '{C.EVENT_SOURCE_TYPE}' AS source_type, CMPLID AS source_record_id, ODINO AS source_reference_id,
  {association('normalized_make', 'normalized_model', 'model_year')} AS broad_vehicle_id,
  known_configuration_id, MAKETXT AS source_make, normalized_make, MODELTXT AS source_model, normalized_model,
  YEARTXT AS source_model_year, model_year, component, COMPDESC AS source_component, severity,
  death_count, injury_count, crash_seen AS crash, fire_seen AS fire, mileage, 'miles' AS mileage_unit,
  occurrence_date, report_date, CDESCR AS narrative,
  {', '.join(f"coalesce({rule}, false) AS quality_{name}" for name, rule in _FLAGS.items())}
FROM mapped WHERE reason IS NULL"""

CTES["ev"] = f"""SELECT event_id, source_type, source_record_id, source_reference_id, broad_vehicle_id,
  known_configuration_id, {KEY}, component, severity, report_date,
  CAST(year(report_date) AS INTEGER) AS report_year, CAST(month(report_date) AS INTEGER) AS report_month,
  occurrence_date, CAST(year(occurrence_date) AS INTEGER) AS occurrence_year,
  CAST(CASE WHEN year(report_date) >= model_year THEN year(report_date) - model_year END AS INTEGER) AS vehicle_age_at_report_years,
  year(report_date) < model_year AS report_before_model_year,
  CAST(CASE WHEN year(occurrence_date) >= model_year THEN year(occurrence_date) - model_year END AS INTEGER) AS vehicle_age_at_occurrence_years,
  year(occurrence_date) < model_year AS occurrence_before_model_year,
  CAST(report_date - occurrence_date AS INTEGER) AS occurrence_to_report_delay_days,
  mileage, mileage_unit, mileage IS NOT NULL AS mileage_observed, death_count, injury_count,
  crash AS crash_positive, fire AS fire_positive, injury_count > 0 AS injury_positive, death_count > 0 AS death_positive,
  {', '.join(f'quality_{n}' for n in C.QUALITY_FLAGS)}
FROM clean"""


def _cohort_columns() -> str:
    out = [
        "min(broad_vehicle_id) AS broad_vehicle_id", KEY, "count(*) AS complaint_event_count",
        "count(DISTINCT event_id) AS unique_event_count",
        "count(DISTINCT source_reference_id) AS unique_source_reference_count",
        "min(report_date) AS first_observed_report_date", "max(report_date) AS last_observed_report_date",
        "count(known_configuration_id) AS known_configuration_count",
        "count(known_configuration_id) / count(*)::DOUBLE AS known_configuration_share",
    ]
    for field, names in (("component", C.COMPONENTS), ("severity", C.SEVERITIES)):
        for n in names:
            hits = f"count(*) FILTER ({field} = '{n}')"
            out.append(f"{hits} AS {field}_{n}_complaint_count")
            out.append(f"{hits} / count(*)::DOUBLE AS {field}_{n}_complaint_share")
    for n in C.EVIDENCE:
        out.append(f"count({n}_positive) AS {n}_evidence_observed_count")
        out.append(f"count(*) FILTER ({n}_positive) AS {n}_positive_count")
        out.append(
            f"count(*) FILTER ({n}_positive) / nullif(count({n}_positive), 0)::DOUBLE AS {n}_positive_share_of_observed"
        )
    for label, column, median in (
        ("mileage", "mileage", "mileage_all_observed_median_miles"),
        ("report_delay", "occurrence_to_report_delay_days", "report_delay_median_days"),
    ):
        out += [
            f"count({column}) AS {label}_observed_count",
            f"count({column}) / count(*)::DOUBLE AS {label}_observed_share",
            f"quantile_cont({column}::DOUBLE, 0.5) AS {median}",
        ]
    for n in C.QUALITY_FLAGS:
        out.append(f"count(*) FILTER (quality_{n}) AS quality_{n}_count")
        out.append(f"count(*) FILTER (quality_{n}) / count(*)::DOUBLE AS quality_{n}_share")
    return ",\n  ".join(out)


CTES["coh"] = f"SELECT {_cohort_columns()}\nFROM ev GROUP BY {KEY}"
CTES["keys"] = f"SELECT {KEY}, min(broad_vehicle_id) AS broad_vehicle_id, count(*) AS complaint_event_count FROM ev GROUP BY {KEY}"

# --- production ---------------------------------------------------------------------------
CTES["filings"] = f"SELECT\n  {_rules(B.FILING_RULES)}\nFROM line2"
_FILING_JSON = " || ',' || ".join(
    f"'\"{name}\":' || " + (q(name) if text else f"{name}")
    for name, text in sorted(
        {
            "manufacturer_id": False, "manufacturer_name": True, "report_id": False,
            "reporting_year": False, "reporting_quarter": False, "fuel_propulsion_system": True,
            "make": True, "model": True, "model_year": True, "platform": True,
            "report_category": True, "total_production": False, "type_code": True,
            "source_row_number": False,
        }.items()
    )
)
CTES["canon"] = f"""SELECT 'nhtsa_ewr_' || sha256('{{' || {_FILING_JSON} || '}}') AS source_record_id,
  manufacturer_id, report_id, reporting_year, reporting_quarter,
  {norm('make')} AS normalized_make, {norm('model')} AS normalized_model, {year_of('model_year')} AS model_year,
  platform, type_code, fuel_propulsion_system, total_production AS production_count,
  make, model, source_row_number, manufacturer_name
FROM filings"""
_CONF = f"manufacturer_id, {KEY}, platform, type_code, fuel_propulsion_system"
CTES["latest"] = f"""SELECT * FROM canon QUALIFY row_number() OVER (PARTITION BY {_CONF}
  ORDER BY reporting_year DESC, reporting_quarter DESC, report_id DESC, source_record_id) = 1"""
CTES["prod"] = f"""SELECT {KEY}, sum(production_count)::BIGINT AS production_count, count(*) AS source_record_count,
  list_sort(list(source_record_id)) AS source_record_ids,
  list_sort(list_distinct(list(reporting_year || 'Q' || reporting_quarter))) AS reporting_periods,
  list_sort(list_distinct(list(manufacturer_id))) AS reporting_entity_ids
FROM latest GROUP BY {KEY}"""
CTES["alias"] = "SELECT DISTINCT " + _rules(B.ALIAS_RULES) + " FROM part WHERE p_brand = 'Brand#13'"
CTES["pmatch"] = f"""SELECT k.broad_vehicle_id, k.normalized_make, k.normalized_model, k.model_year, k.complaint_event_count,
  CASE WHEN e.model_year IS NOT NULL THEN 'EXACT' WHEN v.model_year IS NOT NULL THEN 'EXPLICIT_ALIAS'
    ELSE 'NO_PRODUCTION_RECORD' END AS production_match_status,
  CASE WHEN e.model_year IS NOT NULL THEN 'exact_normalized' WHEN v.model_year IS NOT NULL THEN 'explicit_alias' END AS match_method,
  coalesce(e.production_count, v.production_count) AS production_count,
  coalesce(e.source_record_count, v.source_record_count, 0) AS production_source_record_count,
  coalesce(e.source_record_ids, v.source_record_ids, []) AS production_source_record_ids,
  coalesce(e.reporting_periods, v.reporting_periods, []) AS production_reporting_periods,
  0::BIGINT AS ambiguity_candidate_count,
  CASE WHEN coalesce(e.production_count, v.production_count) > 0
    THEN k.complaint_event_count * 10000.0::DOUBLE / coalesce(e.production_count, v.production_count) END AS complaints_per_10k_produced
FROM keys k LEFT JOIN prod e USING ({KEY})
LEFT JOIN alias a ON k.normalized_make = a.make AND k.normalized_model = a.model
LEFT JOIN prod v ON v.normalized_make = a.alias_make AND v.normalized_model = a.alias_model AND v.model_year = k.model_year"""

# --- communications -------------------------------------------------------------------------
CTES["commrows"] = "SELECT\n  " + _rules(
    B.communication_rules(_fmt, lambda day, days: f"(CAST({day} AS DATE) - CAST({days} AS INTEGER))")
) + "\nFROM line3"


def flagged(x: str, name: str) -> tuple[str, str]:
    day = f"({day_of(x)})"
    usable = f"year({day}) BETWEEN 1900 AND 2100"
    return (
        f"CASE WHEN {usable} THEN {day} END",
        f"CASE WHEN NOT regexp_full_match({x}, '[0-9]{{8}}') THEN 'malformed_{name}' WHEN {day} IS NULL"
        f" THEN 'invalid_{name}' WHEN NOT ({usable}) THEN 'out_of_range_{name}' END",
    )


_ADDED, _ADDED_FLAG = flagged("added", "date_added")
_SENT, _SENT_FLAG = flagged("communicated", "communication_date")
CTES["docgroup"] = f"""SELECT source_id, min(replacement) AS replacement, min(added) AS added, min(document) AS document,
  min(communicated) AS communicated, min(campaign) AS campaign, min(type) AS type, min(summary) AS summary,
  list_sort(list(DISTINCT component)) AS source_components,
  list_sort(list_distinct(list({component_of('component')}))) AS canonical_components,
  coalesce(list_sort(list(DISTINCT system) FILTER (system IS NOT NULL)), []) AS component_systems,
  coalesce(list_sort(list(DISTINCT subsystem) FILTER (subsystem IS NOT NULL)), []) AS component_subsystems,
  count(*) AS source_row_count
FROM commrows GROUP BY source_id"""
CTES["docs"] = f"""SELECT 'nhtsa_mc_' || source_id AS communication_id, source_id, document AS manufacturer_document_id,
  nullif(replacement, '') AS replacement_document_id, nullif(campaign, '') AS manufacturer_campaign_or_software_id,
  type AS original_communication_type, {map_case('type', C.COMMUNICATION_TYPE_NAMES, 'UNKNOWN')} AS communication_type,
  added AS original_date_added, {_ADDED} AS date_added, communicated AS original_communication_date,
  {_SENT} AS communication_date,
  list_sort(list_filter([{_ADDED_FLAG}, {_SENT_FLAG}], lambda f: f IS NOT NULL)) AS date_quality_flags,
  summary, source_components, canonical_components, component_systems, component_subsystems, source_row_count
FROM docgroup"""
CTES["capps"] = f"""SELECT 'nhtsa_mc_app_' || sha256('["' || source_id || '","' || make || '","' || model || '","' || year || '"]') AS applicability_id,
  'nhtsa_mc_' || source_id AS communication_id, source_id, make AS original_make, model AS original_model, year AS original_model_year,
  {norm('make')} AS normalized_make, {norm('model')} AS normalized_model, {year_of('year')} AS model_year,
  CASE WHEN ({year_of('year')}) IS NOT NULL THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_VEHICLE_IDENTITY' END AS applicability_status,
  count(*) AS source_expanded_row_count
FROM commrows GROUP BY source_id, make, model, year"""


def _matched(apps: str) -> str:
    return f"""SELECT a.*, CASE WHEN a.model_year IS NULL THEN 'INSUFFICIENT_VEHICLE_IDENTITY'
  WHEN k.broad_vehicle_id IS NOT NULL THEN 'EXACT' ELSE 'NO_MATCH' END AS complaint_match_status,
  CASE WHEN k.broad_vehicle_id IS NOT NULL THEN 'exact_normalized' END AS match_method,
  k.broad_vehicle_id AS matched_broad_vehicle_id, 0::BIGINT AS ambiguity_candidate_count
FROM {apps} a LEFT JOIN keys k USING ({KEY})"""


CTES["cmatch"] = _matched("capps")


def _evidence(values: str, table: str, columns, count: str, status: str) -> str:
    filled = ", ".join(f"v.{n}" if n.endswith("_date") else f"coalesce(v.{n}, 0)::BIGINT AS {n}" for n in columns)
    return f"""SELECT k.broad_vehicle_id, k.normalized_make, k.normalized_model, k.model_year, k.complaint_event_count,
  CASE WHEN v.{count} IS NULL THEN 'NO_MATCH' ELSE 'EXACT' END AS {status},
  CASE WHEN v.{count} IS NOT NULL THEN 'exact_normalized' END AS match_method, {filled}
FROM keys k LEFT JOIN ({values} FROM {table} GROUP BY 1) v USING (broad_vehicle_id)"""


CTES["cjoin"] = """SELECT m.matched_broad_vehicle_id AS broad_vehicle_id, m.applicability_id, m.source_expanded_row_count, d.*
FROM cmatch m JOIN docs d USING (communication_id) WHERE m.matched_broad_vehicle_id IS NOT NULL"""
CTES["cev"] = _evidence(
    "SELECT broad_vehicle_id, count(DISTINCT communication_id) AS unique_communication_count,"
    " count(DISTINCT applicability_id) AS communication_applicability_row_count,"
    " sum(cjoin.source_expanded_row_count)::BIGINT AS source_expanded_row_count,"
    " count(DISTINCT manufacturer_document_id) AS unique_manufacturer_document_id_count,"
    " min(communication_date) AS first_communication_date, max(communication_date) AS last_communication_date,"
    " count(DISTINCT communication_id) FILTER (summary <> '') AS summary_observed_communication_count,"
    " count(DISTINCT communication_id) FILTER (len(component_systems) > 0 OR len(component_subsystems) > 0)"
    " AS manufacturer_component_observed_communication_count, "
    + ", ".join(
        f"count(DISTINCT communication_id) FILTER (communication_type = '{n}') AS communication_type_{n.lower()}_count"
        for n in C.COMMUNICATION_TYPES
    )
    + ", "
    + ", ".join(
        f"count(DISTINCT communication_id) FILTER (list_contains(canonical_components, '{n}')) AS component_{n}_communication_count"
        for n in C.COMPONENTS
    ),
    "cjoin", C.COMMUNICATION_EVIDENCE_VALUES, "unique_communication_count",
    "manufacturer_communication_match_status",
)
CTES["compact"] = "SELECT " + _rules(B.COMPACT_RULES) + " FROM line2"
CTES["products"] = "SELECT source_id, make, model, unnest(string_split(years, ',')) AS year FROM compact"
CTES["late_compact"] = "SELECT " + _rules(B.COMPACT_RULES) + f" FROM line2 WHERE l_shipdate >= TIMESTAMP '{B.COMPACT_FROM}'"
CTES["late_products"] = "SELECT source_id, make, model, unnest(string_split(years, ',')) AS year FROM late_compact"

# --- recalls -----------------------------------------------------------------------------------
CTES["recrows"] = "SELECT\n  " + _rules(
    B.recall_rules(_fmt, lambda day, days: f"(CAST({day} AS DATE) + CAST({days} AS INTEGER))")
) + "\nFROM line2"


def _set(column: str) -> str:
    return f"coalesce(list_sort(list(DISTINCT {column}) FILTER ({column} IS NOT NULL)), [])"


_SETS = {
    "manufacturer_campaign_numbers": "MFGCAMPNO", "filing_manufacturers": "MFGNAME",
    "recalled_manufacturers": "MFGTXT", "original_recall_type_codes": "RCLTYPECD",
    "initiators": "INFLUENCED_BY", "regulation_part_numbers": "RPNO", "fmvss_numbers": "FMVSS",
    "original_components": "COMPNAME", "defect_descriptions": "DESC_DEFECT",
    "consequence_descriptions": "CONEQUENCE_DEFECT", "corrective_actions": "CORRECTIVE_ACTION",
    "notes": "NOTES", "do_not_drive_values": "DO_NOT_DRIVE", "park_outside_values": "PARK_OUTSIDE",
}
CTES["campraw"] = f"""SELECT CAMPNO, {', '.join(f'{_set(c)} AS {n}' for n, c in _SETS.items())},
  {_set(map_case('RCLTYPECD', C.RECALL_TYPE_CODES, 'OTHER'))} AS recall_types,
  {_set(day_of('RCDATE'))} AS report_received_dates, {_set(day_of('ODATE'))} AS owner_notification_dates,
  {_set(day_of('DATEA'))} AS record_creation_dates,
  {_set("CASE WHEN regexp_full_match(POTAFF, '[0-9]+') THEN CAST(POTAFF AS BIGINT) END")} AS potential_units_affected_values,
  {_set(f"CASE WHEN COMPNAME IS NOT NULL THEN {component_of('COMPNAME')} END")} AS canonical_components,
  bool_or(RCDATE IS NOT NULL AND ({day_of('RCDATE')}) IS NULL OR ODATE IS NOT NULL AND ({day_of('ODATE')}) IS NULL
    OR DATEA IS NOT NULL AND ({day_of('DATEA')}) IS NULL) AS bad_date,
  {_set('source_file')} AS source_artifact_filenames, count(*) AS source_row_count
FROM recrows GROUP BY CAMPNO"""
CTES["camps"] = f"""SELECT 'nhtsa_recall_' || CAMPNO AS campaign_id, CAMPNO AS campaign_number, {', '.join(_SETS)},
  recall_types, report_received_dates, owner_notification_dates, record_creation_dates,
  CASE WHEN len(potential_units_affected_values) = 1 THEN potential_units_affected_values[1] END AS potential_units_affected,
  potential_units_affected_values, canonical_components,
  list_filter([CASE WHEN len(potential_units_affected_values) > 1 THEN 'multiple_potential_units_affected_values' END,
    CASE WHEN bad_date THEN 'unparseable_date_value' END], lambda f: f IS NOT NULL) AS quality_flags,
  source_artifact_filenames, source_row_count
FROM campraw"""
CTES["rapps"] = f"""SELECT 'nhtsa_recall_app_' || sha256('["' || CAMPNO || '","' || RECORD_ID || '","' || MAKETXT || '","' || MODELTXT || '","' || YEARTXT || '"]') AS applicability_id,
  'nhtsa_recall_' || CAMPNO AS campaign_id, RECORD_ID AS source_record_number,
  {norm('MAKETXT')} AS normalized_make, {norm('MODELTXT')} AS normalized_model, {year_of('YEARTXT')} AS model_year,
  {component_of('COMPNAME')} AS canonical_component, {day_of('BGMAN')} AS manufacturing_begin_date,
  {day_of('ENDMAN')} AS manufacturing_end_date, source_file AS source_artifact_filename
FROM recrows WHERE RCLTYPECD = 'V'"""
CTES["rmatch"] = _matched("rapps")
CTES["rjoin"] = """SELECT m.matched_broad_vehicle_id AS broad_vehicle_id, m.applicability_id, c.*
FROM rmatch m JOIN camps c USING (campaign_id) WHERE m.matched_broad_vehicle_id IS NOT NULL"""
CTES["rev"] = _evidence(
    "SELECT broad_vehicle_id, count(DISTINCT campaign_id) AS unique_recall_campaign_count,"
    " count(DISTINCT applicability_id) AS recall_applicability_row_count,"
    " min(report_received_dates[1]) AS first_recall_date, max(report_received_dates[-1]) AS last_recall_date,"
    " count(DISTINCT campaign_id) FILTER (len(fmvss_numbers) > 0) AS noncompliance_campaign_count,"
    " count(DISTINCT campaign_id) FILTER (potential_units_affected IS NOT NULL) AS known_affected_population_campaign_count,"
    " count(DISTINCT campaign_id) FILTER (len(corrective_actions) > 0) AS remedy_observed_campaign_count, "
    + ", ".join(
        f"count(DISTINCT campaign_id) FILTER (list_contains(recall_types, '{n}')) AS recall_type_{n.lower()}_campaign_count"
        for n in C.RECALL_TYPES
    )
    + ", "
    + ", ".join(
        f"count(DISTINCT campaign_id) FILTER (list_contains(canonical_components, '{n}')) AS component_{n}_recall_campaign_count"
        for n in C.COMPONENTS
    ),
    "rjoin", C.RECALL_EVIDENCE_VALUES, "unique_recall_campaign_count", "recall_match_status",
)


def query(final: str, extra: dict[str, str] | None = None) -> str:
    """The final SELECT preceded by just the stages it refers to, in order."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if word in known and word not in needed:
                needed.add(word)
                visit(known[word])

    visit(final)
    listed = [f"{name} AS MATERIALIZED ({known[name]})" for name in known if name in needed]
    return ("WITH " + ",\n".join(listed) + "\n" if listed else "") + final
