"""More SQL stages for the checks: integration, targets, as-of features, metrics."""

from __future__ import annotations

from cohortlens import constants as C
from cohortlens.functions import numbers
from cohortlens.modeling.preprocess import feature_type
from cohortlens.operators import integration as I
from cohortlens.plans import bindings as B
from cohortlens.plans.sqltext import CTES, CUT, KEY, in_list

END = f"DATE '{numbers.window_end(B.CUTOFF, B.HORIZON).isoformat()}'"


def _integrated() -> str:
    out = [f"c.{n} AS {I.complaint_name(n)}" for n in C.COHORT_FEATURE_COLUMNS]

    def gate(alias, names, condition, flag, status, method):
        out.append(f"{condition} AS {flag}")
        out.append(f"{alias}.{status[1]} AS {status[0]}")
        out.append(f"{alias}.match_method AS {method}")
        out.extend(f"CASE WHEN {condition} THEN {alias}.{old} END AS {new}" for new, old in names.items())

    gate("p", I.PRODUCTION_NAMES, "p.production_count IS NOT NULL", "has_production_match",
         ("production_match_status", "production_match_status"), "production_match_method")
    gate("m", I.COMMUNICATION_NAMES, "m.unique_communication_count > 0", "has_manufacturer_communications",
         ("communication_match_status", "manufacturer_communication_match_status"), "communication_match_method")
    gate("r", I.RECALL_NAMES, "r.unique_recall_campaign_count > 0", "has_recall",
         ("recall_match_status", "recall_match_status"), "recall_match_method")
    n = (
        "1 + (p.production_count IS NOT NULL)::INTEGER + (m.unique_communication_count > 0)::INTEGER"
        " + (r.unique_recall_campaign_count > 0)::INTEGER"
    )
    out.append(f"({n})::INTEGER AS source_count_available")
    out.append(f"({n}) = 4 AS has_all_four_sources")
    out.append(
        "'complaints' || CASE WHEN p.production_count IS NOT NULL THEN '+production' ELSE '' END"
        " || CASE WHEN m.unique_communication_count > 0 THEN '+communications' ELSE '' END"
        " || CASE WHEN r.unique_recall_campaign_count > 0 THEN '+recalls' ELSE '' END AS source_coverage_category"
    )
    return (
        "SELECT " + ",\n  ".join(out)
        + "\nFROM coh c JOIN pmatch p USING (broad_vehicle_id) JOIN cev m USING (broad_vehicle_id)"
        + " JOIN rev r USING (broad_vehicle_id)"
    )


CTES["integ"] = _integrated()

# --- targets ---------------------------------------------------------------------------------
_PAST = f"report_date <= {CUT}"
_AHEAD = f"report_date > {CUT} AND report_date <= {END}"
_NUMBERS = [
    "historical_complaint_count", "future_complaint_count", "future_severe_complaint_count",
    *(f"future_component_{n}_complaint_count" for n in C.SELECTED_COMPONENTS),
]
CTES["evcounts"] = f"""SELECT broad_vehicle_id, count(*) FILTER ({_PAST}) AS historical_complaint_count,
  min(report_date) FILTER ({_PAST}) AS first_historical_date,
  count(*) FILTER ({_AHEAD}) AS future_complaint_count,
  count(*) FILTER ({_AHEAD} AND severity IN ({in_list(C.SEVERE)})) AS future_severe_complaint_count,
  {', '.join(f"count(*) FILTER ({_AHEAD} AND component = '{n}') AS future_component_{n}_complaint_count" for n in C.SELECTED_COMPONENTS)}
FROM ev GROUP BY 1"""
CTES["lab"] = f"""SELECT k.broad_vehicle_id, k.normalized_make, k.normalized_model, k.model_year,
  {', '.join(f'coalesce(e.{n}, 0) AS {n}' for n in _NUMBERS)},
  CASE WHEN k.model_year > {B.CUTOFF.year} THEN 'MODEL_YEAR_AFTER_CUTOFF'
    WHEN coalesce(e.historical_complaint_count, 0) < 1 THEN 'NO_HISTORICAL_COMPLAINT' ELSE 'ELIGIBLE' END AS eligibility_reason,
  CAST({B.CUTOFF.year} - k.model_year AS INTEGER) AS cohort_age_at_cutoff,
  CASE WHEN {B.CUTOFF.year} - k.model_year = 0 THEN '0' WHEN {B.CUTOFF.year} - k.model_year <= 2 THEN '1-2'
    WHEN {B.CUTOFF.year} - k.model_year <= 5 THEN '3-5' WHEN {B.CUTOFF.year} - k.model_year <= 10 THEN '6-10'
    WHEN {B.CUTOFF.year} - k.model_year <= 20 THEN '11-20' ELSE '21+' END AS age_bucket,
  CAST({CUT} - e.first_historical_date AS INTEGER) AS historical_observation_days
FROM keys k LEFT JOIN evcounts e USING (broad_vehicle_id)"""
CTES["tgt"] = f"""SELECT broad_vehicle_id, {KEY}, '{C.TARGET_VERSION}' AS target_definition_version, {CUT} AS cutoff_date,
  CAST({B.HORIZON} AS INTEGER) AS horizon_months, {CUT} + 1 AS future_window_start, {END} AS future_window_end,
  true AS target_eligible, eligibility_reason, cohort_age_at_cutoff, historical_complaint_count, future_complaint_count,
  future_complaint_count >= 1 AS future_any_complaint,
  {', '.join(f'future_complaint_count >= {n} AS future_complaint_at_least_{n}' for n in (2, 3, 5, 10))},
  future_severe_complaint_count, future_severe_complaint_count >= 1 AS future_severe_complaint_activity,
  {', '.join(_NUMBERS[3:])}
FROM lab WHERE eligibility_reason = 'ELIGIBLE'"""

# --- as-of features -----------------------------------------------------------------------------


def _history() -> str:
    out = [
        "broad_vehicle_id", "count(*) AS historical_complaint_count",
        "count(DISTINCT source_reference_id) AS historical_unique_odino_count",
        "(max(report_date) - min(report_date)) / 365.25::DOUBLE AS historical_years_observed",
        "min(report_date) AS historical_first_report_date", "max(report_date) AS historical_last_report_date",
        f"CAST({CUT} - max(report_date) AS INTEGER) AS days_since_last_historical_complaint",
    ]
    for m in C.RECENCY_MONTHS:
        out.append(
            f"count(*) FILTER (report_date >= {CUT} - INTERVAL {m} MONTH + INTERVAL 1 DAY) AS complaints_last_{m}m"
        )
    for field, names in (("component", C.COMPONENTS), ("severity", C.SEVERITIES)):
        for n in names:
            hits = f"count(*) FILTER ({field} = '{n}')"
            out.append(f"{hits} AS historical_complaint_{field}_{n}_count")
            out.append(f"{hits} / count(*)::DOUBLE AS historical_complaint_{field}_{n}_share")
    out += [f"count(*) FILTER ({n}_positive) AS historical_{n}_positive_count" for n in C.EVIDENCE]
    out += [
        "count(mileage) AS historical_mileage_observed_count",
        "count(mileage) / count(*)::DOUBLE AS historical_mileage_observed_share",
        "quantile_cont(mileage::DOUBLE, 0.5) AS historical_mileage_median",
    ]
    return (
        "SELECT " + ",\n  ".join(out)
        + f"\nFROM ev WHERE report_date <= {CUT} AND broad_vehicle_id IN (SELECT broad_vehicle_id FROM tgt) GROUP BY 1"
    )


CTES["ahist"] = _history()


def _documents(stem: str, counter: str, source: str, key: str, day: str, extra: list[str]) -> str:
    known = f"d <= {CUT}"
    counts = [f"count(*) FILTER ({known}) AS {counter}", *[e.replace("@known", known) for e in extra]]
    inner = f"""SELECT broad_vehicle_id, count(*) AS total, {', '.join(counts)},
    min(d) FILTER ({known}) AS f, max(d) FILTER ({known}) AS l
    FROM (SELECT DISTINCT ON (broad_vehicle_id, {key}) *, {day} AS d FROM {source}) GROUP BY 1"""
    names = [c.rsplit(" AS ", 1)[1] for c in counts]
    return f"""SELECT t.broad_vehicle_id, coalesce(s.{counter}, 0) > 0 AS {stem}_observed_by_cutoff,
  CASE WHEN s.{counter} > 0 THEN 'OBSERVED_RECORDS' WHEN s.total > 0 THEN 'MATCHED_RECORDS_AFTER_CUTOFF_ONLY'
    ELSE 'NO_MATCHED_RECORD' END AS {stem}_asof_status,
  {', '.join(f'coalesce(s.{n}, 0) AS {n}' for n in names)},
  s.f AS historical_first_{stem}_date, s.l AS historical_last_{stem}_date,
  CAST({CUT} - s.l AS INTEGER) AS days_since_last_{stem}
FROM tgt t LEFT JOIN ({inner}) s USING (broad_vehicle_id)"""


CTES["acomm"] = _documents(
    "communication", "historical_unique_communication_count", "cjoin", "communication_id", "date_added",
    [
        f"count(*) FILTER (@known AND communication_type = '{n}') AS historical_communication_type_{n.lower()}_count"
        for n in C.COMMUNICATION_TYPES
    ]
    + [
        f"count(*) FILTER (@known AND list_contains(canonical_components, '{n}')) AS historical_communication_component_{n}_count"
        for n in C.COMPONENTS
    ],
)
CTES["arec"] = _documents(
    "recall", "historical_unique_recall_campaign_count", "rjoin", "campaign_id", "report_received_dates[1]",
    [
        "count(*) FILTER (@known AND (len(fmvss_numbers) > 0 OR len(regulation_part_numbers) > 0)) AS historical_recall_noncompliance_count",
        "count(*) FILTER (@known AND list_contains(do_not_drive_values, 'Yes')) AS historical_recall_do_not_drive_count",
        "count(*) FILTER (@known AND list_contains(park_outside_values, 'Yes')) AS historical_recall_park_outside_count",
    ]
    + [
        f"count(*) FILTER (@known AND list_contains(canonical_components, '{n}')) AS historical_recall_component_{n}_count"
        for n in C.COMPONENTS
    ],
)
_OWN = {*C.IDENTITY_FEATURES}
CTES["feat"] = f"""SELECT t.broad_vehicle_id, t.normalized_make, t.normalized_model, t.model_year, t.cohort_age_at_cutoff,
  {CUT} AS feature_cutoff_date, {', '.join(f'h.{n}' for n in C.FEATURE_COLUMNS if n not in _OWN and n not in C.COMMUNICATION_FEATURES and n not in C.RECALL_FEATURES)},
  {', '.join(f'm.{n}' for n in C.COMMUNICATION_FEATURES)}, {', '.join(f'r.{n}' for n in C.RECALL_FEATURES)}
FROM tgt t JOIN ahist h USING (broad_vehicle_id) JOIN acomm m USING (broad_vehicle_id) JOIN arec r USING (broad_vehicle_id)"""

# --- split ---------------------------------------------------------------------------------------


def _allot(name: str, source: str, size: str, total: str, out: str) -> str:
    return f"""SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, lab::INTEGER) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS {out}
FROM (SELECT *, floor(total * {size} / sum({size}) OVER ())::BIGINT AS base,
    total * {size} / sum({size}) OVER () - floor(total * {size} / sum({size}) OVER ()) AS rest
  FROM (SELECT *, ({total})::BIGINT AS total FROM {source}))"""


CTES["classes"] = "SELECT future_any_complaint AS lab, count(*) AS class_rows FROM tgt GROUP BY 1"
CTES["quota1"] = _allot(
    "quota1", "classes", "class_rows",
    "sum(class_rows) OVER () - ceil(sum(class_rows) OVER () * 3 / 10.0)", "train_rows",
)
CTES["quota2"] = "SELECT lab, class_rows, train_rows, class_rows - train_rows AS held FROM quota1"
CTES["quota3"] = _allot(
    "quota3", "quota2", "held", "sum(held) OVER () - ceil(sum(held) OVER () / 2.0)", "validation_rows"
)
CTES["hsplit"] = f"""SELECT broad_vehicle_id, CASE WHEN pos < train_rows THEN 'TRAIN' WHEN pos < train_rows + validation_rows
  THEN 'VALIDATION' ELSE 'TEST' END AS split
FROM (SELECT broad_vehicle_id, future_any_complaint AS lab,
  row_number() OVER (PARTITION BY future_any_complaint ORDER BY md5('{C.SEED}|' || broad_vehicle_id)) - 1 AS pos FROM tgt)
JOIN quota3 USING (lab)"""
CTES["mds"] = """SELECT f.*, t.future_any_complaint::INTEGER AS target, s.split
FROM feat f JOIN tgt t USING (broad_vehicle_id) JOIN hsplit s USING (broad_vehicle_id)"""

# --- predictions of two fixed rules ------------------------------------------------------------------
CTES["pred"] = """SELECT broad_vehicle_id AS cohort_id, normalized_make, normalized_model, model_year, target, split,
  cohort_age_at_cutoff, historical_complaint_count, complaints_last_12m, communication_observed_by_cutoff, recall_observed_by_cutoff,
  (historical_complaint_count * 3 + complaints_last_12m * 5) / (historical_complaint_count * 3 + complaints_last_12m * 5 + 12.0::DOUBLE) AS probability,
  (historical_complaint_count * 2 + complaints_last_12m * 9) / (historical_complaint_count * 2 + complaints_last_12m * 9 + 14.0::DOUBLE) AS p_right
FROM mds"""
CTES["grp"] = """SELECT p.*, u.family, u.grp FROM pred p, LATERAL (VALUES
  ('age', CASE WHEN p.cohort_age_at_cutoff <= 2 THEN '0-2' WHEN p.cohort_age_at_cutoff <= 5 THEN '3-5'
    WHEN p.cohort_age_at_cutoff <= 10 THEN '6-10' WHEN p.cohort_age_at_cutoff <= 20 THEN '11-20' ELSE '21+' END),
  ('historical_support', CASE WHEN p.historical_complaint_count = 1 THEN '1' WHEN p.historical_complaint_count <= 4 THEN '2-4'
    WHEN p.historical_complaint_count <= 9 THEN '5-9' WHEN p.historical_complaint_count <= 49 THEN '10-49' ELSE '50+' END),
  ('source_coverage', CASE WHEN p.communication_observed_by_cutoff AND p.recall_observed_by_cutoff THEN 'communications_and_recalls'
    WHEN p.communication_observed_by_cutoff THEN 'communications_only' WHEN p.recall_observed_by_cutoff THEN 'recalls_only'
    ELSE 'complaints_only_or_limited' END)) AS u(family, grp)"""


def metrics(source: str, groups: str = "", *, weight: str = "1", score: str = "probability",
            label: str = "target", threshold: float = 0.5) -> str:
    """Metric contract as SQL: sort-based, unlike the histogram plan it checks."""
    lead = f"{groups}, " if groups else ""
    by = f"PARTITION BY {groups} " if groups else ""
    group = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}
  (tp + fp + fn + tn)::BIGINT AS row_count, (tp + fn) / n AS positive_prevalence, (tp + fp) / n AS predicted_positive_prevalence,
  (tp + tn) / n AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
  CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN wins / ((tp + fn) * (fp + tn))::DOUBLE END AS roc_auc,
  CASE WHEN tp + fn > 0 THEN ap / (tp + fn)::DOUBLE ELSE 0 END AS pr_auc, sq / n AS brier_score,
  tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, {threshold}::DOUBLE AS threshold
FROM (SELECT {lead} sum(pos + neg)::DOUBLE AS n,
    coalesce(sum(pos) FILTER (s >= {threshold}), 0) AS tp, coalesce(sum(neg) FILTER (s >= {threshold}), 0) AS fp,
    coalesce(sum(pos) FILTER (s < {threshold}), 0) AS fn, coalesce(sum(neg) FILTER (s < {threshold}), 0) AS tn,
    sum(neg * (above - pos + pos / 2.0::DOUBLE)) AS wins,
    coalesce(sum(pos * above / (above + nabove)::DOUBLE) FILTER (pos > 0), 0) AS ap,
    sum(pos * (1 - s) * (1 - s) + neg * s * s) AS sq
  FROM (SELECT {lead} s, pos, neg, sum(pos) OVER ({by}ORDER BY s DESC) AS above, sum(neg) OVER ({by}ORDER BY s DESC) AS nabove
    FROM (SELECT {lead} {score} AS s, sum({weight}) FILTER ({label} = 1) AS pos0, sum({weight}) FILTER ({label} = 0) AS neg0,
        coalesce(pos0, 0)::DOUBLE AS pos, coalesce(neg0, 0)::DOUBLE AS neg
      FROM {source} GROUP BY {lead} {score}))
  {group})"""


# --- preprocessing -------------------------------------------------------------------------------------
_NAMES = C.ALL_EVIDENCE_MODEL
CTES["trainlong"] = f"""SELECT broad_vehicle_id, feature, v FROM (
  SELECT broad_vehicle_id, {', '.join(f'{n}::DOUBLE AS {n}' for n in _NAMES)} FROM mds WHERE split = 'TRAIN')
UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_NAMES)}))"""
CTES["fmeta"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {i}, '{feature_type(n)}')" for i, n in enumerate(_NAMES)
) + ") AS t(feature, place, kind)"
CTES["fstat"] = """SELECT feature, place, kind, count(v) AS seen, count(*) AS n, min(v) AS low, max(v) AS high,
  quantile_cont(v, 0.5) AS median, list(coalesce(v::VARCHAR, 'null') ORDER BY broad_vehicle_id) AS column_values
FROM trainlong JOIN fmeta USING (feature) GROUP BY ALL"""
CTES["fkeep"] = """SELECT a.*, CASE WHEN seen = 0 THEN 'all_missing_in_training'
  WHEN seen = n AND low = high THEN 'constant_in_training'
  WHEN EXISTS (SELECT 1 FROM fstat b WHERE b.place < a.place AND b.column_values = a.column_values
    AND NOT (b.seen = b.n AND b.low = b.high)
    AND (CASE WHEN b.kind IN ('binary', 'share') THEN 'identity' ELSE b.kind END)
      = (CASE WHEN a.kind IN ('binary', 'share') THEN 'identity' ELSE a.kind END))
  THEN 'exact_duplicate_in_training' END AS removed FROM fstat a"""
CTES["fscale"] = """SELECT l.feature, avg(x) AS mean, stddev_pop(x) AS deviation FROM (
  SELECT t.feature, CASE WHEN k.kind = 'count' THEN ln(1 + coalesce(t.v, k.median)) ELSE coalesce(t.v, k.median) END AS x
  FROM trainlong t JOIN fkeep k USING (feature) WHERE k.removed IS NULL AND k.kind IN ('count', 'continuous')) l GROUP BY 1"""
