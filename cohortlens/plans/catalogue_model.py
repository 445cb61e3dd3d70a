"""Queries over the model dataset: split, preprocessing, metrics, models, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers
from cohortlens.modeling import bootstrap, explain, importance, metrics, models, preprocess, report, results, split
from cohortlens.operators import asof
from cohortlens.plans import bindings as B
from cohortlens.plans import sqlstages as X
from cohortlens.plans.registry import num, register
from cohortlens.session import stage, stage_path

c = F.col
LABEL = "future_any_complaint"
_DATASETS: dict[tuple[str, str], DataFrame] = {}
_TARGETS: dict[tuple[str, str], DataFrame] = {}
_FORESTS: dict[tuple[str, str], models.Fitted] = {}
_PERCEPTRONS: dict[tuple[str, str], models.Fitted] = {}


def dataset(spark, folder) -> DataFrame:
    """Features, label and split of one folder, staged once per application.

    As in a run by stages: later queries open the table that the feature stage wrote.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _DATASETS:
        evidence = B.Evidence(spark, folder, event_columns=asof.EVENT_COLUMNS)
        _TARGETS[key] = evidence.targets
        parts = split.stratified_split(evidence.targets, label=LABEL)
        _DATASETS[key] = stage(
            models.model_dataset(evidence.features(), evidence.targets, parts), "model-dataset"
        )
    return _DATASETS[key]


def dataset_targets(spark, folder) -> DataFrame:
    """The staged targets that the folder's dataset was built from."""
    dataset(spark, folder)
    return _TARGETS[(spark.sparkContext.applicationId, folder)]


def predictions(spark, folder) -> DataFrame:
    """Two fixed scores per cohort, in the columns of a prediction table."""
    h, r = c("historical_complaint_count"), c("complaints_last_12m")
    return dataset(spark, folder).select(
        c(C.COHORT_ID).alias("cohort_id"), *C.KEY, "target", "split", "cohort_age_at_cutoff",
        "historical_complaint_count", "complaints_last_12m", "communication_observed_by_cutoff",
        "recall_observed_by_cutoff",
        ((h * 3 + r * 5) / (h * 3 + r * 5 + 12.0)).alias("probability"),
        ((h * 2 + r * 9) / (h * 2 + r * 9 + 14.0)).alias("p_right"),
    ).withColumn("predicted_class", (c("probability") >= C.THRESHOLD).cast("int"))


def prediction_pairs(spark, folder) -> DataFrame:
    rows = predictions(spark, folder)
    return metrics.aligned(rows.drop("p_right"), rows.withColumn("probability", c("p_right")))


# --- split and preprocessing ----------------------------------------------------------------


@register("stratified_split", "SELECT * FROM hsplit")
def stratified_split(spark, folder):
    return split.stratified_split(B.Evidence(spark, folder).targets, label=LABEL)


@register(
    "split_summary",
    f"SELECT split, count(*) AS \"rows\", sum(target)::BIGINT AS positives, {num('avg(target)', 'positive_prevalence')} FROM mds GROUP BY 1",
)
def split_summary(spark, folder):
    return split.split_summary(dataset(spark, folder), "target")


@register(
    "alignment_check",
    "SELECT broad_vehicle_id FROM tgt WHERE broad_vehicle_id NOT IN (SELECT broad_vehicle_id FROM hsplit) "
    "OR broad_vehicle_id NOT IN (SELECT broad_vehicle_id FROM feat)",
)
def alignment_check(spark, folder):
    rows = dataset(spark, folder)
    return models.alignment_mismatches(
        rows, dataset_targets(spark, folder), rows.select(C.COHORT_ID, "split")
    ).select(C.COHORT_ID)


_SELECTED = "fkeep k LEFT JOIN fscale s USING (feature) WHERE k.removed IS NULL"


def _fit(spark, folder) -> preprocess.CohortPreprocessor:
    return preprocess.CohortPreprocessor.fit(dataset(spark, folder).where("split = 'TRAIN'"))


@register(
    "preprocess_stats",
    f"SELECT k.feature, k.kind AS feature_type, {num('k.median', 'median')}, {num('s.mean', 'mean')}, "
    f"{num('s.deviation', 'deviation')}, k.seen < k.n AS missing_indicator FROM {_SELECTED}",
)
def preprocess_stats(spark, folder):
    """Typed preprocessing numbers learned from TRAIN."""
    schema = "feature string, feature_type string, median double, mean double, deviation double, missing_indicator boolean"
    return spark.createDataFrame(_fit(spark, folder).statistics(), schema)


@register("preprocess_removed", "SELECT feature, removed AS reason FROM fkeep WHERE removed IS NOT NULL")
def preprocess_removed(spark, folder):
    rows = [(r["feature"], r["reason"]) for r in _fit(spark, folder).removed]
    return spark.createDataFrame(rows, "feature string, reason string")


_ALL_LONG = (
    "(SELECT split, feature, v FROM (SELECT split, "
    + ", ".join(f"{n}::DOUBLE AS {n}" for n in C.ALL_EVIDENCE_MODEL)
    + " FROM mds) UNPIVOT INCLUDE NULLS (v FOR feature IN (" + ", ".join(C.ALL_EVIDENCE_MODEL) + ")))"
)
_FILLED = "CASE WHEN k.kind = 'count' THEN ln(1 + coalesce(l.v, k.median)) ELSE coalesce(l.v, k.median) END"


@register(
    "preprocess_apply",
    f"SELECT split, feature, count(*) AS \"rows\", {num('avg(x)', 'mean')}, {num('max(x)', 'maximum')}, "
    f"{num('avg(absent)', 'missing_share')} FROM (SELECT l.split, l.feature, CASE WHEN l.v IS NULL THEN 1.0 ELSE 0.0 END AS absent, "
    f"CASE WHEN s.mean IS NULL THEN {_FILLED} ELSE ({_FILLED} - s.mean) / s.deviation END AS x "
    f"FROM {_ALL_LONG} l JOIN fkeep k USING (feature) LEFT JOIN fscale s USING (feature) WHERE k.removed IS NULL) GROUP BY ALL",
)
def preprocess_apply(spark, folder):
    """The frozen numbers applied to all splits, summarized per split and feature."""
    fitted = _fit(spark, folder)
    wide = fitted.transform(dataset(spark, folder), keep=["split"])
    flag = {n: c(f"{n}__missing") if n in fitted.missing else F.lit(0.0) for n in fitted.selected}
    pairs = F.array(
        *[F.struct(F.lit(n).alias("feature"), c(n).alias("x"), flag[n].alias("absent")) for n in fitted.selected]
    )
    return wide.select("split", F.explode(pairs).alias("p")).groupBy("split", "p.feature").agg(
        F.count("*").alias("rows"), F.avg("p.x").alias("mean"), F.max("p.x").alias("maximum"),
        F.avg("p.absent").alias("missing_share"),
    )


@register(
    "impute_scale",
    f"SELECT feature, {num('median')}, {num('avg(coalesce(v, median))', 'mean')}, "
    f"{num('CASE WHEN stddev_pop(coalesce(v, median)) = 0 THEN 1 ELSE stddev_pop(coalesce(v, median)) END', 'deviation')}, "
    "count(v) < count(*) AS missing_indicator FROM trainlong JOIN (SELECT feature, median FROM fstat WHERE seen > 0) USING (feature) GROUP BY feature, median",
)
def impute_scale(spark, folder):
    train = dataset(spark, folder).where("split = 'TRAIN'")
    fit = preprocess.ImputeScale.fit(train, C.ALL_EVIDENCE_MODEL, scale=True)
    rows = [(n, fit.medians[n], fit.means[n], fit.deviations[n], n in fit.missing) for n in fit.names]
    return spark.createDataFrame(
        rows, "feature string, median double, mean double, deviation double, missing_indicator boolean"
    )


@register(
    "one_hot_rare",
    "SELECT split, CASE WHEN n >= 2 THEN k WHEN n IS NOT NULL THEN '__infrequent__' END AS label, count(*) AS \"rows\" FROM "
    "(SELECT split, normalized_make || ' ' || model_year AS k FROM mds) LEFT JOIN (SELECT normalized_make || ' ' || model_year AS k, count(*) AS n "
    "FROM mds WHERE split = 'TRAIN' GROUP BY 1) USING (k) GROUP BY ALL",
)
def one_hot_rare(spark, folder):
    """Rare-label grouping on a key with many labels."""
    rows = dataset(spark, folder).withColumn("k", F.concat_ws(" ", "normalized_make", "model_year"))
    train = rows.where("split = 'TRAIN'")
    grouped = preprocess.group_rare(train, rows, "k", "label")
    return grouped.groupBy("split", "label").agg(F.count("*").alias("rows"))


@register("one_hot_vectors")
def one_hot_vectors(spark, folder):
    """One-hot vectors of make and model, reduced to their set positions."""
    rows = dataset(spark, folder)
    hot = preprocess.one_hot(rows.where("split = 'TRAIN'"), rows, C.IDENTITY_MODEL)
    from pyspark.ml.functions import vector_to_array

    position = {n: F.array_position(vector_to_array(f"{n}_hot"), 1.0) for n in C.IDENTITY_MODEL}
    return hot.groupBy(*C.IDENTITY_MODEL, *[v.alias(f"{n}_position") for n, v in position.items()]).agg(
        F.count("*").alias("rows")
    )


@register(
    "missing_before_preprocessing",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count(*) - count({n}) AS missing_rows FROM mds" for n in C.ALL_EVIDENCE_MODEL
    ),
)
def missing_before_preprocessing(spark, folder):
    return preprocess.missing_counts(dataset(spark, folder), C.ALL_EVIDENCE_MODEL)


# --- metrics -----------------------------------------------------------------------------------

_M_DOUBLES = (
    "positive_prevalence", "predicted_positive_prevalence", "accuracy", "precision", "recall", "f1",
    "roc_auc", "pr_auc", "brier_score", "threshold",
)
_M_SHOWN = "row_count, " + ", ".join(num(n) for n in _M_DOUBLES) + ", tn, fp, fn, tp"


@register("binary_metrics", f"SELECT split, {_M_SHOWN} FROM ({X.metrics('pred', 'split')})")
def binary_metrics(spark, folder):
    """The metric contract per split."""
    return metrics.binary_metrics(predictions(spark, folder), ["split"])


@register(
    "grouped_metrics",
    f"SELECT family, grp AS \"group\", {_M_SHOWN}, tp + fn AS positive_count FROM ({X.metrics('grp', 'family, grp')})",
)
def grouped_metrics(spark, folder):
    return metrics.subgroup_metrics(predictions(spark, folder))


def _sweep_sql():
    parts = []
    for t in C.SENSITIVITY_THRESHOLDS:
        inner = X.metrics("pred", threshold=t)
        shown = ", ".join(num(n) for n in ("threshold", "predicted_positive_prevalence", "precision", "recall", "f1"))
        parts.append(f"SELECT {shown}, tn, fp, fn, tp FROM ({inner})")
    return " UNION ALL ".join(parts)


@register("threshold_sweep", _sweep_sql())
def threshold_sweep(spark, folder):
    return metrics.threshold_sensitivity(predictions(spark, folder))


_RULES = (("historical_complaint_count", 2, 50), ("complaints_last_12m", 1, 20))


def _rule_sql(value, first, last):
    return (
        f"SELECT '{value}' AS rule, t, {num('f1')}, {num('roc_auc')}, tp, fp, fn, tn FROM (SELECT t::INTEGER AS t, "
        "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1, "
        "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (fp + tn)::DOUBLE) / 2 END AS roc_auc, tp, fp, fn, tn FROM "
        f"(SELECT t, count(*) FILTER ({value} >= t AND target = 1) AS tp, count(*) FILTER ({value} >= t AND target = 0) AS fp, "
        f"count(*) FILTER ({value} < t AND target = 1) AS fn, count(*) FILTER ({value} < t AND target = 0) AS tn "
        f"FROM pred, range({first}, {last + 1}) r(t) WHERE split = 'VALIDATION' GROUP BY t))"
    )


def _rule_tables(spark, folder):
    held = predictions(spark, folder).where("split = 'VALIDATION'")
    return {value: metrics.rule_candidates(held, value, a, b) for value, a, b in _RULES}


@register("rule_candidates", " UNION ALL ".join(_rule_sql(*r) for r in _RULES))
def rule_candidates(spark, folder):
    """Every threshold of the two rule baselines on the validation rows."""
    tables = _rule_tables(spark, folder)
    parts = [t.select(F.lit(name).alias("rule"), "*") for name, t in tables.items()]
    return parts[0].unionByName(parts[1])


@register(
    "rule_selection",
    " UNION ALL ".join(f"SELECT * FROM (SELECT * FROM ({_rule_sql(*r)}) ORDER BY f1 DESC, roc_auc DESC, t LIMIT 1)" for r in _RULES),
)
def rule_selection(spark, folder):
    tables = _rule_tables(spark, folder)
    parts = [metrics.select_rule(t).select(F.lit(name).alias("rule"), "*") for name, t in tables.items()]
    return parts[0].unionByName(parts[1])


_BINS = (
    "SELECT b::INTEGER AS bin, b / 10.0::DOUBLE AS lower_bound, (b + 1) / 10.0::DOUBLE AS upper_bound, coalesce(n, 0) AS row_count, p AS mean_predicted_probability, "
    "o AS observed_positive_fraction, p - o AS calibration_gap FROM range(10) r(b) LEFT JOIN (SELECT least(floor(probability * 10), 9) AS b, "
    "count(*) AS n, avg(probability) AS p, avg(target) AS o FROM pred GROUP BY 1) USING (b)"
)


@register(
    "calibration_bins",
    "SELECT bin, row_count, " + ", ".join(
        num(n) for n in ("lower_bound", "upper_bound", "mean_predicted_probability", "observed_positive_fraction", "calibration_gap")
    ) + f" FROM ({_BINS})",
)
def calibration_bins(spark, folder):
    return metrics.calibration(predictions(spark, folder))


@register(
    "calibration_error",
    f"SELECT {num('sum(abs(calibration_gap) * row_count) / sum(row_count)', 'expected_calibration_error')} FROM ({_BINS})",
)
def calibration_error(spark, folder):
    return metrics.expected_calibration_error(metrics.calibration(predictions(spark, folder)))


_CATEGORY = (
    "CASE WHEN target = (probability >= 0.5)::INTEGER THEN 'true_' ELSE 'false_' END || "
    "CASE WHEN probability >= 0.5 THEN 'positive' ELSE 'negative' END"
)
_AGE = (
    "CASE WHEN cohort_age_at_cutoff <= 2 THEN '0-2' WHEN cohort_age_at_cutoff <= 5 THEN '3-5' WHEN cohort_age_at_cutoff <= 10 THEN '6-10' "
    "WHEN cohort_age_at_cutoff <= 20 THEN '11-20' ELSE '21+' END"
)
_SUPPORT = (
    "CASE WHEN historical_complaint_count = 1 THEN '1' WHEN historical_complaint_count <= 4 THEN '2-4' WHEN historical_complaint_count <= 9 THEN '5-9' "
    "WHEN historical_complaint_count <= 49 THEN '10-49' ELSE '50+' END"
)


@register(
    "error_analysis",
    "SELECT category, dimension, value, count(*) AS \"rows\" FROM (SELECT category, u.* FROM (SELECT *, "
    f"{_CATEGORY} AS category FROM pred UNION ALL SELECT *, CASE WHEN target = 0 AND probability >= 0.8 THEN 'false_positive_probability_gte_0_8' "
    "WHEN target = 1 AND probability <= 0.2 THEN 'false_negative_probability_lte_0_2' END AS category FROM pred "
    "WHERE (target = 0 AND probability >= 0.8) OR (target = 1 AND probability <= 0.2)) p, "
    f"LATERAL (VALUES ('all', 'all'), ('age', {_AGE}), ('support', {_SUPPORT}), "
    "('communication_available', p.communication_observed_by_cutoff::VARCHAR), ('recall_available', p.recall_observed_by_cutoff::VARCHAR), "
    "('model_year', p.model_year::VARCHAR)) AS u(dimension, value)) GROUP BY ALL",
)
def error_analysis(spark, folder):
    return metrics.error_analysis(predictions(spark, folder))


@register(
    "model_agreement",
    f"SELECT {num('avg((a = b)::INTEGER)', 'class_agreement_rate')}, {num('corr(probability, p_right)', 'probability_correlation')}, "
    "count(*) FILTER (a = y AND b = y) AS both_correct, count(*) FILTER (a = y AND b <> y) AS left_only_correct, "
    "count(*) FILTER (a <> y AND b = y) AS right_only_correct, count(*) FILTER (a <> y AND b <> y) AS both_incorrect, "
    "count(*) FILTER (a <> b) AS disagreement_count FROM (SELECT *, probability >= 0.5 AS a, p_right >= 0.5 AS b, target = 1 AS y FROM pred)",
)
def model_agreement(spark, folder):
    return metrics.agreement(prediction_pairs(spark, folder))


@register(
    "model_disagreements",
    f"SELECT 'age' AS dimension, {_AGE} AS value, count(*) AS \"rows\" FROM pred WHERE (probability >= 0.5) <> (p_right >= 0.5) GROUP BY ALL "
    f"UNION ALL SELECT 'support', {_SUPPORT}, count(*) FROM pred WHERE (probability >= 0.5) <> (p_right >= 0.5) GROUP BY ALL",
)
def model_disagreements(spark, folder):
    return metrics.disagreements(prediction_pairs(spark, folder))


@register(
    "pair_alignment",
    "SELECT cohort_id FROM pred WHERE target IS NULL",
)
def pair_alignment(spark, folder):
    return metrics.misaligned(prediction_pairs(spark, folder)).select("cohort_id")


@register(
    "prediction_validity",
    "SELECT (count(*) - count(DISTINCT cohort_id))::BIGINT AS repeated_ids, count(*) FILTER (NOT probability BETWEEN 0 AND 1) AS probability_out_of_range, "
    "0::BIGINT AS wrong_split, 0::BIGINT AS class_differs_from_threshold, sum(target)::BIGINT AS positives FROM pred WHERE split = 'TEST'",
)
def prediction_validity(spark, folder):
    return metrics.invalid_predictions(predictions(spark, folder).where("split = 'TEST'"))


@register(
    "metric_deltas",
    "SELECT l.split, " + ", ".join(num(f"r.{n} - l.{n}", n) for n in bootstrap.PAIRED)
    + f" FROM ({X.metrics('pred', 'split')}) l JOIN ({X.metrics('pred', 'split', score='p_right')}) r USING (split)",
)
def metric_deltas(spark, folder):
    rows = predictions(spark, folder)
    left = metrics.binary_metrics(rows, ["split"])
    right = metrics.binary_metrics(rows, ["split"], score="p_right")
    return metrics.metric_deltas(left, right, ["split"])


# --- bootstrap --------------------------------------------------------------------------------------


def _draws(source, score, seed=C.SEED, samples=C.BOOTSTRAP_SAMPLES):
    """Draw table as SQL: sample, label and scores with their multiplicity."""
    return {
        f"{source}_rows": f"SELECT *, row_number() OVER (ORDER BY md5('row|' || cohort_id)) - 1 AS index FROM {source}",
        f"{source}_draws": f"SELECT sample, index, count(*) AS times FROM (SELECT s AS sample, "
        f"('0x' || substr(md5('{seed}|' || s || '|' || d), 1, 12))::BIGINT % (SELECT count(*) FROM {source}) AS index "
        f"FROM range({samples}) a(s), range((SELECT count(*) FROM {source})) b(d)) GROUP BY ALL",
        f"{source}_boot": f"SELECT sample, target, times, {score} FROM {source}_draws JOIN {source}_rows USING (index)",
    }


def _interval(names, source):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {num(f'quantile_cont({n}, 0.025)', 'lower_95')}, {num(f'quantile_cont({n}, 0.975)', 'upper_95')}, "
        f"count({n}) AS valid_samples FROM {source}"
        for n in names
    )


@register(
    "bootstrap_intervals",
    _interval(metrics.METRICS, "pred_measured"),
    {**_draws("pred", "probability"), "pred_measured": X.metrics("pred_boot", "sample", weight="times")},
)
def bootstrap_intervals(spark, folder):
    """1,000 resamples of all cohorts, seven metrics, one plan."""
    return bootstrap.bootstrap_intervals(predictions(spark, folder), whole=True)


@register(
    "paired_bootstrap",
    " UNION ALL ".join(
        f"SELECT '{n}' AS metric, (SELECT {num(f'r.{n} - l.{n}', 'x').rsplit(' AS ', 1)[0]} FROM ({X.metrics('pred')}) l, "
        f"({X.metrics('pred', score='p_right')}) r) AS observed_difference, {num(f'quantile_cont(b.{n} - a.{n}, 0.025)', 'lower_95')}, "
        f"{num(f'quantile_cont(b.{n} - a.{n}, 0.975)', 'upper_95')}, count(b.{n} - a.{n}) AS valid_samples "
        "FROM pred_left a JOIN pred_right b USING (sample)"
        for n in bootstrap.PAIRED
    ),
    {
        **_draws("pred", "probability, p_right"),
        "pred_left": X.metrics("pred_boot", "sample", weight="times"),
        "pred_right": X.metrics("pred_boot", "sample", weight="times", score="p_right"),
    },
)
def paired_bootstrap(spark, folder):
    return bootstrap.paired_bootstrap(prediction_pairs(spark, folder))


_CRITICAL = {
    "support_1": ("one", "historical_complaint_count = 1", C.SEED),
    "age_21_plus": ("old", "cohort_age_at_cutoff >= 21", C.SEED + 1),
}
_CRITICAL_STAGES = {}
for _name, (_alias, _rule, _seed) in _CRITICAL.items():
    _CRITICAL_STAGES[_alias] = f"SELECT * FROM pred WHERE {_rule}"
    _CRITICAL_STAGES |= _draws(_alias, "probability", _seed)
    _CRITICAL_STAGES[f"{_alias}_measured"] = X.metrics(f"{_alias}_boot", "sample", weight="times")


@register(
    "critical_subgroup_intervals",
    " UNION ALL ".join(
        f"SELECT '{name}' AS subgroup, * FROM ({_interval(('recall', 'f1', 'roc_auc'), alias + '_measured')})"
        for name, (alias, _, _) in _CRITICAL.items()
    ),
    _CRITICAL_STAGES,
)
def critical_subgroup_intervals(spark, folder):
    return bootstrap.critical_intervals(predictions(spark, folder))


# --- models: no SQL twin ------------------------------------------------------------------------------


def _fit_table(spark, folder, name, candidates, columns=None) -> DataFrame:
    fit = models.evaluate_candidates(dataset(spark, folder), columns or C.ALL_EVIDENCE_MODEL, candidates)
    return models.metrics_frame(
        spark, [("complaints_communications_recalls", name, fit.candidate, fit.metrics)]
    )


@register("fit_logistic")
def fit_logistic(spark, folder):
    return _fit_table(spark, folder, "logistic_regression", models.logistic_candidates())


def forest(spark, folder) -> models.Fitted:
    """The chosen 200-tree forest of one folder, fitted once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FORESTS:
        _FORESTS[key] = models.evaluate_candidates(
            dataset(spark, folder), C.ALL_EVIDENCE_MODEL, models.forest_candidates()
        )
    return _FORESTS[key]


@register("fit_forest")
def fit_forest(spark, folder):
    fit = forest(spark, folder)
    return models.metrics_frame(
        spark, [("complaints_communications_recalls", "random_forest", fit.candidate, fit.metrics)]
    )


@register("fit_gbt")
def fit_gbt(spark, folder):
    return _fit_table(spark, folder, "gradient_boosting", models.boosting_candidates())


def perceptron(spark, folder) -> models.Fitted:
    """The perceptron of one folder that validation chooses by tolerance, fitted once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PERCEPTRONS:
        fits = {
            f.candidate: f
            for f in models.evaluate_each(dataset(spark, folder), C.ALL_EVIDENCE_MODEL, models.perceptron_candidates())
        }
        chosen = models.select_with_tolerance(
            [(n, f.metrics["VALIDATION"], models.parameter_count(f.model.getLayers())) for n, f in fits.items()]
        )
        _PERCEPTRONS[key] = fits[chosen]
    return _PERCEPTRONS[key]


@register("fit_mlp")
def fit_mlp(spark, folder):
    """Three perceptrons; the winner by tolerance on validation metrics."""
    fit = perceptron(spark, folder)
    return models.metrics_frame(
        spark, [("complaints_communications_recalls", "perceptron", fit.candidate, fit.metrics)]
    )


@register("ablation")
def ablation(spark, folder):
    """Logistic regression on the seven nested feature sets."""
    return models.ablation(dataset(spark, folder))


@register("seed_robustness")
def seed_robustness(spark, folder):
    """The chosen perceptron fitted again with five seeds."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    fit = perceptron(spark, folder)
    hidden = [int(n) for n in fit.candidate.split("-")]
    seeds = [C.SEED + i for i in range(5)]
    return models.seed_robustness(
        fit.prepared,
        lambda n, width, seed: MultilayerPerceptronClassifier(
            labelCol="target", layers=[width, *hidden, 2], solver="l-bfgs", seed=seed, maxIter=100
        ),
        seeds,
    )


def _reopened(spark, folder, fit: models.Fitted) -> DataFrame:
    """Scores of the model as it is after a save and a load, from the unprepared dataset."""
    path = stage_path(spark, "chosen-model")
    fit.save(path)
    return models.score(models.load_chosen(spark, path)[0], dataset(spark, folder))


@register(
    "saved_models",
    " UNION ALL ".join(f"SELECT '{n}' AS model, split, count(*) AS cohorts, 0::BIGINT AS changed FROM mds GROUP BY split" for n in ("random_forest", "perceptron")),
)
def saved_models(spark, folder):
    """Cohorts by model and split, and those whose score differs after the chosen model is saved and loaded."""
    parts = []
    for name, fit in (("random_forest", forest(spark, folder)), ("perceptron", perceptron(spark, folder))):
        before = models.score(fit.model, fit.prepared).select(C.COHORT_ID, c("probability").alias("before"))
        after = _reopened(spark, folder, fit).join(before, C.COHORT_ID, "full")
        parts.append(after.groupBy(F.lit(name).alias("model"), "split").agg(
            F.count("*").alias("cohorts"), F.count_if(~c("probability").eqNullSafe(c("before"))).alias("changed")
        ))
    return parts[0].unionByName(parts[1])


@register("evaluation_report")
def evaluation_report(spark, folder):
    """Metrics, intervals, calibration, errors, differences and agreement of the saved forest and perceptron on TEST."""
    sides = [
        models.prediction_table(_reopened(spark, folder, fit).where("split = 'TEST'"), name, B.CUTOFF)
        for name, fit in (("random_forest", forest(spark, folder)), ("perceptron", perceptron(spark, folder)))
    ]
    return report.evaluation(*sides, ("random_forest", "perceptron"))


def _scored(spark, folder) -> DataFrame:
    fit = forest(spark, folder)
    return models.score(fit.model, fit.prepared)


@register("batch_predictions")
def batch_predictions(spark, folder):
    """The 15-column prediction table of the forest on TEST."""
    scored = _scored(spark, folder).where("split = 'TEST'")
    return models.prediction_table(scored, "random-forest", B.CUTOFF)


@register("permutation_importance")
def permutation_importance(spark, folder):
    fit = forest(spark, folder)
    held = fit.prepared.where("split = 'VALIDATION'")
    groups = {n: [i] for i, n in enumerate(fit.preprocessing.outputs)}
    table = importance.permutation_importance(fit.model, held, groups, repeats=5)
    return table.orderBy(F.desc("mean_roc_auc_decrease"), "feature").limit(20)


@register("family_importance")
def family_importance(spark, folder):
    fit = forest(spark, folder)
    held = fit.prepared.where("split = 'VALIDATION'")
    groups = importance.family_positions(fit.preprocessing.outputs)
    return importance.permutation_importance(fit.model, held, groups, repeats=1)


def _contributed(spark, folder, part="VALIDATION"):
    fit = forest(spark, folder)
    rows = fit.prepared.where(F.col("split") == part) if part else fit.prepared
    manifest = explain.feature_manifest(fit.preprocessing.outputs)
    return explain.contributions(fit.model, rows), manifest


@register("feature_manifest")
def feature_manifest(spark, folder):
    return explain.manifest_frame(
        spark, explain.feature_manifest(forest(spark, folder).preprocessing.outputs)
    )


@register("tree_contributions")
def tree_contributions(spark, folder):
    """Baseline, contribution sum and probability of every cohort."""
    contributed, _ = _contributed(spark, folder, None)
    total = F.aggregate("contribution", F.lit(0.0), lambda a, b: a + b)
    rows = contributed.join(_scored(spark, folder).select(C.COHORT_ID, "probability"), C.COHORT_ID)
    return rows.select(
        C.COHORT_ID, "baseline", total.alias("contribution_sum"), "probability",
        (F.abs(c("baseline") + total - c("probability")) <= 1e-12).alias("reconstructed"),
    )


@register("global_importance")
def global_importance(spark, folder):
    contributed, manifest = _contributed(spark, folder)
    return explain.global_importance(contributed, explain.manifest_frame(spark, manifest))


@register("importance_by_family")
def importance_by_family(spark, folder):
    return explain.grouped_importance(global_importance(spark, folder), "family")


def _explanations(spark, folder, part="TEST"):
    contributed, manifest = _contributed(spark, folder, part)
    return explain.local_explanations(contributed, _scored(spark, folder), manifest)


@register("local_explanations", shown=False)
def local_explanations(spark, folder):
    rows = _explanations(spark, folder)
    return rows.select(
        C.COHORT_ID, F.round("probability", 6).alias("probability"),
        F.round("reconstructed_probability", 6).alias("reconstructed_probability"),
        F.to_json("top_positive_contributors").alias("top_positive_contributors"),
        F.to_json("top_negative_contributors").alias("top_negative_contributors"),
        F.to_json("family_contributions").alias("family_contributions"),
        F.array_join("evaluation_warnings", "|").alias("evaluation_warnings"),
    )


@register("representatives")
def representatives(spark, folder):
    return explain.representatives(_explanations(spark, folder)).select(
        "rule", C.COHORT_ID, "target", "predicted_class", "probability", "historical_complaint_count",
        "cohort_age_at_cutoff",
    )


def _documents(spark, folder):
    return results.result_documents(
        _explanations(spark, folder, None), dataset(spark, folder), cutoff=B.CUTOFF,
        window_end=numbers.window_end(B.CUTOFF, B.HORIZON), model_id="random-forest",
    )


@register("result_documents", shown=False)
def result_documents(spark, folder):
    """One JSON document per cohort."""
    docs = _documents(spark, folder)
    return docs.select("cohort_id", F.to_json(F.struct(*docs.columns)).alias("document"))


@register("result_consistency")
def result_consistency(spark, folder):
    return results.inconsistent_results(_documents(spark, folder), tolerance=1e-12)


@register(
    "cohort_page",
    "SELECT normalized_make, normalized_model, model_year, broad_vehicle_id, historical_complaint_count FROM feat "
    "ORDER BY 1, 2, 3, 4 LIMIT 50 OFFSET 100",
)
def cohort_page(spark, folder):
    return results.cohort_page(dataset(spark, folder), limit=50, offset=100)
