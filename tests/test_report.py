"""The two-model report against the single operators, and models that are saved and loaded."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.modeling import bootstrap, metrics, models, preprocess, report

NAMES = ("one", "two")


def predictions(spark, n=90):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.4).astype(int)
    rows = [
        (f"c{i}", int(y[i]), float(np.round(np.clip(0.5 * y[i] + rng.random() * 0.5, 0, 1), 1)), float(rng.random()), int(rng.integers(0, 30)),
         int(rng.choice([1, 1, 3, 7, 80])), bool(rng.random() < 0.5), bool(rng.random() < 0.3), 2000 + int(rng.integers(0, 20)))
        for i in range(n)
    ]
    both = spark.createDataFrame(rows, "cohort_id string, target int, probability double, other double, cohort_age_at_cutoff int, historical_complaint_count long, communication_observed_by_cutoff boolean, recall_observed_by_cutoff boolean, model_year int")
    left = both.drop("other").withColumn("predicted_class", (F.col("probability") >= 0.5).cast("int"))
    return left, both.withColumn("probability", F.col("other")).drop("other").withColumn("predicted_class", (F.col("probability") >= 0.5).cast("int"))


def test_report_equals_its_parts(spark):
    left, right = (t.cache() for t in predictions(spark))
    table = {tuple(r)[:4]: r["value"] for r in report.evaluation(left, right, NAMES, samples=30).collect()}
    checked = 0

    def same(section, model, item, metric, value):
        nonlocal checked
        checked += 1
        found = table[section, model, item, metric]
        assert found == (None if value is None else pytest.approx(value, abs=1e-12)), (section, model, item, metric)

    for name, rows in zip(NAMES, (left, right), strict=True):
        for r in [{**metrics.binary_metrics(rows).first().asDict(), "family": None}, *[r.asDict() for r in metrics.subgroup_metrics(rows).collect()]]:
            item = "all" if r["family"] is None else f"{r['family']}:{r['group']}"
            for metric in (*metrics.METRICS, "row_count", "tp", "fn", "positive_prevalence"):
                same("metrics", name, item, metric, r[metric])
        bins = metrics.calibration(rows)
        for r in bins.where("row_count > 0").collect():
            for metric in ("row_count", "mean_predicted_probability", "observed_positive_fraction", "calibration_gap"):
                same("calibration", name, str(r["bin"]), metric, r[metric])
        same("calibration", name, "all", "expected_calibration_error", metrics.expected_calibration_error(bins).first()[0])
        for r in metrics.threshold_sensitivity(rows).collect():
            same("threshold", name, str(r["threshold"]), "f1", r["f1"])
        for r in metrics.error_analysis(rows).collect():
            same("errors", name, f"{r['category']}:{r['dimension']}:{r['value']}", "rows", r["rows"])
        for r in bootstrap.bootstrap_intervals(rows, samples=30).collect():
            same("interval", name, r["metric"], "lower_95", r["lower_95"])
    pairs, both = metrics.paired(left, right), "two - one"
    for r in bootstrap.paired_bootstrap(pairs, samples=30).collect():
        for metric in ("observed_difference", "upper_95"):
            same("difference", both, r["metric"], metric, r[metric])
    agreed = metrics.agreement(pairs).first().asDict()
    for metric, value in agreed.items():
        same("agreement", both, "all", metric, value)
    assert checked > 200 and {k[0] for k in table} == {"metrics", "calibration", "threshold", "interval", "errors", "difference", "agreement", "disagreements"}
    with pytest.raises(Exception, match="rows or labels"):
        report.evaluation(left, right.where("cohort_id != 'c1'"), NAMES, samples=2).collect()


def test_a_constant_score_has_no_correlation(spark):
    left, right = predictions(spark)
    constant = left.withColumn("probability", F.lit(1.0)).withColumn("predicted_class", F.lit(1))
    table = {tuple(r)[:4]: r["value"] for r in report.evaluation(constant, right, NAMES, samples=5).collect()}
    assert table["agreement", "two - one", "all", "probability_correlation"] is None
    assert table["interval", "one", "brier_score", "valid_samples"] == 5
    counts = [table["agreement", "two - one", "all", n] for n in ("both_correct", "left_only_correct", "right_only_correct", "both_incorrect")]
    assert sum(counts) == 90
    nothing = metrics.agreement(metrics.paired(left, right).where("false")).first()
    assert nothing["class_agreement_rate"] is None and nothing["probability_correlation"] is None and nothing["both_correct"] == 0


def test_report_is_run_in_parts(spark, monkeypatch):
    """No resample is drawn twice for two models, and the plan that is left reads staged parts alone."""
    drawn = []
    monkeypatch.setattr(bootstrap, "draws", lambda *a, real=bootstrap.draws: drawn.append(a[1:]) or real(*a))
    out = report.evaluation(*predictions(spark), NAMES, samples=4)
    assert len(drawn) == len(set(drawn)) == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InArrow" not in plan


def dataset(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [
        (f"v{i}", "m", "x", 2010, 3, 2, True, False, ("TRAIN", "TRAIN", "VALIDATION", "TEST")[i % 4], int(rng.random() < 0.5), float(rng.integers(0, 50)), None if i % 5 == 0 else float(rng.random()))
        for i in range(n)
    ]
    kinds = "string, normalized_make string, normalized_model string, model_year int, cohort_age_at_cutoff int, historical_complaint_count long, communication_observed_by_cutoff boolean, recall_observed_by_cutoff boolean, split string, target int, complaints_last_12m double, crash_share double"
    return spark.createDataFrame(rows, f"{C.COHORT_ID} {kinds}")


@pytest.mark.parametrize("candidate", [models.forest_candidates(5, ((3, 2),))[0], models.perceptron_candidates(((4,),), iterations=20)[0], models.logistic_candidates((1.0,))[0]], ids=lambda c: c.name)
def test_chosen_models_are_the_same_after_a_load(spark, tmp_path, candidate):
    data = dataset(spark)
    fit = models.evaluate_candidates(data, ["complaints_last_12m", "crash_share"], [candidate])
    fit.save(str(tmp_path / "m"))
    loaded, told = models.load_chosen(spark, str(tmp_path / "m"))
    before = {r[0]: r[1] for r in models.score(fit.model, fit.prepared, [C.COHORT_ID]).collect()}
    assert {r[0]: r[1] for r in models.score(loaded, data, [C.COHORT_ID]).collect()} == before
    assert (told["candidate"], told["training_partitions"]) == (candidate.name, models.LEAST_PARTITIONS)
    assert isinstance(loaded.stages[0], preprocess.Preprocess) and loaded.stages[0].fitted == fit.preprocessing
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        fit.save(str(tmp_path / "m"))


def test_training_partitions_follow_from_rows(spark):
    data = dataset(spark)
    rows, n, partitions = models.training_rows(data, 5)
    assert (n, partitions, rows.rdd.getNumPartitions()) == (60, 12, 12)
    assert models.training_rows(data)[2] == models.LEAST_PARTITIONS
    columns, candidates = ["complaints_last_12m", "crash_share"], models.forest_candidates(3, ((3, 2),))
    fits = [models.evaluate_candidates(d, columns, candidates, rows_per_partition=5) for d in (data, data.repartition(7))]
    assert fits[0].partitions == 12 and fits[0].metrics == fits[1].metrics


def test_prediction_table_has_a_window(spark):
    fit = models.evaluate_candidates(dataset(spark), ["complaints_last_12m"], models.logistic_candidates((1.0,)))
    table = models.prediction_table(models.score(fit.model, fit.prepared), "m", dt.date(2022, 12, 31))
    assert len(table.columns) == 15
