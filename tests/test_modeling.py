import datetime as dt
import json

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.modeling import bootstrap, explain, importance, metrics, models, preprocess, results, split
from tests.helpers import rows


def predictions(spark, shift=0.0):
    p = [0.1, 0.2, 0.4, 0.7, 0.8, 0.9, 0.3, 0.6, 0.15, 0.85]
    y = [0, 0, 1, 1, 0, 1, 0, 1, 1, 0]
    support = [1, 3, 7, 20, 60] * 2
    table = [
        (f"c{i}", y[i], p[i] + shift, int(p[i] + shift >= 0.5), "TEST", 2000 + i, 24 - 2 * i, support[i], i % 2 == 0, i % 3 == 0)
        for i in range(10)
    ]
    return spark.createDataFrame(
        table, "cohort_id string, target int, probability double, predicted_class int, split string, model_year int, "
        "cohort_age_at_cutoff int, historical_complaint_count long, communication_observed_by_cutoff boolean, recall_observed_by_cutoff boolean",
    )


def test_metric_contract(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.8), (1, 0.7), (1, 0.9)], "target int, probability double")
    got = metrics.binary_metrics(df).first()
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (1, 1, 0, 2)
    assert got["roc_auc"] == pytest.approx(0.75)
    assert got["pr_auc"] == pytest.approx(5 / 6)
    assert got["brier_score"] == pytest.approx(0.1875)


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_metrics_equal_brute_force_with_ties_and_a_hot_group(spark):
    rng = np.random.default_rng(1)
    n = 4000
    g = np.where(rng.random(n) < 0.7, "hot", "cold")
    s = np.round(rng.random(n), 2)
    y = (rng.random(n) < s).astype(int)
    df = spark.createDataFrame([(a, int(b), float(v)) for a, b, v in zip(g, y, s, strict=True)], "g string, target int, probability double")
    got = {r["g"]: r for r in metrics.binary_metrics(df, ["g"]).collect()}
    for name in ("hot", "cold"):
        m = g == name
        assert got[name]["roc_auc"] == pytest.approx(brute_auc(y[m], s[m]))
        ap, last = 0.0, 0.0
        for t in sorted(set(s[m]), reverse=True):
            hit = s[m] >= t
            recall = y[m][hit].sum() / y[m].sum()
            ap += (recall - last) * y[m][hit].mean()
            last = recall
        assert got[name]["pr_auc"] == pytest.approx(ap)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "target int, probability double")
    got = metrics.binary_metrics(df).first()
    assert got["roc_auc"] is None and got["recall"] == 0.5
    none = metrics.binary_metrics(df.withColumn("target", F.lit(0))).first()
    assert none["pr_auc"] == 0.0 and none["precision"] == 0.0


def test_report_tables_conserve_rows(spark):
    df = predictions(spark)
    bins = metrics.calibration(df)
    assert bins.count() == 10 and bins.agg(F.sum("row_count")).first()[0] == 10
    assert metrics.expected_calibration_error(bins).first()[0] > 0
    groups = metrics.subgroup_metrics(df)
    assert {r[0]: r[1] for r in rows(groups.groupBy("family").agg(F.sum("row_count").alias("n")), "family", "n")} == {
        "age": 10, "historical_support": 10, "source_coverage": 10,
    }
    fifty = groups.where("family = 'historical_support' AND group = '50+'").first()
    assert fifty["roc_auc"] is None
    errors = metrics.error_analysis(df)
    assert errors.where("dimension = 'age' AND category NOT LIKE '%gte%' AND category NOT LIKE '%lte%'").agg(F.sum("rows")).first()[0] == 10
    assert metrics.threshold_sensitivity(df).count() == 5
    assert tuple(metrics.invalid_predictions(df).first()) == (0, 0, 0, 0, 5)
    bad = df.withColumn("probability", F.lit(1.2)).withColumn("split", F.lit("TRAIN"))
    row = metrics.invalid_predictions(bad).first()
    assert row["probability_out_of_range"] == 10 and row["wrong_split"] == 10


def test_pairs(spark):
    pairs = metrics.paired(predictions(spark), predictions(spark, 0.03))
    assert metrics.misaligned(pairs).isEmpty()
    got = metrics.agreement(pairs).first()
    assert got["class_agreement_rate"] == 1.0 and got["probability_correlation"] == pytest.approx(1)
    assert metrics.disagreements(pairs).isEmpty()
    other = predictions(spark).withColumn("target", 1 - F.col("target"))
    assert metrics.misaligned(metrics.paired(predictions(spark), other)).count() == 10


def test_bootstrap_is_repeatable_and_equals_a_loop(spark):
    df = predictions(spark)
    a = sorted(map(tuple, bootstrap.bootstrap_intervals(df, samples=40).collect()))
    b = sorted(map(tuple, bootstrap.bootstrap_intervals(df.repartition(5), samples=40).collect()))
    assert a == b
    index = {r["cohort_id"]: r["index"] for r in bootstrap.numbered(df).collect()}
    assert sorted(index.values()) == list(range(10))
    by_index = {index[r["cohort_id"]]: (r["target"], r["probability"]) for r in df.collect()}
    draws = bootstrap.draw_counts(df, 10, 40, C.SEED).collect()
    assert sum(r["times"] for r in draws) == 400
    accuracy = []
    for s in range(40):
        picked = [by_index[r["index"]] for r in draws if r["sample"] == s for _ in range(r["times"])]
        accuracy.append(np.mean([(p >= 0.5) == bool(y) for y, p in picked]))
    got = {r[0]: r for r in a}["accuracy"]
    assert got[1] == pytest.approx(np.quantile(accuracy, 0.025)) and got[2] == pytest.approx(np.quantile(accuracy, 0.975))
    same = bootstrap.paired_bootstrap(metrics.paired(df, df), samples=10).collect()
    assert all(r["observed_difference"] == 0 and r["upper_95"] == 0 for r in same)


def test_split_sizes_and_repeatability(spark):
    df = spark.createDataFrame([(f"v{i}", i % 2 == 0) for i in range(100)], "broad_vehicle_id string, y boolean")
    got = split.stratified_split(df, label="y")
    counts = dict(rows(got.groupBy("split").agg(F.count("*").alias("n")), "split", "n"))
    assert counts == {"TRAIN": 70, "VALIDATION": 15, "TEST": 15}
    again = split.stratified_split(df.repartition(7), label="y")
    assert got.exceptAll(again).isEmpty() and got.select("broad_vehicle_id").distinct().count() == 100
    big = spark.range(8416).select(F.concat(F.lit("v"), "id").alias("broad_vehicle_id"), (F.col("id") < 4398).alias("y"))
    sizes = dict(rows(split.stratified_split(big, label="y").groupBy("split").agg(F.count("*").alias("n")), "split", "n"))
    assert sizes == {"TRAIN": 5891, "VALIDATION": 1262, "TEST": 1263}


NAMES = ["historical_complaint_count", "complaints_last_12m", "historical_mileage_median", "days_since_last_recall",
         "historical_mileage_observed_share", "recall_observed_by_cutoff", "historical_unique_odino_count",
         "historical_years_observed", "days_since_last_communication"]


def cohorts(spark, *, holdout=None):
    table = []
    for i in range(20):
        part = "TRAIN" if i < 12 else "VALIDATION" if i < 16 else "TEST"
        big = holdout if holdout is not None and i >= 12 else None
        n = big or i + 1
        table.append((
            f"c{i}", part, n, big or 2 * (i + 1), None if i in (0, 12, 16) else float(big or 3 * i), None if i in (1, 13, 17) else 5 + i * i,
            ((i + 1) * 5 % 101) / 100, i % 2 == 0, n, 4.0, None,
        ))
    return spark.createDataFrame(
        table, "broad_vehicle_id string, split string, historical_complaint_count long, complaints_last_12m long, "
        "historical_mileage_median double, days_since_last_recall int, historical_mileage_observed_share double, "
        "recall_observed_by_cutoff boolean, historical_unique_odino_count long, historical_years_observed double, days_since_last_communication int",
    )


def test_preprocessor(spark):
    df = cohorts(spark)
    fit = preprocess.CohortPreprocessor.fit(df.where("split = 'TRAIN'"), NAMES)
    assert fit.missing == ["historical_mileage_median", "days_since_last_recall"]
    assert [(r["feature"], r["reason"]) for r in fit.removed] == [
        ("historical_unique_odino_count", "exact_duplicate_in_training"),
        ("historical_years_observed", "constant_in_training"),
        ("days_since_last_communication", "all_missing_in_training"),
    ]
    x = np.log1p(np.arange(1, 13))
    out = {r["broad_vehicle_id"]: r for r in fit.transform(df, keep=["broad_vehicle_id"]).collect()}
    assert out["c0"]["historical_complaint_count"] == pytest.approx((x[0] - x.mean()) / x.std())
    assert out["c3"]["historical_mileage_observed_share"] == pytest.approx(0.2)
    assert out["c0"]["historical_mileage_median__missing"] == 1.0 and out["c2"]["historical_mileage_median__missing"] == 0.0
    extreme = cohorts(spark, holdout=10**9)
    assert preprocess.CohortPreprocessor.fit(extreme.where("split = 'TRAIN'"), NAMES) == fit
    assert preprocess.CohortPreprocessor.from_json(fit.to_json()) == fit
    assert [m["index"] for m in fit.manifest()] == list(range(len(fit.transformed)))


def test_preprocessor_keeps_a_flat_feature_with_missing_values(spark):
    rows = [(f"c{i}", None if i < 2 else 19.0, float(i)) for i in range(6)]
    train = spark.createDataFrame(rows, "broad_vehicle_id string, days double, other double")
    fitted = preprocess.CohortPreprocessor.fit(train, ["days", "other"])
    assert fitted.selected == ["days", "other"] and fitted.missing == ["days"] and fitted.removed == []
    assert (fitted.means["days"], fitted.deviations["days"]) == (19.0, 0.0)
    held = spark.createDataFrame([("d0", 19.0, 1.0), ("d1", 20.0, 1.0), ("d2", 3.0, 1.0), ("d3", None, 1.0)], train.schema)
    found = {r["broad_vehicle_id"]: (str(r["days"]), r["days__missing"]) for r in fitted.transform(held, ["broad_vehicle_id"]).collect()}
    assert found == {"d0": ("nan", 0.0), "d1": ("inf", 0.0), "d2": ("-inf", 0.0), "d3": ("nan", 1.0)}


def test_preprocessor_round_trip(spark, tmp_path):
    fit = preprocess.CohortPreprocessor.fit(cohorts(spark).where("split = 'TRAIN'"), NAMES[:3])
    fit.save(spark, str(tmp_path / "p"))
    assert preprocess.CohortPreprocessor.load(spark, str(tmp_path / "p")) == fit
    assert json.loads(fit.to_json())["selected"] == NAMES[:3]


def test_one_hot_groups_rare_and_ignores_unknown(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("rare",), ("odd",)], "m string")
    both = train.unionByName(spark.createDataFrame([("new",)], "m string"))
    got = {r["m"]: r["m_hot"].toArray().tolist() for r in preprocess.one_hot(train, both, ["m"]).collect()}
    assert got["rare"] == got["odd"] and sum(got["a"]) == 1 and got["a"] != got["b"]
    assert sum(got["new"]) == 0 and len(got["new"]) == 3


def test_rule_selection(spark):
    df = spark.createDataFrame([(v, int(v >= 4)) for v in range(1, 9)], "v long, target int")
    best = metrics.select_rule(metrics.rule_candidates(df, "v", 2, 8)).first()
    assert (best["t"], best["f1"], best["roc_auc"]) == (4, 1.0, 1.0)
    tie = spark.createDataFrame([(1, 0), (9, 1)], "v long, target int")
    assert metrics.select_rule(metrics.rule_candidates(tie, "v", 2, 8)).first()["t"] == 2


def test_selection_with_tolerance():
    m = {"roc_auc": 0.9, "pr_auc": 0.8, "f1": 0.7, "brier_score": 0.1}
    near = {**m, "roc_auc": 0.90005, "brier_score": 0.2}
    assert models.select_with_tolerance([("a", m, 10), ("b", near, 5)]) == "a"
    assert models.select_with_tolerance([("a", m, 10), ("b", dict(m), 5)]) == "b"
    assert models.parameter_count([105, 64, 32, 2]) == 106 * 64 + 65 * 32 + 33 * 2


def test_selection_where_validation_has_one_class():
    m = {"roc_auc": None, "pr_auc": 1.0, "f1": 0.9, "brier_score": 0.1}
    assert models.select_with_tolerance([("a", m, 9), ("b", m | {"f1": 0.95}, 12)]) == "b"
    assert models.select_with_tolerance([("a", m, 9), ("b", m, 5)]) == "b"


def forest_data(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.random((n, 4))
    y = (x[:, 0] + 0.3 * rng.random(n) > 0.6).astype(int)
    table = [(f"c{i}", int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(table, "broad_vehicle_id string, target int, a double, b double, c double, d double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)


def test_tree_contributions_rebuild_the_probability(spark):
    df = forest_data(spark)
    model = RandomForestClassifier(labelCol="target", numTrees=7, maxDepth=5, seed=1).fit(df)
    got = explain.contributions(model, df)
    probability = models.score(model, df, [C.COHORT_ID])
    joined = got.join(probability, C.COHORT_ID).collect()
    assert len(joined) == 300
    for r in joined:
        assert r["baseline"] + sum(r["contribution"]) == pytest.approx(r["probability"], abs=1e-12)
    manifest = [
        {"index": i, "feature": n, "raw_feature": n, "family": f, "source": "s", "label": n.upper(), "feature_type": "count", "missing_indicator": False}
        for i, (n, f) in enumerate(zip("abcd", ["F", "F", "G", "G"], strict=True))
    ]
    table = explain.global_importance(got, explain.manifest_frame(spark, manifest))
    assert table.orderBy(F.desc("mean_absolute_contribution")).first()["feature"] == "a"
    scored = models.score(model, df, [C.COHORT_ID, "target"]).withColumns(
        {"historical_complaint_count": F.lit(1), "cohort_age_at_cutoff": F.lit(30)}
    )
    local = explain.local_explanations(got, scored, manifest, k=2)
    one = local.orderBy(F.desc("probability")).first()
    assert one["reconstruction_absolute_error"] < 1e-12
    assert one["top_positive_contributors"][0]["feature"] == "a" and len(one["top_positive_contributors"]) <= 2
    sums = {r["family"]: r["contribution"] for r in one["family_contributions"]}
    assert sum(sums.values()) + one["baseline_probability"] == pytest.approx(one["probability"])
    assert one["evaluation_warnings"] == ["weak_evaluation_support_1", "weak_evaluation_age_21_plus"]
    picked = {r["rule"]: r for r in explain.representatives(local).collect()}
    top = local.where("target = 1").agg(F.max("probability")).first()[0]
    assert picked["high_probability_observed_positive"]["probability"] == top


def test_permutation_importance(spark):
    df = forest_data(spark)
    model = RandomForestClassifier(labelCol="target", numTrees=7, maxDepth=4, seed=1).fit(df)
    got = {r["feature"]: r for r in importance.permutation_importance(model, df, {"a": [0], "b": [1], "all": [0, 1, 2, 3]}, repeats=2).collect()}
    assert got["a"]["mean_roc_auc_decrease"] > 0.2 > abs(got["b"]["mean_roc_auc_decrease"])
    assert got["all"]["mean_roc_auc_decrease"] == pytest.approx(0.45, abs=0.15)
    assert got["a"]["repeats"] == 2


def test_page_bounds(spark):
    df = spark.createDataFrame([("a", "m", 2000 + i, f"v{i}", i) for i in range(5)],
                               "normalized_make string, normalized_model string, model_year int, broad_vehicle_id string, historical_complaint_count long")
    assert [r["model_year"] for r in results.cohort_page(df, limit=2, offset=3).collect()] == [2003, 2004]
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            results.cohort_page(df, limit=limit, offset=offset)


def test_candidates_use_training_rows_only_and_results_hold_together(spark, folder):
    from cohortlens.plans import bindings as B
    from cohortlens.plans import catalogue_model as K

    data = K.dataset(spark, folder)
    assert models.alignment_mismatches(data, data, data.select(C.COHORT_ID, "split")).isEmpty()
    fit = models.evaluate_candidates(data, C.EXPERIMENTS["complaint_volume_recency"], models.forest_candidates(5, ((4, 2),)))
    assert set(fit.metrics) == {"TRAIN", "VALIDATION", "TEST"}
    scored = models.score(fit.model, fit.prepared)
    table = models.prediction_table(scored.where("split = 'TEST'"), "m", B.CUTOFF)
    assert len(table.columns) == 15
    checks = metrics.invalid_predictions(table).first()
    assert checks["class_differs_from_threshold"] == checks["wrong_split"] == 0
    manifest = explain.feature_manifest(fit.preprocessing.outputs)
    local = explain.local_explanations(explain.contributions(fit.model, fit.prepared), scored, manifest)
    docs = results.result_documents(local, data, cutoff=B.CUTOFF, window_end=dt.date(1999, 12, 31), model_id="m")
    assert tuple(results.inconsistent_results(docs, 1e-9).first()) == (0, 0, 0, 0)
    doc = docs.first()
    assert doc["prediction"]["percentage"] == doc["prediction"]["probability"] * 100
