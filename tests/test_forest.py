"""Walks of a forest in shards, and importance against one model run for each moved column."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from cohortlens import constants as C
from cohortlens.modeling import explain, forest, importance, models
from tests.test_modeling import forest_data

GROUPS = {"a": [0], "b": [1], "d": [3], "pair": [1, 2]}


@pytest.fixture(scope="module")
def fitted(spark):
    df = forest_data(spark, 200).cache()
    return df, RandomForestClassifier(labelCol="target", numTrees=9, maxDepth=4, featureSubsetStrategy="2", seed=1).fit(df)


def auc(y, p):
    y, p = np.array(y), np.round(p, 12)
    return np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])


def by_hand(spark, df, model, repeats, seed):
    """Mean and spread of the decrease, every column moved and scored by itself."""
    rows = [(r[C.COHORT_ID], r["target"], r["features"].toArray()) for r in df.collect()]
    order = lambda prefix: sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{prefix}|{rows[i][0]}".encode()).hexdigest())

    def scored(x):
        frame = spark.createDataFrame([(i, Vectors.dense(v.tolist())) for i, v in enumerate(x)], ["i", "features"])
        return [float(r["probability"][1]) for r in model.transform(frame).orderBy("i").collect()]

    y, x = [t for _, t, _ in rows], np.array([v for *_, v in rows])
    intact, place = auc(y, scored(x)), order("row")
    out = {}
    for name, columns in GROUPS.items():
        found = []
        for r in range(repeats):
            moved = x.copy()
            for to, donor in zip(place, order(f"{seed}|{r}"), strict=True):
                moved[to, columns] = x[donor, columns]
            found.append(auc(y, scored(moved)))
        out[name] = (intact - np.mean(found), np.std(found))
    return out


@pytest.mark.parametrize("most", [20, forest.SHARD_NODES])
def test_importance_equals_moving_columns_one_by_one(spark, fitted, most):
    df, model = fitted
    expected = by_hand(spark, df, model, 2, 5)
    found = importance.permutation_importance(model, df, GROUPS, repeats=2, seed=5, most=most).collect()
    assert {r["feature"] for r in found} == set(GROUPS)
    for r in found:
        assert (r["repeats"], r["mean_roc_auc_decrease"], r["standard_deviation"]) == (2, pytest.approx(expected[r["feature"]][0], abs=1e-9), pytest.approx(expected[r["feature"]][1], abs=1e-9))


def test_shards_hold_whole_trees_and_bounded_nodes(spark, fitted):
    _, model = fitted
    table = forest.node_table(model, spark)
    sizes = {r["tree"]: r["count"] for r in table.groupBy("tree").count().collect()}
    parts = list(forest.shards(table, 20))
    assert sum(len(p["root"]) for p in parts) == 9 and sum(len(p["left"]) for p in parts) == sum(sizes.values())
    assert all(len(p["left"]) <= 20 or len(p["root"]) == 1 for p in parts) and len(parts) > 1
    used = [f for p in parts for f in forest.used_features(p)]
    assert len(used) == 9 and set().union(*used) <= set(range(4))
    splits = table.where("left >= 0").groupBy("tree").agg({"feature": "collect_set"}).orderBy("tree").collect()
    assert [set(r[1]) for r in splits] == used


def test_contributions_do_not_depend_on_shards(spark, fitted):
    df, model = fitted
    small = {r[C.COHORT_ID]: r for r in explain.contributions(model, df, most=20).collect()}
    whole = {r[C.COHORT_ID]: r for r in explain.contributions(model, df).collect()}
    probability = {r[C.COHORT_ID]: r["probability"] for r in models.score(model, df, [C.COHORT_ID]).collect()}
    assert small.keys() == whole.keys() == probability.keys()
    for i, r in small.items():
        assert r["contribution"] == pytest.approx(whole[i]["contribution"], abs=1e-12)
        assert r["baseline"] + sum(r["contribution"]) == pytest.approx(probability[i], abs=1e-12)


def test_small_tables_are_walked_by_several_tasks(spark, fitted):
    df, model = fitted
    rows = df.coalesce(1).select(C.COHORT_ID, models.vector_to_array("features").alias("x"))

    def walk(shared):
        from pyspark import TaskContext

        return lambda batch: np.full((len(batch), 1), float(TaskContext.get().partitionId()))

    tasks = forest.added_by_row(rows, forest.node_table(model, spark), walk, 1).select("sums").distinct().count()
    assert tasks > 1
