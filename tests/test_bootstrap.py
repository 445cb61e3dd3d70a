"""Block resampling, held against every draw written out."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.modeling import bootstrap, metrics


def counts_by_hand(ids, samples, seed):
    """Draw counts of the rows in the order of ``ids``."""
    n = len(ids)
    order = sorted(range(n), key=lambda i: hashlib.md5(f"row|{ids[i]}".encode()).hexdigest())
    out = np.zeros((samples, n), int)
    for s in range(samples):
        for d in range(n):
            out[s, order[int(hashlib.md5(f"{seed}|{s}|{d}".encode()).hexdigest()[:12], 16) % n]] += 1
    return out


def metrics_by_hand(y, p, times):
    y, p = np.repeat(y, times), np.repeat(p, times)
    pos, neg = int(y.sum()), int((1 - y).sum())
    hit = p >= 0.5
    tp, fp = int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum())
    wins = sum((a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0])
    ap = sum((y[p >= a] == 1).mean() for a in p[y == 1]) / pos if pos else 0.0
    return {
        "accuracy": (tp + neg - fp) / len(y), "precision": tp / (tp + fp) if tp + fp else 0.0, "recall": tp / pos if pos else 0.0,
        "f1": 2 * tp / (tp + fp + pos) if tp + fp + pos else 0.0, "roc_auc": wins / (pos * neg) if pos and neg else None,
        "pr_auc": ap, "brier_score": float(((y - p) ** 2).mean()),
    }


@pytest.mark.parametrize(("block", "slices", "batch"), [(7, 3, 4), (16_384, 256, 10_000)])
def test_resamples_equal_those_drawn_one_by_one(spark, monkeypatch, block, slices, batch):
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "SLICES", slices)
    monkeypatch.setattr(bootstrap, "PACKED", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = np.random.default_rng(2)
    n, samples = 40, 6
    # Few distinct scores, so that ties cross blocks and batches; a third of the rows share one.
    p = np.where(rng.random(n) < 0.33, 0.5, rng.choice([0.0, 0.2, 0.5, 0.7, 1.0], n))
    q, y = rng.random(n), (rng.random(n) < 0.4).astype(int)
    ids = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, a, b, c in zip(ids, y, p, q, strict=True)], "cohort_id string, target int, p double, q double")
    try:
        found = {(r["sample"], r["model"]): r.asDict() for r in bootstrap._resampled(df, ["p", "q"], samples, 11).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(found) == {(s, m) for s in range(samples) for m in "pq"}
    times = counts_by_hand(ids, samples, 11)
    for s in range(samples):
        for name, score in (("p", p), ("q", q)):
            row = found[s, name]
            assert row["row_count"] == n
            for metric, value in metrics_by_hand(y, score, times[s]).items():
                assert row[metric] == (pytest.approx(value) if value is not None else None), (s, name, metric)


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(f"c{i}", 1, i / 10) for i in range(5)], "cohort_id string, target int, probability double")
    found = {r["metric"]: r for r in bootstrap.bootstrap_intervals(df, samples=20).collect()}
    assert set(found) == set(metrics.METRICS) - {"roc_auc"} and found["pr_auc"]["lower_95"] == 1.0
    with pytest.raises(ValueError, match="needs rows"):
        bootstrap.bootstrap_intervals(df.where("false"))
    constant = df.withColumn("probability", F.lit(0.25)).withColumn("target", F.when(F.col("cohort_id") == "c1", 1).otherwise(0))
    assert {r["lower_95"] for r in bootstrap.bootstrap_intervals(constant, samples=5, names=("roc_auc",)).collect()} <= {0.5}


def one_class(spark, n=30):
    return spark.createDataFrame(
        [(f"c{i}", 1, 0.6 + i / 100, 0.55 + i / 90, 5, 12) for i in range(n)],
        "cohort_id string, target int, probability double, other double, cohort_age_at_cutoff int, historical_complaint_count long",
    )


def test_every_metric_has_its_row(spark):
    df = one_class(spark)
    found = {r["metric"]: tuple(r)[1:] for r in bootstrap.bootstrap_intervals(df, samples=20, whole=True).collect()}
    assert set(found) == set(metrics.METRICS) and found["roc_auc"] == (None, None, 0) and found["pr_auc"] == (1.0, 1.0, 20)
    pairs = metrics.paired(df.drop("other"), df.drop("probability").withColumnRenamed("other", "probability"))
    both = {r["metric"]: tuple(r)[1:] for r in bootstrap.paired_bootstrap(pairs, samples=20).collect()}
    assert set(both) == set(bootstrap.PAIRED) and both["roc_auc"] == (None, None, None, 0) and both["f1"][3] == 20


def test_empty_subgroups_have_null_bounds(spark):
    found = {tuple(r) for r in bootstrap.critical_intervals(one_class(spark), samples=20).collect()}
    assert found == {(g, m, None, None, 0) for g in ("support_1", "age_21_plus") for m in ("recall", "f1", "roc_auc")}
