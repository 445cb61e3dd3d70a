"""Binary classification metrics from score histograms.

Rows are first combined per distinct score. Confusion counts, Brier score, ROC-AUC and
average precision all follow from that histogram, so no step ever sorts all rows of a
group in one task, and any number of groups is measured in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers, ordered
from cohortlens.operators import guards, statistics

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score")
ID, LABEL, SCORE = "cohort_id", "target", "probability"


def score_histogram(
    df: DataFrame, groups: Sequence[str] = (), weight: Column | None = None,
    label: str = LABEL, score: str = SCORE,
) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    w = F.lit(1) if weight is None else weight
    positive = F.col(label).cast("int") == 1
    return df.groupBy(*groups, F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(positive, w).otherwise(0)).alias("pos"),
        F.sum(F.when(~positive, w).otherwise(0)).alias("neg"),
    )


def _confusion(threshold: Column) -> dict[str, Column]:
    hit = F.col("s") >= threshold
    return {
        "tp": F.sum(F.when(hit, F.col("pos")).otherwise(0)),
        "fp": F.sum(F.when(hit, F.col("neg")).otherwise(0)),
        "fn": F.sum(F.when(~hit, F.col("pos")).otherwise(0)),
        "tn": F.sum(F.when(~hit, F.col("neg")).otherwise(0)),
    }


def _rates() -> dict[str, Column]:
    """Metrics of four confusion counts; a zero denominator gives zero."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return {
        "row_count": n,
        "positive_prevalence": (tp + fn) / n,
        "predicted_positive_prevalence": (tp + fp) / n,
        "accuracy": (tp + tn) / n,
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2.0 * tp, 2 * tp + fp + fn),
    }


def metrics_of_histogram(
    histogram: DataFrame, groups: Sequence[str] = (), threshold: float = C.THRESHOLD
) -> DataFrame:
    s, pos, neg = F.col("s"), F.col("pos"), F.col("neg")
    running = ordered.totals_before(
        histogram, groups, ordered.score_bucket(s), s,
        {"pos_above": "pos", "neg_above": "neg"}, descending=True,
    )
    seen_pos = F.col("pos_above") + pos
    seen = seen_pos + F.col("neg_above") + neg
    sums = running.groupBy(*groups).agg(
        *[column.alias(name) for name, column in _confusion(F.lit(threshold)).items()],
        F.sum(neg * (F.col("pos_above") + pos / 2.0)).alias("_wins"),
        F.sum(F.when(pos > 0, pos * seen_pos / seen)).alias("_precision_sum"),
        F.sum(pos * (1 - s) * (1 - s) + neg * s * s).alias("_squares"),
    )
    return metrics_of_sums(sums, groups, threshold)


def metrics_of_sums(sums: DataFrame, groups: Sequence[str], threshold: float = C.THRESHOLD) -> DataFrame:
    """The metrics from confusion counts and the sums ``_wins``, ``_precision_sum`` and ``_squares``."""
    p, q = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return sums.select(
        *groups,
        *[column.alias(name) for name, column in _rates().items()],
        F.when((p > 0) & (q > 0), F.col("_wins") / (p * q)).alias("roc_auc"),
        F.when(p > 0, F.col("_precision_sum") / p).otherwise(F.lit(0.0)).alias("pr_auc"),
        (F.col("_squares") / (p + q)).alias("brier_score"),
        "tn", "fp", "fn", "tp",
        F.lit(threshold).alias("threshold"),
    )


def binary_metrics(
    df: DataFrame, groups: Sequence[str] = (), *, weight: Column | None = None,
    threshold: float = C.THRESHOLD, label: str = LABEL, score: str = SCORE,
) -> DataFrame:
    """The metric contract per group: one row each.

    ROC-AUC is null when a group has one class; average precision is zero without
    positives.
    """
    return metrics_of_histogram(
        score_histogram(df, groups, weight, label, score), groups, threshold
    )


def invalid_predictions(df: DataFrame, split: str = "TEST") -> DataFrame:
    """Rule counts of a prediction table (one row); all but ``positives`` must be zero."""
    c = F.col
    repeated = df.groupBy(ID).agg(F.count("*").alias("n")).agg(
        F.count_if(c("n") > 1).alias("repeated_ids")
    )
    rules = df.agg(
        F.count_if(~c(SCORE).between(0, 1) | c(SCORE).isNull()).alias("probability_out_of_range"),
        F.count_if(c("split") != split).alias("wrong_split"),
        F.count_if(
            c("predicted_class") != (c(SCORE) >= C.THRESHOLD).cast("int")
        ).alias("class_differs_from_threshold"),
        F.coalesce(F.sum(c(LABEL).cast("int")), F.lit(0)).alias("positives"),
    )
    return ordered.side_by_side(repeated, rules)


def _pair(name: str, label: str, field: str, value: Column) -> Column:
    return F.named_struct(F.lit(name), F.lit(label), F.lit(field), value)


def with_groups(df: DataFrame) -> DataFrame:
    """Repeat each row for its age, support and source-coverage group."""
    c = F.col
    families = {
        "age": numbers.age_bucket(c("cohort_age_at_cutoff")),
        "historical_support": numbers.support_bucket(c("historical_complaint_count")),
        "source_coverage": numbers.coverage_bucket(
            c("communication_observed_by_cutoff"), c("recall_observed_by_cutoff")
        ),
    }
    pairs = [_pair("family", k, "group", v) for k, v in families.items()]
    return df.select("*", F.explode(F.array(*pairs)).alias("_g")).select(
        *df.columns, "_g.family", "_g.group"
    )


def subgroup_metrics(df: DataFrame) -> DataFrame:
    out = binary_metrics(with_groups(df), ["family", "group"])
    return out.withColumn("positive_count", F.col("tp") + F.col("fn"))


def threshold_sensitivity(
    df: DataFrame, thresholds: Sequence[float] = C.SENSITIVITY_THRESHOLDS
) -> DataFrame:
    """Precision, recall, F1 and confusion counts at fixed thresholds."""
    return thresholds_of_histogram(score_histogram(df), (), thresholds)


def thresholds_of_histogram(
    histogram: DataFrame, groups: Sequence[str] = (), thresholds: Sequence[float] = C.SENSITIVITY_THRESHOLDS
) -> DataFrame:
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    counted = histogram.select(*groups, "s", "pos", "neg", grid).groupBy(*groups, "threshold").agg(
        *[column.alias(name) for name, column in _confusion(F.col("threshold")).items()]
    )
    rates = _rates()
    names = ("predicted_positive_prevalence", "precision", "recall", "f1")
    return counted.select(
        *groups, "threshold", *[rates[n].alias(n) for n in names], "tn", "fp", "fn", "tp"
    )


def rule_candidates(df: DataFrame, value: str, first: int, last: int, label: str = LABEL) -> DataFrame:
    """Metrics of the rules ``value >= t`` for every t, read as 0/1 probabilities."""
    c = F.col
    histogram = df.groupBy(c(value).cast("double").alias("s")).agg(
        F.count_if(c(label).cast("int") == 1).alias("pos"),
        F.count_if(c(label).cast("int") == 0).alias("neg"),
    )
    grid = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t")
    counted = histogram.select("s", "pos", "neg", grid).groupBy("t").agg(
        *[column.alias(name) for name, column in _confusion(c("t")).items()]
    )
    p, q = c("tp") + c("fn"), c("fp") + c("tn")
    auc = F.when((p > 0) & (q > 0), (c("tp") / p + c("tn") / q) / 2.0)
    return counted.select("t", _rates()["f1"].alias("f1"), auc.alias("roc_auc"), "tp", "fp", "fn", "tn")


def select_rule(candidates: DataFrame) -> DataFrame:
    """Best rule by F1, then ROC-AUC; the smallest threshold wins a tie."""
    return candidates.orderBy(F.desc("f1"), F.desc("roc_auc"), "t").limit(1)


def majority(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The majority class of the training rows (1 on a tie) and its accuracy in each split."""
    target = F.col(label).cast("int")
    predicted = df.where("split = 'TRAIN'").agg((2 * F.sum(target) >= F.count("*")).cast("int").alias("p")).first()["p"]
    return df.groupBy("split").agg(
        F.lit(predicted).alias("predicted"), F.count("*").alias("rows"),
        F.avg((target == F.lit(predicted)).cast("double")).alias("accuracy"),
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins with their predicted mean and observed rate; empty bins stay."""
    c = F.col
    index = F.least(F.floor(c(SCORE) * bins), F.lit(bins - 1)).cast("int")
    filled = df.groupBy(index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(SCORE).alias("p"), F.avg(c(LABEL).cast("double")).alias("o")
    )
    every = df.sparkSession.range(bins).select(c("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        (c("bin") / bins).alias("lower_bound"),
        ((c("bin") + 1) / bins).alias("upper_bound"),
        F.coalesce("n", F.lit(0)).alias("row_count"),
        c("p").alias("mean_predicted_probability"),
        c("o").alias("observed_positive_fraction"),
        (c("p") - c("o")).alias("calibration_gap"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.abs("calibration_gap") * F.col("row_count")
    return bins.agg((F.sum(gap) / F.sum("row_count")).alias("expected_calibration_error"))


def error_analysis(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per group, error category and dimension value, with the high-confidence errors."""
    c = F.col
    category = F.concat(
        F.when(c(LABEL).cast("int") == c("predicted_class"), "true_").otherwise("false_"),
        F.when(c("predicted_class") == 1, "positive").otherwise("negative"),
    )
    confident = (
        F.when((category == "false_positive") & (c(SCORE) >= 0.8), "false_positive_probability_gte_0_8")
        .when((category == "false_negative") & (c(SCORE) <= 0.2), "false_negative_probability_lte_0_2")
    )
    dimensions = {
        "all": F.lit("all"),
        "age": numbers.age_bucket(c("cohort_age_at_cutoff")),
        "support": numbers.support_bucket(c("historical_complaint_count")),
        "communication_available": c("communication_observed_by_cutoff").cast("string"),
        "recall_available": c("recall_observed_by_cutoff").cast("string"),
        "model_year": c("model_year").cast("string"),
    }
    pairs = [_pair("dimension", k, "value", v) for k, v in dimensions.items()]
    long = df.select(
        *groups,
        F.explode(F.array_compact(F.array(category, confident))).alias("category"),
        F.array(*pairs).alias("d"),
    ).select(*groups, "category", F.explode("d").alias("d"))
    return long.groupBy(*groups, "category", "d.dimension", "d.value").agg(F.count("*").alias("rows"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two models' predictions side by side; rows without a partner keep nulls."""
    a = left.select("*", F.col(SCORE).alias("p_left"), F.col(LABEL).alias("y_left")).drop(SCORE)
    b = right.select(ID, F.col(SCORE).alias("p_right"), F.col(LABEL).alias("y_right"))
    return a.join(b, ID, "full")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """`paired` rows; one without a partner, twice in a table or with two labels stops the run."""
    once = [guards.unique(t, ID, f"the {side} predictions") for t, side in ((left, "left"), (right, "right"))]
    same = F.col("y_left").cast("int") == F.col("y_right").cast("int")
    return guards.hold(paired(*once), same, F.concat(F.lit("predictions differ in rows or labels at "), F.col(ID)))


def misaligned(pairs: DataFrame) -> DataFrame:
    """Pairs whose label differs or is missing on a side; must be empty."""
    return pairs.where(
        F.coalesce(F.col("y_left").cast("int") != F.col("y_right").cast("int"), F.lit(True))
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Class agreement, score correlation and who is right (one row).

    Without rows there is no agreement rate, and no correlation where one model gives all rows the same score: null.
    """
    c = F.col
    y = c("y_left").cast("int") == 1
    a, b = c("p_left") >= C.THRESHOLD, c("p_right") >= C.THRESHOLD
    right_a, right_b = a == y, b == y
    return pairs.agg(
        F.try_divide(F.count_if(a == b), F.count("*")).alias("class_agreement_rate"),
        statistics.pearson("p_left", "p_right").alias("probability_correlation"),
        F.count_if(right_a & right_b).alias("both_correct"),
        F.count_if(right_a & ~right_b).alias("left_only_correct"),
        F.count_if(~right_a & right_b).alias("right_only_correct"),
        F.count_if(~right_a & ~right_b).alias("both_incorrect"),
        F.count_if(a != b).alias("disagreement_count"),
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """Rows where the two classes differ, by age and support."""
    c = F.col
    differ = pairs.where((c("p_left") >= C.THRESHOLD) != (c("p_right") >= C.THRESHOLD))
    dims = F.array(
        _pair("dimension", "age", "value", numbers.age_bucket(c("cohort_age_at_cutoff"))),
        _pair("dimension", "support", "value", numbers.support_bucket(c("historical_complaint_count"))),
    )
    return differ.select(F.explode(dims).alias("d")).groupBy("d.dimension", "d.value").agg(
        F.count("*").alias("rows")
    )


def metric_deltas(left: DataFrame, right: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Right minus left for the four headline metrics."""
    names = ("roc_auc", "pr_auc", "f1", "brier_score")
    keyed = [t.withColumn("_k", F.lit(0)) for t in (left, right)]
    joined = keyed[0].alias("l").join(keyed[1].alias("r"), ["_k", *on])
    return joined.select(*on, *[(F.col(f"r.{n}") - F.col(f"l.{n}")).alias(n) for n in names])
