"""The evaluation report of two fitted models on the same rows, as one long table.

Both models' scores are staged once, beside the groups that the report needs. One aggregate over grouping sets counts
the scores of every model and group; all metrics, calibration bins and thresholds follow from these counts. Both models
are resampled on the same draws, and all intervals and differences follow from the staged resamples. Each part is staged
by itself, so that the driver never plans and runs the whole report as one query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import numbers
from cohortlens.modeling import bootstrap
from cohortlens.modeling import metrics as M
from cohortlens.session import stage

COLUMNS = ("section", "model", "item", "metric", "value")
_FAMILIES = ("age", "historical_support", "source_coverage")
_COUNTS = ("row_count", "tn", "fp", "fn", "tp")
_RATES = ("positive_prevalence", "predicted_positive_prevalence", *M.METRICS)


def _long(section: str, table: DataFrame, model: Column, item: Column, names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return table.select(F.lit(section).alias("section"), model.alias("model"), item.alias("item"), F.explode(pairs).alias("m")).select(
        "section", "model", "item", "m.metric", "m.value"
    )


def _with_groups(scores: DataFrame) -> DataFrame:
    c = F.col
    return scores.withColumns(
        {
            "age": numbers.age_bucket(c("cohort_age_at_cutoff")),
            "historical_support": numbers.support_bucket(c("historical_complaint_count")),
            "source_coverage": numbers.coverage_bucket(c("communication_observed_by_cutoff"), c("recall_observed_by_cutoff")),
        }
    )


def histograms(scores: DataFrame) -> DataFrame:
    """Positives and negatives by model, family, group and score; family ``all`` has every row."""
    positive = F.col(M.LABEL).cast("int") == 1
    keys = ["model", "s", *_FAMILIES]
    sets = [["model", "s"], *[["model", "s", f] for f in _FAMILIES]]
    counted = scores.withColumn("s", F.col(M.SCORE).cast("double")).groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_set"), F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    # The last bits say which families are left out of a set.
    family, group = F.lit("all"), F.lit("all")
    for place, name in enumerate(_FAMILIES):
        kept = F.col("_set").bitwiseAND(F.lit(1 << (len(_FAMILIES) - 1 - place))) == 0
        family, group = F.when(kept, name).otherwise(family), F.when(kept, F.col(name)).otherwise(group)
    return counted.select("model", family.alias("family"), group.alias("group"), "s", "pos", "neg")


def evaluation(left: DataFrame, right: DataFrame, names: tuple[str, str], *, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED) -> DataFrame:
    """(section, model, item, metric, value) over two prediction tables of the same rows.

    Sections: ``metrics`` by model and subgroup, ``interval`` (95 percent, also of the two weak subgroups), ``calibration``
    by bin with the expected error, ``threshold``, ``errors`` by category and dimension, and of both models together
    ``difference`` (right minus left, with its interval), ``agreement`` and ``disagreements``. Tables that differ in rows
    or labels stop the run. A metric without a value is null.
    """
    c = F.col
    pairs = stage(M.aligned(left, right), "report-pairs")
    either = F.array(*[F.struct(F.lit(n).alias("model"), c(p).alias("p")) for n, p in zip(names, ("p_left", "p_right"), strict=True)])
    rows = pairs.withColumn(M.LABEL, c("y_left").cast("int")).withColumn("_m", F.explode(either))
    scores = stage(
        _with_groups(rows.withColumns({"model": c("_m.model"), M.SCORE: c("_m.p")})).withColumn(
            "predicted_class", (c(M.SCORE) >= C.THRESHOLD).cast("int")
        ).drop("_m", "p_left", "p_right", "y_left", "y_right"),
        "report-scores",
    )
    counted = stage(histograms(scores), "report-histograms")
    whole = counted.where("family = 'all'")
    measured = M.metrics_of_histogram(counted, ["model", "family", "group"])
    group = F.when(c("family") == "all", "all").otherwise(F.concat_ws(":", "family", "group"))
    parts = [_long("metrics", measured, c("model"), group, [*_COUNTS, *_RATES])]

    bins = F.least(F.floor(c("s") * 10), F.lit(9)).cast("int")
    filled = whole.groupBy("model", bins.alias("bin")).agg(
        F.sum(c("pos") + c("neg")).alias("row_count"), F.sum(c("s") * (c("pos") + c("neg"))).alias("_p"), F.sum("pos").alias("_o")
    ).withColumns({"mean_predicted_probability": c("_p") / c("row_count"), "observed_positive_fraction": c("_o") / c("row_count")})
    gap = filled.withColumn("calibration_gap", c("mean_predicted_probability") - c("observed_positive_fraction"))
    parts.append(_long("calibration", gap, c("model"), c("bin").cast("string"), ["row_count", "mean_predicted_probability", "observed_positive_fraction", "calibration_gap"]))
    error = gap.groupBy("model").agg((F.sum(F.abs("calibration_gap") * c("row_count")) / F.sum("row_count")).alias("expected_calibration_error"))
    parts.append(_long("calibration", error, c("model"), F.lit("all"), ["expected_calibration_error"]))

    swept = M.thresholds_of_histogram(whole, ["model"])
    parts.append(_long("threshold", swept, c("model"), c("threshold").cast("string"), ["predicted_positive_prevalence", "precision", "recall", "f1", "tn", "fp", "fn", "tp"]))

    parts.append(_long("errors", M.error_analysis(scores, ["model"]), c("model"), F.concat_ws(":", "category", "dimension", "value"), ["rows"]))

    sides, bounds = ("p_left", "p_right"), ["lower_95", "upper_95", "valid_samples"]
    side = F.when(c("model") == sides[0], names[0]).otherwise(names[1])
    labelled = pairs.withColumn(M.LABEL, c("y_left").cast("int"))
    drawn = bootstrap.resamples(labelled, sides, samples=samples, seed=seed)
    parts.append(_long("interval", bootstrap.model_intervals(drawn, sides, pairs.sparkSession), side, c("metric"), bounds))
    weak = bootstrap.critical_intervals(labelled, samples=samples, seed=seed, scores=sides)
    parts.append(_long("interval", weak, side, F.concat_ws(":", "subgroup", "metric"), bounds))
    both = F.lit(f"{names[1]} - {names[0]}")
    paired = bootstrap.paired_bootstrap(pairs, samples=samples, seed=seed, drawn=drawn)
    parts.append(_long("difference", paired, both, c("metric"), ["observed_difference", "lower_95", "upper_95", "valid_samples"]))
    agreed = M.agreement(pairs)
    parts.append(_long("agreement", agreed, both, F.lit("all"), agreed.columns))
    parts.append(_long("disagreements", M.disagreements(pairs), both, F.concat_ws(":", "dimension", "value"), ["rows"]))
    out, *rest = [stage(part.select(*COLUMNS), "report-part") for part in parts]
    for part in rest:
        out = out.unionByName(part)
    return out
