"""MLlib candidates, selection on validation rows, and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.modeling import metrics as M
from cohortlens.modeling.preprocess import ImputeScale, Preprocess, one_hot
from cohortlens.operators import guards
from cohortlens.session import stage

SPLITS = ("TRAIN", "VALIDATION", "TEST")
META = (
    C.COHORT_ID, *C.KEY, "cohort_age_at_cutoff", "historical_complaint_count",
    "communication_observed_by_cutoff", "recall_observed_by_cutoff", "split", "target",
)


def model_dataset(features: DataFrame, targets: DataFrame, split: DataFrame) -> DataFrame:
    """Features with their label and split, one row per cohort.

    The three tables must have the same cohorts, each once, and features and targets the same make, model and
    year for each: anything else stops the run, whichever columns are read.
    """
    key = list(C.KEY)
    labels = targets.select(
        C.COHORT_ID, F.col("future_any_complaint").cast("int").alias("target"), F.struct(*key).alias("_key")
    )
    out = guards.unique(features.withColumn("_row", F.lit(True)), C.COHORT_ID, "the feature table")
    for part, said in ((labels, "target"), (split, "split")):
        once = guards.unique(part.withColumn(f"_{said}", F.lit(True)), C.COHORT_ID, f"the {said} table")
        out = out.join(once, C.COHORT_ID, "full")
    whole = F.col("_row") & F.col("_target") & F.col("_split") & F.struct(*key).eqNullSafe(F.col("_key"))
    said = F.concat(F.lit("features, targets and split differ at cohort "), C.COHORT_ID)
    return guards.hold(out, whole, said).drop("_row", "_target", "_split", "_key")


def alignment_mismatches(features: DataFrame, targets: DataFrame, split: DataFrame) -> DataFrame:
    """Ids that are not in all three tables, or whose identity fields differ."""
    key = list(C.KEY)
    a = features.select(C.COHORT_ID, F.struct(*key).alias("a"))
    b = targets.select(C.COHORT_ID, F.struct(*key).alias("b"))
    d = split.select(C.COHORT_ID, F.col("split").alias("d"))
    joined = a.join(b, C.COHORT_ID, "full").join(d, C.COHORT_ID, "full")
    same = F.col("a").eqNullSafe(F.col("b"))
    return joined.where(~same | F.col("d").isNull())


@dataclass(frozen=True)
class Candidate:
    name: str
    build: Callable[[int, int], object]  # (training rows, input width) -> estimator
    scale: bool = False


def logistic_candidates(strengths: Sequence[float] = (0.1, 1.0)) -> list[Candidate]:
    """L2 logistic regression; the penalty is 1/(C n) on already scaled inputs."""
    return [
        Candidate(
            f"C={c}",
            lambda n, width, c=c: LogisticRegression(
                labelCol="target", regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=1000,
                standardization=False,
            ),
            scale=True,
        )
        for c in strengths
    ]


def forest_candidates(
    trees: int = 200, shapes: Sequence[tuple[int, int]] = ((10, 5), (30, 10)), seed: int = C.SEED
) -> list[Candidate]:
    """Random forests by (depth, smallest leaf); 30 is the deepest MLlib allows."""
    return [
        Candidate(
            f"depth={depth},min_leaf={leaf}",
            lambda n, width, depth=depth, leaf=leaf: RandomForestClassifier(
                labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
                seed=seed,
            ),
        )
        for depth, leaf in shapes
    ]


def boosting_candidates(
    rounds: int = 150, rates: Sequence[float] = (0.05, 0.1), seed: int = C.SEED
) -> list[Candidate]:
    """Gradient boosting; depth 4 stands for the cap of 15 leaves."""
    return [
        Candidate(
            f"learning_rate={rate}",
            lambda n, width, rate=rate: GBTClassifier(
                labelCol="target", maxIter=rounds, stepSize=rate, maxDepth=4,
                minInstancesPerNode=20, seed=seed,
            ),
        )
        for rate in rates
    ]


def perceptron_candidates(
    hidden: Sequence[tuple[int, ...]] = ((64, 32), (64,), (128, 64)), seed: int = C.SEED,
    iterations: int = 100,
) -> list[Candidate]:
    return [
        Candidate(
            "-".join(str(h) for h in layers),
            lambda n, width, layers=layers: MultilayerPerceptronClassifier(
                labelCol="target", layers=[width, *layers, 2], solver="l-bfgs", seed=seed,
                maxIter=iterations,
            ),
            scale=True,
        )
        for layers in hidden
    ]


def parameter_count(layers: Sequence[int]) -> int:
    """Weights and biases of a fully connected network."""
    return sum((a + 1) * b for a, b in zip(layers, layers[1:], strict=False))


def score(model: Model, rows: DataFrame, keep: Sequence[str] = META) -> DataFrame:
    """Probability of the positive class beside the metadata columns."""
    scored = model.transform(rows)
    return scored.select(*keep, vector_to_array("probability")[1].alias("probability"))


def prediction_table(scored: DataFrame, model_id: str, cutoff) -> DataFrame:
    """The 15-column prediction table at the fixed threshold."""
    c = F.col
    return scored.select(
        c(C.COHORT_ID).alias("cohort_id"),
        *C.KEY,
        "target",
        "probability",
        (c("probability") >= C.THRESHOLD).cast("int").alias("predicted_class"),
        "split",
        F.lit(model_id).alias("model_identifier"),
        F.lit(C.TARGET_VERSION).alias("target_version"),
        F.lit(cutoff).alias("cutoff"),
        "cohort_age_at_cutoff",
        "historical_complaint_count",
        "communication_observed_by_cutoff",
        "recall_observed_by_cutoff",
    )


@dataclass
class Fitted:
    candidate: str
    model: Model
    prepared: DataFrame
    preprocessing: ImputeScale
    metrics: dict[str, dict[str, float]]
    #: Partitions the training rows were dealt to; tree bagging depends on it.
    partitions: int = 0

    def pipeline(self) -> PipelineModel:
        """Preprocessing and model as one; numeric columns only."""
        if list(self.prepared.select("features").first()["features"].toArray().shape) != [len(self.preprocessing.outputs)]:
            raise ValueError("one-hot columns have no place in the saved pipeline")
        return PipelineModel([Preprocess(self.preprocessing), self.model])

    def save(self, path: str) -> None:
        """Write the pipeline once, with a line that says what was chosen and how it was trained."""
        spark = self.prepared.sparkSession
        self.pipeline().write().save(f"{path}/pipeline")
        told = {"candidate": self.candidate, "training_partitions": self.partitions, "validation": self.metrics["VALIDATION"]}
        spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/chosen")


def load_chosen(spark, path: str) -> tuple[PipelineModel, dict[str, object]]:
    """The pipeline that `Fitted.save` wrote, and what it says about itself."""
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/chosen").first()["value"])


def prepare_inputs(
    dataset: DataFrame, columns: Sequence[str], *, scale: bool, known: ImputeScale | None = None
) -> tuple[DataFrame, ImputeScale]:
    """Assembled vectors for all splits, with every statistic taken from TRAIN.

    ``known`` holds numbers already learned from TRAIN for these columns or more.
    """
    identity = [n for n in columns if n in C.IDENTITY_MODEL]
    numeric = [n for n in columns if n not in identity]
    train = dataset.where("split = 'TRAIN'")
    fitted = known.subset(numeric) if known else ImputeScale.fit(train, numeric, scale=scale)
    rows = one_hot(train, dataset, identity) if identity else dataset
    kept = fitted.assemble(rows, META, [f"{n}_hot" for n in identity])
    return stage(kept, "model-inputs"), fitted


#: Training rows of one partition at most, on average, and the least number of partitions. Tree bagging is seeded for
#: each partition, so the number follows from the rows alone: the same rows give the same model on any cluster.
ROWS_PER_PARTITION = 50_000
LEAST_PARTITIONS = 8


def training_rows(rows: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> tuple[DataFrame, int, int]:
    """TRAIN rows, dealt by cohort id, their number and that of their partitions."""
    train = rows.where("split = 'TRAIN'")
    n = train.count()
    partitions = max(LEAST_PARTITIONS, -(-n // rows_per_partition))
    return train.repartition(partitions, C.COHORT_ID).sortWithinPartitions(C.COHORT_ID), n, partitions


def _metrics_by_split(scored: DataFrame) -> dict[str, dict[str, float]]:
    rows = M.binary_metrics(scored, ["split"]).collect()
    return {r["split"]: {k: v for k, v in r.asDict().items() if k != "split"} for r in rows}


def evaluate_each(
    dataset: DataFrame, columns: Sequence[str], candidates: Sequence[Candidate],
    known: ImputeScale | None = None, *, rows_per_partition: int = ROWS_PER_PARTITION,
) -> list[Fitted]:
    """Every candidate fitted on TRAIN and measured on all splits; inputs are prepared once for each scaling."""
    out: list[Fitted] = []
    inputs: dict[bool, tuple[DataFrame, ImputeScale]] = {}
    for candidate in candidates:
        if candidate.scale not in inputs:
            inputs[candidate.scale] = prepare_inputs(
                dataset, columns, scale=candidate.scale, known=known
            )
        rows, fitted = inputs[candidate.scale]
        train, n, partitions = training_rows(rows, rows_per_partition)
        width = len(rows.select("features").first()["features"])
        model = candidate.build(n, width).fit(train)
        out.append(Fitted(candidate.name, model, rows, fitted, _metrics_by_split(score(model, rows)), partitions))
    return out


def evaluate_candidates(
    dataset: DataFrame, columns: Sequence[str], candidates: Sequence[Candidate],
    known: ImputeScale | None = None, *, rows_per_partition: int = ROWS_PER_PARTITION,
) -> Fitted:
    """Fit on TRAIN, choose on VALIDATION by ROC-AUC, then average precision, then F1.

    TEST is only reported. The first candidate wins a tie.
    """
    fits = evaluate_each(dataset, columns, candidates, known, rows_per_partition=rows_per_partition)
    return max(fits, key=_rank)


def _rank(fit: Fitted) -> tuple[float, float, float]:
    m = fit.metrics["VALIDATION"]
    return (m["roc_auc"] or 0.0, m["pr_auc"], m["f1"])


def select_with_tolerance(
    results: Sequence[tuple[str, dict[str, float], int]], tolerance: float = 1e-4
) -> str:
    """Pick by ROC-AUC, average precision, F1 and Brier in turn; near ties go on to the
    next metric, and the smallest model wins in the end. A metric without a value, as ROC-AUC where validation has
    one class, counts as zero."""
    left = [(name, {k: v or 0.0 for k, v in m.items()}, size) for name, m, size in results]
    for name, sign in (("roc_auc", 1), ("pr_auc", 1), ("f1", 1), ("brier_score", -1)):
        top = max(sign * m[name] for _, m, _ in left)
        left = [r for r in left if abs(sign * r[1][name] - top) <= tolerance]
        if len(left) == 1:
            return left[0][0]
    return min(left, key=lambda r: r[2])[0]


def metrics_frame(spark, rows: Sequence[tuple]) -> DataFrame:
    """Reported metrics as a table: experiment, model, candidate, split and values."""
    names = ("roc_auc", "pr_auc", "f1", "accuracy", "brier_score")
    flat = [
        (experiment, model, candidate, split, int(m["row_count"]), *[None if m[n] is None else float(m[n]) for n in names])
        for experiment, model, candidate, table in rows
        for split, m in table.items()
    ]
    schema = "experiment string, model string, candidate string, split string, row_count long, " + ", ".join(
        f"{n} double" for n in names
    )
    return spark.createDataFrame(flat, schema)


def ablation(dataset: DataFrame, experiments: dict[str, list[str]] | None = None) -> DataFrame:
    """The logistic model on each nested feature set."""
    out = []
    train = dataset.where("split = 'TRAIN'")
    known = ImputeScale.fit(train, C.ALL_EVIDENCE_MODEL, scale=True)
    for name, columns in (experiments or C.EXPERIMENTS).items():
        fit = evaluate_candidates(dataset, columns, logistic_candidates(), known)
        out.append((name, "logistic_regression", fit.candidate, fit.metrics))
    return metrics_frame(dataset.sparkSession, out)


def seed_robustness(
    rows: DataFrame, build: Callable[[int, int, int], object], seeds: Sequence[int], *,
    rows_per_partition: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """Validation metrics of one configuration refitted per seed: mean and spread."""
    train, n, _ = training_rows(rows, rows_per_partition)
    held = rows.where("split = 'VALIDATION'")
    width = len(rows.select("features").first()["features"])
    scored = None
    for seed in seeds:
        part = score(build(n, width, seed).fit(train), held).withColumn("seed", F.lit(seed))
        scored = part if scored is None else scored.unionByName(part)
    table = M.binary_metrics(scored, ["seed"])
    names = ["roc_auc", "pr_auc", "f1", "brier_score"]
    long = table.unpivot(["seed"], names, "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("standard_deviation"),
    )
