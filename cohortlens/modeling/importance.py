"""Permutation importance of single features and of whole families."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import ordered
from cohortlens.modeling import forest
from cohortlens.modeling import metrics as M
from cohortlens.session import stage


def _permuted(rows: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Each row with, per repeat, the vector of the row that a shuffle puts in its place.

    Both orders are hash orders with dense positions, so the shuffle is an equi-join.
    """
    c = F.col
    base = rows.select(C.COHORT_ID, "target", vector_to_array("features").alias("x"))
    placed = ordered.positions(
        base.withColumn("_h", ordered.hash_key("row", c(C.COHORT_ID))), [], "_h", "index"
    ).drop("_h")
    grid = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")
    again = base.select(C.COHORT_ID, "x", grid).withColumn(
        "_h", ordered.hash_key(seed, c("repeat"), c(C.COHORT_ID))
    )
    donors = ordered.positions(again, ["repeat"], "_h", "index").select(
        "repeat", "index", c("x").alias("donor")
    )
    return placed.join(donors, "index")


def permutation_importance(
    model: RandomForestClassificationModel, rows: DataFrame, groups: dict[str, Sequence[int]], *, repeats: int = 5,
    seed: int = C.SEED, most: int = forest.SHARD_NODES,
) -> DataFrame:
    """Mean and spread of the ROC-AUC decrease per group of vector positions.

    A group of one position is a feature; a longer one is a family moved together. Every row walks every tree once;
    for each group only the trees that split on one of its features are walked again with the donor's values. A row
    and repeat stays one row, with a probability for each group, until the scores are counted.
    """
    c = F.col
    both = _permuted(rows, repeats, seed).select("target", "repeat", "x", "donor")
    width = len(groups) + 1
    moved = forest.added_by_row(
        both, forest.node_table(model, rows.sparkSession), _moving([list(g) for g in groups.values()], model.getNumTrees), width, most
    )
    # The order of a sum shows in its last digits only; without them rows of equal leaves tie.
    long = moved.select("target", "repeat", F.posexplode("sums").alias("place", "p")).select(
        "target", "repeat", "place", F.round("p", 12).alias("probability")
    )
    measured = stage(M.binary_metrics(long, ["place", "repeat"]).select("place", "repeat", "roc_auc"), "importance-auc")
    # The last place is the intact row, the same in each repeat.
    intact = measured.where(c("place") == len(groups)).agg(F.max("roc_auc").alias("intact")).first()["intact"]
    names = F.get(F.array(*[F.lit(n) for n in groups]), c("place"))
    return measured.where(c("place") < len(groups)).groupBy(names.alias("feature")).agg(
        F.count("*").alias("repeats"),
        (F.lit(intact).cast("double") - F.avg("roc_auc")).alias("mean_roc_auc_decrease"),
        F.stddev_pop("roc_auc").alias("standard_deviation"),
    )


def _moving(groups: list[list[int]], trees: int):
    """For each row of a batch the shard's part of its probability, with each group moved and last intact."""

    def over(shared):
        users: dict[str, list[list[int]]] = {}

        def walk(batch: pd.DataFrame) -> np.ndarray:
            n = shared.value
            if "of" not in users:
                used = forest.used_features(n)
                users["of"] = [[t for t, own in enumerate(used) if not own.isdisjoint(g)] for g in groups]
            x, donor = (np.vstack(batch[name].to_numpy()) for name in ("x", "donor"))
            leaves = np.stack([n["value"][forest.descend(n, root, x)] for root in n["root"]], axis=1)
            out = np.empty((len(x), len(groups) + 1))
            out[:, -1] = leaves.sum(axis=1) / trees
            for place, (group, own) in enumerate(zip(groups, users["of"], strict=True)):
                mixed, changed = x.copy(), leaves.copy()
                mixed[:, group] = donor[:, group]
                for t in own:
                    changed[:, t] = n["value"][forest.descend(n, n["root"][t], mixed)]
                out[:, place] = changed.sum(axis=1) / trees
            return out

        return walk

    return over


def family_positions(outputs: Sequence[str]) -> dict[str, list[int]]:
    """Vector positions per feature family, missing indicators with their feature."""
    from cohortlens.modeling.preprocess import feature_family

    out: dict[str, list[int]] = {}
    for i, name in enumerate(outputs):
        out.setdefault(feature_family(name.removeprefix("missing_")), []).append(i)
    return out
