"""A fitted forest as node tables of bounded size, and walks of rows through them.

The forest is read from its saved form in shards of whole trees. Each shard is broadcast, walked by all rows and
released before the next one is read, so neither the driver nor a task ever holds more than one; what the shards give
is added up by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage, stage_path

#: A shard has the trees up to so many nodes, or a single larger tree.
SHARD_NODES = 1_000_000

Nodes = dict[str, np.ndarray]


def node_table(model: RandomForestClassificationModel, spark) -> DataFrame:
    """(tree, id, left, right, feature, threshold, stats) of the saved model."""
    path = stage_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    # The layout names the node struct ``nodeData``; take whichever wrapper is there.
    node = "nodeData" if "nodeData" in saved.columns else None
    field = (lambda n: F.col(f"{node}.{n}")) if node else F.col
    return saved.select(
        F.col("treeID").cast("int").alias("tree"),
        field("id").alias("id"),
        field("leftChild").alias("left"),
        field("rightChild").alias("right"),
        field("split.featureIndex").alias("feature"),
        F.get(field("split.leftCategoriesOrThreshold"), 0).alias("threshold"),
        field("impurityStats").alias("stats"),
    )


def shards(table: DataFrame, most: int = SHARD_NODES) -> Iterator[Nodes]:
    """Node arrays of one shard after the other."""
    group: list[int] = []
    room = most
    # One row for each tree.
    for row in table.groupBy("tree").count().orderBy("tree").collect():
        if group and row["count"] > room:
            yield _arrays(table, group)
            group, room = [], most
        group.append(row["tree"])
        room -= row["count"]
    if group:
        yield _arrays(table, group)


def _arrays(table: DataFrame, trees: Sequence[int]) -> Nodes:
    rows = table.where(F.col("tree").between(trees[0], trees[-1])).toPandas()
    rows = rows.sort_values(["tree", "id"]).reset_index(drop=True)
    start = rows.groupby("tree").cumcount().rsub(pd.Series(rows.index)).to_numpy()
    stats = np.vstack(rows["stats"].to_numpy())
    leaf = rows["left"].to_numpy() < 0
    return {
        "root": np.unique(start),
        "left": np.where(leaf, -1, rows["left"].to_numpy() + start),
        "right": np.where(leaf, -1, rows["right"].to_numpy() + start),
        "feature": rows["feature"].to_numpy(),
        "threshold": rows["threshold"].to_numpy(dtype=float),
        "value": stats[:, 1] / stats.sum(axis=1),
    }


def used_features(nodes: Nodes) -> list[set[int]]:
    """The features that each tree of a shard splits on."""
    edges = [*nodes["root"].tolist(), len(nodes["left"])]
    inner = nodes["left"] >= 0
    return [set(nodes["feature"][a:b][inner[a:b]].tolist()) for a, b in zip(edges, edges[1:], strict=False)]


def descend(nodes: Nodes, root: int, x: np.ndarray, step: Callable | None = None) -> np.ndarray:
    """The leaf of each row in one tree; ``step(rows, nodes, children)`` sees each move."""
    at = np.full(len(x), root)
    live = np.arange(len(x))
    while len(live):
        live = live[nodes["left"][at[live]] >= 0]
        here = at[live]
        goes_left = x[live, nodes["feature"][here]] <= nodes["threshold"][here]
        child = np.where(goes_left, nodes["left"][here], nodes["right"][here])
        if step is not None:
            step(live, here, child)
        at[live] = child
    return at


def added_by_row(rows: DataFrame, table: DataFrame, walk: Callable, width: int, most: int = SHARD_NODES) -> DataFrame:
    """``rows`` with the array ``sums`` (``width`` numbers), the sum over all shards of what ``walk`` gives.

    ``walk(broadcast nodes)`` makes a function of batches of (x, ...) that yields a ``(rows, width)`` block for each.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    # A small table would come to one task, and a walk costs far more than the move of its rows.
    whole = stage(numbered.repartition(spark.sparkContext.defaultParallelism, "_row"), "forest-rows")
    found: list[DataFrame] = []
    for nodes in shards(table, most):
        shared = spark.sparkContext.broadcast(nodes)
        fields = "_row bigint, sums array<double>"
        found.append(stage(whole.mapInPandas(_batches(walk(shared)), fields), "forest-sums"))
        shared.destroy()
    if len(found) == 1:
        sums = found[0]
    else:
        every = found[0]
        for part in found[1:]:
            every = every.unionByName(part)
        zero = F.array_repeat(F.lit(0.0), width)
        # One array for each shard.
        sums = every.groupBy("_row").agg(F.collect_list("sums").alias("parts")).select(
            "_row", F.aggregate("parts", zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("sums")
        )
    return whole.join(sums, "_row").drop("_row")


def _batches(walk: Callable):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"_row": batch["_row"], "sums": list(walk(batch))})

    return run
