"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, turned onto principal axes and then by a learned rotation, and cut to
signs: one 64-bit code each. A code is split into eight substrings, and each has an index from
value to rows. Codes within a Hamming radius r of a query agree with it in some substring up to
r // 8 bits, so probing all such values in all eight indexes finds every one of them. What
lies in the radius is ranked by the true inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare, stage

BITS = 64
SUBSTRINGS = 8
#: Bounds of the sample on which rotation and radius are learned, and of the queries in it.
SAMPLE_ROWS = 8_192
SAMPLE_QUERIES = 256
ROTATION_STEPS = 30
#: Share of true neighbours, in the sample, that the learned radius must hold.
TARGET_RECALL = 0.98
#: Rows of an index shard and queries of a block: what one task holds.
SHARD_ROWS = 8_192
BLOCK_QUERIES = 4_096


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors - self.mean) @ self.rotation > 0
        padded = np.zeros((len(vectors), BITS), np.uint8)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def learn(sample: np.ndarray, k: int, target: float = TARGET_RECALL) -> Coder:
    """Mean, rotation and radius from a sample of vectors.

    The rotation alternates between signs and the orthogonal matrix that fits them best. The radius
    is the smallest that holds ``target`` of the sample's true ``k`` nearest. More rows only bring
    neighbours closer, so the radius holds for the full table.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :BITS]
    flat = centred @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((axes.shape[1],) * 2))
    for _ in range(ROTATION_STEPS):
        left, _, right = np.linalg.svd(flat.T @ np.where(flat @ turn > 0, 1.0, -1.0))
        turn = left @ right
    coder = Coder(mean, axes @ turn, BITS)
    codes, queries = coder.codes(sample), sample[:SAMPLE_QUERIES]
    products = queries @ sample.T
    products[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return coder
    nearest = np.argpartition(-products, k - 1, axis=1)[:, :k]
    distances = np.bitwise_count(codes[: len(queries), None] ^ codes[nearest])
    return Coder(mean, coder.rotation, int(np.quantile(distances, target, method="higher")))


class Index:
    """Substring indexes over the codes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(np.uint8).reshape(len(codes), SUBSTRINGS)
        self.order = [np.argsort(parts[:, s], kind="stable") for s in range(SUBSTRINGS)]
        self.starts = [np.searchsorted(parts[self.order[s], s], np.arange(257)) for s in range(SUBSTRINGS)]
        self.near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.codes), bool)
        own = np.array([code], np.uint64).view(np.uint8)
        for s in range(SUBSTRINGS):
            starts, order = self.starts[s], self.order[s]
            for value in np.flatnonzero(self.near[own[s]] <= radius // SUBSTRINGS):
                found[order[starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, one for each id.

    Left out are null ids, vectors that are null, zero, or hold null or non-finite components, and those
    whose length isn't the most frequent one. Of repeated ids the smallest vector counts.
    """
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = (
        vectors.select("vec_id", e.alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & F.exists("embedding", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )
    good = stage(good, "vectors")
    common = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return good.join(F.broadcast(common.select("n")), F.size("embedding") == F.col("n"), "left_semi")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query by inner product.

    Queries are the rows of `usable` where ``is_query`` holds; candidates are all usable rows but the
    query's own. Ties go to the smaller id. All candidates come back if they are fewer than ``k``.
    An empty table, or one without queries, gives no rows. Other columns are not read.

    Every pair of an index shard and a block of queries is one task of bounded size; it keeps the best
    ``k``, and these are merged for each query.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = learn(np.array([r[0] for r in sample]), k)
    queries = rows.where(is_query)
    shards, blocks = -(-rows.count() // SHARD_ROWS), max(1, -(-queries.count() // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), deal(shards).alias("shard"), everywhere(blocks).alias("block"))
    asked = queries.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), everywhere(shards).alias("shard"), deal(blocks).alias("block"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, table = _matrix(left)
        query_ids, wanted = _matrix(right)
        found = Index(coder.codes(table)) if len(ids) and len(query_ids) else None
        out: list[tuple[np.ndarray, ...]] = []
        codes = coder.codes(wanted) if found else ()
        for query_id, vector, code in zip(query_ids, wanted, codes, strict=True) if found else ():
            radius = coder.radius
            near = found.within(code, radius)
            while len(near) <= k and radius < BITS:  # the query's own row may be among them
                radius = min(BITS, radius + SUBSTRINGS)
                near = found.within(code, radius)
            near = near[ids[near] != query_id]
            # Summed row by row in one order, so equal vectors have equal scores.
            scores = (table[near] * vector).sum(axis=1)
            best = np.lexsort((ids[near], -scores))[:k]
            out.append((np.full(len(best), query_id), ids[near][best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    cells = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    partial = cells.applyInArrow(nearest, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows["id"].to_numpy().astype(np.int64)
    if not len(ids):
        return ids, np.zeros((0, 0))
    flat = rows["vector"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
