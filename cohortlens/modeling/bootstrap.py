"""Bootstrap intervals from blocks of draw counts.

A resample is a vector of draw counts over the rows. All resamples of a row are kept together, as one vector with a count
for each resample, so what is shuffled is one row for each evaluated row, not one for each draw:

1. Draws travel as two-byte places inside a block of `BLOCK` rows, packed by block and resample.
2. Each block turns them into count vectors, and adds up those of rows with equal score and label.
3. Vectors are dealt to slices of the score range. Sums over slices give how many positives and negatives of each
   resample lie above a slice; with these, one pass down each slice yields the sums that all metrics need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import ordered
from cohortlens.modeling import metrics as M
from cohortlens.session import stage

PAIRED = ("roc_auc", "pr_auc", "f1", "brier_score")


def numbered(df: DataFrame, key: str = M.ID) -> DataFrame:
    """Dense zero-based ``index`` in the order of a hash of the id."""
    hashed = df.withColumn("_hash", ordered.hash_key("row", F.col(key)))
    return ordered.positions(hashed, [], "_hash", "index").drop("_hash")


#: Rows of a block (places fit in two bytes), draws packed at a time, and slices of the score range.
BLOCK = 16_384
PACKED = 2_000_000
SLICES = 256


def draws(df: DataFrame, rows: int, samples: int, seed: int) -> DataFrame:
    """(sample, index): which row each draw of each resample takes.

    Draw j of sample s is a hash of (seed, s, j) modulo the row count. A resample has as many draws as there are rows.
    """
    c = F.col
    every = df.sparkSession.range(samples * rows).select(
        F.expr(f"id div {rows}").alias("sample"), (c("id") % rows).alias("draw")
    )
    number = F.conv(F.substring(ordered.hash_key(seed, c("sample"), c("draw")), 1, 12), 16, 10)
    return every.select("sample", (number.cast("long") % rows).alias("index"))


def draw_counts(df: DataFrame, rows: int, samples: int, seed: int) -> DataFrame:
    """How often each row index is drawn in each resample, one row for each that is; combined before the shuffle."""
    return draws(df, rows, samples, seed).groupBy("sample", "index").agg(F.count("*").alias("times"))


_MESSAGES = pa.schema([("block", pa.int64()), ("sample", pa.int64()), ("places", pa.binary())])


def _packing(size: int, most: int):
    """Draws as (block, sample, places in the block of ``size`` rows), about ``most`` draws at a time."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sample, index = (np.concatenate(part) for part in zip(*held, strict=True))
        block = index // size
        order = np.lexsort((sample, block))
        sample, block, place = sample[order], block[order], (index % size).astype("<u2")[order]
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(sample) != 0) | (np.diff(block) != 0))))
        parts = [p.tobytes() for p in np.split(place, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array(sample[edges]), pa.array(parts, pa.binary())], schema=_MESSAGES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, drawn = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                drawn += batch.num_rows
            if drawn >= most:
                yield flush(held)
                held, drawn = [], 0
        if drawn:
            yield flush(held)

    return pack


def _percentiles(
    long: DataFrame | None, names: Sequence[str], spark: SparkSession, scores: Sequence[str] = ()
) -> DataFrame:
    """2.5 and 97.5 percentiles of ``value`` per metric over the resamples; one without a value has null bounds.

    ``scores`` are the values of ``model`` where each has percentiles of its own.
    """
    keys = ["model", "metric"] if scores else ["metric"]
    every = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("metric"))
    if scores:
        every = every.select(F.explode(F.array(*[F.lit(s) for s in scores])).alias("model"), "metric")
    if long is None:
        none = F.lit(None).cast("double")
        return every.select(*keys, none.alias("lower_95"), none.alias("upper_95"), F.lit(0).cast("long").alias("valid_samples"))
    q = ordered.quantiles(long, keys, {"v": F.col("value")}, [0.025, 0.975])
    return every.join(q, keys, "left").select(
        *keys,
        F.col("q")[0].alias("lower_95"),
        F.col("q")[1].alias("upper_95"),
        F.coalesce("n", F.lit(0)).alias("valid_samples"),
    )


_VECTORS = pa.schema([("model", pa.string()), ("s", pa.float64()), ("y", pa.int32()), ("counts", pa.binary())])


def _vectors(scores: Sequence[str], samples: int, size: int):
    """Rows of a block and the draws that fall into it, to a count vector for each score and label."""

    def count(rows: pa.Table, messages: pa.Table) -> pa.Table:
        place = rows.column("index").to_numpy() % size
        dense = np.zeros((samples, size), np.uint32)
        for sample, places in zip(messages.column("sample").to_pylist(), messages.column("places").to_pylist(), strict=True):
            dense[sample] += np.bincount(np.frombuffer(places, "<u2"), minlength=size).astype(np.uint32)
        mine = np.ascontiguousarray(dense[:, place].T)
        y = rows.column("y").to_numpy()
        out = []
        for name in scores:
            s = rows.column(name).to_numpy()
            order = np.lexsort((y, s))
            first = np.flatnonzero(np.concatenate(([True], (np.diff(s[order]) != 0) | (np.diff(y[order]) != 0))))
            sums = np.add.reduceat(mine[order], first, axis=0, dtype=np.uint32)
            out.append(pa.table([
                pa.array([name] * len(first)), pa.array(s[order][first]), pa.array(y[order][first], pa.int32()),
                pa.array([v.tobytes() for v in sums], pa.binary()),
            ], schema=_VECTORS))
        return pa.concat_tables(out)

    return count


def _matrix(batch: pa.RecordBatch, samples: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint32).reshape(-1, samples).astype(np.int64)


_TOTALS = pa.schema([("model", pa.string()), ("slice", pa.int64()), ("pos", pa.list_(pa.int64())), ("neg", pa.list_(pa.int64()))])
_TOTALS_DDL = "model string, slice bigint, pos array<bigint>, neg array<bigint>"


def _totals(samples: int):
    """Positives and negatives of each resample in each slice, as far as a task sees them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            counts, y = _matrix(batch, samples), batch.column("y").to_numpy()
            keys = list(zip(batch.column("model").to_pylist(), batch.column("slice").to_pylist(), strict=True))
            for key in set(keys):
                own = np.array([k == key for k in keys])
                both = np.stack([counts[own & (y == label)].sum(axis=0) for label in (1, 0)])
                sums[key] = sums.get(key, 0) + both
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int64()),
                 *[pa.array([v[i].tolist() for v in sums.values()], pa.list_(pa.int64())) for i in (0, 1)]], schema=_TOTALS,
            )

    return add


SUMS = ("tp", "fp", "fn", "tn", "_wins", "_precision_sum", "_squares")
_SUMS = pa.schema([("model", pa.string()), *[(n, pa.list_(pa.float64())) for n in SUMS]])


def _descend(samples: int, above: dict[tuple[str, int], np.ndarray], threshold: float):
    """Down each slice, highest score first: the sums of each resample that its metrics need."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, sums, rest = None, None, None, None

        def close(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
            """Takes in whole scores, one row each, in falling order."""
            nonlocal seen
            before = seen + np.concatenate((np.zeros((1, 2, samples)), np.cumsum(np.stack([pos, neg], 1), axis=0)[:-1]))
            seen = seen + np.stack([pos.sum(axis=0), neg.sum(axis=0)])
            found = before[:, 0] + pos
            hit = (score >= threshold)[:, None]
            share = np.divide(pos * found, found + before[:, 1] + neg, out=np.zeros_like(found), where=pos > 0)
            s = score[:, None]
            parts = (pos * hit, neg * hit, pos * ~hit, neg * ~hit, neg * (before[:, 0] + pos / 2), share, pos * (1 - s) ** 2 + neg * s**2)
            for i, part in enumerate(parts):
                sums[i] += part.sum(axis=0)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in sums]], schema=_SUMS)

        for batch in batches:
            score, label = batch.column("s").to_numpy(), batch.column("y").to_numpy()
            keys = list(zip(batch.column("model").to_pylist(), batch.column("slice").to_pylist(), strict=True))
            counts = _matrix(batch, samples).astype(np.float64)
            change = np.array([True, *[a != b or c != d for a, b, c, d in zip(keys, keys[1:], score, score[1:], strict=False)]])
            edges = np.flatnonzero(change)
            if not len(keys):
                continue
            yes = np.where((label == 1)[:, None], counts, 0.0)
            pos, neg = np.add.reduceat(yes, edges, axis=0), np.add.reduceat(counts - yes, edges, axis=0)
            scores, owners = score[edges], [keys[e] for e in edges]
            at = 0
            while at < len(edges):
                stop = at
                while stop < len(edges) and owners[stop] == owners[at]:
                    stop += 1
                if owners[at] != key:
                    if key is not None:
                        close(*rest)
                        yield row()
                    key, seen, sums, rest = owners[at], above[owners[at]].astype(np.float64), [np.zeros(samples) for _ in SUMS], None
                own = [scores[at:stop], pos[at:stop], neg[at:stop]]
                if rest is not None and rest[0][0] == own[0][0]:
                    own[1][0] += rest[1][0]
                    own[2][0] += rest[2][0]
                elif rest is not None:
                    close(*rest)
                # The last score may go on in the next batch.
                if stop - at > 1:
                    close(*[v[:-1] for v in own])
                rest = [v[-1:].copy() for v in own]
                at = stop
        if key is not None:
            close(*rest)
            yield row()

    return walk


def _slices(table: DataFrame, scores: Sequence[str], rows: int) -> dict[str, list[int]]:
    """For each score column the lowest score buckets of its slices, which hold about equally many rows."""
    pairs = F.array(*[F.struct(F.lit(s).alias("model"), ordered.score_bucket(F.col(s)).alias("bucket")) for s in scores])
    counted = table.select(F.explode(pairs).alias("m")).groupBy("m.model", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    cuts: dict[str, list[int]] = {s: [0] for s in scores}
    room = dict.fromkeys(scores, rows / SLICES)
    # One row for each of the fixed score buckets at most.
    for r in counted.orderBy("model", "bucket").collect():
        if room[r["model"]] <= 0:
            cuts[r["model"]].append(r["bucket"])
            room[r["model"]] = rows / SLICES
        room[r["model"]] -= r["n"]
    return cuts


def _resampled(df: DataFrame, scores: Sequence[str], samples: int, seed: int, threshold: float = C.THRESHOLD) -> DataFrame | None:
    """Metrics of every resample and score column: ``sample``, ``model`` and the metric contract; None without rows."""
    rows = df.count()
    if rows == 0:
        return None
    spark = df.sparkSession
    table = stage(
        numbered(df).select("index", F.col(M.LABEL).cast("int").alias("y"), *[F.col(s).cast("double").alias(s) for s in scores])
        .withColumn("block", F.floor(F.col("index") / BLOCK).cast("long")),
        "bootstrap-rows",
    )
    messages = draws(df, rows, samples, seed).mapInArrow(_packing(BLOCK, PACKED), "block long, sample long, places binary")
    vectors = table.groupBy("block").cogroup(messages.groupBy("block")).applyInArrow(
        _vectors(scores, samples, BLOCK), "model string, s double, y int, counts binary"
    )
    cuts = _slices(table, scores, rows)
    place = F.lit(0)
    for name in scores:
        inside = F.aggregate(F.lit(cuts[name]), F.lit(-1), lambda n, cut: n + (ordered.score_bucket(F.col("s")) >= cut).cast("int"))
        place = F.when(F.col("model") == name, inside).otherwise(place)
    sliced = stage(vectors.withColumn("slice", place.cast("long")), "bootstrap-vectors")
    partial = sliced.mapInArrow(_totals(samples), _TOTALS_DDL)
    # At most SLICES rows for each score column and task.
    sums: dict[tuple[str, int], np.ndarray] = {}
    whole = partial.groupBy("model", "slice").applyInPandas(_summed, _TOTALS_DDL)
    for r in whole.collect():
        sums[r["model"], r["slice"]] = np.array([r["pos"], r["neg"]])
    above = {
        (model, n): sum((v for (m, k), v in sums.items() if m == model and k > n), np.zeros((2, samples), np.int64)) for model, n in sums
    }
    ordered_rows = sliced.repartition("model", "slice").sortWithinPartitions("model", "slice", F.col("s").desc())
    found = ordered_rows.mapInArrow(_descend(samples, above, threshold), "model string, " + ", ".join(f"{n} array<double>" for n in SUMS))
    long = found.select("model", F.posexplode(F.arrays_zip(*SUMS)).alias("sample", "v")).select("model", "sample", "v.*")
    return M.metrics_of_sums(long.groupBy("sample", "model").agg(*[F.sum(n).alias(n) for n in SUMS]), ["sample", "model"], threshold)


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": part["model"][:1], "slice": part["slice"][:1], **{n: [np.stack(part[n]).sum(axis=0)] for n in ("pos", "neg")}})


def _long(table: DataFrame, keys: list[Column], names: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return table.select(*keys, F.explode(F.array(*pairs)).alias("m")).select(
        *[k for k in table.columns if k in ("sample", "model")], "m.metric", "m.value"
    )


def bootstrap_intervals(
    df: DataFrame, *, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED,
    names: Sequence[str] = M.METRICS, whole: bool = False,
) -> DataFrame:
    """95 percent interval of each metric; resamples without a value are left out.

    A metric that no resample has is left out as well, and a table without rows stops the run. ``whole`` gives every
    metric its row instead: in both cases its bounds are null and ``valid_samples`` is zero.
    """
    table = _resampled(df, [M.SCORE], samples, seed)
    if table is None and not whole:
        raise ValueError("a bootstrap needs rows")
    long = None if table is None else _long(table, ["sample", "model"], names)
    found = _percentiles(long, names, df.sparkSession)
    return found if whole else found.where("valid_samples > 0")


def resamples(df: DataFrame, scores: Sequence[str], *, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED) -> DataFrame | None:
    """The metrics of every resample and score column, staged for several readers; None without rows."""
    table = _resampled(df, scores, samples, seed)
    return None if table is None else stage(table, "bootstrap-resamples")


def model_intervals(
    drawn: DataFrame | None, scores: Sequence[str], spark: SparkSession, names: Sequence[str] = M.METRICS
) -> DataFrame:
    """`bootstrap_intervals` of each score column of ``resamples``; every metric has its row."""
    long = None if drawn is None else _long(drawn, ["sample", "model"], names)
    return _percentiles(long, names, spark, scores)


def paired_bootstrap(
    pairs: DataFrame, *, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED, drawn: DataFrame | None = None
) -> DataFrame:
    """Observed right-minus-left difference and its interval, both on the same draws.

    ``pairs`` is the output of ``metrics.paired``; ``drawn`` holds its `resamples` where a caller has them already.
    """
    rows = pairs.withColumn(M.LABEL, F.col("y_left").cast("int"))
    sides = ["p_left", "p_right"]

    def differences(table: DataFrame, keys: list[str]) -> DataFrame:
        long = _long(table, [*keys, "model"], PAIRED)
        value = F.max(F.when(F.col("model") == "p_right", F.col("value"))) - F.max(
            F.when(F.col("model") == "p_left", F.col("value"))
        )
        return long.groupBy(*keys, "metric").agg(value.alias("value"))

    table = _resampled(rows, sides, samples, seed) if drawn is None else drawn
    resampled = None if table is None else differences(table, ["sample"])
    both = rows.select(
        M.LABEL,
        F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("p")) for s in sides])).alias("m"),
    ).select(M.LABEL, "m.model", F.col("m.p").alias(M.SCORE))
    observed = differences(M.binary_metrics(both, ["model"]), [])
    return _percentiles(resampled, PAIRED, rows.sparkSession).join(
        observed.withColumnRenamed("value", "observed_difference"), "metric", "left"
    ).select("metric", "observed_difference", "lower_95", "upper_95", "valid_samples")


def critical_intervals(
    df: DataFrame, *, samples: int = C.BOOTSTRAP_SAMPLES, seed: int = C.SEED, scores: Sequence[str] = ()
) -> DataFrame:
    """Intervals for the two weak subgroups, each with its own seed; an empty one has null bounds.

    Several ``scores`` share the draws, and ``model`` tells whose the intervals are.
    """
    groups = {
        "support_1": F.col("historical_complaint_count") == 1,
        "age_21_plus": F.col("cohort_age_at_cutoff") >= 21,
    }
    out, names = None, ("recall", "f1", "roc_auc")
    for offset, (name, rule) in enumerate(groups.items()):
        table = _resampled(df.where(rule), scores or [M.SCORE], samples, seed + offset)
        long = None if table is None else _long(table, ["sample", "model"], names)
        part = _percentiles(long, names, df.sparkSession, scores).select(F.lit(name).alias("subgroup"), "*")
        out = part if out is None else out.unionByName(part)
    return out
