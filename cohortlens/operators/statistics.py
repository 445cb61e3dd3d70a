"""Distribution summaries and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import ordered

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def distributions(
    df: DataFrame,
    measures: dict[str, Column],
    groups: list[str] | None = None,
    probabilities: tuple[float, ...] = QUANTILES,
) -> DataFrame:
    """One row per measure: counts, extremes, quantiles, mean, population spread."""
    keys = [*(groups or []), "measure"]
    long = df.select(
        *(groups or []),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value"))
                    for k, v in measures.items()
                ]
            )
        ).alias("m"),
    ).select(*(groups or []), "m.measure", "m.value")
    base = long.groupBy(*keys).agg(
        F.count("value").alias("observed_count"),
        F.count_if(F.col("value").isNull()).alias("missing_count"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("population_variance"),
        F.stddev_pop("value").alias("population_standard_deviation"),
    )
    exact = ordered.quantiles(df, groups or [], measures, probabilities).select(
        *keys,
        *[F.col("q")[i].alias(f"p{round(p * 1000) / 10:g}".replace(".", "_")) for i, p in enumerate(probabilities)],
    )
    return base.join(exact, keys, "left")


def pearson(left: str, right: str) -> Column:
    """Aggregate over complete pairs of doubles; null when a side does not vary, where ``F.corr`` stops the run."""
    whole = F.col(left).isNotNull() & F.col(right).isNotNull()
    x, y = F.when(whole, F.col(left)), F.when(whole, F.col(right))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson and Spearman over complete pairs; null when a side does not vary.

    Ranks come from the histogram of each side, and equal pairs are combined before
    they meet their ranks, so no task ever sorts all rows.
    """
    c = F.col
    pairs = df.where(c(left).isNotNull() & c(right).isNotNull()).select(
        c(left).cast("double").alias("x"), c(right).cast("double").alias("y")
    )
    counted = pairs.groupBy("x", "y").agg(F.count("*").alias("w"))
    ranked = counted.join(ordered.average_ranks(pairs, "x", "rx"), "x").join(
        ordered.average_ranks(pairs, "y", "ry"), "y"
    )
    linear = pairs.agg(
        F.count("*").alias("n"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies"),
        pearson("x", "y").alias("r"),
    )
    w, x, y = c("w"), c("rx"), c("ry")
    rank_sums = ranked.agg(
        F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    n = c("n")
    covariance = c("sxy") - c("sx") * c("sy") / n
    spread = F.sqrt((c("sxx") - c("sx") * c("sx") / n) * (c("syy") - c("sy") * c("sy") / n))
    return ordered.side_by_side(linear, rank_sums).select(
        F.lit(left).alias("left"),
        F.lit(right).alias("right"),
        n.alias("pair_count"),
        c("r").alias("pearson"),
        F.when(c("varies"), covariance / spread).alias("spearman"),
    )


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    out = None
    for left, right in pairs:
        one = correlation(df, left, right)
        out = one if out is None else out.unionByName(one)
    return out
