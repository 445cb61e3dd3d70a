import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.functions import numbers, ordered, text
from cohortlens.operators import profiling, statistics
from tests.helpers import rows

D = dt.date
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_month_rules(spark):
    assert numbers.window_end(D(2022, 12, 31), 12) == D(2023, 12, 31)
    assert numbers.window_end(D(2023, 1, 31), 1) == D(2023, 2, 28)
    assert [numbers.recency_start(D(2022, 12, 31), m) for m in (12, 24, 36)] == [D(2022, 1, 1), D(2021, 1, 1), D(2020, 1, 1)]
    with pytest.raises(ValueError):
        numbers.window_end(D(2022, 12, 31), 0)
    with pytest.raises(ValueError):
        numbers.add_months(F.col("x"), 0)
    df = spark.createDataFrame([(D(2023, 1, 31),), (D(2024, 2, 29),)], "d date")
    for months in (1, 12, 13):
        got = {r[0]: r[1] for r in rows(df, "d", numbers.add_months(F.col("d"), months))}
        assert got == {d: numbers.shift_months(d, months) for d in got}


def test_flagged_dates(spark):
    cases = {"20210102": (D(2021, 1, 2), None), "x": (None, "malformed_d"), "20210230": (None, "invalid_d"),
             "18991231": (None, "out_of_range_d"), "00000101": (None, "invalid_d")}
    parsed, flag = text.flagged_date(F.col("v"), "d")
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r[0]: (r[1], r[2]) for r in rows(df, "v", parsed, flag)} == cases


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 5, 6, 10, 11, 20, 21, 49, 50)], "n int")
    n = F.col("n")
    got = rows(df, numbers.age_at_cutoff_bucket(n), numbers.age_bucket(n), numbers.support_bucket(n))
    assert [r[0] for r in got] == ["0", "1-2", "1-2", "3-5", "3-5", "6-10", "6-10", "11-20", "11-20", "21+", "21+", "21+"]
    assert [r[1] for r in got] == ["0-2"] * 3 + ["3-5"] * 2 + ["6-10"] * 2 + ["11-20"] * 2 + ["21+"] * 3
    assert [r[2] for r in got][1:] == ["1", "2-4", "2-4", "5-9", "5-9"] + ["10-49"] * 5 + ["50+"]


@SLOW
@given(values=st.lists(st.integers(-50, 1000) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ps = [0.0, 0.025, 0.5, 0.77, 1.0]
    got = ordered.quantiles(df, [], {"v": F.col("v")}, ps).first()
    assert got["n"] == len(values)
    assert got["q"] == pytest.approx(list(np.quantile(values, ps)), rel=1e-9, abs=1e-9)


def test_grouped_quantiles_with_a_hot_group(spark):
    random.seed(3)
    table = [("hot" if random.random() < 0.8 else f"g{random.randrange(5)}", random.randrange(400) / 7, i) for i in range(3000)]
    table.append(("empty", None, 0))
    df = spark.createDataFrame(table, "g string, v double, i int")
    frame = pd.DataFrame(table, columns=["g", "v", "i"])
    got = {r["g"]: (r["v"], r["i"]) for r in ordered.grouped_medians(df, ["g"], {"v": F.col("v"), "i": F.col("i")}).collect()}
    for g, part in frame.groupby("g"):
        assert got[g][1] == pytest.approx(part["i"].median())
        assert got[g][0] is None if g == "empty" else got[g][0] == pytest.approx(part["v"].median())


def test_totals_before_match_a_sorted_loop(spark):
    random.seed(5)
    table = [(f"g{i % 3}", v, random.randrange(9)) for i, v in enumerate(random.sample(range(-500, 500), 300))]
    df = spark.createDataFrame(table, "g string, v int, w int")
    for down in (False, True):
        out = ordered.totals_before(df, ["g"], ordered.value_bucket(F.col("v")), F.col("v"), {"before": "w"}, descending=down)
        got = {(r["g"], r["v"]): r["before"] for r in out.collect()}
        for g in ("g0", "g1", "g2"):
            total = 0
            for _, v, w in sorted((r for r in table if r[0] == g), key=lambda r: r[1], reverse=down):
                assert got[(g, v)] == total
                total += w


def test_positions_are_dense(spark):
    df = spark.range(500).withColumn("h", ordered.hash_key(7, F.col("id")))
    got = sorted((r["h"], r["position"]) for r in ordered.positions(df, [], "h").collect())
    assert [p for _, p in got] == list(range(500))


@SLOW
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 40)), min_size=2, max_size=50))
def test_correlations_equal_pandas(spark, pairs):
    df = spark.createDataFrame([*pairs, (None, 3)], "a int, b int")
    got = statistics.correlation(df, "a", "b").first()
    frame = pd.DataFrame(pairs, columns=["a", "b"])
    assert got["pair_count"] == len(pairs)
    if frame["a"].nunique() < 2 or frame["b"].nunique() < 2:
        assert got["pearson"] is None and got["spearman"] is None
    else:
        ranks = frame.rank()
        assert got["pearson"] == pytest.approx(frame["a"].corr(frame["b"]), abs=1e-9)
        assert got["spearman"] == pytest.approx(ranks["a"].corr(ranks["b"]), abs=1e-9)


def test_distribution(spark):
    values = [1, 2, 2, 10, None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = statistics.distributions(df, {"v": F.col("v")}).first()
    known = [v for v in values if v is not None]
    assert (got["observed_count"], got["missing_count"], got["maximum"]) == (4, 1, 10)
    assert got["population_standard_deviation"] == pytest.approx(np.std(known))
    assert got["p95"] == pytest.approx(np.quantile(known, 0.95))


def test_profiles(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", "10"), (1, "a", "x", "10"), (2, "a", None, "zz"), (3, None, "y", None)], "k int, r string, m string, n string"
    )
    ids = profiling.profile_ids(df, "k", "r").first()
    assert (ids["rows"], ids["unique_records"], ids["rows_under_repeated_record"], ids["exact_copies"]) == (4, 3, 2, 2)
    assert (ids["unique_references"], ids["rows_under_repeated_reference"]) == (1, 3)
    missing = {r["column"]: r["missing_percent"] for r in profiling.profile_missing(df, df.columns).collect()}
    assert missing == {"k": 0.0, "r": 25.0, "m": 25.0, "n": 25.0}
    numeric = profiling.profile_numeric(df, "n", text.unsigned(F.col("n")), {"over_9": 9}).first()
    assert (numeric["available"], numeric["malformed"], numeric["over_9"], numeric["p50"]) == (3, 1, 2, 10.0)
    repeats = profiling.profile_repeats(df, "r", "m", ["r", "m"]).first()
    assert (repeats["repeated_references"], repeats["references_with_several_components"], repeats["repeated_combinations"]) == (1, 0, 1)
    bins = dict(rows(profiling.profile_histogram(spark.range(11), F.col("id"), 0, 10.0, 5), "bin", "rows"))
    assert bins == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    shares = {r["value"]: r["percent"] for r in profiling.profile_groups(df, "m").collect()}
    assert shares["x"] == 50.0


def test_buckets_spread_shares_and_time_stamps(spark):
    shares = spark.range(1_000_000).select(F.rand(5).alias("x"))
    stamps = spark.range(1_000_000).select((F.lit(1.6e9) + F.rand(6) * 31_536_000).alias("x"))
    for rows in (shares, stamps):
        largest = rows.groupBy(ordered.value_bucket(F.col("x")).alias("b")).count().agg(F.max("count")).first()[0]
        assert largest <= 0.011 * 1_000_000


def test_buckets_follow_the_order_of_numbers(spark):
    values = [-1e300, -2.5, -1.0, -1e-300, 0.0, 1e-310, 1e-9, 0.3, 0.5, 1.0, 1.0000001, 7.0, 1e300]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered.value_bucket(F.col("x")).alias("b"))
    buckets = [r["b"] for r in rows.orderBy("x").collect()]
    assert buckets == sorted(buckets)
