"""Guards stop every reader of a table, whichever columns it asks for."""

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.modeling import metrics, models
from cohortlens.operators import communications, exposure, guards, integration
from tests.test_evidence import CANON, filing

COLUMNS = (
    "source_id string, replacement string, added string, document string, communicated string, campaign string, type string, "
    "make string, model string, year string, component string, system string, subsystem string, summary string"
)


def bulletin(source, summary, type_="Other"):
    return (source, "", "20200101", "D1", "20200102", "", type_, "acme", "one", "2020", "ENGINE", "", "", summary)


def stops(df, said):
    with pytest.raises(Exception, match=said):
        df.collect()


READS = {
    "all": lambda df: df,
    "count": lambda df: df.agg(F.count(F.lit(1))),
    "no id": lambda df: df.groupBy(df.columns[-1]).count(),
    "one column": lambda df: df.select(df.columns[1]).distinct(),
}


@pytest.mark.parametrize("read", READS.values(), ids=READS)
def test_documents_that_disagree(spark, read):
    good = spark.createDataFrame([bulletin("1", "a"), bulletin("1", "a"), bulletin("2", "b")], COLUMNS)
    assert read(communications.documents(good)).count() > 0
    bad = good.unionByName(spark.createDataFrame([bulletin("2", "c")], COLUMNS))
    stops(read(communications.documents(bad)), "differ within document 2")
    stops(communications.documents(bad).groupBy("communication_type").count(), "differ within document 2")
    stops(communications.document_profile(communications.documents(bad)), "differ within document 2")


@pytest.mark.parametrize("read", READS.values(), ids=READS)
def test_filings_of_one_period_that_disagree(spark, read):
    bad = spark.createDataFrame([filing("two", 2024, 123), filing("one", 2024, 124), filing("x", 2020, 1, model="other")], CANON)
    stops(read(exposure.latest_filings(bad)), "filings of one period differ")
    stops(read(exposure.aggregate_production(bad)), "filings of one period differ")
    old = spark.createDataFrame([filing("a", 2014, 1), filing("b", 2014, 2), filing("c", 2024, 3)], CANON)
    assert [r["source_record_id"] for r in exposure.latest_filings(old).collect()] == ["c"]
    empty = spark.createDataFrame([], CANON)
    assert exposure.latest_filings(empty).count() == 0
    blank = spark.createDataFrame([filing("b", 2024, None, fuel=None), filing("a", 2024, None, fuel=None)], CANON)
    assert [r["source_record_id"] for r in exposure.latest_filings(blank).collect()] == ["a"]


def sources(spark, ids):
    """Narrow tables with the columns that integration reads, one row for each id."""
    base = spark.createDataFrame([(i,) for i in ids], f"{C.COHORT_ID} string")

    def filled(names):
        kinds = {n: "array<string>" if n.endswith(("_ids", "_periods")) else "date" if n.endswith("_date") else "string" if n.endswith(("_status", "_method")) else "bigint" for n in names}
        return base.select(C.COHORT_ID, *[F.lit(1 if k == "bigint" else None).cast(k).alias(n) for n, k in kinds.items() if n != C.COHORT_ID])

    return (
        filled(C.COHORT_FEATURE_COLUMNS),
        filled(["production_match_status", "match_method", *integration.PRODUCTION_NAMES.values()]),
        filled(["manufacturer_communication_match_status", "match_method", *integration.COMMUNICATION_NAMES.values()]),
        filled(["recall_match_status", "match_method", *integration.RECALL_NAMES.values()]),
    )


@pytest.mark.parametrize(("table", "ids", "said"), [
    (0, "ab", "no or another cohort c"), (1, "abcc", "production has more than one row of c"), (2, "abcd", "no or another cohort d"), (3, "ab", "no or another cohort c"),
])
def test_integration_needs_each_cohort_once_everywhere(spark, table, ids, said):
    changed = [sources(spark, ids)[i] if i == table else t for i, t in enumerate(sources(spark, "abc"))]
    stops(READS["no id"](integration.integrate(*changed)), said)


def model_tables(spark, ids, year=2020):
    key = [(i, "acme", "one", year) for i in ids]
    schema = f"{C.COHORT_ID} string, normalized_make string, normalized_model string, model_year int"
    features = spark.createDataFrame(key, schema).withColumn("x", F.lit(1.0))
    return features, spark.createDataFrame(key, schema).withColumn("future_any_complaint", F.lit(True)), features.select(C.COHORT_ID, F.lit("TRAIN").alias("split"))


@pytest.mark.parametrize(("table", "ids", "said"), [(0, "abcc", "more than one row of c"), (1, "ab", "differ at cohort c"), (2, "abcd", "differ at cohort d")])
def test_model_dataset_needs_equal_tables(spark, table, ids, said):
    read, good = READS["one column"], model_tables(spark, "abc")
    assert models.model_dataset(*good).count() == 3
    changed = [model_tables(spark, ids)[i] if i == table else t for i, t in enumerate(good)]
    stops(read(models.model_dataset(*changed)), said)
    if table < 2:
        moved = [model_tables(spark, "abc", 2021)[i] if i == table else t for i, t in enumerate(good)]
        stops(read(models.model_dataset(*moved)), "differ at cohort")


def test_pairs_of_predictions(spark):
    left = spark.createDataFrame([("a", 1, 0.2), ("b", 0, 0.4)], "cohort_id string, target int, probability double")
    assert metrics.aligned(left, left).count() == 2
    for right, said in (
        (left.where("cohort_id = 'a'"), "rows or labels at b"), (left.withColumn("target", 1 - F.col("target")), "rows or labels"),
        (left.unionByName(left), "the right predictions has more than one row"),
    ):
        stops(metrics.agreement(metrics.aligned(left, right)), said)


def test_unique_passes_empty_tables_and_names_nulls(spark):
    empty = spark.createDataFrame([], "k string, v int")
    assert guards.unique(empty, "k", "it").count() == 0
    twice = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    stops(guards.unique(twice, "k", "it").agg(F.sum("v")), "it has more than one row of null")
