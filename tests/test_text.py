"""The choice of the normalization rule by the labels themselves."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text

PLAIN = ["  Acme   Works ", "MODEL-3", "a\tb\n", "", "   ", None]


@pytest.mark.parametrize(("labels", "rule"), [
    (PLAIN, text.normalize_jvm), ([], text.normalize_jvm), ([None], text.normalize_jvm), ([*PLAIN, "FÖRD"], text.normalize_identity),
    (["ＡＢＣ"], text.normalize_identity), ([" "], text.normalize_identity),
])
def test_rule_follows_from_the_labels(spark, labels, rule):
    df = spark.createDataFrame([(v, "x") for v in labels], "a string, b string")
    assert text.normalizer(df) is rule and text.normalizer(df.select("b", "a")) is rule
    chosen = text.normalizer(df)(F.col("a"))
    got = df.select(chosen.alias("chosen"), text.normalize_identity(F.col("a")).alias("whole")).collect()
    assert all(r["chosen"] == r["whole"] for r in got)


def test_repeated_and_folded_labels(spark):
    df = spark.createDataFrame([(v,) for v in ["FÖRD", "ﬁat  ", "FÖRD", None, "Straße", "İ", "plain"] * 3], "a string")
    got = [r[0] for r in df.select(text.normalize_identity(F.col("a"))).collect()]
    assert got == ["förd", "fiat", "förd", None, "strasse", "i̇", "plain"] * 3
