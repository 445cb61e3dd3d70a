from types import SimpleNamespace

import pytest

from cohortlens import session
from cohortlens.operators import complaints
from tests.helpers import complaints as rows_of


class _Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["yarn", "k8s://host", "local-cluster[2,1,1024]", "spark://host:7077"])
def test_a_cluster_needs_a_shared_folder(master):
    fake = SimpleNamespace(conf=_Conf(), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)


def test_staged_tables_are_released(spark):
    before = spark.conf.get(session.FOLDER_KEY)
    kept, session._STAGED = session._STAGED, {}
    try:
        staged = session.stage(spark.range(3), "numbers")
        assert staged.count() == 3
        (path,) = session._STAGED[spark.sparkContext.applicationId]
        assert session.release(spark) == 1
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    finally:
        session._STAGED = kept
    assert spark.conf.get(session.FOLDER_KEY) == before


def test_counts_beyond_64_bits_and_labels_beyond_ascii(spark):
    raw = rows_of(spark, {"MILES": "9" * 20}, {"DEATHS": "1" * 25}, {"MAKETXT": "  Straße\u00a0ＧＴ "})
    found = [(r["reason"], r["normalized_make"]) for r in complaints.map_complaints(raw).collect()]
    assert found == [("malformed_mileage", "quillon"), ("malformed_count", "quillon"), (None, "strasse gt")]
