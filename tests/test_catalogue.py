import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

SAMPLE = ["map_reasons", "latest_filing_sum", "two_view_audit", "campaign_rollup", "profile_dates", "unique_key_check"]


def test_every_check_belongs_to_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(checks) > 100
    assert all(callable(q) for q in queries.values())


class _Hidden:
    """Makes imports of some modules fail as if their files were gone."""

    def __init__(self, *names):
        self.names = names

    def find_spec(self, name, path=None, target=None):
        if any(name == n or name.startswith(f"{n}.") for n in self.names):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None


@pytest.mark.parametrize("gone", [("cohortlens.llm",), ("corpus_pipeline",), ("cohortlens.llm", "corpus_pipeline")])
def test_text_operators_can_be_taken_out(monkeypatch, gone):
    whole = entry.queries()
    for name in list(sys.modules):
        if name == "corpus_pipeline" or f"{name}.".startswith("cohortlens.llm."):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [_Hidden(*gone), *sys.meta_path])
    left, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(left) <= set(whole) and len(left) > 130 and "pipeline" not in left
    if "cohortlens.llm" in gone:
        assert not any(name.startswith("op") and name[2].isdigit() for name in left)


def test_other_import_errors_are_raised(monkeypatch):
    whole = entry.queries()
    if "pipeline" in whole:
        for name in list(sys.modules):
            if name == "corpus_pipeline" or f"{name}.".startswith("cohortlens.llm."):
                monkeypatch.delitem(sys.modules, name)
        monkeypatch.setattr(sys, "meta_path", [_Hidden("zstandard"), *sys.meta_path])
        monkeypatch.delitem(sys.modules, "zstandard", raising=False)
        with pytest.raises(ModuleNotFoundError, match="zstandard"):
            entry.queries()


def test_entry_has_the_cohort_columns(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 93 and not df.isEmpty()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    result = con.execute(entry.oracle_sql()[name])
    wanted = normal([d[0] for d in result.description], result.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == wanted
