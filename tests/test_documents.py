"""Reports found through a manifest, and quoted text read in splits."""

import csv
import hashlib
import json
import random

import pytest

from bench import shuffled
from cohortlens import constants as C
from cohortlens.sources import readers
from tests.test_sources import production_entry


def snapshot(folder, reports, *, complete=True, change=None):
    """A folder of reports with its manifest; ``change`` edits the artifacts before they are written."""
    artifacts = []
    for i, entries in enumerate(reports, 1):
        name = f"production-report-{i}.json"
        body = json.dumps({"results": entries, "meta": {"pagination": {"nextUrl": None, "total": len(entries)}}}, indent=1)
        (folder / name).write_text(body)
        artifacts.append({"filename": name, "sha256": hashlib.sha256(body.encode()).hexdigest(), "manufacturer_id": 2, "manufacturer_name": "Maker", "reportId": i, "reporting_year": 2024, "reporting_quarter": 4})
    (folder / "years.json").write_text("[2024]")
    artifacts.append({"filename": "years.json", "sha256": hashlib.sha256(b"[2024]").hexdigest()})
    if change:
        change(artifacts)
    path = folder / "manifest.json"
    path.write_text(json.dumps({"complete_for_selected_scope": complete, "artifacts": artifacts}, indent=2))
    return str(path)


def opened(spark, folder, path):
    rows = readers.read_production(spark, str(folder), readers.read_manifest(spark, path))
    return readers.checked(rows, readers.production_rules())


def test_reports_of_a_manifest(spark, tmp_path):
    path = snapshot(tmp_path, [[production_entry(), production_entry(totalProduction=7)], [production_entry(make="other")]])
    (tmp_path / "production-report-9.json").write_text("not listed, not read")
    found = opened(spark, tmp_path, path).orderBy("report_id", "source_row_number").collect()
    assert [(r["report_id"], r["source_row_number"], r["total_production"]) for r in found] == [(1, 1, 123), (1, 2, 7), (2, 1, 123)]
    assert {(r["manufacturer_name"], r["reporting_year"]) for r in found} == {("Maker", 2024)}


@pytest.mark.parametrize(("change", "said"), [
    (lambda a: a[0].update(sha256="0" * 64), "checksum_mismatch"),
    (lambda a: a[-1].update(sha256="0" * 64), "checksum_mismatch"),
    (lambda a: a.append({**a[0], "filename": "production-report-7.json"}), "missing_file"),
    (lambda a: a[1].update(reporting_quarter=5), "invalid_quarter"),
    (lambda a: a[1].update(filename=""), "blank_filename"),
])
def test_faults_of_a_snapshot(spark, tmp_path, change, said):
    path = snapshot(tmp_path, [[production_entry()], [production_entry()]], change=change)
    with pytest.raises(readers.SourceError, match=said):
        opened(spark, tmp_path, path)


def test_manifests_that_are_none(spark, tmp_path):
    with pytest.raises(readers.SourceError, match="incomplete"):
        opened(spark, tmp_path, snapshot(tmp_path, [[production_entry()]], complete=False))
    broken = tmp_path / "broken.json"
    for text in ("{", "[]", '{"files": []}'):
        broken.write_text(text)
        with pytest.raises(readers.SourceError, match="not a manifest"):
            readers.read_manifest(spark, str(broken))


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_text_in_splits_equals_a_plain_reader(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    parts = ['plain', 'two\nlines', 'a "word" in quotes', '""', ',', 'ü\n\n\nend', 'x' * 300, '"\n"', "2020,2021"]
    expected = []
    for name in ("a.csv", "b.csv"):
        rows = [[str(rng.randrange(10**6)), *[rng.choice(parts) for _ in range(4)]] for _ in range(60)]
        expected += rows
        with open(tmp_path / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            for i, row in enumerate(rows):
                if i % 20 == 0:
                    writer.writerow(C.COMPACT_COLUMNS)
                writer.writerow(row)
    found = readers.read_compact(spark, str(tmp_path))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    got = sorted(tuple(r)[:5] for r in readers.checked(found, readers.width_rule()).collect())
    assert got == sorted(map(tuple, expected))


def test_even_splits_inside_and_outside_a_long_record(spark, tmp_path, small_splits):
    inner = "\n".join(f"line {i}" for i in range(120))
    (tmp_path / "a.csv").write_text("".join(f"{i},a,b,2020,s\n" for i in range(60)) + f'60,a,b,2020,"{inner}"\n' + "61,a,b,2020,t\n" * 60)
    got = sorted(tuple(r)[::4] for r in readers.read_compact(spark, str(tmp_path)).select("source_id", "make", "model", "years", "summary").collect())
    assert got == sorted([*[(str(i), "s") for i in range(60)], ("60", inner), *[("61", "t")] * 60])


def test_lines_of_even_splits_are_not_shuffled(spark, tmp_path):
    body = "".join(f"{i},{hashlib.sha256(str(i).encode()).hexdigest()},b,2020,s\n" for i in range(20000))
    (tmp_path / "a.csv").write_text(body)
    before = shuffled(spark)
    readers.read_compact(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 0.1


def test_short_and_blank_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,a,b,2020,"x"\n\n2,a,b\n')
    found = readers.read_compact(spark, str(tmp_path))
    assert found.count() == 2
    with pytest.raises(readers.SourceError, match="wrong_field_count"):
        readers.checked(found, readers.width_rule())
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "y.csv").write_text("")
    assert readers.read_compact(spark, str(tmp_path / "empty")).count() == 0
