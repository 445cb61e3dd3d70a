import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens import schemas
from cohortlens.sources import readers, tables
from tests.helpers import complaint, complaints, rows


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def line(values):
    return "\t".join(v or "" for v in values)


def test_complaint_scan(spark, tmp_path):
    body = "\r\n".join([line(complaint(CDESCR='say "hi" \u0085 é', VEHICLE_OPERATOR="x")), line(complaint(CMPLID="2"))])
    df = readers.read_complaints(spark, write(tmp_path / "c.txt", body + "\r\n", "latin-1"))
    out = readers.checked(df, readers.width_rule()).orderBy("CMPLID").collect()
    assert len(out) == 2
    assert out[0]["CDESCR"] == 'say "hi" \u0085 é' and out[0]["VEHICLE_OPERATOR"] == "x"
    assert out[1]["VEHICLE_OPERATOR"] is None and out[1]["CITY"] is None


def test_complaint_scan_rejects_wrong_width(spark, tmp_path):
    short = line(complaint()[:50])
    df = readers.read_complaints(spark, write(tmp_path / "c.txt", line(complaint()) + "\n" + short + "\n"))
    with pytest.raises(readers.SourceError, match="wrong_field_count"):
        readers.checked(df, readers.width_rule())


def test_bounded_scan_is_marked(spark):
    df = spark.range(5)
    part, whole = readers.bounded(df, 2)
    assert part.count() == 2 and whole is False
    assert readers.bounded(df, None)[1] is True
    with pytest.raises(ValueError):
        readers.bounded(df, -1)


def recall(**over):
    row = {
        "RECORD_ID": "123456", "CAMPNO": "22V176000", "MAKETXT": " FÖRD ", "MODELTXT": " F-150 ", "YEARTXT": "2022",
        "COMPNAME": "SUSPENSION", "BGMAN": "20210101", "ENDMAN": "20211231", "RCLTYPECD": "V", "POTAFF": "100",
        "ODATE": "20220613", "RCDATE": "20220323", "DATEA": "20220324", "RPNO": "573", "DESC_DEFECT": 'a "quoted" text',
    }
    row.update(over)
    return tuple(row.get(n) for n in C.RECALL_COLUMNS)


def test_recall_scan_over_two_files(spark, tmp_path):
    a = write(tmp_path / "pre.txt", line(recall(RECORD_ID="1", CAMPNO="09V001000")) + "\n", "latin-1")
    b = write(tmp_path / "post.txt", line(recall()) + "\n\n", "latin-1")
    df = readers.checked(readers.read_recalls(spark, [a, b]), readers.recall_rules())
    found = sorted(rows(df, "CAMPNO", "source_file", "MAKETXT", "DESC_DEFECT"))
    assert found == [
        ("09V001000", "pre.txt", " FÖRD ", 'a "quoted" text'), ("22V176000", "post.txt", " FÖRD ", 'a "quoted" text'),
    ]


@pytest.mark.parametrize("over", [{"CAMPNO": "X2V1"}, {"RECORD_ID": "12345678901"}, {"YEARTXT": " "}])
def test_recall_rules(spark, tmp_path, over):
    path = write(tmp_path / "r.txt", line(recall(**over)) + "\n", "latin-1")
    with pytest.raises(readers.SourceError):
        readers.checked(readers.read_recalls(spark, path), readers.recall_rules())


def test_communication_scan(spark, tmp_path):
    good = ("10000001", "", "20210102", "TSB-1", "20201231", "", "Other", " FÖRD ", " F-150 ", "2020", "STEERING", "", "", "Sum")
    path = write(tmp_path / "t.txt", line(good) + "\r\n")
    df = readers.checked(readers.read_communications(spark, path), readers.communication_rules())
    row = df.first()
    assert row["make"] == " FÖRD " and row["summary"] == "Sum" and row["replacement"] is None
    bad = write(tmp_path / "b.txt", line(("x1", *good[1:])) + "\n")
    with pytest.raises(readers.SourceError, match="malformed_id"):
        readers.checked(readers.read_communications(spark, bad), readers.communication_rules())


def test_compact_scan_skips_repeated_headers(spark, tmp_path):
    head = ",".join(C.COMPACT_COLUMNS)
    body = f'{head}\n1,Ford,F-150,"2020,2021","two\nlines, ""quoted"""\n{head}\n2,Ford,F-150,9999,text\n'
    df = readers.checked(readers.read_compact(spark, write(tmp_path / "m.csv", body)), readers.compact_rules())
    found = sorted(rows(df, "source_id", "years", "summary"))
    assert found == [("1", "2020,2021", 'two\nlines, "quoted"'), ("2", "9999", "text")]


def production_entry(**over):
    return {
        "fuelPropulsionSystem": "SIF", "make": "FÖRD", "model": "  F-150 ", "modelYear": "2020", "platform": "P702",
        "reportCategory": "L", "totalProduction": 123, "typeCode": "PU", **over,
    }


def production(spark, tmp_path, results, meta=None):
    body = {"results": results}
    if meta is not None:
        body["meta"] = {"pagination": meta}
    path = write(tmp_path / "production-report-1.json", json.dumps(body, ensure_ascii=False))
    manifest = spark.createDataFrame(
        [("production-report-1.json", 2, "Ford", 10, 2024, 4)],
        "filename string, manufacturer_id int, manufacturer_name string, report_id long, reporting_year int, reporting_quarter int",
    )
    return readers.checked(readers.read_production(spark, path, manifest), readers.production_rules())


def test_production_scan(spark, tmp_path):
    entry = production_entry()
    bare = {k: v for k, v in production_entry(totalProduction=0).items() if k not in ("platform", "fuelPropulsionSystem")}
    found = production(spark, tmp_path, [entry, bare], {"nextUrl": None, "total": 2}).orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["total_production"], r["platform"]) for r in found] == [(1, 123, "P702"), (2, 0, None)]


@pytest.mark.parametrize(
    ("entry", "meta"),
    [
        (production_entry(reportCategory="M"), None), (production_entry(totalProduction=-1), None),
        (production_entry(make=""), None), (production_entry(), {"nextUrl": "more", "total": 1}),
        (production_entry(), {"nextUrl": None, "total": 2}), (production_entry(totalProduction=1.5), None),
    ],
)
def test_production_rules(spark, tmp_path, entry, meta):
    with pytest.raises(readers.SourceError):
        production(spark, tmp_path, [entry], meta)


def test_write_once_provenance_and_validation(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    path, side = str(tmp_path / "t"), str(tmp_path / "p")
    tables.write_table(df, path, order=["k"])
    with pytest.raises(AnalysisException):
        tables.write_table(df, path)
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    tables.write_provenance(tables.provenance(df, version="v1", run_ts=now), side)
    assert tables.validate_input(spark, path, side, version="v1").count() == 2
    with pytest.raises(readers.SourceError, match="version"):
        tables.validate_input(spark, path, side, version="v2")
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(readers.SourceError, match="checksum"):
        tables.validate_input(spark, path, side, version="v1")
    with pytest.raises(ValueError):
        tables.provenance(df, version="v1", run_ts=dt.datetime(2024, 1, 1))


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    first = tuple(tables.fingerprint(df).first())
    assert tuple(tables.fingerprint(df.repartition(5)).first()) == first
    assert tuple(tables.fingerprint(df.withColumn("v", F.col("v") + (F.col("id") == 3).cast("int"))).first()) != first


def test_schema_and_key_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(readers.SourceError, match="repeats"):
        readers.read_table(spark, str(tmp_path / "t"), df.schema, key=["k"])
    with pytest.raises(schemas.SchemaMismatch):
        schemas.assert_schema(df, schemas.COMPACT_SOURCE)
    with pytest.raises(schemas.SchemaMismatch):
        schemas.assert_columns(df, ("v", "k"))
    tables.require_empty(df.where("k = 2"), "none")
    with pytest.raises(readers.SourceError):
        tables.require_empty(df, "rows left")


def test_structured_scan_and_clean_rules(spark, tmp_path):
    complaints(spark, {}, {"CMPLID": "2"}).write.json(str(tmp_path / "j"))
    assert readers.read_structured(spark, str(tmp_path / "j")).count() == 2
    from tests.test_complaints import clean_rows

    good = clean_rows(spark)
    readers.checked(good, readers.clean_rules())
    for bad in (
        good.withColumn("component", F.lit("wheel")), good.withColumn("quality_flags", F.array(F.lit("x"))),
        good.withColumn("quality_flags", F.array(F.lit("zero_mileage"), F.lit("missing_mileage"))),
        good.withColumn("model_year", F.lit(1700)),
    ):
        with pytest.raises(readers.SourceError):
            readers.checked(bad, readers.clean_rules())
    tables.require_zero(tables.conservation(good.withColumn("reason", F.lit(None).cast("string"))), "unaccounted_rows")


def test_stages_of_a_run_are_chained(spark, tmp_path):
    root, now, versions = str(tmp_path), dt.datetime(2024, 1, 1, tzinfo=dt.UTC), {"a": "1", "b": "2", "c": "3"}
    df = spark.createDataFrame([(2, "y"), (1, "x")], "k int, v string")
    a = tables.write_stage(df, root, "a", version="1", run_ts=now)
    b = tables.write_stage(a.where("k = 1"), root, "b", version="2", run_ts=now, inputs=["a"])
    tables.write_stage(b.join(a, "k", "left").select("k", a["v"]), root, "c", version="3", run_ts=now, inputs=["a", "b"], order=["k"])
    assert [tuple(r) for r in tables.open_stage(spark, root, "c", versions).collect()] == [(1, "x")]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_stage(df, root, "a", version="1", run_ts=now)
    for wrong, said in (({**versions, "a": "9"}, "version differs"), ({"b": "2", "c": "3"}, "no version is wanted of a")):
        with pytest.raises(tables.SourceError, match=said):
            tables.open_stage(spark, root, "c", wrong)
    # Another run of the first stage, whole in itself, is not what the later ones were made from.
    other = tmp_path / "other"
    tables.write_stage(df.where("k = 2"), str(other), "a", version="1", run_ts=now)
    (tmp_path / "a").rename(tmp_path / "old")
    (other / "a").rename(tmp_path / "a")
    assert tables.open_stage(spark, root, "a", versions).count() == 1
    for name in ("b", "c"):
        with pytest.raises(tables.SourceError, match="made from another a"):
            tables.open_stage(spark, root, name, versions)
