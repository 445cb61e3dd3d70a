import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens import schemas
from cohortlens.functions import identity, text
from cohortlens.operators import complaints as K
from tests.helpers import complaints, rows


def mapped(spark, *overrides):
    tagged = [{**o, "CITY": str(i)} for i, o in enumerate(overrides)]
    return K.map_complaints(complaints(spark, *tagged)).orderBy(F.col("CITY").cast("int"))


REJECTIONS = [
    ({"PROD_TYPE": "T"}, "unsupported_product_type"),
    ({"CMPLID": ""}, "missing_source_identifier"),
    ({"CMPLID": "ABC"}, "malformed_source_identifier"),
    ({"MAKETXT": ""}, "missing_vehicle_identity"),
    ({"MODELTXT": "   "}, "missing_vehicle_identity"),
    ({"YEARTXT": "9999"}, "invalid_model_year"),
    ({"YEARTXT": "1800"}, "invalid_model_year"),
    ({"YEARTXT": "0000"}, "invalid_model_year"),
    ({"INJURED": "many"}, "malformed_count"),
    ({"CRASH": "U"}, "malformed_indicator"),
    ({"FIRE": "y"}, "malformed_indicator"),
    ({"MILES": "-1"}, "malformed_mileage"),
    ({"MILES": "12.5"}, "malformed_mileage"),
    ({"MILES": " 100"}, "malformed_mileage"),
    ({"MILES": "5\n"}, "malformed_mileage"),
    ({"FAILDATE": "20200230"}, "malformed_date"),
    ({"FAILDATE": "2020-01-01"}, "malformed_date"),
    ({"FAILDATE": "00000101"}, "malformed_date"),
    ({"LDATE": "notadate"}, "malformed_date"),
    # the first failed check wins
    ({"PROD_TYPE": "T", "CMPLID": "", "YEARTXT": "9999"}, "unsupported_product_type"),
    ({"YEARTXT": "9999", "MILES": "x", "LDATE": "x"}, "invalid_model_year"),
    ({"DEATHS": "x", "MILES": "x"}, "malformed_mileage"),
    ({"CRASH": "U", "LDATE": "x"}, "malformed_indicator"),
]


def test_rejection_reasons(spark):
    found = rows(mapped(spark, *[o for o, _ in REJECTIONS]), "reason")
    assert [r[0] for r in found] == [reason for _, reason in REJECTIONS]


def test_optional_fields_may_be_blank(spark):
    blank = dict.fromkeys(("MILES", "FAILDATE", "LDATE", "TRANS_TYPE", "DRIVE_TRAIN"), "")
    row = mapped(spark, blank).first()
    assert row["reason"] is None
    assert row["mileage"] is None and row["report_date"] is None
    assert row["known_configuration_id"] is None


def test_severity(spark):
    cases = [
        (("1", "0", "N", "N"), "critical"), (("0", "2", "N", "N"), "high"),
        (("0", "0", "Y", "N"), "moderate"), (("0", "0", "N", "Y"), "moderate"),
        (("0", "0", "N", "N"), "low"), (("", "", "", ""), "unknown"),
        (("", "0", "N", "N"), "unknown"), (("", "1", "N", "N"), "high"),
    ]
    names = ("DEATHS", "INJURED", "CRASH", "FIRE")
    found = rows(mapped(spark, *[dict(zip(names, v, strict=True)) for v, _ in cases]), "severity")
    assert [r[0] for r in found] == [s for _, s in cases]


def test_components(spark):
    cases = {
        None: "unknown", " ": "unknown", "ENGINE": "engine", "engine:oil": "engine",
        "ENGINEERING": "other", "ENGINE AND ENGINE COOLING:COOLING SYSTEM:FAN": "cooling",
        "ENGINE AND ENGINE COOLING:EXHAUST SYSTEM": "exhaust",
        "ENGINE AND ENGINE COOLING": "engine", "FORWARD COLLISION AVOIDANCE": "other",
        "SERVICE BRAKES, HYDRAULIC:PADS": "brakes", "POWER TRAIN": "other",
        "POWER TRAIN:CLUTCH ASSEMBLY": "transmission", "SEAT BELTS": "airbags_restraints",
        " wheels ": "tires_wheels",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    found = dict(rows(df, "v", text.component(F.col("v"))))
    assert found == cases


def test_clean_keeps_originals_and_normalizes(spark):
    row = K.clean_complaints(mapped(spark, {"MAKETXT": "  ＭＡＺＤＡ ", "MODELTXT": "CX\t 5"})).first()
    assert (row["normalized_make"], row["normalized_model"]) == ("mazda", "cx 5")
    assert (row["source_make"], row["source_model"]) == ("  ＭＡＺＤＡ ", "CX\t 5")
    assert row["quality_flags"] == []


FLAGS = [
    ({"MILES": ""}, {"missing_mileage"}),
    ({"MILES": "0"}, {"zero_mileage"}),
    ({"MILES": "500001"}, {"extreme_mileage"}),
    ({"MILES": "500000"}, set()),
    ({"YEARTXT": "2021", "FAILDATE": "20200102", "LDATE": "20200101"}, {"future_model_year", "negative_report_delay"}),
    ({"FAILDATE": "20000101"}, {"extreme_report_delay"}),
    ({"CDESCR": "x" * 10}, {"short_narrative"}),
    ({"CDESCR": "x" * 2049}, {"oversized_narrative"}),
    ({"CDESCR": "a narrative with \u0081"}, {"encoding_control_character"}),
    ({"CDESCR": ""}, {"missing_narrative"}),
    ({"COMPDESC": "POWER TRAIN"}, {"broad_other_component"}),
    ({"DRIVE_TRAIN": "tiptronic"}, {"missing_configuration_detail"}),
    ({"TRANS_TYPE": "CVT"}, {"missing_configuration_detail"}),
]


def test_quality_flags(spark):
    tagged = [{**o, "CMPLID": str(i + 1)} for i, (o, _) in enumerate(FLAGS)]
    clean = K.clean_complaints(K.map_complaints(complaints(spark, *tagged)))
    found = {int(r[0]): r[1] for r in rows(clean, "source_record_id", "quality_flags")}
    for i, (_, wanted) in enumerate(FLAGS):
        assert found[i + 1] == sorted(wanted)


def test_clean_and_excluded_conserve_rows(spark):
    m = mapped(
        spark, {"CMPLID": "100", "ODINO": "900"}, {"CMPLID": "101", "ODINO": "900"},
        {"CMPLID": "102", "YEARTXT": "9999"}, {"CMPLID": "103", "PROD_TYPE": "T"},
    )
    assert K.clean_complaints(m).count() == 2
    assert sorted(rows(K.excluded_complaints(m), "source_record_id", "reason", "message")) == [
        ("102", "invalid_model_year", "YEARTXT=9999"), ("103", "unsupported_product_type", "PROD_TYPE=T"),
    ]
    schemas.assert_schema(K.clean_complaints(m), schemas.CLEAN_COMPLAINT)


def test_ids_equal_json_digests(spark):
    def digest(prefix, value):
        raw = json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        return prefix + hashlib.sha256(raw.encode()).hexdigest()

    make, model = 'förd "x"', "f/150"
    df = spark.createDataFrame([(make, model, 2020)], "a string, b string, y int")
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    row = df.select(
        identity.association_id(a, b, y), identity.vehicle_id(a, b, y, F.lit("mk2")),
        identity.configuration_id(a, b, y, F.lit("cvt"), F.lit("awd")),
        identity.application_id("nhtsa_mc", F.lit("1"), a, b, F.lit("2020")), identity.event_id(F.lit("77")),
    ).first()
    core = {"generation": None, "make": make, "model": model, "year": 2020}
    assert row[0] == digest("vehicle_association_", core)
    assert row[1] == digest("vehicle_", {**core, "generation": "mk2"})
    assert row[2] == digest(
        "configuration_", {**core, "trim": None, "engine": None, "transmission": "cvt", "drivetrain": "awd"}
    )
    assert row[3] == digest("nhtsa_mc_app_", ["1", make, model, "2020"])
    assert row[4] == digest(
        "event_",
        {
            "dataset": C.EVENT_DATASET, "organization": C.EVENT_ORGANIZATION,
            "source_record_id": "77", "source_type": C.EVENT_SOURCE_TYPE,
        },
    )


def test_normalization_and_aliases(spark):
    cases = {
        "  MAZDA  ": "mazda", " Mazda3\tSport ": "mazda3 sport", "GＴ": "gt", "Straße": "strasse",
        "ﬁat 500": "fiat 500", "a\u001cb": "a b", "  ": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert dict(rows(df, "v", text.normalize_identity(F.col("v")))) == cases
    both = text.normalize_by_dictionary(df, {"v": "folded"})
    assert dict(rows(both, "v", "folded")) == cases
    t = spark.createDataFrame([("continuously-variable transmission",), ("part-time sometimes",)], "v string")
    assert [r[0] for r in rows(t, text.transmission(F.col("v")))] == ["cvt", None]
    d = spark.createDataFrame([("rear-wheel-drive",), ("4WD",), ("four-wheel drive",), ("tiptronic",)], "v string")
    assert [r[0] for r in rows(d, text.drivetrain(F.col("v")))] == ["rwd", "four_wd", "four_wd", None]


def clean_rows(spark):
    base = {
        "source_type": "t", "source_make": "M", "source_model": "M", "source_model_year": "2020",
        "mileage_unit": "miles", "source_component": None, "narrative": "n",
    }
    d = dt.date
    mazda = {"broad_vehicle_id": "v1", "normalized_make": "mazda", "normalized_model": "mazda3", "model_year": 2020}
    ford = {"broad_vehicle_id": "v2", "normalized_make": "ford", "normalized_model": "focus", "model_year": 2025}
    none4 = dict.fromkeys(("death_count", "injury_count", "crash", "fire"))
    clear = {"death_count": 0, "injury_count": 0, "crash": False, "fire": False}
    table = [
        {**base, **mazda, **clear, "event_id": "e1", "source_record_id": "1", "source_reference_id": "900",
         "component": "engine", "severity": "low", "mileage": 100, "occurrence_date": d(2021, 1, 2),
         "report_date": d(2022, 1, 2), "quality_flags": ["missing_configuration_detail"]},
        {**base, **mazda, "death_count": 0, "injury_count": 2, "crash": True, "fire": False, "event_id": "e2",
         "source_record_id": "2", "source_reference_id": "900", "component": "brakes", "severity": "high",
         "mileage": 500001, "occurrence_date": d(2021, 6, 1), "report_date": d(2022, 6, 11),
         "quality_flags": ["extreme_mileage", "missing_configuration_detail"]},
        {**base, **mazda, **none4, "event_id": "e3", "source_record_id": "3", "source_reference_id": "901",
         "component": "other", "severity": "unknown", "mileage": None, "occurrence_date": None, "report_date": None,
         "quality_flags": ["broad_other_component", "missing_configuration_detail", "missing_mileage"]},
        {**base, **ford, **clear, "event_id": "e4", "source_record_id": "4", "source_reference_id": "902",
         "component": "engine", "severity": "low", "mileage": 100, "occurrence_date": d(2023, 1, 1),
         "report_date": d(2024, 1, 1), "quality_flags": ["future_model_year", "missing_configuration_detail"]},
    ]
    names = schemas.CLEAN_COMPLAINT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in table], schemas.CLEAN_COMPLAINT)


def test_event_features(spark):
    features = {r["event_id"]: r for r in K.event_features(clean_rows(spark)).collect()}
    e1, e4 = features["e1"], features["e4"]
    assert len(e1) == 42
    assert (e1["report_year"], e1["report_month"], e1["vehicle_age_at_report_years"]) == (2022, 1, 2)
    assert (e1["vehicle_age_at_occurrence_years"], e1["occurrence_to_report_delay_days"]) == (1, 365)
    assert e4["vehicle_age_at_report_years"] is None and e4["report_before_model_year"] is True
    assert e4["vehicle_age_at_occurrence_years"] is None and e4["occurrence_before_model_year"] is True
    assert features["e3"]["crash_positive"] is None and features["e3"]["mileage_observed"] is False


def test_cohort_features(spark):
    events = K.event_features(clean_rows(spark))
    for parts in (1, 7):
        table = K.cohort_features(events.repartition(parts)).orderBy("normalized_make").collect()
        assert [r["normalized_make"] for r in table] == ["ford", "mazda"]
        mazda = table[1]
        assert len(mazda) == 93
        assert mazda["complaint_event_count"] == mazda["unique_event_count"] == 3
        assert mazda["unique_source_reference_count"] == 2
        assert mazda["mileage_observed_count"] == 2
        assert mazda["mileage_observed_share"] == pytest.approx(2 / 3)
        assert mazda["mileage_all_observed_median_miles"] == 250050.5
        assert (mazda["crash_evidence_observed_count"], mazda["crash_positive_count"]) == (2, 1)
        assert mazda["crash_positive_share_of_observed"] == 0.5
        shares = [mazda[f"component_{n}_complaint_share"] for n in C.COMPONENTS]
        assert sum(shares) == pytest.approx(1)
        assert sum(r["complaint_event_count"] for r in table) == 4
    guards = K.cohort_guards(events).first()
    assert tuple(guards) == (0, 0)


def test_event_stream(spark, tmp_path):
    from cohortlens.streaming import event_feature_stream, read_complaint_stream
    from tests.helpers import complaint

    (tmp_path / "in").mkdir()
    lines = ["\t".join(v or "" for v in complaint(CMPLID=str(i))) for i in (1, 2)]
    lines.append("\t".join(v or "" for v in complaint(PROD_TYPE="T")))
    (tmp_path / "in" / "a.txt").write_bytes("\n".join(lines).encode("latin-1"))
    stream = event_feature_stream(read_complaint_stream(spark, str(tmp_path / "in")))
    query = (
        stream.writeStream.format("memory").queryName("event_features_out")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("event_features_out").count() == 2


def test_labels_parsed_once_tell_the_same(spark):
    raw = complaints(
        spark, {}, {"CMPLID": "2"}, {"CMPLID": "3", "MAKETXT": " QUILLON ", "COMPDESC": "TIRES"}, {"CMPLID": "4", "COMPDESC": ""},
        {"CMPLID": "5", "MODELTXT": ""}, {"CMPLID": "6", "YEARTXT": "9999"}, {"CMPLID": "7", "PROD_TYPE": "T"}, {"CMPLID": "8", "YEARTXT": ""},
        {"CMPLID": "9", "MAKETXT": "STRASSE \u00df"}, {"CMPLID": "10", "LDATE": "20230229"},
    )
    each, once = K.clean_from_raw(raw), K.clean_from_raw(raw, by_label=True)
    assert each.columns == once.columns and once.count() == 5
    assert each.exceptAll(once).isEmpty() and once.exceptAll(each).isEmpty()


def test_compact_dates(spark):
    days = {
        "20200229": "2020-02-29", "00010101": "0001-01-01", "99991231": "9999-12-31", "20230229": None, "00000101": None, "": None,
        "2020-01-01": None, "2020": None, "202001011": None, " 20200101": None, "20200101\n": None, "--": None, "20201301": None,
        "\u0662\u0660\u0662\u0660\u0660\u0661\u0660\u0661": None,
    }
    rows = spark.createDataFrame([(k, v) for k, v in days.items()] + [(None, None)], "value string, wanted string")
    got = rows.select("value", "wanted", text.compact_date(F.col("value")).cast("string").alias("got")).collect()
    assert [(r["value"], r["got"]) for r in got] == [(r["value"], r["wanted"]) for r in got]
