"""Raw complaint rows to clean events, event features and cohort features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import identity, numbers, ordered, text
from cohortlens.session import stage


def _present_but(parsed: Column, source: Column) -> Column:
    return source.isNotNull() & parsed.isNull()


def _identity(normalize: Callable[[Column], Column]) -> dict[str, Column]:
    c = F.col
    return {
        "normalized_make": F.when(~text.is_blank(c("MAKETXT")), normalize(c("MAKETXT"))),
        "normalized_model": F.when(~text.is_blank(c("MODELTXT")), normalize(c("MODELTXT"))),
        "model_year": text.model_year(c("YEARTXT")),
    }


def with_labels(
    raw: DataFrame, normalize: Callable[[Column], Column] = text.normalize_identity
) -> DataFrame:
    """``raw`` with what its labels tell: make, model, year, cohort id and component.

    Labels are parsed once for each distinct product and component, not for each row. Both tables are staged, so Catalyst
    sees their true size and picks the joins from that. ``map_complaints`` keeps the columns that it finds.
    """
    c = F.col

    def joined(df: DataFrame, names: tuple[str, ...], parsed: DataFrame, label: str) -> DataFrame:
        side = stage(parsed, label).withColumnsRenamed({n: f"_{n}" for n in names})
        same = F.lit(True)
        for n in names:
            same = same & c(n).eqNullSafe(c(f"_{n}"))
        return df.join(side, same).drop(*[f"_{n}" for n in names])

    product = ("MAKETXT", "MODELTXT", "YEARTXT")
    products = raw.select(*product).distinct().withColumns(_identity(normalize)).withColumn(
        C.COHORT_ID, identity.association_id(c("normalized_make"), c("normalized_model"), c("model_year"))
    )
    components = raw.select("COMPDESC").distinct().withColumn("component", text.component(c("COMPDESC")))
    out = joined(raw, product, products, "complaint-products")
    return joined(out, ("COMPDESC",), components, "complaint-components")


def map_complaints(
    raw: DataFrame, normalize: Callable[[Column], Column] = text.normalize_identity
) -> DataFrame:
    """Parse raw rows; keep every row and say in ``reason`` why it is rejected.

    The first failed check wins, in the order the checks are listed. ``detail`` names
    the field and value that failed. Spark compares column names without case, so no
    parsed column may differ from a source column by case alone.
    """
    c = F.col
    known = {n: v for n, v in _identity(normalize).items() if n not in raw.columns}
    parsed = raw.withColumns(
        {
            **known,
            "mileage": text.unsigned(c("MILES")),
            "death_count": text.unsigned(c("DEATHS")),
            "injury_count": text.unsigned(c("INJURED")),
            "crash_observed": text.yes_no(c("CRASH")),
            "fire_observed": text.yes_no(c("FIRE")),
            "occurrence_date": text.compact_date(c("FAILDATE")),
            "report_date": text.compact_date(c("LDATE")),
            "_drivetrain": text.lookup(
                text.squeeze(F.regexp_replace(normalize(c("DRIVE_TRAIN")), "[-_]", " ")),
                C.DRIVETRAIN_ALIASES,
            ),
            "_transmission": text.lookup(c("TRANS_TYPE"), {"AUTO": "automatic", "MAN": "manual"}),
        }
    )
    def malformed(name: str, pattern: str) -> Column:
        return c(name).isNotNull() & ~text.matches(c(name), pattern)

    checks: list[tuple[str, str, Column]] = [
        ("unsupported_product_type", "PROD_TYPE", ~c("PROD_TYPE").eqNullSafe("V")),
        ("missing_source_identifier", "CMPLID", c("CMPLID").isNull()),
        ("malformed_source_identifier", "CMPLID", malformed("CMPLID", "[0-9]{1,9}")),
        ("missing_source_identifier", "ODINO", c("ODINO").isNull()),
        ("malformed_source_identifier", "ODINO", malformed("ODINO", "[0-9]{1,9}")),
        ("missing_vehicle_identity", "MAKETXT", c("normalized_make").isNull()),
        ("missing_vehicle_identity", "MODELTXT", c("normalized_model").isNull()),
        ("invalid_model_year", "YEARTXT", c("model_year").isNull()),
        ("malformed_mileage", "MILES", _present_but(c("mileage"), c("MILES"))),
        ("malformed_count", "DEATHS", _present_but(c("death_count"), c("DEATHS"))),
        ("malformed_count", "INJURED", _present_but(c("injury_count"), c("INJURED"))),
        ("malformed_indicator", "CRASH", _present_but(c("crash_observed"), c("CRASH"))),
        ("malformed_indicator", "FIRE", _present_but(c("fire_observed"), c("FIRE"))),
        ("malformed_date", "FAILDATE", _present_but(c("occurrence_date"), c("FAILDATE"))),
        ("malformed_date", "LDATE", _present_but(c("report_date"), c("LDATE"))),
    ]
    failures = [
        F.when(
            bad,
            F.struct(
                F.lit(reason).alias("reason"),
                F.concat_ws("=", F.lit(name), F.coalesce(c(name), F.lit("null"))).alias("detail"),
            ),
        )
        for reason, name, bad in checks
    ]
    mapped = parsed.withColumn("_failure", F.coalesce(*failures)).withColumns(
        {"reason": c("_failure.reason"), "detail": c("_failure.detail")}
    )
    known = c("_transmission").isNotNull() & c("_drivetrain").isNotNull()
    return mapped.withColumns(
        {
            "component": c("component") if "component" in raw.columns else text.component(c("COMPDESC")),
            "severity": text.severity(
                c("death_count"), c("injury_count"), c("crash_observed"), c("fire_observed")
            ),
            "known_configuration_id": F.when(
                known,
                identity.configuration_id(
                    c("normalized_make"), c("normalized_model"), c("model_year"),
                    c("_transmission"), c("_drivetrain"),
                ),
            ),
        }
    ).drop("_failure", "_drivetrain", "_transmission")


def quality_flags(mapped: DataFrame) -> Column:
    """Sorted array of the non-destructive observations on one mapped row."""
    c = F.col
    delay = F.date_diff(c("report_date"), c("occurrence_date"))
    length = F.length(c("CDESCR"))
    controls = [text.has_control_character(c(n)) for n in ("MAKETXT", "MODELTXT", "COMPDESC", "CDESCR")]
    conditions = {
        "broad_other_component": c("component") == "other",
        "encoding_control_character": controls[0] | controls[1] | controls[2] | controls[3],
        "extreme_mileage": c("mileage") > C.EXTREME_MILEAGE,
        "extreme_report_delay": delay > C.EXTREME_DELAY_DAYS,
        "future_model_year": c("model_year") > F.year(c("report_date")),
        "missing_configuration_detail": c("known_configuration_id").isNull(),
        "missing_mileage": c("mileage").isNull(),
        "missing_narrative": c("CDESCR").isNull(),
        "negative_report_delay": delay < 0,
        "oversized_narrative": length > C.LONG_NARRATIVE,
        "short_narrative": length <= C.SHORT_NARRATIVE,
        "zero_mileage": c("mileage") == 0,
    }
    # The dictionary is in alphabetical order, so the array is sorted as built.
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in conditions.items()]))


def clean_complaints(mapped: DataFrame) -> DataFrame:
    """Accepted rows: source values beside canonical ones, plus quality flags."""
    c = F.col
    return mapped.where(c("reason").isNull()).select(
        identity.event_id(c("CMPLID")).alias("event_id"),
        F.lit(C.EVENT_SOURCE_TYPE).alias("source_type"),
        c("CMPLID").alias("source_record_id"),
        c("ODINO").alias("source_reference_id"),
        c(C.COHORT_ID) if C.COHORT_ID in mapped.columns else identity.association_id(
            c("normalized_make"), c("normalized_model"), c("model_year")
        ).alias(C.COHORT_ID),
        "known_configuration_id",
        c("MAKETXT").alias("source_make"),
        "normalized_make",
        c("MODELTXT").alias("source_model"),
        "normalized_model",
        c("YEARTXT").alias("source_model_year"),
        "model_year",
        "component",
        c("COMPDESC").alias("source_component"),
        "severity",
        "death_count",
        "injury_count",
        c("crash_observed").alias("crash"),
        c("fire_observed").alias("fire"),
        "mileage",
        F.lit(C.MILEAGE_UNIT).alias("mileage_unit"),
        "occurrence_date",
        "report_date",
        c("CDESCR").alias("narrative"),
        quality_flags(mapped).alias("quality_flags"),
    )


def clean_from_raw(
    raw: DataFrame, normalize: Callable[[Column], Column] = text.normalize_identity, *, by_label: bool = False
) -> DataFrame:
    """Accepted rows only. The first check runs as a filter that reaches the scan, so rows
    of other products are never parsed; the result is that of mapping every row. ``by_label`` parses each
    distinct label once (``with_labels``), which reads ``raw`` three times."""
    rows = raw.where(F.col("PROD_TYPE") == "V")
    return clean_complaints(map_complaints(with_labels(rows, normalize) if by_label else rows, normalize))


def excluded_complaints(mapped: DataFrame) -> DataFrame:
    """Rejected rows with their original evidence, the reason and the failing field."""
    c = F.col
    return mapped.where(c("reason").isNotNull()).select(
        c("CMPLID").alias("source_record_id"),
        c("ODINO").alias("source_reference_id"),
        c("PROD_TYPE").alias("source_product_type"),
        c("MAKETXT").alias("source_make"),
        c("MODELTXT").alias("source_model"),
        c("YEARTXT").alias("source_model_year"),
        c("COMPDESC").alias("source_component"),
        "reason",
        c("detail").alias("message"),
    )


def reason_counts(mapped: DataFrame) -> DataFrame:
    rejected = mapped.where(F.col("reason").isNotNull())
    return rejected.groupBy("reason").agg(F.count("*").alias("rows"))


def flag_counts(clean: DataFrame) -> DataFrame:
    """Rows per quality flag; every flag is listed, also with zero rows."""
    hits = clean.agg(
        *[F.count_if(F.array_contains("quality_flags", n)).alias(n) for n in C.QUALITY_FLAGS]
    )
    return hits.unpivot([], list(C.QUALITY_FLAGS), "flag", "rows")


def event_features(clean: DataFrame) -> DataFrame:
    """One row per clean event, 42 columns in declared order."""
    c = F.col
    report_age, report_early = numbers.age(c("report_date"), c("model_year"))
    occurrence_age, occurrence_early = numbers.age(c("occurrence_date"), c("model_year"))
    derived = clean.withColumns(
        {
            "report_year": F.year("report_date"),
            "report_month": F.month("report_date"),
            "occurrence_year": F.year("occurrence_date"),
            "vehicle_age_at_report_years": report_age,
            "report_before_model_year": report_early,
            "vehicle_age_at_occurrence_years": occurrence_age,
            "occurrence_before_model_year": occurrence_early,
            "occurrence_to_report_delay_days": F.date_diff("report_date", "occurrence_date"),
            "mileage_observed": c("mileage").isNotNull(),
            "crash_positive": c("crash"),
            "fire_positive": c("fire"),
            "injury_positive": c("injury_count") > 0,
            "death_positive": c("death_count") > 0,
            **{f"quality_{n}": F.array_contains("quality_flags", n) for n in C.QUALITY_FLAGS},
        }
    )
    return derived.select(*C.EVENT_FEATURE_COLUMNS)


def cohort_features(events: DataFrame) -> DataFrame:
    """One row per (make, model, year), 93 columns in declared order.

    Three narrow branches meet at cohort grain: counts that combine on the map side,
    exact distinct counts, and exact medians. No branch holds a whole cohort in one task.
    """
    c, key = F.col, list(C.KEY)
    total = c("complaint_event_count")
    counts = [
        F.min(C.COHORT_ID).alias(C.COHORT_ID),
        F.count("*").alias("complaint_event_count"),
        F.min("report_date").alias("first_observed_report_date"),
        F.max("report_date").alias("last_observed_report_date"),
        F.count("known_configuration_id").alias("known_configuration_count"),
        F.count("mileage").alias("mileage_observed_count"),
        F.count("occurrence_to_report_delay_days").alias("report_delay_observed_count"),
    ]
    shares = {
        "known_configuration_share": "known_configuration_count",
        "mileage_observed_share": "mileage_observed_count",
        "report_delay_observed_share": "report_delay_observed_count",
    }
    for field, names in (("component", C.COMPONENTS), ("severity", C.SEVERITIES)):
        for name in names:
            stem = f"{field}_{name}_complaint"
            counts.append(F.count_if(c(field) == name).alias(f"{stem}_count"))
            shares[f"{stem}_share"] = f"{stem}_count"
    for name in C.QUALITY_FLAGS:
        counts.append(F.count_if(c(f"quality_{name}")).alias(f"quality_{name}_count"))
        shares[f"quality_{name}_share"] = f"quality_{name}_count"
    evidence = {}
    for name in C.EVIDENCE:
        observed, positive = f"{name}_evidence_observed_count", f"{name}_positive_count"
        counts.append(F.count(f"{name}_positive").alias(observed))
        counts.append(F.count_if(c(f"{name}_positive")).alias(positive))
        evidence[f"{name}_positive_share_of_observed"] = numbers.share(c(positive), c(observed))
    base = events.groupBy(*key).agg(*counts)
    distinct = ordered.distinct_counts(
        events,
        key,
        {
            "unique_event_count": c("event_id"),
            "unique_source_reference_count": c("source_reference_id"),
        },
    )
    medians = ordered.grouped_medians(
        events,
        key,
        {
            "mileage_all_observed_median_miles": c("mileage"),
            "report_delay_median_days": c("occurrence_to_report_delay_days"),
        },
    )
    joined = base.join(distinct, key, "left").join(medians, key, "left")
    filled = joined.withColumns(
        {
            **{share: c(part) / total for share, part in shares.items()},
            **evidence,
            "unique_event_count": F.coalesce("unique_event_count", F.lit(0)),
            "unique_source_reference_count": F.coalesce("unique_source_reference_count", F.lit(0)),
        }
    )
    return filled.select(*C.COHORT_FEATURE_COLUMNS)


def cohort_guards(events: DataFrame) -> DataFrame:
    """Counts that must be zero before a rollup is trusted (one row)."""
    ids = events.groupBy("event_id").agg(F.count("*").alias("n"))
    repeated = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_event_rows"))
    per_key = events.select(*C.KEY, C.COHORT_ID).distinct().groupBy(*C.KEY).agg(F.count("*").alias("n"))
    conflicting = per_key.agg(F.count_if(F.col("n") > 1).alias("cohorts_with_several_ids"))
    return ordered.side_by_side(repeated, conflicting)
