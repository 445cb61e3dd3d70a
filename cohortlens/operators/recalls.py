"""Recall campaigns: campaign rollup, vehicle applications, cohort evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import identity, numbers, ordered, text
from cohortlens.operators.communications import fill_evidence

#: Campaign columns that the profile reads.
PROFILED = (
    "source_row_count", "potential_units_affected", "quality_flags", "original_components", "defect_descriptions",
    "report_received_dates", "corrective_actions", "recall_types", "manufacturer_campaign_numbers",
)

# Campaign column -> source column whose distinct non-null values it holds, sorted.
VALUE_SETS = {
    "manufacturer_campaign_numbers": "MFGCAMPNO",
    "filing_manufacturers": "MFGNAME",
    "recalled_manufacturers": "MFGTXT",
    "original_recall_type_codes": "RCLTYPECD",
    "initiators": "INFLUENCED_BY",
    "regulation_part_numbers": "RPNO",
    "fmvss_numbers": "FMVSS",
    "original_components": "COMPNAME",
    "defect_descriptions": "DESC_DEFECT",
    "consequence_descriptions": "CONEQUENCE_DEFECT",
    "corrective_actions": "CORRECTIVE_ACTION",
    "notes": "NOTES",
    "do_not_drive_values": "DO_NOT_DRIVE",
    "park_outside_values": "PARK_OUTSIDE",
}
DATE_SETS = {
    "report_received_dates": "RCDATE",
    "owner_notification_dates": "ODATE",
    "record_creation_dates": "DATEA",
}


def _field_sets(file_column: str) -> tuple[tuple[str, ...], ...]:
    """Fields that tend to change together: a row gives one value of each set, not one of each field."""
    return (
        (
            "MFGCAMPNO", "MFGNAME", "MFGTXT", "INFLUENCED_BY", "RPNO", "FMVSS", "POTAFF", "ODATE", "DESC_DEFECT",
            "CONEQUENCE_DEFECT", "CORRECTIVE_ACTION", "NOTES", "DO_NOT_DRIVE", "PARK_OUTSIDE",
        ),
        ("RCLTYPECD", "COMPNAME"),
        ("RCDATE", "DATEA", file_column),
    )


def _value_lists(rows: DataFrame, fields: list[str], file_column: str) -> DataFrame:
    """One row per campaign number: the sorted distinct values of each field as ``_<field>``, and the row count.

    Rows move once, as they are, so what is shuffled is bounded by the input whatever its order. A campaign with very
    many rows goes to several tasks; each makes its values distinct before they meet.
    """
    c = F.col
    every = [*VALUE_SETS.values(), *DATE_SETS.values(), "POTAFF", file_column]
    # A campaign is one with any value, whichever fields are asked for.
    rows = rows.select("CAMPNO", *fields, F.when(F.coalesce(*every).isNotNull(), "").alias("_present"))
    sets = [[n for n in names if n in fields] for names in _field_sets(file_column)]
    sets = [names for names in sets if names]
    sets[0].append("_present")
    width = max(len(names) for names in sets)
    dealt = ordered.spread(rows, "CAMPNO")

    def packed(index: int, names) -> Column:
        padded = [c(n) for n in names] + [F.lit(None).cast("string")] * (width - len(names))
        return F.struct(F.lit(index).alias("s"), *[v.alias(f"v{i}") for i, v in enumerate(padded)])

    slots = [f"v{i}" for i in range(width)]
    tuples = (
        dealt.select("CAMPNO", "_part", F.explode(F.array(*[packed(i, names) for i, names in enumerate(sets)])).alias("t"))
        .select("CAMPNO", "_part", "t.*")
        .groupBy("CAMPNO", "_part", "s", *slots)
        .agg(F.count("*").alias("n"))
    )
    named = F.lit(None).cast("array<struct<f:string,v:string>>")
    for i, names in enumerate(sets):
        pairs = F.array(*[F.struct(F.lit(n).alias("f"), c(f"v{j}").alias("v")) for j, n in enumerate(names)])
        named = F.when(c("s") == i, pairs).otherwise(named)
    long = tuples.select("CAMPNO", "_part", "n", F.explode(named).alias("p")).select("CAMPNO", "_part", "n", "p.f", "p.v")
    local = long.where(c("v").isNotNull()).groupBy("CAMPNO", "_part", "f", "v").agg(F.sum("n").alias("n"))
    values = local.select("CAMPNO", "f", "v", "n").repartition("CAMPNO").groupBy("CAMPNO", "f", "v").agg(F.sum("n").alias("n"))
    per_field = values.groupBy("CAMPNO", "f").agg(
        F.array_sort(F.collect_list("v")).alias("values"), F.sum("n").alias("n")
    )
    maps = per_field.groupBy("CAMPNO").agg(
        F.map_from_entries(F.collect_list(F.struct("f", "values"))).alias("_m"),
        F.sum(F.when(c("f") == file_column, c("n"))).alias("source_row_count"),
    )
    none = F.array().cast("array<string>")
    return maps.select(
        "CAMPNO", "source_row_count", *[F.coalesce(F.try_element_at("_m", F.lit(n)), none).alias(f"_{n}") for n in fields]
    )


def campaigns(rows: DataFrame, file_column: str = "source_file", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per campaign number, with the sorted distinct values of every field.

    ``columns`` names what is wanted beside the campaign's id and number; only the fields behind it are moved.
    """
    c = F.col
    population = F.array_sort(
        F.transform(
            F.filter(c("_POTAFF"), lambda v: text.matches(v, "[0-9]+")),
            lambda v: v.try_cast("bigint"),
        )
    )
    dates = {n: F.transform(c(f"_{s}"), text.compact_date) for n, s in DATE_SETS.items()}
    bad_date = F.lit(False)
    for parsed in dates.values():
        bad_date = bad_date | F.exists(parsed, lambda d: d.isNull())
    many = F.size("potential_units_affected_values") > 1
    # Output column -> its expression and the source fields behind it.
    built = {
        **{n: (c(f"_{s}"), [s]) for n, s in VALUE_SETS.items()},
        "recall_types": (F.array_sort(F.array_distinct(F.transform("_RCLTYPECD", text.recall_type))), ["RCLTYPECD"]),
        **{n: (F.array_sort(F.array_compact(d)), [DATE_SETS[n]]) for n, d in dates.items()},
        "potential_units_affected": (
            F.when(
                F.size("potential_units_affected_values") == 1,
                F.try_element_at("potential_units_affected_values", F.lit(1)),
            ),
            ["POTAFF"],
        ),
        "potential_units_affected_values": (c("potential_units_affected_values"), ["POTAFF"]),
        "canonical_components": (text.component_of_roots(c("_COMPNAME")), ["COMPNAME"]),
        "quality_flags": (
            F.array_compact(
                F.array(
                    F.when(many, "multiple_potential_units_affected_values"),
                    F.when(bad_date, "unparseable_date_value"),
                )
            ),
            ["POTAFF", *DATE_SETS.values()],
        ),
        "source_artifact_filenames": (c(f"_{file_column}"), [file_column]),
        "source_row_count": (c("source_row_count"), [file_column]),
    }
    wanted = list(built) if columns is None else list(columns)
    fields = list(dict.fromkeys(s for n in wanted for s in built[n][1]))
    lists = _value_lists(rows, fields, file_column)
    if "POTAFF" in fields:
        lists = lists.withColumn("potential_units_affected_values", population)
    return lists.select(
        F.concat(F.lit(f"{C.RECALL_PREFIX}_"), c("CAMPNO")).alias("campaign_id"),
        c("CAMPNO").alias("campaign_number"),
        *[built[n][0].alias(n) for n in wanted],
    )


#: Source fields whose values make a row one of a campaign, beside the file's name.
_FIELDS = (*VALUE_SETS.values(), *DATE_SETS.values(), "POTAFF")
SIGNAL_FIELDS = ("CAMPNO", *_FIELDS, "source_file")


def signals(rows: DataFrame, columns: Sequence[str], file_column: str = "source_file") -> DataFrame:
    """One row per campaign number with numbers only, for readers that count campaigns and do not show them.

    ``columns`` is a choice of ``first_report_date``, ``component_bits``, ``has_rule``, ``has_stop`` and ``has_park``. Rows of a
    campaign are combined where they are read, without sets. The result lies by ``campaign_number``.
    """
    c = F.col
    built = {
        "first_report_date": lambda: F.min("_day"),
        "component_bits": lambda: F.bit_or("component_bits"),
        "has_rule": lambda: F.coalesce(F.bool_or(c("FMVSS").isNotNull() | c("RPNO").isNotNull()), F.lit(False)),
        "has_stop": lambda: F.coalesce(F.bool_or(c("DO_NOT_DRIVE") == "Yes"), F.lit(False)),
        "has_park": lambda: F.coalesce(F.bool_or(c("PARK_OUTSIDE") == "Yes"), F.lit(False)),
    }
    kept = rows.where(F.coalesce(*_FIELDS, file_column).isNotNull())
    if "component_bits" in columns:
        kept = text.component_bits(kept, "COMPNAME", "component_bits")
    if "first_report_date" in columns:
        kept = kept.withColumn("_day", text.compact_date(c("RCDATE")))
    return kept.groupBy(c("CAMPNO").alias("campaign_number")).agg(*[built[n]().alias(n) for n in columns])


def applications(
    rows: DataFrame,
    normalize: Callable[[Column], Column] = text.normalize_identity,
    file_column: str = "source_file",
) -> DataFrame:
    """Vehicle rows only, each kept with its own source identity."""
    c = F.col
    vehicles = rows.where(text.recall_type(c("RCLTYPECD")) == "VEHICLE")
    parts = [c(n) for n in ("CAMPNO", "RECORD_ID", "MAKETXT", "MODELTXT", "YEARTXT")]
    return vehicles.select(
        identity.application_id(C.RECALL_PREFIX, *parts).alias("applicability_id"),
        F.concat(F.lit(f"{C.RECALL_PREFIX}_"), c("CAMPNO")).alias("campaign_id"),
        c("CAMPNO").alias("campaign_number"),
        F.concat(F.lit(f"{C.RECALL_PREFIX}_row_"), c("RECORD_ID")).alias("source_record_id"),
        c("RECORD_ID").alias("source_record_number"),
        c("MAKETXT").alias("original_make"),
        c("MODELTXT").alias("original_model"),
        c("YEARTXT").alias("original_model_year"),
        normalize(c("MAKETXT")).alias("normalized_make"),
        normalize(c("MODELTXT")).alias("normalized_model"),
        text.model_year(c("YEARTXT")).alias("model_year"),
        c("RCLTYPECD").alias("original_product_type_code"),
        text.recall_type(c("RCLTYPECD")).alias("product_type"),
        c("COMPNAME").alias("original_component"),
        text.component(c("COMPNAME")).alias("canonical_component"),
        c("BGMAN").alias("manufacturing_begin_date_raw"),
        text.compact_date(c("BGMAN")).alias("manufacturing_begin_date"),
        c("ENDMAN").alias("manufacturing_end_date_raw"),
        text.compact_date(c("ENDMAN")).alias("manufacturing_end_date"),
        c("RCL_CMPT_ID").alias("recalled_component_id"),
        c("MFR_COMP_NAME").alias("manufacturer_component_name"),
        c("MFR_COMP_DESC").alias("manufacturer_component_description"),
        c("MFR_COMP_PTNO").alias("manufacturer_component_part_number"),
        c(file_column).alias("source_artifact_filename"),
    )


#: Campaign columns that cohort evidence reads.
EVIDENCE_FACTS = (
    "report_received_dates", "recall_types", "canonical_components", "fmvss_numbers", "potential_units_affected",
    "corrective_actions",
)


def cohort_evidence(
    cohorts: DataFrame, matched: DataFrame, campaign_table: DataFrame, campaign: str = "campaign_id"
) -> DataFrame:
    """Whole-history recall evidence per cohort; unmatched cohorts have zeros.

    Noncompliance here means a safety-standard number only. The first and last dates
    run over all report dates of the matched campaigns.
    """
    c = F.col
    hits = matched.where(c("matched_broad_vehicle_id").isNotNull())
    # Repeated rows give one application id, and an application is counted once.
    unique = hits.groupBy(
        c("matched_broad_vehicle_id").alias(C.COHORT_ID), campaign, "applicability_id"
    ).agg(F.count("*").alias("_rows"))
    pairs = unique.groupBy(C.COHORT_ID, campaign).agg(F.count("*").alias("_apps"))
    facts = campaign_table.select(
        campaign,
        F.array_min("report_received_dates").alias("_first"),
        F.array_max("report_received_dates").alias("_last"),
        "recall_types",
        "canonical_components",
        numbers.has_any(c("fmvss_numbers")).alias("_standard"),
        c("potential_units_affected").isNotNull().alias("_population"),
        numbers.has_any(c("corrective_actions")).alias("_remedy"),
    )
    per_cohort = pairs.join(facts, campaign).groupBy(C.COHORT_ID).agg(
        F.count("*").alias("unique_recall_campaign_count"),
        F.sum("_apps").alias("recall_applicability_row_count"),
        F.min("_first").alias("first_recall_date"),
        F.max("_last").alias("last_recall_date"),
        F.count_if("_standard").alias("noncompliance_campaign_count"),
        F.count_if("_population").alias("known_affected_population_campaign_count"),
        F.count_if("_remedy").alias("remedy_observed_campaign_count"),
        *[
            F.count_if(F.array_contains("recall_types", n)).alias(
                f"recall_type_{n.lower()}_campaign_count"
            )
            for n in C.RECALL_TYPES
        ],
        *[
            F.count_if(F.array_contains("canonical_components", n)).alias(
                f"component_{n}_recall_campaign_count"
            )
            for n in C.COMPONENTS
        ],
    )
    return fill_evidence(
        cohorts, per_cohort, C.RECALL_EVIDENCE_VALUES,
        "unique_recall_campaign_count", "recall_match_status",
    )


def campaign_profile(table: DataFrame) -> DataFrame:
    """Ingestion profile of the campaign table: one row of counts and ranges. The table is read twice."""
    c = F.col

    def several(name: str) -> Column:
        return F.count_if(F.size(name) > 1)

    base = table.agg(
        F.count("*").alias("unique_campaign_count"),
        F.sum("source_row_count").alias("source_row_count"),
        F.max("source_row_count").alias("maximum_source_rows_for_one_campaign"),
        F.count_if(c("source_row_count") > 1).alias("campaigns_with_multiple_source_rows"),
        F.count("potential_units_affected").alias("campaigns_with_known_affected_population"),
        F.count_if(
            F.array_contains("quality_flags", "multiple_potential_units_affected_values")
        ).alias("campaigns_with_conflicting_affected_population_values"),
        several("original_components").alias("campaigns_with_multiple_original_components"),
        several("defect_descriptions").alias("campaigns_with_multiple_defect_descriptions"),
        several("report_received_dates").alias("campaigns_with_multiple_report_received_dates"),
        F.count_if(F.size("corrective_actions") > 0).alias("campaigns_with_corrective_action"),
        F.min(F.array_min("report_received_dates")).alias("first_recall_date"),
        F.max(F.array_max("report_received_dates")).alias("last_recall_date"),
        *[
            F.count_if(F.array_contains("recall_types", n)).alias(f"type_{n.lower()}_campaign_count")
            for n in C.RECALL_TYPES
        ],
    )
    reuse = (
        table.select(F.explode("manufacturer_campaign_numbers").alias("number"))
        .groupBy("number")
        .agg(F.count("*").alias("n"))
        .agg(
            F.count("*").alias("unique_manufacturer_campaign_number_count"),
            F.count_if(c("n") > 1).alias("manufacturer_campaign_numbers_reused"),
        )
    )
    return ordered.side_by_side(base, reuse)
