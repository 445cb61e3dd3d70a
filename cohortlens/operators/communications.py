"""Manufacturer communications: documents, applications, second view, evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import identity, numbers, ordered, text
from cohortlens.operators import guards
from cohortlens.session import stage

METADATA = ("replacement", "added", "document", "communicated", "campaign", "type", "summary")
PRODUCT = ("source_id", "make", "model", "year")


def metadata_conflicts(rows: DataFrame) -> DataFrame:
    """Documents whose rows disagree on document-level fields."""
    filled = [F.coalesce(n, F.lit("")).alias(n) for n in METADATA]
    distinct = rows.select("source_id", *filled).distinct()
    return distinct.groupBy("source_id").agg(F.count("*").alias("variants")).where("variants > 1")


#: Document columns that need no field of the rows but the document's own, by the fields behind them.
_FIELDS = {
    "manufacturer_document_id": ("document",), "replacement_document_id": ("replacement",),
    "manufacturer_campaign_or_software_id": ("campaign",), "original_communication_type": ("type",),
    "communication_type": ("type",), "original_date_added": ("added",), "date_added": ("added",),
    "original_communication_date": ("communicated",), "communication_date": ("communicated",),
    "date_quality_flags": ("added", "communicated"), "summary": ("summary",), "source_components": ("component",),
    "canonical_components": ("component",), "component_systems": ("system",), "component_subsystems": ("subsystem",),
    "source_artifact_filename": (), "source_row_count": (),
}


def documents(rows: DataFrame, source_file: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per document. Rows repeat per product and component; values are sets.

    ``columns`` names what is wanted beside the document's ids; only the fields behind it are moved. Rows of a document
    that disagree on document-level fields stop the run, whichever columns are read; ``metadata_conflicts`` lists such
    documents beforehand. The result lies by ``source_id``, so a join on it moves the other side only.
    """
    c = F.col
    wanted = list(_FIELDS) if columns is None else list(columns)
    behind = {n for name in wanted for n in _FIELDS[name]}
    once, many = [n for n in METADATA if n in behind], [n for n in ("component", "system", "subsystem") if n in behind]
    # A hash tells whether the rows agree on all fields, those that are not moved included.
    filled = rows.withColumns({n: F.coalesce(n, F.lit("")) for n in METADATA})
    narrow = filled.select(
        "source_id", F.xxhash64(*METADATA).alias("_digest"), *once, *[F.nullif(n, F.lit("")).alias(n) if n != "component" else c(n) for n in many]
    )
    # Rows move once as they are; equal ones are counted before any set is built.
    dealt = ordered.spread(narrow, "source_id")
    counted = dealt.groupBy(*dealt.columns).agg(F.count("*").alias("_rows"))
    sets = [F.collect_set(n).alias(n) for n in many]
    local = counted.groupBy("source_id", "_digest", "_part", *once).agg(F.sum("_rows").alias("_rows"), *sets)
    fields = F.min(F.struct("_digest", *once)).alias("_fields")
    joined = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in many]
    grouped = local.repartition("source_id").groupBy("source_id").agg(
        fields, F.max("_digest").alias("_most"), F.sum("_rows").alias("source_row_count"), *joined
    )
    said = F.concat(F.lit("document-level fields differ within document "), F.coalesce("source_id", F.lit("null")))
    agreed = guards.hold(grouped, c("_fields._digest") == c("_most"), said)
    grouped = agreed.select("source_id", *[c("_fields")[n].alias(n) for n in once], "source_row_count", *many)
    made = {
        "manufacturer_document_id": lambda: c("document"),
        "replacement_document_id": lambda: F.nullif("replacement", F.lit("")),
        "manufacturer_campaign_or_software_id": lambda: F.nullif("campaign", F.lit("")),
        "original_communication_type": lambda: c("type"),
        "communication_type": lambda: text.communication_type(c("type")),
        "original_date_added": lambda: c("added"),
        "date_added": lambda: text.flagged_date(c("added"), "date_added")[0],
        "original_communication_date": lambda: c("communicated"),
        "communication_date": lambda: text.flagged_date(c("communicated"), "communication_date")[0],
        "date_quality_flags": lambda: F.array_sort(F.array_compact(F.array(
            text.flagged_date(c("added"), "date_added")[1], text.flagged_date(c("communicated"), "communication_date")[1]
        ))),
        "summary": lambda: c("summary"),
        "source_components": lambda: c("component"),
        "canonical_components": lambda: text.component_of_roots(c("component")),
        "component_systems": lambda: c("system"),
        "component_subsystems": lambda: c("subsystem"),
        "source_artifact_filename": lambda: F.lit(source_file).cast("string"),
        "source_row_count": lambda: c("source_row_count"),
    }
    return grouped.select(
        F.concat(F.lit(f"{C.COMMUNICATION_PREFIX}_"), c("source_id")).alias("communication_id"),
        "source_id",
        *[made[n]().alias(n) for n in wanted],
    )


def signals(rows: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row per document with numbers only, for readers that count documents and do not show them.

    ``columns`` names what is wanted beside ``source_id``: ``date_added``, ``communication_date``, ``communication_type`` (its
    place in ``COMMUNICATION_TYPES``) and ``component_bits``. Every field is a number before rows move, so rows of a document
    are combined where they are read, without sets; a document with very many rows sends one row a task. Rows may bring
    ``component_bits`` in place of ``component``. The guard is that of ``documents``. The result lies by ``source_id``.
    """
    c = F.col
    places = {n: i for i, n in enumerate(C.COMMUNICATION_TYPES)}
    # Rows of a document agree on these fields, or the guard stops the run.
    days = {"date_added": "added", "communication_date": "communicated"}
    once = {
        **{n: lambda n=n: F.when(F.year(c(f"_{n}")).between(1900, 2100), c(f"_{n}")) for n in days},
        "communication_type": lambda: F.coalesce(
            text.lookup(c("type"), {k: places[v] for k, v in C.COMMUNICATION_TYPE_NAMES.items()}), F.lit(places["UNKNOWN"])
        ),
    }
    filled = rows.withColumns({n: F.coalesce(n, F.lit("")) for n in METADATA})
    if "component_bits" in columns and "component_bits" not in rows.columns:
        filled = text.component_bits(filled, "component", "component_bits")
    # Days are read in a step of their own, once a row, before their range is checked; the rule is that of ``documents``.
    filled = filled.withColumns({f"_{n}": text.compact_date(c(days[n])) for n in columns if n in days})
    narrow = filled.select(
        "source_id", F.xxhash64(*METADATA).alias("_digest"),
        *[once[n]().alias(n) if n in once else c(n) for n in columns],
    )
    grouped = narrow.groupBy("source_id").agg(
        F.min("_digest").alias("_least"), F.max("_digest").alias("_most"),
        *[F.bit_or(n).alias(n) if n == "component_bits" else F.min(n).alias(n) for n in columns],
    )
    said = F.concat(F.lit("document-level fields differ within document "), F.coalesce("source_id", F.lit("null")))
    return guards.hold(grouped, c("_least") == c("_most"), said).select("source_id", *columns)


def applications(
    rows: DataFrame, normalize: Callable[[Column], Column] = text.normalize_identity
) -> DataFrame:
    """One row per (document, product) with the number of source rows behind it."""
    c = F.col
    counted = rows.groupBy(*PRODUCT).agg(F.count("*").alias("source_expanded_row_count"))
    year = text.model_year(c("year"))
    return counted.select(
        identity.application_id(C.COMMUNICATION_PREFIX, *[c(n) for n in PRODUCT]).alias("applicability_id"),
        F.concat(F.lit(f"{C.COMMUNICATION_PREFIX}_"), c("source_id")).alias("communication_id"),
        "source_id",
        c("make").alias("original_make"),
        c("model").alias("original_model"),
        c("year").alias("original_model_year"),
        normalize(c("make")).alias("normalized_make"),
        normalize(c("model")).alias("normalized_model"),
        year.alias("model_year"),
        F.when(year.isNotNull(), "ELIGIBLE")
        .otherwise("INSUFFICIENT_VEHICLE_IDENTITY")
        .alias("applicability_status"),
        "source_expanded_row_count",
    )


def compact_products(compact: DataFrame) -> DataFrame:
    """Second view: its year list becomes one row per year."""
    return compact.select(
        "source_id", "make", "model", F.explode(text.split_years(F.col("years"))).alias("year")
    )


def audit_views(first: DataFrame, second: DataFrame) -> DataFrame:
    """Overlap of two views on identifiers and on products; they are never unioned."""

    def sides(columns: list[str], label: str) -> DataFrame:
        left = first.select(*columns, F.lit(1).alias("in_first"), F.lit(0).alias("in_second"))
        right = second.select(*columns, F.lit(0).alias("in_first"), F.lit(1).alias("in_second"))
        seen = left.unionByName(right).groupBy(*columns).agg(
            F.max("in_first").alias("f"), F.max("in_second").alias("s")
        )
        return seen.agg(
            F.count_if((F.col("f") == 1) & (F.col("s") == 1)).alias("overlap_count"),
            F.count_if(F.col("s") == 0).alias("first_only_count"),
            F.count_if(F.col("f") == 0).alias("second_only_count"),
        ).select(F.lit(label).alias("grain"), "*")

    return sides(["source_id"], "identifier").unionByName(sides(list(PRODUCT), "product"))


#: Document columns that cohort evidence reads.
EVIDENCE_FACTS = (
    "manufacturer_document_id", "communication_type", "canonical_components", "communication_date", "summary",
    "component_systems", "component_subsystems",
)


def cohort_evidence(
    cohorts: DataFrame, matched: DataFrame, docs: DataFrame, document: str = "communication_id"
) -> DataFrame:
    """Whole-history evidence per cohort; an unmatched cohort has zeros and null dates.

    ``matched`` is the output of ``matching.match_applications``. Applications collapse
    to (cohort, document) first, so each later count is a plain conditional count and
    a document with very many applications is spread over its cohorts. Where ``matched`` and ``docs`` both lie by
    ``document``, neither moves again.
    """
    c = F.col
    hits = matched.where(c("matched_broad_vehicle_id").isNotNull())
    pairs = hits.groupBy(
        c("matched_broad_vehicle_id").alias(C.COHORT_ID), document
    ).agg(F.count("*").alias("_apps"), F.sum("source_expanded_row_count").alias("_rows"))
    facts = docs.select(
        document,
        "manufacturer_document_id",
        "communication_type",
        "canonical_components",
        "communication_date",
        (F.coalesce("summary", F.lit("")) != "").alias("_summary"),
        (numbers.has_any(c("component_systems")) | numbers.has_any(c("component_subsystems"))).alias(
            "_systems"
        ),
    )
    # Read twice below, and small beside what it is made of.
    known = stage(pairs.join(facts, document).drop(document), "communication-pairs")
    per_cohort = known.groupBy(C.COHORT_ID).agg(
        F.count("*").alias("unique_communication_count"),
        F.sum("_apps").alias("communication_applicability_row_count"),
        F.sum("_rows").alias("source_expanded_row_count"),
        F.min("communication_date").alias("first_communication_date"),
        F.max("communication_date").alias("last_communication_date"),
        F.count_if("_summary").alias("summary_observed_communication_count"),
        F.count_if("_systems").alias("manufacturer_component_observed_communication_count"),
        *[
            F.count_if(c("communication_type") == n).alias(f"communication_type_{n.lower()}_count")
            for n in C.COMMUNICATION_TYPES
        ],
        *[
            F.count_if(F.array_contains("canonical_components", n)).alias(
                f"component_{n}_communication_count"
            )
            for n in C.COMPONENTS
        ],
    )
    document_ids = known.select(C.COHORT_ID, "manufacturer_document_id").distinct()
    per_cohort = per_cohort.join(
        document_ids.groupBy(C.COHORT_ID).agg(
            F.count("manufacturer_document_id").alias("unique_manufacturer_document_id_count")
        ),
        C.COHORT_ID,
    )
    return fill_evidence(
        cohorts, per_cohort, C.COMMUNICATION_EVIDENCE_VALUES,
        "unique_communication_count", "manufacturer_communication_match_status",
    )


def fill_evidence(
    cohorts: DataFrame, values: DataFrame, columns: tuple[str, ...], count: str, status: str
) -> DataFrame:
    """Left join evidence to all cohorts: counts become zero, dates stay null."""
    c = F.col
    base = cohorts.select(C.COHORT_ID, *C.KEY, "complaint_event_count")
    joined = base.join(values, C.COHORT_ID, "left")
    found = c(count).isNotNull()
    filled = [
        c(n) if n.endswith("_date") else F.coalesce(c(n), F.lit(0)).alias(n) for n in columns
    ]
    return joined.select(
        C.COHORT_ID,
        *C.KEY,
        "complaint_event_count",
        F.when(found, "EXACT").otherwise("NO_MATCH").alias(status),
        F.when(found, "exact_normalized").alias("match_method"),
        *filled,
    )


def document_profile(docs: DataFrame) -> DataFrame:
    """Ingestion profile of the document table: one row of counts and ranges."""
    c = F.col
    base = docs.agg(
        F.count("*").alias("unique_communication_count"),
        F.sum("source_row_count").alias("source_row_count"),
        F.count("communication_date").alias("valid_communication_date_document_count"),
        F.count_if(F.array_contains("date_quality_flags", "malformed_date_added")).alias("malformed_date_added"),
        F.count_if(F.array_contains("date_quality_flags", "malformed_communication_date")).alias(
            "malformed_communication_date"
        ),
        F.min("date_added").alias("first_date_added"),
        F.max("date_added").alias("last_date_added"),
        F.count_if(F.coalesce("summary", F.lit("")) != "").alias("summary_document_count"),
        F.count_if(
            numbers.has_any(c("component_systems")) | numbers.has_any(c("component_subsystems"))
        ).alias("manufacturer_component_document_count"),
        F.count("manufacturer_campaign_or_software_id").alias("campaign_or_software_document_count"),
        F.count("replacement_document_id").alias("replacement_document_reference_count"),
    )
    reuse = docs.groupBy("manufacturer_document_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("unique_manufacturer_document_id_count"),
        F.count_if((c("n") > 1) & (c("manufacturer_document_id") != "")).alias(
            "repeated_manufacturer_document_id_count"
        ),
    )
    return ordered.side_by_side(base, reuse)
