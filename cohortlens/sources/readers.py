"""Strict readers of the source files.

A reader returns the rows together with what it needs to refuse them: rows of the wrong
width land in ``_corrupt_record``, and ``violations`` counts every broken rule in one
aggregate. ``checked`` runs that aggregate and raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as C
from cohortlens import schemas
from cohortlens.functions import text

CORRUPT = "_corrupt_record"
ROWS = "rows_read"


class SourceError(ValueError):
    """Input rows break a rule of their source."""


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` again when no rule is broken; otherwise an error with the counts."""
    counts = violations(df, rules).first().asDict()
    broken = {name: n for name, n in counts.items() if n and name != ROWS}
    if broken:
        raise SourceError(f"source rules broken: {broken}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule (one row, one column per rule).

    The filled values of the first column are counted too: Spark does not read the
    corrupt-record column on its own.
    """
    broken = [F.count_if(F.coalesce(bad, F.lit(False))).alias(n) for n, bad in rules.items()]
    return df.agg(F.count(F.col(f"`{df.columns[0]}`")).alias(ROWS), *broken)


def _tab_separated(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, encoding: str) -> DataFrame:
    """Headerless tab-separated text where quote characters mean nothing.

    Blank fields are null; a carriage return before the line feed is dropped.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(wide)
        .option("sep", "\t")
        .option("quote", "")
        .option("encoding", encoding)
        .option("lineSep", "\n")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("mode", "PERMISSIVE")
        # Without this, columns nobody asks for are skipped and a short row looks whole.
        .option("columnPruning", "false")
        .option("maxCharsPerColumn", "-1")
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    last = schema.fields[-1].name
    trimmed = F.nullif(F.rtrim(F.col(last), F.lit("\r")), F.lit(""))
    return raw.withColumn(last, trimmed)


def width_rule() -> dict[str, Column]:
    return {"wrong_field_count": F.col(CORRUPT).isNotNull()}


def required_rules(names: Sequence[str]) -> dict[str, Column]:
    return {f"blank_{n}": text.is_blank(F.col(n)) for n in names}


def read_complaints(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """51 string columns per complaint, Latin-1; use ``checked`` with ``width_rule``."""
    return _tab_separated(spark, path, schemas.COMPLAINT_SOURCE, "ISO-8859-1")


def bounded(df: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows, and whether the result is the complete artifact."""
    if limit is None:
        return df, True
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.limit(limit), False


def read_recalls(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """29 string columns per recall row over one or more files, with the file name."""
    rows = _tab_separated(spark, paths, schemas.RECALL_SOURCE, "ISO-8859-1")
    return rows.withColumn("source_file", F.col("_metadata.file_name"))


def recall_rules() -> dict[str, Column]:
    return {
        **width_rule(),
        **required_rules(C.RECALL_REQUIRED),
        "malformed_record_id": ~text.matches(F.col("RECORD_ID"), "[0-9]{1,9}"),
        "malformed_campaign": ~text.matches(F.col("CAMPNO"), "[0-9]{2}[A-Z0-9]{1,10}"),
    }


def read_communications(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """14 string columns per communication row, UTF-8."""
    return _tab_separated(spark, path, schemas.COMMUNICATION_SOURCE, "UTF-8")


def communication_rules() -> dict[str, Column]:
    return {
        **width_rule(),
        **required_rules(C.COMMUNICATION_REQUIRED),
        "malformed_id": ~text.matches(F.col("source_id"), "[0-9]{1,9}"),
    }


def read_compact(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Quoted five-column CSV whose header line may come again between the rows; any file is read by many tasks."""
    wide = T.StructType([*schemas.COMPACT_SOURCE.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    shape = ", ".join(f"`{f.name}` string" for f in wide.fields)
    raw = quoted_records(spark, path).select(F.from_csv("record", shape, options).alias("r")).select("r.*")
    is_header = F.lit(True)
    for name in C.COMPACT_COLUMNS:
        is_header = is_header & F.col(f"`{name}`").eqNullSafe(F.lit(name))
    short = dict(zip(C.COMPACT_COLUMNS, ("source_id", "make", "model", "years", "summary"), strict=True))
    return raw.where(~is_header).select(
        *[F.col(f"`{old}`").alias(new) for old, new in short.items()], CORRUPT
    )


def quoted_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The records of quoted text files, one in a row, where a quoted field may hold line feeds.

    Lines are read in splits. Whether a line begins inside quotes follows from the number of quotes before it: the
    parity within its split, and that of the splits before, which are summed by split. A line that begins outside
    begins a record; lines that begin inside belong to the last one that did. Only records of several lines are
    gathered. A split in which each line has an even number of quotes keeps the state it begins with, so its lines
    are neither ordered nor moved; the tables of splits are small, one row for each. A carriage return at the end of a record is dropped, and empty records are no records.
    """
    lines = (
        spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
            (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
        )
    )
    per_split = lines.groupBy("file", "split").agg(F.max(F.col("quotes") % 2).alias("turns"), F.max("at").alias("last"))
    turning = per_split.where("turns = 1").select(F.col("file").alias("t_file"), F.col("split").alias("t_split"))
    same = (F.col("file") == F.col("t_file")) & (F.col("split") == F.col("t_split"))
    inside = Window.partitionBy("file", "split").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    local = lines.join(F.broadcast(turning), same, "left_semi").withColumn("odd", before)
    # Of each split: its quotes, and the last line that begins a record if the split begins outside or inside quotes.
    turned = local.groupBy("file", "split").agg(
        (F.sum("quotes") % 2).alias("odd"),
        *[F.max(F.when(F.col("odd") == n, F.col("at"))).alias(f"last_{n}") for n in (0, 1)],
    )
    even = per_split.where("turns = 0").select(
        "file", "split", F.lit(0).cast("bigint").alias("odd"), F.col("last").alias("last_0"), F.lit(None).cast("bigint").alias("last_1")
    )
    splits = turned.withColumn("even", F.lit(False)).unionByName(even.withColumn("even", F.lit(True)))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.withColumn("within", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    last = F.when(F.col("within") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    known = opened.select(
        F.col("file").alias("s_file"), F.col("split").alias("s_split"), "even", "within",
        F.last(last, ignorenulls=True).over(earlier).alias("carried"),
    )
    there = (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split"))
    calm = lines.join(F.broadcast(known.where("even")), there)
    placed = local.join(F.broadcast(known.where("NOT even")), there).withColumn("starts", (F.col("odd") + F.col("within")) % 2 == 0)
    alone = F.col("starts") & (F.col("quotes") % 2 == 0)
    here = F.last(F.when(F.col("starts"), F.col("at")), ignorenulls=True).over(inside)
    several = placed.withColumn("first", F.coalesce(here, F.col("carried"))).where(~alone).select("file", "first", "at", "line").unionByName(
        calm.where("within = 1").select("file", F.col("carried").alias("first"), "at", "line")
    )
    gathered = several.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record")
    )
    single = calm.where("within = 0").select("line").unionByName(placed.where(alone).select("line"))
    records = single.select(F.col("line").alias("record")).unionByName(gathered)
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record != ''")


def compact_rules() -> dict[str, Column]:
    return {**width_rule(), **required_rules(("source_id", "make", "model", "years", "summary"))}


#: Names of reports start with this; other files of a manifest are checked but not parsed.
REPORT_PREFIX = "production-report-"
ARTIFACT = (
    "filename string, sha256 string, manufacturer_id int, manufacturer_name string, reportId int, "
    "reporting_year int, reporting_quarter int"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file that a snapshot's manifest lists.

    The manifest is one JSON document with the array ``artifacts``; a document without it, or one that says it is
    not complete, is refused.
    """
    shape = f"complete_for_selected_scope boolean, artifacts array<struct<{ARTIFACT.replace(' string', ':string').replace(' int', ':int')}>>"
    document = spark.read.schema(f"{shape}, {CORRUPT} string").option("multiLine", "true").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    first = document.select(CORRUPT, F.col("artifacts").isNull().alias("empty"), "complete_for_selected_scope").first()
    if first is None or first[CORRUPT] is not None or first["empty"]:
        raise SourceError(f"{path} is not a manifest")
    if first["complete_for_selected_scope"] is False:
        raise SourceError(f"{path} lists an incomplete snapshot")
    rows = document.select(F.explode("artifacts").alias("a")).select("a.*").withColumnRenamed("reportId", "report_id")
    return checked(rows, {"blank_filename": text.is_blank(F.col("filename"))})


def read_production(spark: SparkSession, paths: str | Sequence[str], manifest: DataFrame) -> DataFrame:
    """One row per entry of every production report that a manifest lists, with the report's context.

    ``manifest`` has one row per file: filename, manufacturer_id, manufacturer_name, report_id, reporting_year,
    reporting_quarter, and sha256 if contents are to be checked. Each file is one JSON document, named by its place
    below the given folder. A listed file that is not there, or has other bytes, keeps one row for the rules;
    files that are not listed are not parsed.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(given)
    below = F.regexp_extract("path", "([^/]+)$", 1)
    for root in given:
        name = root.rstrip("/").rsplit("/", 1)[-1]
        inside = F.substring_index("path", f"/{name}/", -1)
        below = F.when(F.contains("path", F.lit(f"/{name}/")), inside).otherwise(below)
    found = files.select(below.alias("filename"), "content", F.lit(True).alias("_found"))
    listed = manifest if "sha256" in manifest.columns else manifest.withColumn("sha256", F.lit(None).cast("string"))
    shape = T.StructType([*schemas.PRODUCTION_DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])
    is_report = F.substring_index("filename", "/", 1).contains(REPORT_PREFIX)
    text_ = F.when(is_report, F.decode("content", "UTF-8"))
    documents = listed.join(found, "filename", "left").select(
        *[F.col(f"`{n}`") for n in listed.columns], F.coalesce("_found", F.lit(False)).alias("_found"), is_report.alias("_report"),
        (F.col("sha256").isNull() | (F.sha2("content", 256) == F.col("sha256"))).alias("_same"),
        F.from_json(text_, shape, {"columnNameOfCorruptRecord": CORRUPT}).alias("_document"),
    )
    return production_rows(documents.where("_report OR NOT _found OR NOT _same").select("*", "_document.*"))


def production_rows(reports: DataFrame) -> DataFrame:
    """One row per listed entry; an empty report keeps one row for its checks."""
    context = (
        "manufacturer_id", "manufacturer_name", "report_id", "reporting_year", "reporting_quarter",
    )
    rows = reports.select(
        *context,
        CORRUPT,
        F.size("results").alias("_listed"),
        F.col("meta.pagination.total").alias("_total"),
        F.col("meta.pagination.nextUrl").alias("_next"),
        F.col("meta.pagination").isNotNull().alias("_paged"),
        "_found",
        "_same",
        F.posexplode_outer("results").alias("_position", "r"),
    )
    return rows.select(
        *context,
        F.col("r.fuelPropulsionSystem").alias("fuel_propulsion_system"),
        F.col("r.make").alias("make"),
        F.col("r.model").alias("model"),
        F.col("r.modelYear").alias("model_year"),
        F.col("r.platform").alias("platform"),
        F.col("r.reportCategory").alias("report_category"),
        F.col("r.totalProduction").alias("total_production"),
        F.col("r.typeCode").alias("type_code"),
        (F.col("_position") + 1).alias("source_row_number"),
        "_listed", "_total", "_next", "_paged", "_found", "_same", CORRUPT,
    )


def production_rules() -> dict[str, Column]:
    """A number written as text, or a fraction, makes the document corrupt under the schema."""
    c = F.col
    listed = c("source_row_number").isNotNull()
    return {
        "missing_file": ~c("_found"),
        "checksum_mismatch": c("_found") & ~c("_same"),
        "not_a_report": c("_found") & (c(CORRUPT).isNotNull() | c("_listed").isNull() | (c("_listed") < 0)),
        "incomplete_report": c("_paged") & (c("_next").isNotNull() | ~c("_total").eqNullSafe(c("_listed"))),
        "invalid_quarter": ~c("reporting_quarter").between(1, 4),
        "invalid_year": c("reporting_year") < 2000,
        "invalid_ids": (c("manufacturer_id") < 1) | (c("report_id") < 1),
        **{
            f"blank_{n}": listed & (F.coalesce(c(n), F.lit("")) == "")
            for n in ("make", "model", "model_year", "report_category", "type_code")
        },
        "invalid_production": listed & (c("total_production").isNull() | (c("total_production") < 0)),
        "other_category": listed & (c("report_category") != C.PRODUCTION_CATEGORY),
    }


def filing_rules() -> dict[str, Column]:
    """Rules of canonical production rows."""
    return {
        "invalid_model_year": F.col("model_year").isNull(),
        "blank_make": F.col("normalized_make").isNull(),
        "blank_model": F.col("normalized_model").isNull(),
    }


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, *, key: Sequence[str] = ()
) -> DataFrame:
    """A stage table that has exactly the declared columns and, if asked, a unique key."""
    df = schemas.assert_schema(spark.read.parquet(path), schema)
    if key:
        repeats = repeated_keys(df, key)
        if not repeats.isEmpty():
            raise SourceError(f"key {tuple(key)} repeats in {path}")
    return df


def read_structured(spark: SparkSession, path: str, schema: T.StructType = schemas.COMPLAINT_SOURCE) -> DataFrame:
    """JSON Lines of a declared schema; a row that does not fit stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def clean_rules() -> dict[str, Column]:
    """Rules of the clean complaint table: types come from the schema, values from here."""
    c = F.col
    needed = (
        "event_id", "source_record_id", C.COHORT_ID, "source_make", "normalized_make",
        "source_model", "normalized_model", "source_model_year",
    )
    flags = c("quality_flags")
    known = F.array(*[F.lit(n) for n in C.QUALITY_FLAGS])
    return {
        **required_rules(needed),
        "model_year_range": ~c("model_year").between(C.MIN_MODEL_YEAR, C.MAX_MODEL_YEAR) | c("model_year").isNull(),
        "unknown_component": ~c("component").isin(*C.COMPONENTS) | c("component").isNull(),
        "unknown_severity": ~c("severity").isin(*C.SEVERITIES) | c("severity").isNull(),
        "negative_number": (c("death_count") < 0) | (c("injury_count") < 0) | (c("mileage") < 0),
        "unit": c("mileage_unit") != C.MILEAGE_UNIT,
        "unknown_flag": F.size(F.array_except(flags, known)) > 0,
        "unsorted_flags": flags != F.array_sort(F.array_distinct(flags)),
    }
