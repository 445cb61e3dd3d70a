"""Profile queries over the raw feed and the shared tables, and scans of written files."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import constants as C
from cohortlens.functions import ordered, text
from cohortlens.operators import profiling
from cohortlens.plans import bindings as B
from cohortlens.plans import sqltext as S
from cohortlens.plans.registry import day, num, register
from cohortlens.session import stage, stage_path
from cohortlens.sources import readers

c = F.col
P = profiling.PERCENTILES
#: Filings of one report.
REPORT_ROWS = 1000


def _q(x: str, prefix: str = "p") -> str:
    return ", ".join(num(f"quantile_cont({x}::DOUBLE, {p})", f"{prefix}{round(p * 100)}") for p in P)


def _sizes(table: str, key: str, label: str) -> str:
    grouped = f"(SELECT count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})"
    return (
        f"(SELECT count(*) FROM {grouped}) AS unique_{label}s, (SELECT count(*) FROM {grouped} WHERE n > 1) AS repeated_{label}s, "
        f"(SELECT coalesce(sum(n), 0)::BIGINT FROM {grouped} WHERE n > 1) AS rows_under_repeated_{label}, (SELECT max(n) FROM {grouped}) AS largest_{label}"
    )


_RAW = ", ".join(B.complaint_rules(lambda d: d))


@register(
    "profile_ids",
    f"SELECT (SELECT count(*) FROM raw) AS \"rows\", {_sizes('raw', 'CMPLID', 'record')}, {_sizes('raw', 'ODINO', 'reference')}, "
    f"(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM raw GROUP BY {_RAW} HAVING count(*) > 1)) AS exact_copies",
)
def profile_ids(spark, folder):
    return profiling.profile_ids(B.raw_complaints(spark, folder), "CMPLID", "ODINO")


_FIELDS = list(B.complaint_rules(lambda d: d))


@register(
    "profile_missing",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing_count, {num(f'100.0 * (count(*) - count({n})) / count(*)', 'missing_percent')} FROM raw"
        for n in _FIELDS
    ),
)
def profile_missing(spark, folder):
    return profiling.profile_missing(B.raw_complaints(spark, folder), _FIELDS)


@register(
    "profile_coverage",
    "SELECT count(*) FILTER (PROD_TYPE = 'V') AS accepted_rows, count(*) FILTER (PROD_TYPE <> 'V') AS other_rows, "
    + ", ".join(f"count(DISTINCT {k}) FILTER (PROD_TYPE = 'V') AS \"unique_{k}\"" for k in ("MAKETXT", "MODELTXT", "YEARTXT"))
    + ", (SELECT count(*) FROM (SELECT DISTINCT MAKETXT, MODELTXT, YEARTXT FROM raw WHERE PROD_TYPE = 'V')) AS unique_combinations FROM raw",
)
def profile_coverage(spark, folder):
    return profiling.profile_coverage(
        B.raw_complaints(spark, folder), ["MAKETXT", "MODELTXT", "YEARTXT"], c("PROD_TYPE") == "V"
    )


@register(
    "profile_top",
    "SELECT MAKETXT AS value, count(*) AS \"rows\" FROM raw WHERE PROD_TYPE = 'V' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def profile_top(spark, folder):
    from cohortlens.operators.matching import top_counts

    return top_counts(B.raw_complaints(spark, folder).where("PROD_TYPE = 'V'"), "MAKETXT")


_MILES = "CASE WHEN regexp_full_match(MILES, '[0-9]+') THEN try_cast(MILES AS BIGINT) END"


@register(
    "profile_numeric",
    "SELECT count(MILES) AS available, count(*) - count(MILES) AS missing, count(*) FILTER (MILES IS NOT NULL AND v IS NULL) AS malformed, "
    "count(*) FILTER (v = 0) AS zero, count(*) FILTER (v > 500000) AS over_500k, count(*) FILTER (v > 1000000) AS over_1m, "
    f"{num('max(v)', 'maximum')}, {num('avg(v)', 'mean')}, {_q('v')} FROM (SELECT MILES, {_MILES} AS v FROM raw)",
)
def profile_numeric(spark, folder):
    return profiling.profile_numeric(
        B.raw_complaints(spark, folder), "MILES", text.unsigned(c("MILES")),
        {"over_500k": 500_000, "over_1m": 1_000_000},
    )


def _date_parts(label: str, source: str, d: str) -> str:
    return (
        f"count({d}) AS {label}_available, count(*) - count({source}) AS {label}_missing, "
        f"count(*) FILTER ({source} IS NOT NULL AND {d} IS NULL) AS {label}_malformed, {day(f'min({d})', f'{label}_min')}, {day(f'max({d})', f'{label}_max')}"
    )


@register(
    "profile_dates",
    f"SELECT {_date_parts('first', 'FAILDATE', 'a')}, {_date_parts('second', 'LDATE', 'b')}, count(b - a) AS paired_valid_dates, "
    f"count(*) FILTER (b - a < 0) AS negative_delays, count(*) FILTER (b - a > 3652) AS long_delays, {_q('(b - a)', 'delay_p')} "
    f"FROM (SELECT FAILDATE, LDATE, {S.day_of('FAILDATE')} AS a, {S.day_of('LDATE')} AS b FROM raw)",
)
def profile_dates(spark, folder):
    return profiling.profile_dates(
        B.raw_complaints(spark, folder), "FAILDATE", "LDATE", text.compact_date(c("FAILDATE")),
        text.compact_date(c("LDATE")), C.EXTREME_DELAY_DAYS,
    )


def _percent_sql(column: str, source: str) -> str:
    return (
        f"SELECT {column} AS value, count(*) AS \"rows\", {num(f'100.0 * count(*) / (SELECT count(*) FROM {source})', 'percent')} "
        f"FROM {source} GROUP BY 1"
    )


@register("profile_components", _percent_sql("component", "(SELECT * FROM mapped WHERE reason IS NULL)"))
def profile_components(spark, folder):
    return profiling.profile_groups(B.mapped(spark, folder).where("reason IS NULL"), "component")


@register("profile_severity", _percent_sql("severity", "(SELECT * FROM mapped WHERE reason IS NULL)"))
def profile_severity(spark, folder):
    return profiling.profile_groups(B.mapped(spark, folder).where("reason IS NULL"), "severity")


@register(
    "profile_other_labels",
    "SELECT COMPDESC AS value, count(*) AS \"rows\" FROM mapped WHERE reason IS NULL AND component = 'other' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
)
def profile_other_labels(spark, folder):
    from cohortlens.operators.matching import top_counts

    rows = B.mapped(spark, folder).where("reason IS NULL AND component = 'other'")
    return top_counts(rows, "COMPDESC", 30)


@register(
    "profile_mileage_by_component",
    f"SELECT component, count(mileage) AS observed, {num('avg(mileage)', 'mean')}, {num('max(mileage)', 'maximum')}, "
    f"{num('quantile_cont(mileage::DOUBLE, 0.5)', 'median')} FROM mapped WHERE reason IS NULL GROUP BY 1",
)
def profile_mileage_by_component(spark, folder):
    return profiling.profile_measure_by_group(
        B.mapped(spark, folder).where("reason IS NULL"), "component", c("mileage")
    )


@register(
    "profile_combinations",
    "SELECT CRASH, FIRE, INJURED, DEATHS, count(*) AS \"rows\" FROM raw GROUP BY ALL ORDER BY 5 DESC, "
    "CRASH NULLS FIRST, FIRE NULLS FIRST, INJURED NULLS FIRST, DEATHS NULLS FIRST LIMIT 20",
)
def profile_combinations(spark, folder):
    return profiling.profile_combinations(
        B.raw_complaints(spark, folder), ["CRASH", "FIRE", "INJURED", "DEATHS"]
    )


@register(
    "profile_text",
    "SELECT 0::BIGINT AS missing, count(text) AS available, count(*) FILTER (length(text) = 0) AS length_zero, "
    "count(*) FILTER (length(text) BETWEEN 1 AND 10) AS short, count(*) FILTER (length(text) > 2048) AS oversized, "
    f"max(length(text))::BIGINT AS maximum_length, {_q('length(text)')} FROM documents",
)
def profile_text(spark, folder):
    return profiling.profile_text(
        B.table(spark, folder, "documents"), "text", C.SHORT_NARRATIVE, C.LONG_NARRATIVE
    )


@register(
    "profile_repeats",
    "SELECT count(*) FILTER (n > 1) AS repeated_references, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_under_repeated_reference, "
    "max(n) AS largest_reference, count(*) FILTER (k > 1) AS references_with_several_components, "
    "(SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY MAKETXT, MODELTXT, YEARTXT, COMPDESC HAVING count(*) > 1)) AS repeated_combinations "
    "FROM (SELECT count(*) AS n, count(DISTINCT COMPDESC) AS k FROM raw WHERE ODINO IS NOT NULL GROUP BY ODINO)",
)
def profile_repeats(spark, folder):
    return profiling.profile_repeats(
        B.raw_complaints(spark, folder), "ODINO", "COMPDESC", ["MAKETXT", "MODELTXT", "YEARTXT", "COMPDESC"]
    )


@register("profile_monthly", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS \"rows\" FROM events GROUP BY 1")
def profile_monthly(spark, folder):
    return profiling.profile_monthly(B.table(spark, folder, "events"), c("ts"))


@register(
    "profile_lag",
    "SELECT count(lag) AS observed, count(*) FILTER (lag < 0) AS negative, count(*) FILTER (lag > 30) AS long, "
    f"{_q('lag', 'lag_p')} FROM (SELECT year(report_date) - model_year AS lag FROM parsed)",
)
def profile_lag(spark, folder):
    return profiling.profile_lag(B.mapped(spark, folder), F.year("report_date") - c("model_year"))


@register(
    "profile_histogram",
    f"SELECT bin, count(*) AS \"rows\", {num('1 + bin * w', 'lower')} FROM "
    "(SELECT least(floor((v - 1) / w), 59)::INTEGER AS bin, w FROM (SELECT v, (hi - 1) / 60 AS w, hi FROM "
    f"(SELECT {_MILES} AS v FROM raw), (SELECT quantile_cont({_MILES}::DOUBLE, 0.99) AS hi FROM raw)) "
    "WHERE v BETWEEN 1 AND hi) GROUP BY bin, w",
)
def profile_histogram(spark, folder):
    return profiling.profile_histogram_to_quantile(
        B.raw_complaints(spark, folder), text.unsigned(c("MILES")), 1.0, 0.99, 60
    )


@register(
    "profile_delay_histogram",
    f"SELECT least(floor((v + 365) / (4017 / 70.0::DOUBLE)), 69)::INTEGER AS bin, count(*) AS \"rows\", "
    f"{num('-365 + least(floor((v + 365) / (4017 / 70.0::DOUBLE)), 69) * (4017 / 70.0::DOUBLE)', 'lower')} FROM "
    f"(SELECT {S.day_of('LDATE')} - {S.day_of('FAILDATE')} AS v FROM raw) WHERE v BETWEEN -365 AND 3652 GROUP BY ALL",
)
def profile_delay_histogram(spark, folder):
    delay = F.date_diff(text.compact_date(c("LDATE")), text.compact_date(c("FAILDATE")))
    return profiling.profile_histogram(B.raw_complaints(spark, folder), delay, -365.0, 3652.0, 70)


@register(
    "profile_headline",
    "SELECT count(*) AS records, count(*) FILTER (reason IS NULL) AS mapped, count(*) FILTER (reason IS NOT NULL) AS rejected, "
    + num("100.0 * count(*) FILTER (reason IS NULL) / count(*)", "mapping_success_percent") + ", "
    + ", ".join(
        num(f"100.0 * count(*) FILTER (reason IS NULL AND {rule}) / count(*) FILTER (reason IS NULL)", name)
        for name, rule in (
            ("component_other_percent", "component = 'other'"), ("component_unknown_percent", "component = 'unknown'"),
            ("severity_unknown_percent", "severity = 'unknown'"),
        )
    ) + " FROM mapped",
)
def profile_headline(spark, folder):
    return profiling.headline(B.mapped(spark, folder))


# --- scans: the feed is written as source files first, then read back strictly ----------------


def _write_lines(df, path: str, columns, *, encoding: str) -> str:
    """Headerless tab-separated text without quoting, as the sources publish it."""
    (
        df.select(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in columns])
        .write.mode("errorifexists").option("sep", "\t").option("quote", "").option("escapeQuotes", "false")
        .option("encoding", encoding).option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false").csv(path)
    )
    return path


@register(
    "scan_event_tsv",
    "SELECT PROD_TYPE AS product, count(*) AS \"rows\", count(CMPLID) AS ids, count(CDESCR) AS narratives, "
    "sum(length(CDESCR))::BIGINT AS characters FROM raw GROUP BY 1",
)
def scan_event_tsv(spark, folder):
    """51 columns, Latin-1, tab separated: written from the feed, read and checked."""
    raw = B.raw_complaints(spark, folder)
    absent = [n for n in C.COMPLAINT_COLUMNS if n not in raw.columns]
    wide = raw.withColumns({n: F.lit(None).cast("string") for n in absent})
    path = _write_lines(wide, stage_path(spark, "complaint-files"), C.COMPLAINT_COLUMNS, encoding="ISO-8859-1")
    rows = readers.checked(readers.read_complaints(spark, path), readers.width_rule())
    return rows.groupBy(c("PROD_TYPE").alias("product")).agg(
        F.count("*").alias("rows"), F.count("CMPLID").alias("ids"), F.count("CDESCR").alias("narratives"),
        F.sum(F.length("CDESCR")).alias("characters"),
    )


@register(
    "scan_recall_tsv",
    "SELECT CAMPNO AS campaign, count(*) AS \"rows\", count(POTAFF) AS populations, count(DISTINCT MAKETXT) AS makes FROM recrows GROUP BY 1",
)
def scan_recall_tsv(spark, folder):
    raw = B.recall_rows(spark, folder)
    path = _write_lines(raw, stage_path(spark, "recall-files"), C.RECALL_COLUMNS, encoding="ISO-8859-1")
    rows = readers.checked(readers.read_recalls(spark, path), readers.recall_rules())
    return rows.groupBy(c("CAMPNO").alias("campaign")).agg(
        F.count("*").alias("rows"), F.count("POTAFF").alias("populations"), F.countDistinct("MAKETXT").alias("makes")
    )


@register(
    "scan_communication_tsv",
    "SELECT type, count(*) FILTER (summary <> '') AS \"rows\", count(campaign) FILTER (summary <> '') AS campaigns, "
    "count(system) FILTER (summary <> '') AS systems, count(*) FILTER (summary = '') AS rejected FROM commrows GROUP BY 1",
)
def scan_communication_tsv(spark, folder):
    """Every row is written; those with an empty required summary break a rule of the reader."""
    raw = B.communication_rows(spark, folder)
    path = _write_lines(raw, stage_path(spark, "communication-files"), C.COMMUNICATION_COLUMNS, encoding="UTF-8")
    rows = readers.read_communications(spark, path)
    broken = F.lit(False)
    for rule in readers.communication_rules().values():
        broken = broken | F.coalesce(rule, F.lit(False))
    return rows.withColumn("broken", broken).groupBy("type").agg(
        F.count_if(~c("broken")).alias("rows"), F.count_if(~c("broken") & c("campaign").isNotNull()).alias("campaigns"),
        F.count_if(~c("broken") & c("system").isNotNull()).alias("systems"), F.count_if("broken").alias("rejected"),
    )


@register(
    "scan_repeated_header_csv",
    "SELECT make, years, count(*) AS \"rows\", count(DISTINCT source_id) AS ids FROM compact GROUP BY ALL",
)
def scan_repeated_header_csv(spark, folder):
    """Quoted CSV in many part files, each with its own header line."""
    names = ("source_id", "make", "model", "years", "summary")
    pairs = zip(names, C.COMPACT_COLUMNS, strict=True)
    raw = B.compact_rows(spark, folder).select(*[c(a).alias(b) for a, b in pairs])
    path = stage_path(spark, "compact-files")
    raw.write.mode("errorifexists").option("header", "true").option("escape", '"').csv(path)
    rows = readers.checked(readers.read_compact(spark, path), readers.compact_rules())
    return rows.groupBy("make", "years").agg(F.count("*").alias("rows"), F.countDistinct("source_id").alias("ids"))


@register(
    "scan_filing_json",
    "SELECT (reporting_year + 20)::INTEGER AS reporting_year, reporting_quarter, count(*) AS \"rows\", sum(total_production)::BIGINT AS units, count(platform) AS platforms "
    "FROM filings GROUP BY ALL",
)
def scan_filing_json(spark, folder):
    """Reports of one JSON document a file, listed by a manifest with checksums.

    Filings of a (manufacturer, year, quarter) are numbered and cut into reports of `REPORT_ROWS`, so no report gathers
    an unbounded number of rows. The source accepts years from 2000 on, so the shared tables' years are moved by 20.
    """
    period = ["manufacturer_id", "reporting_year", "reporting_quarter"]
    filed = B.filings(spark, folder).withColumn("reporting_year", c("reporting_year") + 20)
    numbered = ordered.positions(
        filed.withColumn("_h", ordered.hash_key("report", c("report_id"), c("source_row_number"))), period, "_h"
    ).withColumn("report_id", (F.floor(c("position") / REPORT_ROWS) + 1).cast("int"))
    keys = [*period, "report_id"]
    entry = F.struct(
        c("fuel_propulsion_system").alias("fuelPropulsionSystem"), "make", "model", c("model_year").alias("modelYear"),
        "platform", c("report_category").alias("reportCategory"), c("total_production").alias("totalProduction"),
        c("type_code").alias("typeCode"),
    )
    pagination = F.struct(F.lit(None).cast("string").alias("nextUrl"), F.count(F.lit(1)).alias("total"))
    body = F.struct(F.struct(pagination.alias("pagination")).alias("meta"), F.collect_list(entry).alias("results"))
    reports = stage(
        numbered.groupBy(*keys).agg(F.to_json(body).alias("value"), F.min("manufacturer_name").alias("manufacturer_name"))
        .withColumn("name", F.concat(F.lit(readers.REPORT_PREFIX), F.concat_ws("-", *keys))),
        "filing-reports",
    )
    path = stage_path(spark, "filing-documents")
    reports.select("value", c("name").alias("report")).repartition("report").write.mode("errorifexists").partitionBy("report").text(path)
    # A report is a folder of one file, whose name is Spark's; the listing reads no contents.
    root = path.rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.substring_index("path", f"/{root}/", -1).alias("filename")
    ).withColumn("name", F.regexp_extract("filename", "^report=([^/]+)/", 1))
    manifest = files.join(reports, "name").select(
        "filename", F.sha2(F.concat("value", F.lit("\n")).cast("binary"), 256).alias("sha256"), "manufacturer_name", *keys
    )
    rows = stage(readers.read_production(spark, path, manifest), "filing-rows")
    return readers.checked(rows, readers.production_rules()).groupBy("reporting_year", "reporting_quarter").agg(
        F.count("*").alias("rows"), F.sum("total_production").alias("units"), F.count("platform").alias("platforms")
    )
