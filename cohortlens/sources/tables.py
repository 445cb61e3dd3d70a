"""Stage tables: write-once output, fingerprints, provenance and conservation checks."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.readers import SourceError

_KEEP_NULLS = {"ignoreNullFields": "false"}


def write_table(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """Write once. An existing output is refused; a failed job leaves no table behind.

    ``order`` is given only where a total order is part of the contract.
    """
    rows = df.orderBy(*order) if order else df
    rows.write.mode("errorifexists").parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content checksum: row count and summed row hashes (one row)."""
    row = F.to_json(F.struct(*df.columns), _KEEP_NULLS)
    digest = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(digest.alias("d")).agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("d"), F.lit(0)).cast("string").alias("checksum"),
    )


def provenance(
    df: DataFrame, *, version: str, run_ts: dt.datetime, inputs: dict[str, str] | None = None,
    policy: dict[str, object] | None = None, complete: bool = True,
) -> DataFrame:
    """One-row sidecar: version, counts, checksum, inputs, policy and time."""
    if run_ts.tzinfo is None:
        raise ValueError("the run time must carry a time zone")
    stamp = run_ts.astimezone(dt.UTC).isoformat().replace("+00:00", "Z")
    columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
    return fingerprint(df).select(
        F.lit(version).alias("version"),
        F.lit(stamp).alias("created_utc"),
        "rows",
        "checksum",
        F.lit(json.dumps(columns)).alias("columns"),
        F.lit(json.dumps(inputs or {}, sort_keys=True)).alias("inputs"),
        F.lit(json.dumps(policy or {}, sort_keys=True)).alias("policy"),
        F.lit(complete).alias("complete"),
    )


def write_provenance(sidecar: DataFrame, path: str) -> None:
    sidecar.coalesce(1).write.mode("errorifexists").json(path)


def validate_input(
    spark: SparkSession, path: str, sidecar_path: str, *, version: str
) -> DataFrame:
    """Open a stage table only when version, columns, rows and checksum still agree."""
    df = spark.read.parquet(path)
    said = spark.read.json(sidecar_path).first()
    if said is None or said["version"] != version:
        raise SourceError(f"{path}: version differs from {version}")
    if not said["complete"]:
        raise SourceError(f"{path}: the table is marked incomplete")
    columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
    if json.loads(said["columns"]) != columns:
        raise SourceError(f"{path}: columns differ from the declared ones")
    found = fingerprint(df).first()
    if (found["rows"], found["checksum"]) != (said["rows"], said["checksum"]):
        raise SourceError(f"{path}: content differs from its checksum")
    return df


def write_stage(
    df: DataFrame, root: str, name: str, *, version: str, run_ts: dt.datetime, inputs: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Write one stage of a run below ``root``, and beside it what it was made of; the table as written.

    The sidecar holds the stage's fingerprint and the fingerprints of the stages it read, as their own sidecars
    state them. A stage is written once.
    """
    spark = df.sparkSession
    known = {i: _sidecar(spark, root, i)["checksum"] for i in inputs}
    write_table(df, f"{root}/{name}/table", order=order)
    table = spark.read.parquet(f"{root}/{name}/table")
    write_provenance(provenance(table, version=version, run_ts=run_ts, inputs=known), f"{root}/{name}/provenance")
    return table


def _sidecar(spark: SparkSession, root: str, name: str) -> dict[str, object]:
    row = spark.read.json(f"{root}/{name}/provenance").first()
    if row is None:
        raise SourceError(f"{root}/{name} has no provenance")
    return row.asDict()


def open_stage(spark: SparkSession, root: str, name: str, versions: dict[str, str]) -> DataFrame:
    """A stage of a run, if it and all stages it was made from are as they were when it was written.

    Each stage's version, columns, row count and content have to agree with its sidecar, and the content of each input
    with what the reading stage has noted. ``versions`` names the wanted version of every stage.
    """
    checked: dict[str, DataFrame] = {}

    def check(stage: str) -> None:
        if stage in checked:
            return
        if stage not in versions:
            raise SourceError(f"no version is wanted of {stage}, which {name} was made from")
        said = _sidecar(spark, root, stage)
        for given, checksum in json.loads(said["inputs"]).items():
            check(given)
            if _sidecar(spark, root, given)["checksum"] != checksum:
                raise SourceError(f"{stage} was made from another {given}")
        checked[stage] = validate_input(spark, f"{root}/{stage}/table", f"{root}/{stage}/provenance", version=versions[stage])

    check(name)
    return checked[name]


def conservation(mapped: DataFrame) -> DataFrame:
    """Input rows against accepted and rejected rows (one row); the gap must be zero."""
    accepted = F.count_if(F.col("reason").isNull())
    rejected = F.count_if(F.col("reason").isNotNull())
    return mapped.agg(
        F.count("*").alias("input_rows"),
        accepted.alias("accepted_rows"),
        rejected.alias("rejected_rows"),
        (F.count("*") - accepted - rejected).alias("unaccounted_rows"),
    )


def rollup_gap(events: DataFrame, cohorts: DataFrame, count: str = "complaint_event_count") -> DataFrame:
    """Event rows against the sum of the cohort counts (one row)."""
    from cohortlens.functions.ordered import side_by_side

    return side_by_side(
        events.agg(F.count("*").alias("event_rows")),
        cohorts.agg(F.sum(count).alias("cohort_total"), F.count("*").alias("cohorts")),
    ).withColumn("gap", F.col("event_rows") - F.col("cohort_total"))


def require_zero(counts: DataFrame, *names: str) -> None:
    """Raise unless the named counts of a one-row table are all zero."""
    row = counts.first().asDict()
    bad = {n: row[n] for n in (names or tuple(row)) if row[n]}
    if bad:
        raise SourceError(f"invariants broken: {bad}")


def require_empty(df: DataFrame, what: str) -> None:
    if not df.isEmpty():
        raise SourceError(what)


def set_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    a = left.select(key).distinct().withColumn("in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full").where("in_left IS NULL OR in_right IS NULL")
