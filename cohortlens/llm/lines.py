"""Line deduplication with range-partitioned line hashes and keep bitmaps; DataFrame functions only.

Only hashes travel: each line becomes (hash, document, position). They are range-partitioned
by hash and document and sorted by position within, so a line that a third of all documents
share is spread over many ranges, and one pass over each range yields one row for each
(line, document) with its first place. Lines that enough documents share are written first, so the
join that finds their places knows their size: it is broadcast while small, and beyond that
Spark can split a hot line. The result is a run-length coded keep bitmap for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import ascii_lower, fresh, prepare, stage

MIN_DOCS = 10
MIN_CHARS = 1

# Fixed value: the white space that is stripped from a line's ends, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """One row for each document: (doc_id, mark, n_lines, n_dropped, keep_runs).

    A text is split at newlines; null or empty is one empty line. A line's key is the line
    without white space at its ends and with A-Z in lower case. Keys of at least
    ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their lines,
    or with ``keep_first`` all but the first one by document id and position.

    ``keep_runs`` is the keep bitmap, run-length coded: an array of (start, size) of the lines to
    keep, counted from 0. ``mark`` is a hash of the text: rows with one id and one text are one
    document, rows with one id and different texts are several, a null id is an id. Other
    columns are not read. An empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line")))
    # Two independent hashes name a line; a line too short to count has none.
    long_enough = F.length("key") >= min_chars
    hashes = stage(
        keyed.select(
            "doc_id", "mark", "pos",
            F.when(long_enough, F.xxhash64("key")).alias("h1"),
            F.when(long_enough, F.xxhash64(F.lit(1), "key")).alias("h2"),
        ),
        "line-hashes",
    )
    by_document = ["h1", "h2", "doc_id", "mark"]
    occurrences = (
        hashes.where("h1 is not null")
        .repartitionByRange(*by_document)
        .sortWithinPartitions(*by_document, "pos")
        .groupBy(*by_document)
        .agg(F.min("pos").alias("first"))
    )
    head = [F.min(F.struct("doc_id", "mark", "first")).alias("head")] if keep_first else []
    common = occurrences.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), *head).where(F.col("docs") >= min_docs).drop("docs")
    dropped = hashes.where("h1 is not null").join(stage(common, "common-lines"), ["h1", "h2"])
    if keep_first:
        dropped = dropped.where(~F.struct("doc_id", "mark", "pos").eqNullSafe(F.struct("head.doc_id", "head.mark", F.col("head.first").alias("pos"))))
    dropped = dropped.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    sizes = hashes.groupBy("doc_id", "mark").agg((F.max("pos") + 1).alias("n_lines"))
    d = dropped.withColumnsRenamed({"doc_id": "d_id", "mark": "d_mark"})
    joined = sizes.join(d, sizes["doc_id"].eqNullSafe(d["d_id"]) & (sizes["mark"] == d["d_mark"]), "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    borders = joined.select(
        "doc_id", "mark", F.col("n_lines").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
        F.arrays_zip(
            F.concat(F.array(F.lit(-1)), gone).alias("a"), F.concat(gone, F.array(F.col("n_lines"))).alias("b")
        ).alias("borders"),
    )
    runs = F.filter(
        F.transform("borders", lambda x: F.struct((x["a"] + 1).alias("start"), (x["b"] - x["a"] - 1).alias("size"))),
        lambda r: r["size"] > 0,
    )
    return borders.select("doc_id", "mark", "n_lines", "n_dropped", runs.alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that its bitmap keeps, and the bitmap's counts.

    Adds n_lines and n_dropped (columns of those names are replaced). A null text becomes empty.
    """
    docs = docs.drop("n_lines", "n_dropped")
    b_id, b_mark, runs, split = fresh(docs, "b_id", "b_mark", "keep_runs", "split_lines")
    b = bitmaps.select(
        F.col("doc_id").alias(b_id), F.col("mark").alias(b_mark), "n_lines", "n_dropped", F.col("keep_runs").alias(runs)
    )
    joined = docs.join(b, docs["doc_id"].eqNullSafe(b[b_id]) & (F.xxhash64(docs["text"]) == b[b_mark]))
    kept = F.flatten(F.transform(runs, lambda r: F.slice(F.col(split), r["start"] + 1, r["size"])))
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(F.col("n_dropped") == 0, text).otherwise(F.array_join(kept, "\n"))
    return (
        joined.withColumn(split, F.when(F.col("n_dropped") > 0, F.split(text, "\n")))
        .withColumn("text", cut)
        .select(*docs.columns, "n_lines", "n_dropped")
    )


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """`apply_bitmaps` of the `keep_bitmaps` of ``docs`` itself."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep_first))


CHECK = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
