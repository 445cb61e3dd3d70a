"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, folder) and returns a table that is written and read again as the
next stage's documents; all but the last return the columns of ``docs``. Text that a stage
changes gets its new length in ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, catalogue, contamination, langid, lines, simhash
from cohortlens.llm.common import prepare, stage


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts without a clear language; dictionaries come from the documents' own ``lang``."""
    found = langid.identify(docs, langid.fit(docs), into="found_language")
    return found.where(~F.col("found_language.rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Takes lines out that ten or more documents share; every document stays."""
    cut = lines.drop_common_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates."""
    return simhash.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    benchmark = prepare(spark).read.parquet(f"{folder}/benchmark.parquet")
    found = contamination.scan(docs, benchmark, into="found_windows")
    return found.where(F.col("found_windows.n_hit") == 0).select(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with proof that they decode to its text."""
    path = catalogue.tokenizer_path()
    encoded = bpe.encode(docs, path)
    return encoded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        (bpe.decoder(path)(F.col("token_ids")) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe_encode", bpe_encode),
]

#: SQL can express neither the compression classifier nor the tokenizer; tests hold the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
