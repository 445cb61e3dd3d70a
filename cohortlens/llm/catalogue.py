"""The registered queries of this package; each is a thin digest of an operator's output."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import ann, bpe, brown, contamination, langid, lines, pii, repair, repeats, secrets, simhash, toxicity, trie
from cohortlens.llm.common import residue, stage, table


def tokenizer_path() -> str:
    """The public byte-level BPE file; ``TOKENIZER_FILE`` names another place."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    dictionaries = langid.fit(docs.where(residue(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select(
        "doc_id",
        (residue(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them."""
    path = tokenizer_path()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).drop("text")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(F.col("token_ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decoder(path)(F.col("token_ids")).cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every text without its 200-byte strings that occur anywhere else."""
    found = repeats.remove(table(spark, folder, "documents").select("doc_id", "text"))
    cut = F.col("repeats")
    return found.select(
        "doc_id",
        cut["n_bytes"].alias("n_bytes"),
        (cut["n_bytes"] - F.octet_length(cut["kept"])).cast("long").alias("n_removed"),
        F.size(cut["spans"]).cast("long").alias("n_spans"),
        F.sha2(cut["kept"], 256).alias("kept_sha256"),
    )


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the base kinds and all spans of personal data in every text."""
    found = pii.find(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k.name)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(pii.listing(F.col("spans"), pii.BASE).cast("binary"), 256).alias("base_sha256"),
        pii.listing(F.col("spans")).alias("spans"),
    )


def op5_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Class-bigram and unigram scores of every text, learned from those not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = brown.score(docs, residue(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of near-duplicates of every document."""
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every text without the lines that ten or more documents share."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = lines.drop_common_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.scan(docs, table(spark, folder, "benchmark"))
    hit = F.col("contamination")
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["item_ids"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, predicted after its quality by a chain learned from the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    found = toxicity.predict(docs, chain)
    return found.select(
        "doc_id",
        F.coalesce(F.get("chain", F.lit(1))["flag"], F.lit(False)).alias("toxic"),
        F.coalesce(F.get("chain", F.lit(1))["p"], F.lit(0.0)).alias("p_toxic"),
        F.coalesce(F.get("chain", F.lit(0))["p"], F.lit(0.0)).alias("p_low_quality"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return trie.nodes(table(spark, folder, "conversations"))


def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after seeded damage."""
    conversations = table(spark, folder, "conversations")
    rows = repair.damaged(conversations)
    found = stage(repair.audits(rows), "repair-audits")
    digests = repair.digests(rows, found).withColumnRenamed("conv_id", "digest_id")
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").join(digests, ids["id"].eqNullSafe(digests["digest_id"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("id").alias("conv_id"),
        # Without any row after damage there is no audit; gaps beyond 64 bits stay null.
        *[F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Stated and random-looking secrets of every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find(docs, secrets.fit(docs)).select("doc_id", "secrets")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_repeats, op4_pii, op5_brown_lm, op6_simhash, op7_line_dedup, op8_decontamination, op9_ann, op10_toxicity, op11_prefix_trie, op12_structure_repair, op13_secrets)}
CHECKS = {"op4_pii": pii.CHECK, "op7_line_dedup": lines.CHECK, "op11_prefix_trie": trie.CHECK, "op12_structure_repair": repair.CHECK, "op13_secrets": secrets.CHECK}
