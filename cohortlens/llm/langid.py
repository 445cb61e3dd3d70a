"""Language identification by compression with per-language dictionaries.

Every language has a zstandard raw-content dictionary made of excerpts of its training
texts. A text is encoded once with each dictionary; the language whose dictionary gives
the fewest bytes wins. Where the second smallest size is too close, the text is rejected.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare

UNDETERMINED = "und"

#: Bounds of the training sample: texts for each language, and code points of each text.
SAMPLE_TEXTS = 512
SAMPLE_CHARS = 128
LEVEL = 5
#: Texts are encoded in pieces, so a dictionary keeps its weight in a long text.
PIECE_BYTES = 16_384
SLICES = 64
#: A text is rejected when the runner-up needs less than this share of bytes more.
MARGIN = 0.004


def fit(train: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries from ``train(text, lang)``: language to raw content.

    The sample is bounded: of each text ``chars`` code points at a place that its hash draws from the whole text,
    and for each language the ``texts`` distinct excerpts of smallest hash. So a dictionary has at most ``texts * (chars + 1)``
    code points, and the driver receives that much for each language. Null or empty texts
    and null languages teach nothing; without training rows the result is empty.
    """
    prepare(train.sparkSession)
    train = train.where("lang is not null and text <> ''")
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    excerpts = train.select("lang", F.col("text").substr(place.cast("int"), F.lit(chars)).alias("text")).withColumn("h", F.xxhash64("text"))
    best = excerpts.groupBy("lang", "h").agg(F.min("text").alias("text"))
    # Within slices of each language first, so no task ranks a whole language.
    for keys in (["lang", F.pmod("h", F.lit(SLICES))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        best = best.withColumn("n", rank).where(F.col("n") <= texts).drop("n")
    found: dict[str, list[str]] = {}
    for row in best.orderBy("lang", "h").collect():
        found.setdefault(row["lang"], []).append(row["text"].lower())
    return {lang: "\n".join(rows).encode() for lang, rows in found.items()}


def _has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def detector(dictionaries: dict[str, bytes], margin: float = MARGIN):
    """An Arrow function from texts to (lang, score, rejected)."""

    def detect(texts: pa.Array) -> pa.Array:
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        coders = [
            (lang, zstandard.ZstdCompressor(
                compression_params=settings,
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            ))
            for lang, content in sorted(dictionaries.items())
        ]
        rows = []
        for value in texts:
            text = value.as_py()
            if not coders or text is None or not _has_letter(text):
                rows.append({"lang": UNDETERMINED, "score": 0.0, "rejected": True})
                continue
            data = text.lower().encode()
            pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
            sizes = sorted((sum(len(coder.compress(p)) for p in pieces), lang) for lang, coder in coders)
            second = sizes[1][0] if len(sizes) > 1 else sizes[0][0] * 2
            score = (second - sizes[0][0]) / second
            rows.append({"lang": sizes[0][1], "score": score, "rejected": score < margin})
        return pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return F.arrow_udf(detect, "struct<lang string, score double, rejected boolean>")


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, into: str = "language") -> DataFrame:
    """Add the struct column ``into`` (lang, score, rejected) to every row of ``docs``.

    Only ``text`` is read for it; all columns pass through (a column named ``into`` is
    replaced). A null text, a text without any letter, and any text when no language was
    learned give ``und``, score 0, rejected. ``score`` is the runner-up's surplus as a share of
    its size, 0 to 1. Equal sizes go to the smaller language name, with score 0. Repeated
    rows get equal results; an empty table gives an empty table.
    """
    prepare(docs.sparkSession)
    return docs.withColumn(into, detector(dictionaries, margin)(F.col("text")))
