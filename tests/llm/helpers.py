"""Tables of awkward rows that every text operator has to accept."""

import re

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators might use inside.
    T.StructField("mark", T.StringType()), T.StructField("row", T.StringType()), T.StructField("h_id", T.StringType()),
    T.StructField("b_id", T.StringType()), T.StructField("train", T.StringType()), T.StructField("text_mark", T.StringType()),
])
EXTRA = ("m", "r", "h", "b", "t", "x")

#: One long word, a very long text of many words, and one with special strings.
LONG_WORD = "antidisestablishmentarianism" * 900
LONG_TEXT = "".join(f"word{i % 977} tail{i % 13}é\n" for i in range(9000))
AWKWARD = [
    (1, "One plain line of text.\nAnd a second one, quite as plain.", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n\x0b \n", None),
    (5, LONG_WORD, "en"),
    (6, LONG_TEXT, "de"),
    (6, LONG_TEXT, "de"),
    (None, "A text without an id, ünïcödé and 漢字.", None),
    (None, None, "fr"),
    (7, "first<|endoftext|>second <|endoftext|>", "fr"),
    (7, "The id is there twice, the text is not.", "fr"),
    (8, "12345 !!! ---", "es"),
]


def documents(spark, rows=AWKWARD):
    full = [(i, t, lang, None, None if t is None else len(t), *EXTRA) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def write(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text or ""))


def key(row):
    return (row[0] is None, row[0] or 0)
