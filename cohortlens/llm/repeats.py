"""Removal of byte strings that occur more than once in the corpus.

Every document is a string of suffixes; two suffixes are in one block as long as their first bytes
agree. Blocks are refined with growing context, and a block of one suffix drops out, for what
begins there is unique. Three contexts are enough:

1. The core. Each 200-byte string has an anchor, the place of the smallest hash among the 64 eight-byte
   strings in its middle. Neighbouring strings share an anchor, so a document has one range of strings
   about every 32 bytes. All strings with an anchor hold the 137 bytes around it, the core. Ranges
   whose core is unique are unique.
2. The range. Ranges with equal bytes from the first string's start to the last one's end are repeated
   as a whole.
3. The string. What is left are ranges in which a repeat begins or ends, a few for each repeat. Their
   strings are hashed one by one and counted, along with one example of each repeated range of that core.

Anchors depend on the bytes of the string alone, so equal strings meet wherever they are. Blocks are
named by hashes of their context instead of by rank, so refining them is counting by name, in Spark.
Names have 128 bits where a block is kept for good.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import discard, prepare, stage

LENGTH = 200
GRAM = 8
SPREAD = 64
#: Where in a string the places for its anchor begin; they lie in its middle.
SHIFT = (LENGTH - SPREAD - GRAM + 1) // 2
CORE = LENGTH - SPREAD + 1
#: Texts are joined to pieces of about this many bytes, and longer ones are cut.
PIECE_BYTES = 1 << 20

_MASK = np.uint64((1 << 32) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIXERS = ((0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


@functools.cache
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    base = _BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _mix(x: np.ndarray, which: int) -> np.ndarray:
    a, b = (np.uint64(m) for m in _MIXERS[which])
    x = (x ^ (x >> np.uint64(30))) * a
    x = (x ^ (x >> np.uint64(27))) * b
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any range of one byte string, from sums over its eight-byte strings."""

    def __init__(self, data: bytes, which: int):
        grams = np.ndarray((len(data) - GRAM + 1,), "<u8", data, strides=(1,)) if len(data) >= GRAM else np.zeros(0, "<u8")
        self.mixed = _mix(grams + np.uint64(which), which)
        room = 1 << max(10, (len(self.mixed)).bit_length())
        powers, self.inverse = _powers(room, which)
        self.sums = np.zeros(len(self.mixed) + 1, np.uint64)
        np.cumsum(self.mixed * powers[: len(self.mixed)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end - GRAM + 1] - self.sums[start]) * self.inverse[start], 1)


def ranges(data: bytes, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, last, core, whole) of the ranges of string starts in texts joined at ``borders``."""
    hashes = Hashes(data, 0)
    size = len(data)
    lowest = (hashes.mixed & ~_MASK) | np.arange(len(hashes.mixed), dtype=np.uint64)
    step = 1
    while step < SPREAD:
        lowest = np.minimum(lowest[:-step], lowest[step:])
        step *= 2
    count = size - LENGTH + 1
    anchor = (lowest[SHIFT : SHIFT + count] & _MASK).astype(np.int64)
    turns = np.zeros(count + 1, np.int32)
    np.add.at(turns, borders[:-1], 1)
    np.add.at(turns, borders[1:] - LENGTH + 1, -1)
    inside = np.cumsum(turns[:-1]) > 0
    joined = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
    last = np.flatnonzero(inside & ~np.concatenate((joined, [False])))
    place = anchor[first]
    core_start = place - SHIFT
    core = hashes.of(core_start, core_start + CORE)
    shape = ((place - first) * SPREAD + (last - first)).astype(np.uint64)
    whole = hashes.of(first, last + LENGTH) ^ _mix(shape + np.uint64(1), 0)
    return first, last, core, whole


def _pieces(texts: pa.Array) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Joined bytes of many texts and the (row, offset in the text, size) of their parts."""
    parts: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    room = PIECE_BYTES
    for row, value in enumerate(texts):
        text = value.as_py()
        data = text.encode() if text else b""
        for at in range(0, max(0, len(data) - LENGTH + 1), PIECE_BYTES):
            part = data[at : at + PIECE_BYTES + LENGTH - 1]
            held.append(part)
            parts.append((row, at, len(part)))
            room -= len(part)
            if room <= 0:
                yield b"".join(held), parts
                parts, held, room = [], [], PIECE_BYTES
    if held:
        yield b"".join(held), parts


def _ranges_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last, core, whole) of all ranges of all documents."""
    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")

    def cut(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for data, parts in _pieces(batch.column("text")):
                borders = np.concatenate(([0], np.cumsum([size for _, _, size in parts])))
                first, last, core, whole = ranges(data, borders)
                part = np.searchsorted(borders, first, side="right") - 1
                rows = np.array([row for row, _, _ in parts])[part]
                moved = np.array([at for _, at, _ in parts])[part] - borders[part]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), marks.take(take), pa.array(first + moved), pa.array((last - first).astype(np.int32)),
                     pa.array(core.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=["doc_id", "mark", "first", "more", "core", "whole"],
                )

    schema = T.StructType([source.schema["doc_id"], T.StructField("mark", T.LongType()), T.StructField("first", T.LongType()),
                           T.StructField("more", T.IntegerType()), T.StructField("core", T.LongType()), T.StructField("whole", T.LongType())])
    return source.mapInArrow(cut, schema)


def _with_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """(doc_id, mark, text) of ``docs`` with the columns of ``found`` (d_id, d_mark, ...)."""
    source = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return source.join(found, source["doc_id"].eqNullSafe(found["d_id"]) & (source["mark"] == found["d_mark"]), how).drop("d_id", "d_mark")


def _strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, mark, start, open) of each string in the ``wanted`` ranges."""
    lists = wanted.groupBy(F.col("doc_id").alias("d_id"), F.col("mark").alias("d_mark")).agg(
        F.collect_set(F.struct("first", "more", "open")).alias("ranges")
    )
    source = _with_text(docs, lists, "inner").dropDuplicates(["doc_id", "mark"])

    def expand(batches):
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("mark")
            for row in range(batch.num_rows):
                data = batch.column("text")[row].as_py().encode()
                own = batch.column("ranges")[row].values
                first, more = own.field("first").to_numpy(), own.field("more").to_numpy().astype(np.int64)
                opened = own.field("open").to_numpy(zero_copy_only=False)
                counts = more + 1
                start = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                h1, h2 = (Hashes(data, which).of(start, start + LENGTH) for which in (0, 1))
                take = pa.array(np.full(len(start), row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(take), marks.take(take), pa.array(start),
                     pa.array(np.repeat(opened, counts))],
                    names=["h1", "h2", "doc_id", "mark", "start", "open"],
                )

    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), source.schema["doc_id"],
                           T.StructField("mark", T.LongType()), T.StructField("start", T.LongType()), T.StructField("open", T.BooleanType())])
    return source.mapInArrow(expand, schema)


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, starts[]): for each document with any, the (first, more) of the starts of its
    strings that start anywhere else too. ``mark`` is a hash of the text."""
    prepare(docs.sparkSession)
    rows = _ranges_of(docs)
    # Counts are written before they are joined: then both sides of the join are plain exchanges,
    # and AQE can split a core that very many ranges have.
    repeated = stage(rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "repeated-cores")
    alive = stage(rows.join(repeated, "core", "left_semi"), "alive-ranges")
    discard(repeated)
    blocks = stage(
        alive.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "first", "more")).alias("one")), "range-blocks"
    )
    mixed = blocks.where("n = 1").select("core").distinct()
    examples = (
        blocks.join(mixed, "core", "left_semi").select("one.*", (F.col("n") == 1).alias("open"))
    )
    closed = alive.join(blocks.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("doc_id", "mark", "first", "more")
    strings = stage(_strings(docs, examples), "strings")
    twice = stage(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "repeated-strings")
    # Written apart, so the strings' shuffle files are gone before the ranges are put together.
    opened = stage(
        strings.where("open").join(twice, ["h1", "h2"], "left_semi")
        .select("doc_id", "mark", F.col("start").alias("first"), F.lit(0).alias("more")),
        "open-starts",
    )
    discard(strings, twice)
    return closed.unionByName(opened).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("first", "more"))).alias("starts"))


KEPT = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
KEPT_DDL = "struct<n_bytes bigint, spans array<struct<start bigint, end bigint>>, kept binary>"


def _cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
    rows = []
    for value, own in zip(texts, starts, strict=True):
        text = value.as_py()
        data = text.encode() if text else b""
        spans, kept = [], [data]
        if own.is_valid and len(own.values):
            first = own.values.field("first").to_numpy()
            end = first + own.values.field("more").to_numpy() + LENGTH
            new = np.flatnonzero(np.concatenate(([True], first[1:] > np.maximum.accumulate(end)[:-1])))
            a, b = first[new], np.maximum.reduceat(end, new)
            spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            borders = [0, *np.stack([a, b], axis=1).reshape(-1).tolist(), len(data)]
            kept = [data[x:y] for x, y in zip(borders[::2], borders[1::2], strict=True)]
        rows.append({"n_bytes": len(data), "spans": spans, "kept": b"".join(kept)})
    return pa.array(rows, KEPT)


def remove(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``repeats`` (n_bytes, spans, kept).

    Texts are UTF-8 bytes; a null text is empty. Each byte in a 200-byte string that also starts
    anywhere else, in the same document or another, goes; overlapping strings count, and all is judged on
    the input. ``spans`` are the maximal removed runs in bytes, end exclusive; ``kept`` the rest joined.
    Texts under 200 bytes stay whole. Repeated rows are documents of their own, so all their strings
    are repeated. Ids may be null. An empty table gives an empty table; other columns are not read.
    """
    prepare(docs.sparkSession)
    starts = stage(repeated_starts(docs), "repeated-starts").withColumnsRenamed({"doc_id": "d_id", "mark": "d_mark"})
    joined = _with_text(docs, starts, "left")
    return joined.select("doc_id", F.arrow_udf(_cut, KEPT_DDL)(F.col("text"), F.col("starts")).alias("repeats"))
