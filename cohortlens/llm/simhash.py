"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is read as three segments of 23, 23 and 18 bits. If two fingerprints
differ in at most two bits, then by the pigeonhole principle one segment is equal and another
differs in at most one bit. The perfect Golay code [23, 12] decodes a segment to the index
of its codeword; a segment three bits off its codeword gets five more indices, those of
the codewords four bits off. Segments one bit apart then share an index. A key is thus an equal
segment with an index of another one, and all linked fingerprints share a key.

Keys only propose. Fingerprints that share a key with another one are verified exactly
and without forming pairs: two of them are within two bits if and only if a value within one bit of both
exists, so each is grouped with its 65 neighbours, and a group has 65 members at most.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, prepare, stage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2

# The generator polynomial of the Golay code, and the segments as (shift, bits).
GENERATOR = 0b1010_1110_0011
SEGMENTS = ((0, 23), (23, 23), (46, 18))

HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned SimHash of a text; 0 where it has no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        places = [(0, len(joined))]
    else:
        places = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in places], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        octets = hashes[i : i + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, fingerprint) of every row; ``mark`` is a hash of the text."""

    def compute(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.arrow_udf(compute, "bigint")(F.col("text")).alias("fingerprint"))


@functools.cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each syndrome."""

    def remainder(values: np.ndarray) -> np.ndarray:
        values = values.copy()
        for bit in range(22, 10, -1):
            values ^= np.where(values >> bit & 1, GENERATOR << (bit - 11), 0)
        return values

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    single = 1 << np.arange(23)
    errors = {0}
    for _ in range(3):
        errors |= {e | int(b) for e in errors for b in single}
    patterns = np.array(sorted(errors))
    table = np.zeros(1 << 11, np.int64)
    table[remainder(patterns)] = patterns
    return low, high, table


def codeword_index(segment: np.ndarray) -> np.ndarray:
    low, high, table = _golay()
    return (segment ^ table[low[segment & 0xFFF] ^ high[segment >> 12]]) >> 11


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """Row by row the indices of a segment: of itself and of its 23 neighbours (1 or 6 distinct)."""
    near = segment[:, None] ^ np.concatenate(([0], 1 << np.arange(23)))[None, :]
    return codeword_index(near)


def keys(values: np.ndarray) -> list[np.ndarray]:
    """For each 64-bit value its keys; values that differ in two bits at most share one."""
    parts = [((values >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    columns = []
    for i, equal in enumerate(parts):
        for j, near in enumerate(parts):
            if i != j:
                columns.append((i * 3 + j) << 40 | equal[:, None] << 12 | codeword_indices(near))
    return [np.unique(row) for row in np.concatenate(columns, axis=1)]


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between distinct values of ``fingerprint`` that connect just what
    a link of at most two differing bits connects.

    Edges go from each group's smallest member to the others, so a group of n has n - 1.
    """

    def keyed(values: pa.Array) -> pa.Array:
        return pa.array(keys(values.to_numpy(zero_copy_only=False).view(np.uint64)), pa.list_(pa.int64()))

    distinct = prints.select("fingerprint").distinct()
    proposed = stage(
        distinct.select("fingerprint", F.explode(F.arrow_udf(keyed, "array<bigint>")(F.col("fingerprint"))).alias("key")), "golay-keys"
    )
    shared = (
        proposed.groupBy("key")
        .agg(F.min("fingerprint").alias("least"), F.max("fingerprint").alias("most"))
        .where(F.col("least") < F.col("most"))
    )
    candidates = proposed.join(shared, "key", "left_semi").select("fingerprint").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = candidates.withColumn("flip", F.explode(flips)).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("middle"))
    groups = around.groupBy("middle").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)
    return (
        groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges(a, b)``; one root for each connected component.

    In every round each vertex takes the name of the neighbour, or itself, that comes first in an
    order drawn anew, and edges are renamed; named-alike ends vanish. The vertices shrink by a constant
    factor at least, whatever the shape. Each round is written to the shared folder.
    """
    edges = stage(edges, "edges")
    names = stage(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("root", F.col("vertex")), "names")
    number = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("draw"), F.col(c).alias("name"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.least(F.min(draw("b")), F.first(draw("a")))["name"].alias("name"))
        # One jump: the name that the named vertex takes itself.
        second = first.select(F.col("a").alias("name"), F.col("name").alias("jumped"))
        renamed = stage(first.join(second, "name").select(F.col("a").alias("old"), F.col("jumped").alias("new")), "renamed")
        names = stage(
            names.join(renamed, names["root"] == renamed["old"], "left").select("vertex", F.coalesce("new", "root").alias("root")), "names"
        )
        left, right = renamed.toDF("a", "na"), renamed.toDF("b", "nb")
        edges = stage(
            edges.join(left, "a").join(right, "b").where("na <> nb")
            .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(),
            "edges",
        )
        number += 1
    return names


def groups(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, mark, fingerprint, component_id, component_mark.

    Words are runs of anything but white space, A-Z in lower case; a shingle is ``shingle`` words
    joined by spaces, repeats included; a text of fewer words is one shingle, a text without words
    or a null text has fingerprint 0, linked like any other. Documents whose fingerprints differ in
    at most two bits are linked; ``component_id`` is the smallest id that links reach, itself
    included (null if it reaches null ids only), and ``component_mark`` the smallest text hash
    under that id, so the pair names one document of the group. Repeated rows stay repeated; an
    empty table gives an empty table; other columns are not read.
    """
    prepare(docs.sparkSession)
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    named = components(links(prints))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    smallest = prints.groupBy("fingerprint").agg(F.min(order).alias("head"))
    rooted = smallest.join(named, smallest["fingerprint"] == named["vertex"], "left").select(
        "fingerprint", "head", F.coalesce("root", "fingerprint").alias("root")
    )
    heads = rooted.groupBy("root").agg(F.min("head").alias("head"))
    by_print = rooted.drop("head").join(heads, "root").select(
        "fingerprint", F.col("head.doc_id").alias("component_id"), F.col("head.mark").alias("component_mark")
    )
    return prints.join(by_print, "fingerprint").select("doc_id", "mark", "fingerprint", "component_id", "component_mark")


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group: that of the smallest id, of repeated ids the smallest text hash."""
    h_id, h_mark, mark = fresh(docs, "h_id", "h_mark", "text_mark")
    heads = groups(docs, shingle).select(F.col("component_id").alias(h_id), F.col("component_mark").alias(h_mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(heads, marked["doc_id"].eqNullSafe(heads[h_id]) & (marked[mark] == heads[h_mark]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)
