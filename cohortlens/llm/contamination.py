"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents are normalised alike: A-Z in lower case, words of letters, digits and
all characters beyond ASCII, one space between words. The automaton holds every window
of an item; a document is scanned once, and each hit is mapped back to its words and to
the code points of the original text.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare

WINDOW_WORDS = 10
#: Proven bound of what one task holds: normalised item text of one automaton. More text makes
#: further automata, each over another share of the items; all of them scan every document.
AUTOMATON_BYTES = 16 << 20

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes that are no part of a word, to a space; A-Z to a-z. UTF-8 bytes beyond ASCII stay.
_FOLD = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split(b" ") if text else []


def normalise(text: str | None) -> list[str]:
    return [w.decode() for w in words_of(text) if w]


def windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """(window, item_ids) of ``items(item_id, text)``: each distinct window and its items.

    A window is ``size`` consecutive words; an item of fewer words is one window, an item
    without words or with a null text has none. Null ids stay out of ``item_ids``.
    """

    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            w = normalise(value.as_py())
            rows.append(sorted({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}) if w else [])
        return pa.array(rows, pa.list_(pa.string()))

    cut_udf = F.arrow_udf(cut, "array<string>")
    return (
        items.select("item_id", F.explode(cut_udf(F.col("text"))).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )


def automaton(rows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """Keys have a space at both ends, so they only match whole words."""
    machine = ahocorasick.Automaton()
    for window, ids in rows:
        machine.add_word(f" {window} ", (window.count(" ") + 1, len(window) + 2, tuple(ids)))
    if len(machine):
        machine.make_automaton()
    return machine


_MACHINES: dict[int, list[ahocorasick.Automaton]] = {}


def _machines(shared) -> list[ahocorasick.Automaton]:
    """The automata of one broadcast, built once for each Python worker."""
    if shared.value[0] not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[shared.value[0]] = [automaton(rows) for rows in shared.value[1]]
    return _MACHINES[shared.value[0]]


def hit_words(machines: list[ahocorasick.Automaton], words: list[str]) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the items of those windows."""
    text = f" {' '.join(words)} " if words else ""
    edges, found, starts = np.zeros(len(words) + 1, dtype=np.int32), set(), None
    for machine in machines:
        for end, (count, length, ids) in machine.iter(text) if len(machine) and words else ():
            if starts is None:
                starts = np.cumsum([0] + [len(w) + 1 for w in words])
            first = int(np.searchsorted(starts, end - length + 1))
            edges[first] += 1
            edges[first + count] -= 1
            found.update(ids)
    return np.cumsum(edges[:-1]) > 0, found


RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
RESULT_DDL = "struct<n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start bigint, end bigint>>>"


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, into: str = "contamination") -> DataFrame:
    """Add the struct ``into`` (n_words, n_hit, item_ids, spans) to every row of ``docs``.

    A document word inside any occurrence of a window counts as hit. ``spans`` are the maximal
    runs of hit words as code points of the original text, end exclusive. ``item_ids`` are the
    sorted ids, as text, of the items with a window in the document. A null or empty text has no
    words; with an empty ``items`` nothing is hit. Repeated rows get equal results; other
    columns pass through, one named ``into`` is replaced. Items may repeat; their windows count once.

    The items are what is collected: their text is cut into automata of `AUTOMATON_BYTES`.
    """
    spark = prepare(docs.sparkSession)
    chunks: list[list[tuple[str, list[str]]]] = [[]]
    room = AUTOMATON_BYTES
    for row in windows(items, size).orderBy("window").collect():
        if room < 0:
            chunks.append([])
            room = AUTOMATON_BYTES
        chunks[-1].append((row["window"], row["item_ids"]))
        room -= len(row["window"].encode())
    shared = spark.sparkContext.broadcast((hash(tuple(w for c in chunks for w, _ in c)), chunks))

    def search(texts: pa.Array) -> pa.Array:
        machines = _machines(shared)
        rows = []
        for value in texts:
            text = value.as_py()
            words = normalise(text)
            hit, ids = hit_words(machines, words)
            spans = []
            if ids or hit.any():
                places = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(turns[::2], turns[1::2], strict=True)]
            rows.append({"n_words": len(words), "n_hit": int(hit.sum()), "item_ids": sorted(ids), "spans": spans})
        return pa.array(rows, RESULT)

    return docs.withColumn(into, F.arrow_udf(search, RESULT_DDL)(F.col("text")))


_LOWER = {65 + i: 97 + i for i in range(26)}
