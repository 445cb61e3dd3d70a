"""Language-model scores from Brown class-based bigrams.

Words get classes by exchange clustering; a text's probability is the product of class
transitions and word emissions, smoothed so that each is a proper distribution.

Texts are read once. Each Arrow batch becomes a block: its tokens as numbers into the block's
own word list. Words are dealt to buckets by hash, and a block and a bucket exchange one packed
message a round: the block sends how often each of its words has each class before and after
it, the bucket moves its words to better classes and sends the classes back. So the word list of the
corpus is distributed throughout; the driver sees only tables of classes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import discard, prepare, stage

CLASSES = 32
#: Contexts of a word on each side: the neighbour's class, no class, or the start of the text.
CONTEXTS = CLASSES + 2
ROUNDS = 4
#: The bit of a word's crc32 that says in which rounds it moves.
HALF_BIT = 11
#: Weight of the class frequencies in the transition probabilities.
TRANSITION_PRIOR = 50.0
#: The end of a text as a word; no word holds white space.
END = "\n"
#: Counts of words by context that are rated at once.
AT_ONCE = 1 << 15

BLOCK = [
    T.StructField("block", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("tokens", T.BinaryType()),
    T.StructField("bounds", T.ArrayType(T.IntegerType())),
]


def _pack(values: np.ndarray, kind: type = np.int32) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes())


def _unpack(data: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _pack_rising(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0), np.int64)


def _unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.int64))


def _rows(schema: T.StructType):
    """A function from some columns of ``schema`` to an Arrow batch whose other columns are null."""
    types = to_arrow_schema(schema)

    def rows(columns: dict, size: int) -> pa.RecordBatch:
        full = [pa.nulls(size, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in types]
        return pa.RecordBatch.from_arrays(full, schema=types)

    return rows


def _blocks(docs: DataFrame, train: Column, buckets: int) -> DataFrame:
    """Blocks and their words: a row (block, doc_id[], sizes[], train[], tokens, bounds[]) for each batch of
    documents, and a row (block, bucket, words, counts) for each bucket that words of it are in. Words are
    numbered by bucket, those of bucket b from bounds[b] on. The columns of the other kind are null."""
    source = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([
        *BLOCK, T.StructField("doc_id", T.ArrayType(id_type)), T.StructField("bucket", T.IntegerType()),
        T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    rows = _rows(schema)

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            words: dict[bytes, int] = {END.encode(): 0}
            tokens, sizes = [], []
            for text in batch.column("text"):
                value = text.as_py()
                own = value.encode().lower().split() if value else []
                tokens += [words.setdefault(w, len(words)) for w in own]
                tokens.append(0)
                sizes.append(len(own) + 1)
            if not sizes:
                continue
            listed = sorted((zlib.crc32(w) % buckets, w, i) for w, i in words.items())
            place = np.empty(len(listed), np.int32)
            place[[i for _, _, i in listed]] = np.arange(len(listed))
            ids = place[np.array(tokens, np.int32)]
            used = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(bool), sizes)
            counts = np.bincount(ids[used], minlength=len(listed))
            bounds = np.searchsorted([b for b, _, _ in listed], np.arange(buckets + 1))
            yield rows({
                "block": [number], "doc_id": [batch.column("doc_id").to_pylist()], "sizes": [sizes],
                "train": [batch.column("train").to_pylist()], "tokens": [_pack(ids)], "bounds": [bounds.tolist()],
            }, 1)
            full = np.flatnonzero(np.diff(bounds)).tolist()
            parts = [(bounds[b], bounds[b + 1]) for b in full]
            yield rows({
                "block": [number] * len(full), "bucket": full,
                "words": [zstandard.compress(b" ".join(w for _, w, _ in listed[i:j])) for i, j in parts],
                "counts": [_pack(counts[i:j]) for i, j in parts],
            }, len(full))
            number += 1

    return source.mapInArrow(build, schema)


NUMBERS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("id", T.IntegerType()), T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType()),
])


def _numbers(messages: DataFrame, classes: int) -> DataFrame:
    """(block, bucket, ids): the words of each message as numbers into the bucket's sorted word list; and
    (bucket, id, word, c) of the ``classes`` most frequent words of each bucket that occur in training."""
    rows = _rows(NUMBERS)

    def number(key, table):
        lists = [zstandard.decompress(w.as_py()).split(b" ") for w in table.column("words")]
        listed = sorted({w for own in lists for w in own})
        # Numbers rise with the words; which half moves in a round hangs on the word alone, so numbers are left out.
        half = np.array([zlib.crc32(w) >> HALF_BIT & 1 for w in listed])
        numbers = np.cumsum(np.concatenate((half[:1], np.where(np.diff(half) == 0, 2, 1))))
        index = {w: i for i, w in enumerate(listed)}
        total, ids = np.zeros(len(listed), np.int64), []
        for own, counts in zip(lists, table.column("counts"), strict=True):
            places = np.array([index[w] for w in own])
            ids.append(numbers[places])
            total[places] += _unpack(counts.as_py())
        top = [i for i in np.argsort(-total, kind="stable")[:classes].tolist() if total[i]]
        bucket = key[0].as_py()
        return pa.Table.from_batches([
            rows({"block": table.column("block").to_pylist(), "bucket": [bucket] * len(ids), "ids": [_pack_rising(i) for i in ids]}, len(ids)),
            rows({"bucket": [bucket] * len(top), "id": numbers[top], "word": [listed[i] for i in top], "c": total[top]}, len(top)),
        ])

    return messages.groupBy("bucket").applyInArrow(number, NUMBERS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(profile: np.ndarray) -> float:
    """The part of the class bigrams' log-likelihood that depends on the classes, from their context counts."""
    halves = profile.reshape(len(profile), 2, -1)
    return float(_xlogx(halves).sum() - _xlogx(halves.sum(axis=2)).sum())


def gains(word: np.ndarray, context: np.ndarray, n: np.ndarray, found: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """What each class would gain in likelihood with each word in it, the word's own counts taken out of its class.

    ``n`` counts by (word, context) in the order of words, ``found`` has the class of each word (none: -1) and
    ``profile`` the counts of classes by context, those before a word and then those after it.
    """
    sides = profile.reshape(len(profile), 2, -1).sum(axis=2)
    own = np.bincount(word * 2 + context // (profile.shape[1] // 2), n, 2 * len(found)).reshape(-1, 2)

    def added(rest: np.ndarray, x: np.ndarray, mine: np.ndarray) -> np.ndarray:
        has = np.flatnonzero(mine >= 0)
        rest[has, mine[has]] = np.maximum(rest[has, mine[has]] - x[has], 0)
        return _xlogx(rest + x[:, None]) - _xlogx(rest)

    out = np.zeros((len(found), len(profile)))
    # A word's counts are never parted, so its sums don't depend on the words beside it.
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    at = 0
    while at < len(word):
        later = starts[np.searchsorted(starts, at + AT_ONCE) :]
        stop = int(later[0]) if len(later) else len(word)
        w, k, x = (v[at:stop] for v in (word, context, n))
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] = np.add.reduceat(added(profile.T[k], x, found[w]), first)
        at = stop
    for at in range(0, len(found), AT_ONCE):
        for side in (0, 1):
            x, mine = own[at : at + AT_ONCE, side], found[at : at + AT_ONCE]
            out[at : at + AT_ONCE] -= added(np.tile(sides[:, side], (len(x), 1)), x, mine)
    return out


def assign(vectors: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Classes of words with the context counts ``vectors`` after exchange rounds whose class profiles are ``steps``.

    Step 0 holds the seeds' profiles. Odd rounds move words of odd numbers and even rounds the
    others, so that likes don't chase each other.
    """
    word, context = np.nonzero(vectors)
    found = np.full(len(vectors), -1)
    for number, profile in enumerate(steps):
        best = gains(word, context, vectors[word, context].astype(float), found, profile).argmax(axis=1)
        found = np.where((number == 0) | (np.arange(len(vectors)) % 2 == number % 2), best, found)
    return found


def _summed(keys: np.ndarray, n: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` in order, and the sums of ``n`` (or their numbers)."""
    if size <= 8 * len(keys):
        total = np.bincount(keys, n, size)
        keys = np.flatnonzero(total)
        return keys, total[keys].astype(np.int64)
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


COUNTS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("labels", T.BinaryType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()),
])


def _contexts(numbered: DataFrame, classes: int, seeds: dict[int, list[tuple[int, int]]] | None) -> DataFrame:
    """(block, bucket, ids, labels, cells, counts): the words of each block and bucket, their classes and how often each
    class comes before and after them in training; and (cell, n), the class bigrams of all."""
    unknown, start, width = classes, classes + 1, classes + 2
    rows = _rows(COUNTS)

    def count(batches):
        table = np.zeros(width**2, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                bounds = batch.column("bounds")[row].values.to_numpy()
                ids = [_unpack_rising(g["ids"].as_py()) for g in batch.column("numbers")[row].values]
                full = np.flatnonzero(np.diff(bounds))
                if seeds is None:
                    label, _ = _known(batch, row, unknown)
                else:
                    label = np.full(bounds[-1], unknown)
                    for bucket, own in zip(full.tolist(), ids, strict=True):
                        for i, c in seeds.get(bucket, []):
                            label[bounds[bucket] + np.flatnonzero(own == i)] = c
                tokens, sizes, firsts, used = _tokens(batch, row)
                inner = used.copy()
                inner[firsts + sizes - 1] = False
                labels = label[tokens]
                before, after = np.roll(labels, 1), np.roll(labels, -1)
                before[firsts] = start
                table += np.bincount((before * width + labels)[used], minlength=width**2)
                keys = np.concatenate([(tokens * (2 * width) + before)[used], (tokens * (2 * width) + width + after)[inner]])
                keys, n = _summed(keys, None, int(bounds[-1]) * 2 * width)
                cuts = np.searchsorted(keys, bounds.astype(np.int64) * (2 * width))
                yield rows({
                    "block": [batch.column("block")[row].as_py()] * len(full), "bucket": full, "ids": [_pack_rising(i) for i in ids],
                    "labels": [_pack(label[bounds[b] : bounds[b + 1]], np.int16) for b in full],
                    "cells": [_pack_rising(keys[cuts[b] : cuts[b + 1]] - bounds[b] * 2 * width) for b in full],
                    "counts": [_pack(n[cuts[b] : cuts[b + 1]]) for b in full],
                }, len(full))
        cells = np.flatnonzero(table)
        yield rows({"cell": cells, "n": table[cells]}, len(cells))

    return numbered.mapInArrow(count, COUNTS)


KNOWN = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("labels", T.BinaryType()),
    T.StructField("counts", T.BinaryType()), T.StructField("class", T.IntegerType()), T.StructField("tokens", T.LongType()),
    T.StructField("words", T.LongType()),
])


def _moved(contexts: DataFrame, table: np.ndarray, number: int) -> DataFrame:
    """(block, bucket, labels, counts): classes of words after round ``number`` for each block and their counts in
    training; and (class, tokens, words), the size of each class in a bucket. Only seeds have classes before round 0."""
    width = len(table)
    classes = width - 2
    profile = np.concatenate([table[:, :classes].T, table[:classes]], axis=1).astype(np.float64)
    rows = _rows(KNOWN)

    def move(key, messages):
        ids = [_unpack_rising(i.as_py()) for i in messages.column("ids")]
        found = np.full(max(int(i[-1]) for i in ids) + 1, classes)
        keys, counts = [], []
        for own, labels, cells, n in zip(ids, *(messages.column(c) for c in ("labels", "cells", "counts")), strict=True):
            found[own] = _unpack(labels.as_py(), np.int16)
            cells = _unpack_rising(cells.as_py())
            keys.append(own[cells // (2 * width)] * (2 * width) + cells % (2 * width))
            counts.append(_unpack(n.as_py()))
        keys, n = _summed(np.concatenate(keys), np.concatenate(counts), len(found) * 2 * width)
        word, context = keys // (2 * width), keys % (2 * width)
        total = np.bincount(word, n * (context < width), len(found)).astype(np.int64)
        new = np.where(found < classes, found, -1)
        best = gains(word, context, n.astype(np.float64), new, profile).argmax(axis=1)
        turn = found == classes if number == 0 else np.arange(len(found)) % 2 == number % 2
        new = np.where(total == 0, classes, np.where(turn, best, found))
        sizes = [np.bincount(new, total, width).astype(np.int64), np.bincount(new, minlength=width)]
        return pa.Table.from_batches([
            rows({
                "block": messages.column("block").to_pylist(), "bucket": [key[0].as_py()] * len(ids),
                "labels": [_pack(new[i], np.int16) for i in ids], "counts": [_pack(total[i], np.int64) for i in ids],
            }, len(ids)),
            rows({"class": np.arange(classes), "tokens": sizes[0][:classes], "words": sizes[1][:classes]}, classes),
        ])

    return contexts.where("block is not null").select("block", "bucket", "ids", "labels", "cells", "counts").groupBy("bucket").applyInArrow(move, KNOWN)


def _with(blocks: DataFrame, messages: DataFrame, name: str, *columns: str) -> DataFrame:
    """``blocks`` with what buckets sent to each of them, in the order of buckets."""
    sent = messages.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name))
    return blocks.join(sent, "block", "left")


@dataclass(frozen=True)
class Model:
    """What is known of classes: the log10 tables that score tokens."""

    train_tokens: int
    distinct: int
    class_size: np.ndarray  # tokens and distinct words of each class
    transition: np.ndarray  # log10 P(class | class before), unknown and start last

    @property
    def base_total(self) -> int:
        return self.train_tokens + self.distinct + 1


def score(docs: DataFrame, train: Column, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between white space, A-Z in lower case, and one end for each text; a null
    text is empty, so it has the end alone. Counts come from all rows where ``train`` holds (null:
    not). ``base_score`` is the add-one unigram log10 probability and ``score`` that of the class
    bigrams. Unseen words are one type in a class of its own, as likely as words seen once. Without training rows nothing is known,
    and every token has probability 1. Repeated rows count and return as often as they are there;
    an empty table gives an empty table; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    blocks = stage(_blocks(docs, train, int(spark.conf.get("spark.sql.shuffle.partitions"))), "blocks")
    numbers = stage(_numbers(blocks.where("words is not null").select("block", "bucket", "words", "counts"), classes), "numbers")
    whole = blocks.where("tokens is not null").drop("bucket", "words", "counts")
    numbered = stage(_with(whole, numbers, "numbers", "ids"), "numbered")
    seeds: dict[int, list[tuple[int, int]]] = {}
    top = numbers.where("id is not null").orderBy(F.desc("c"), "word").limit(classes).select("bucket", "id").collect()
    for number, (bucket, i) in enumerate(top):
        seeds.setdefault(bucket, []).append((i, number))
    discard(blocks, numbers)
    size = np.zeros((len(top), 2), np.int64)
    unknown, start, width = len(size), len(size) + 1, len(size) + 2
    cells = width**2

    def summed(counted: DataFrame) -> np.ndarray:
        table = np.zeros(cells, np.float64)
        for row in counted.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            table[row["cell"]] = row["n"]
        return table.reshape(width, width)

    known = None
    for number in range(rounds + 1 if top else 0):
        given = numbered if known is None else _with(numbered, known, "known", "labels")
        contexts = stage(_contexts(given, len(size), seeds if known is None else None), "contexts")
        if known is not None:
            discard(known)
        known = stage(_moved(contexts, summed(contexts), number), "classes")
        discard(contexts)
    if known is None:
        last = numbered.withColumn("known", F.lit(None).cast("array<struct<bucket:int,labels:binary,counts:binary>>"))
    else:
        for row in known.where("class is not null").groupBy("class").agg(F.sum("tokens"), F.sum("words")).collect():
            size[row[0]] = row[1:]
        last = stage(_with(numbered, known, "known", "labels", "counts").drop("numbers"), "labelled")
        discard(numbered, known)

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                counts, labels, before, used, _, _ = _labelled(batch, row, unknown, start)
                total += np.bincount((before * width + labels)[used], minlength=cells)
                # What was seen once stands for what is yet unseen.
                total += np.bincount((before * width + unknown)[used & (counts == 1)], minlength=cells)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["cell", "n"])

    model = fit_transitions(size, summed(last.mapInArrow(count, "cell long, n long")))
    id_type = docs.schema["doc_id"].dataType
    out = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def rate(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                counts, labels, before, _, sizes, firsts = _labelled(batch, row, unknown, start)
                emission = np.zeros(len(counts))
                seen = counts > 0
                within = model.class_size.sum(axis=1)
                emission[seen] = np.log10((counts[seen] + 1) / within[labels[seen]])
                own = emission + model.transition[before, labels]
                base = np.log10((counts + 1) / model.base_total)
                columns = [
                    batch.column("doc_id")[row].values, batch.column("train")[row].values, pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(seen.astype(np.int64), firsts)), pa.array(np.full(len(sizes), model.train_tokens, np.int64)),
                    pa.array(np.add.reduceat(base, firsts)), pa.array(np.add.reduceat(own, firsts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return last.mapInArrow(rate, out)


def _tokens(batch: pa.RecordBatch, row: int):
    """Places of the tokens of a block, sizes and first tokens of its texts, and which tokens train."""
    tokens = _unpack(batch.column("tokens")[row].as_py()).astype(np.int64)
    sizes = batch.column("sizes")[row].values.to_numpy()
    used = np.repeat(batch.column("train")[row].values.to_numpy(zero_copy_only=False).astype(bool), sizes)
    return tokens, sizes, np.cumsum(sizes) - sizes, used


def _known(batch: pa.RecordBatch, row: int, unknown: int):
    """Class and, where sent, count of each word of a block."""
    known = batch.column("known")[row].as_py()
    if known is None:
        size = batch.column("bounds")[row].values[-1].as_py()
        return np.full(size, unknown), np.zeros(size, np.int64)
    label = np.concatenate([_unpack(k["labels"], np.int16) for k in known]).astype(np.int64)
    return label, np.concatenate([_unpack(k["counts"], np.int64) for k in known]) if "counts" in known[0] else None


def _labelled(batch: pa.RecordBatch, row: int, unknown: int, start: int):
    """Count, class and class before of each token of a block, whether it trains, and sizes and first tokens of texts."""
    tokens, sizes, firsts, used = _tokens(batch, row)
    label, counts = _known(batch, row, unknown)
    labels = label[tokens]
    before = np.roll(labels, 1)
    before[firsts] = start
    return counts[tokens], labels, before, used, sizes, firsts


def fit_transitions(size: np.ndarray, table: np.ndarray, prior: float = TRANSITION_PRIOR) -> Model:
    """Smoothed transitions: counts drawn towards the classes' own add-one frequencies.

    The unknown class has the words seen once as its count, so each row sums to one.
    """
    tokens, distinct = int(size[:, 0].sum()), int(size[:, 1].sum())
    frequency = np.zeros(len(size) + 2)
    frequency[: len(size)] = size.sum(axis=1)
    frequency[len(size)] = 1
    frequency /= tokens + distinct + 1
    with np.errstate(divide="ignore"):
        transition = np.log10((table + prior * frequency) / (table.sum(axis=1, keepdims=True) + prior))
    return Model(tokens, distinct, size, transition)
