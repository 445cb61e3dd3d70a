"""Toxicity categories predicted by a chain of linear classifiers.

The categories are predicted in a fixed order. Each classifier sees the features of the text and the
probabilities of the categories before it. In training these are out-of-fold: they come from models
that did not see the row, so later classifiers learn from inputs like those they meet in use.

Features are words, their beginnings and endings, each counted once for each distinct word of a text,
and a few shares that describe the text as a whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare, stage
from cohortlens.llm.contamination import words_of

#: Bounds of the training sample and of the features kept for each category.
SAMPLE_ROWS = 12_000
FEATURES = 1_500
MIN_SUPPORT = 4
MIN_LOG_ODDS = 1.5
FOLDS = 4
STEPS = 250
PENALTY = 1.0
COUNT_CAP = 3.0
#: Words whose features a worker remembers.
CACHE_WORDS = 300_000

LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
CAPITALS = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\x0b\x0c\r"
SHARES = 6


def word_features(word: bytes) -> tuple[bytes, ...]:
    """The word itself, its beginnings of 3 to 6 bytes and its endings of 4 and 5."""
    parts = {word + b"$^"}
    parts |= {word[:n] + b"^" for n in (3, 4, 5, 6) if len(word) > n}
    parts |= {word[-n:] + b"$" for n in (4, 5) if len(word) > n}
    return tuple(parts)


def shares(text: str, words: list[bytes]) -> list[float]:
    """Shares of letters, capitals, digits and marks in the text, of distinct words, and its length."""
    data = text.encode()
    size = max(1, len(data))
    without = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    letters, digits, blanks = without(LETTERS), without(DIGITS), without(SPACE)
    return [
        letters, without(CAPITALS), digits, 1.0 - letters - digits - blanks,
        len(set(words)) / max(1, len(words)), min(1.0, np.log10(size) / 6),
    ]


def _words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


@dataclass(frozen=True)
class Link:
    """One classifier of the chain: weights of features, shares and earlier probabilities, last the constant."""

    category: str
    weights: np.ndarray
    threshold: float


@dataclass(frozen=True)
class Chain:
    features: dict[bytes, int]
    links: tuple[Link, ...]

    def rows(self, text: str | None, cache: dict[bytes, tuple[int, ...]]) -> tuple[dict[int, float], list[float]]:
        words = _words(text)
        counts: dict[int, float] = {}
        for word in set(words):
            own = cache.get(word)
            if own is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                own = cache[word] = tuple(self.features[f] for f in word_features(word) if f in self.features)
            for f in own:
                counts[f] = counts.get(f, 0.0) + 1.0
        return counts, shares(text or "", words)

    def predict(self, counts: dict[int, float], described: list[float]) -> list[float]:
        if not self.links:
            return []
        size, found = len(self.features), []
        at = np.fromiter(counts, np.int64, len(counts))
        values = np.minimum(np.fromiter(counts.values(), np.float64, len(counts)), COUNT_CAP)
        for link in self.links:
            rest = np.array([*described, *found, 1.0])
            found.append(float(_sigmoid(link.weights[at] @ values + link.weights[size:] @ rest)))
        return found


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _fit_one(row: np.ndarray, column: np.ndarray, value: np.ndarray, extra: np.ndarray, target: np.ndarray, size: int) -> np.ndarray:
    """L2 logistic regression by accelerated gradient steps; sparse (row, column, value) and dense ``extra``."""
    n, dense = extra.shape
    weights = np.zeros(size + dense)
    look, momentum = weights.copy(), 1.0
    # The largest curvature is bounded by a quarter of the largest squared row norm times n.
    norms = np.bincount(row, value**2, n) + (extra**2).sum(axis=1)
    rate = 4.0 / (norms.mean() * 4 * n + PENALTY)
    for _ in range(STEPS):
        error = _sigmoid(np.bincount(row, value * look[column], n) + extra @ look[size:]) - target
        slope = np.concatenate([np.bincount(column, value * error[row], size), extra.T @ error])
        slope[:-1] += PENALTY * look[:-1]
        new = look - rate * slope
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / following * (new - weights)
        weights, momentum = new, following
    return weights


def _best_threshold(p: np.ndarray, target: np.ndarray) -> float:
    """The out-of-fold threshold of greatest F1; halfway to the next lower probability."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + target.sum())
    at = int(f1.argmax())
    return float((p[order[at]] + p[order[min(at + 1, len(p) - 1)]]) / 2)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """A chain for ``categories``, 0/1 columns of ``labels(doc_id, ...)``, in their order.

    The sample is bounded: of the labels without a null, the ``sample_rows`` of smallest id hash, with
    the texts of ``docs(doc_id, text)``. Its rows and the best ``FEATURES`` features of each category are
    all the driver sees. Repeated labels of an id count once, at their largest; labels without a document
    are ignored. Without labelled documents the chain is empty; a category with one value only
    predicts that value's rate.
    """
    prepare(docs.sparkSession)
    given = labels.where(" and ".join(f"`{c}` is not null" for c in ["doc_id", *categories]))
    single = given.groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(c) for c in categories])
    chosen = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    labelled = chosen.select("doc_id", F.array(*categories).alias("y"))
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id"), "labelled")
    width = len(categories)

    def count(batches):
        total: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                step = np.array([1, *y])
                for f in {f for w in set(_words(text.as_py())) for f in word_features(w)}:
                    if f in total:
                        total[f] += step
                    else:
                        total[f] = step.copy()
        keys = list(total)
        values = np.array([total[k] for k in keys], np.int64).reshape(-1, width + 1)
        for at in range(0, len(keys), 50_000):
            part = values[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + 50_000], pa.binary()), *[pa.array(np.ascontiguousarray(part[:, i])) for i in range(width + 1)]],
                names=["feature", "n", *[f"y{i}" for i in range(width)]],
            )

    schema = "feature binary, n long" + "".join(f", y{i} long" for i in range(width))
    totals = sample.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.col("y")[i]), F.lit(0)) for i in range(width)]).first()
    if not totals[0]:
        return Chain({}, ())
    sums = sample.mapInArrow(count, schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ["n", *[f"y{i}" for i in range(width)]]])
    features: dict[bytes, int] = {}
    for i in range(width):
        yes, no = totals[i + 1], totals[0] - totals[i + 1]
        a, b = F.col(f"y{i}"), F.col("n") - F.col(f"y{i}")
        odds = F.log((a + 0.5) / (yes + 1.0)) - F.log((b + 0.5) / (no + 1.0))
        best = (
            sums.where((F.col("n") >= MIN_SUPPORT) & (F.abs(odds) >= MIN_LOG_ODDS))
            .orderBy(F.desc(F.abs(odds) * F.sqrt("n")), "feature").limit(FEATURES).select("feature").collect()
        )
        for row in best:
            features.setdefault(bytes(row["feature"]), len(features))

    plain = Chain(features, ())

    def lay_out(texts: pa.Array) -> pa.Array:
        cache: dict = {}
        out = []
        for text in texts:
            counts, described = plain.rows(text.as_py(), cache)
            out.append({"at": list(counts), "x": list(counts.values()), "described": described})
        return pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64())), ("described", pa.list_(pa.float64()))]))

    laid = sample.select(
        "doc_id", "y", F.arrow_udf(lay_out, "struct<at array<int>, x array<double>, described array<double>>")(F.col("text")).alias("f")
    ).select("doc_id", "y", "f.*")
    table = laid.toArrow().sort_by("doc_id")
    return _fit_chain(table, features, categories)


def _fit_chain(table: pa.Table, features: dict[bytes, int], categories: list[str]) -> Chain:
    n, size = table.num_rows, len(features)
    lists = table["at"].to_pylist()
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    column = np.array([f for x in lists for f in x], np.int64)
    value = np.minimum(np.array([v for x in table["x"].to_pylist() for v in x], np.float64), COUNT_CAP)
    described = np.array(table["described"].to_pylist(), np.float64).reshape(n, SHARES)
    targets = np.array(table["y"].to_pylist(), np.float64)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in table["doc_id"].to_pylist()])
    earlier = np.zeros((n, 0))
    links = []
    for i, category in enumerate(categories):
        extra, target = np.concatenate([described, earlier, np.ones((n, 1))], axis=1), targets[:, i]

        def train(rows: np.ndarray, extra=extra, target=target) -> np.ndarray:
            if not rows.any() or target[rows].min() == target[rows].max():
                rate = target[rows].mean() if rows.any() else target.mean()
                constant = np.zeros(size + extra.shape[1])
                constant[-1] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
                return constant
            use, place = rows[row], np.cumsum(rows) - 1
            return _fit_one(place[row[use]], column[use], value[use], extra[rows], target[rows], size)

        outside = np.zeros(n)
        for k in range(FOLDS):
            weights, held = train(fold != k), fold == k
            outside[held] = _sigmoid(np.bincount(row, value * weights[column], n) + extra @ weights[size:])[held]
        links.append(Link(category, train(np.ones(n, bool)), _best_threshold(outside, target)))
        earlier = np.concatenate([earlier, outside[:, None]], axis=1)
    return Chain(features, tuple(links))


def predict(docs: DataFrame, chain: Chain, into: str = "chain") -> DataFrame:
    """Add the array column ``into``, one struct (category, p, flag) for each category, to every row.

    ``p`` is the probability, 0 to 1, and ``flag`` whether it reaches the category's threshold. Whole
    texts are read; a null text is empty and is predicted from its shares alone, never flagged. An
    empty chain gives empty arrays. Repeated rows get equal results; an empty table gives an empty table;
    other columns pass through, one named ``into`` is replaced. The chain is of bounded size.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(chain)

    def rate(texts: pa.Array) -> pa.Array:
        own = shared.value
        cache: dict[bytes, tuple[int, ...]] = {}
        out = []
        for value in texts:
            text = value.as_py()
            found = own.predict(*own.rows(text, cache))
            out.append([
                {"category": k.category, "p": p, "flag": bool(text) and p >= k.threshold}
                for k, p in zip(own.links, found, strict=True)
            ])
        return pa.array(out, pa.list_(pa.struct([("category", pa.string()), ("p", pa.float64()), ("flag", pa.bool_())])))

    return docs.withColumn(into, F.arrow_udf(rate, "array<struct<category string, p double, flag boolean>>")(F.col("text")))
