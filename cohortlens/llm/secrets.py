"""Secrets in texts: stated patterns, and strings that look drawn at random.

Two Markov models of characters are compared: one of random strings, trained on strings labelled as secrets, and one
of ordinary words and identifiers. Both give the chance of a character after the one before it. A run of characters is
reported where the logarithm of the ratio of its two likelihoods exceeds that of the odds against a secret. The labels
come from the patterns: what they match is a secret (each distinct string once, however often it was copied); all other
runs of characters are ordinary if letters and digits do not meet in them. Runs where they do have no label, as unknown
secrets are among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare

# The stated patterns; names in either case, none with letters beyond ASCII.
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")
MIN_VALUE = 6
#: Order of spans with one start.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_CHARS = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
#: Share of plain chance in the random model; weight of single characters in a row of the ordinary one, and the share of
#: plain chance in these; the logarithm of the odds of a million to one against a secret.
RANDOM_CHANCE, ORDINARY_WEIGHT, ORDINARY_CHANCE = 0.5, 100.0, 0.001
ODDS = float(np.log(1e6))

_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
SIZE = len(ALPHABET) + 1

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of what the stated patterns match; leftmost, without overlap within a kind."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _secret(text: str, span: Span) -> str:
    start, kind, end = span
    return ASSIGN.match(text, start, end).group(1) if kind == 0 else text[start:end]


def codes(text: str) -> np.ndarray:
    """Places in the alphabet from 1, 0 for every other character."""
    return _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def pairs(text: str, unmixed: bool = False) -> np.ndarray:
    """How often each character of the alphabet follows each (0: the start of a run).

    ``unmixed`` leaves out runs in which both letters and digits occur.
    """
    own = codes(text).astype(np.int64)
    if not len(own):
        return np.zeros(SIZE * SIZE, np.int64)
    both = np.concatenate(([0], own[:-1])) * SIZE + own
    if unmixed:
        run = np.cumsum(own == 0)
        letters, digits = (np.bincount(run[(own >= low) & (own <= high)], minlength=run[-1] + 1) > 0 for low, high in ((1, 52), (53, 62)))
        both = both[~(letters & digits)[run]]
    return np.bincount(both, minlength=SIZE * SIZE)


@dataclass(frozen=True)
class Model:
    """Logarithm of the ratio of the two models' chances for each pair of characters."""

    ratio: np.ndarray

    def score(self, run: str) -> float:
        own = codes(run).astype(np.int64)
        return float(self.ratio[np.concatenate(([0], own[:-1])), own].sum())


def model(secret: np.ndarray, ordinary: np.ndarray) -> Model:
    """The two models from counts of pairs; what was never seen has plain chance.

    The random model mixes each row of counts with plain chance, the ordinary one with the counts of single characters.
    """
    plain = 1 / len(ALPHABET)

    def share(counts: np.ndarray, chance: float) -> np.ndarray:
        total = counts.sum(axis=-1, keepdims=True)
        return np.where(total > 0, (1 - chance) * counts / np.maximum(total, 1) + chance * plain, plain)

    drawn, known = (table.reshape(SIZE, SIZE)[:, 1:].astype(np.float64) for table in (secret, ordinary))
    single = share(known.sum(axis=0), ORDINARY_CHANCE)
    usual = (known + ORDINARY_WEIGHT * single) / (known.sum(axis=1, keepdims=True) + ORDINARY_WEIGHT)
    return Model(np.hstack([np.zeros((SIZE, 1)), np.log(share(drawn, RANDOM_CHANCE)) - np.log(usual)]))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct secrets of each batch, and last the counts of pairs in all else that the task has seen."""
    total = np.zeros(SIZE * SIZE, np.int64)
    for batch in batches:
        secrets = set()
        for value in batch.column(0):
            text = value.as_py()
            if not text:
                continue
            spans = base_spans(text)
            secrets.update(_secret(text, s) for s in spans)
            at, rest = 0, []
            for start, _, end in sorted(spans):
                rest.append(text[at : max(at, start)])
                at = max(at, end)
            total += pairs(" ".join([*rest, text[at:]]), unmixed=True)
        if secrets:
            yield pa.RecordBatch.from_pydict({"secret": list(secrets), "pair": [None] * len(secrets), "n": [None] * len(secrets)}, schema=_LABELLED)
    seen = np.flatnonzero(total)
    if len(seen):
        yield pa.RecordBatch.from_pydict({"secret": [None] * len(seen), "pair": seen, "n": total[seen]}, schema=_LABELLED)


_LABELLED = pa.schema([("secret", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])


def fit(docs: DataFrame) -> Model:
    """The two models, from the texts of all ``docs``; what comes back is a count for each pair of characters.

    Null and empty texts teach nothing; from an empty table both models are plain chance. Repeated rows count as often
    as they occur, but secrets once. Only ``text`` is read.
    """
    prepare(docs.sparkSession)
    labelled = docs.select("text").mapInArrow(_labelled, "secret string, pair long, n long")
    # One pass over the texts: secrets are made distinct, counts are summed, by one grouping.
    once = labelled.groupBy("secret", "pair").agg(F.sum("n").alias("n"))
    counted = once.select("secret", "pair", "n").mapInArrow(_merged, "secret boolean, pair long, n long")
    tables = {True: np.zeros(SIZE * SIZE, np.int64), False: np.zeros(SIZE * SIZE, np.int64)}
    for row in counted.groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect():
        tables[row["secret"]][row["pair"]] = row["n"]
    return model(tables[True], tables[False])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    secrets, ordinary = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
    for batch in batches:
        for secret, pair, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if secret is None:
                ordinary[pair] += n
            else:
                secrets += pairs(secret)
    for label, total in ((True, secrets), (False, ordinary)):
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_pydict({"secret": [label] * len(seen), "pair": seen, "n": total[seen]})


def spans(text: str | None, known: Model) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of all secrets of a text; random strings that touch a base span are part of it."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*s, known.score(_secret(text, s))) for s in base]
    borders = sorted((start, end) for start, _, end in base)
    for m in RUN.finditer(text):
        if not any(start < m.end() and m.start() < end for start, end in borders):
            score = known.score(m.group())
            if score > ODDS:
                found.append((m.start(), len(BASE), m.end(), score))
    return sorted(found)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("text", pa.string()), ("score", pa.float64())])
_SPAN_DDL = "array<struct<start:bigint,kind:string,end:bigint,text:string,score:double>>"


def find(docs: DataFrame, known: Model, into: str = "secrets") -> DataFrame:
    """Add the array ``into`` (start, kind, end, text, score) to every row of ``docs``, by start and then kind.

    Offsets are code points of the whole text, end exclusive; ``score`` is the logarithm of the likelihood ratio. A null
    or empty text has none. Repeated rows get equal results, other columns pass through, one named ``into`` is
    replaced. Each row is judged by itself, whatever the length of its text.
    """
    prepare(docs.sparkSession)

    def search(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            text = value.as_py()
            rows.append([{"start": a, "kind": KINDS[k], "end": b, "text": text[a:b], "score": s} for a, k, b, s in spans(text, known)])
        return pa.array(rows, pa.list_(_SPAN))

    return docs.withColumn(into, F.arrow_udf(search, _SPAN_DDL)(F.col("text")))


def _sql_base() -> str:
    """Base matches of each kind: (id, rank, kind, gaps before, hits)."""
    # The stated patterns.
    word = "".join
    either = lambda w: word(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), f"{either('api')}_?{either('key')}"])
    stated = (
        ("assign", rf"""({names})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", "AKIA[A-Z0-9]+"),
        ("hex", "[0-9a-f]+"),
    )
    parts = [
        f"SELECT id, {n} AS rank, '{kind}' AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, "
        f"regexp_extract_all(t, '{p}', {2 if kind == 'assign' else 0}) AS v FROM docs"
        for n, (kind, p) in enumerate(stated)
    ]
    return " UNION ALL ".join(parts)


def _sql_placed(table: str) -> str:
    """Matches of ``table`` as rows with start and end in code points."""
    return (
        f"SELECT * EXCLUDE (g, h, v, i), h[i] AS hit, v[i] AS secret, a, a + length(h[i]) AS b FROM (SELECT *, (list_sum(list_transform(g[1:i], lambda x: length(x))) "
        f"+ coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS a FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM {table}))"
    )


_RUN_SQL = f"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}"
_PLAIN = f"(1.0::DOUBLE / {len(ALPHABET)})"
_GRID = f"(SELECT unnest(range({SIZE})) AS p) CROSS JOIN (SELECT unnest(range(1, {SIZE})) AS q)"


def _sql_share(count: str, total: str, chance: float) -> str:
    return f"CASE WHEN coalesce({total}, 0) = 0 THEN {_PLAIN} ELSE (1 - {chance}::DOUBLE) * coalesce({count}, 0) / {total} + {chance}::DOUBLE * {_PLAIN} END"


def _sql_pairs(runs: str) -> str:
    """Counts of pairs in the distinct ``runs(run, n)``."""
    return (
        f"SELECT p, q, sum(n)::DOUBLE AS n FROM (SELECT n, strpos('{ALPHABET}', ch) AS q, coalesce(lag(strpos('{ALPHABET}', ch)) OVER (PARTITION BY run ORDER BY i), 0) AS p "
        f"FROM (SELECT run, n, unnest(string_split(run, '')) AS ch, unnest(range(length(run))) AS i FROM {runs} WHERE run <> '')) WHERE q > 0 GROUP BY p, q"
    )


CHECK = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_sql_base()}),
base AS (SELECT * FROM ({_sql_placed('m')}) WHERE CASE kind WHEN 'assign' THEN length(secret) >= 6 WHEN 'access' THEN length(hit) >= 20 ELSE length(hit) >= 24 END),
secrets AS (SELECT DISTINCT secret AS run, 1 AS n FROM base),
held AS (SELECT id, list(a) AS starts, list(b) AS ends FROM base GROUP BY id),
bare AS (SELECT id, t FROM docs WHERE id NOT IN (SELECT id FROM held) UNION ALL
  SELECT id, string_agg(CASE WHEN len(list_filter(list_zip(starts, ends), lambda z: z[1] <= i AND i < z[2])) > 0 THEN ' ' ELSE ch END, '' ORDER BY i)
  FROM (SELECT docs.id, starts, ends, unnest(string_split(t, '')) AS ch, unnest(range(length(t))) AS i FROM docs JOIN held ON docs.id = held.id) GROUP BY id),
plain_runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]+')) AS run FROM bare)
  WHERE NOT (regexp_matches(run, '[A-Za-z]') AND regexp_matches(run, '[0-9]')) GROUP BY run),
rand AS ({_sql_pairs('secrets')}), ord AS ({_sql_pairs('plain_runs')}),
singles AS (SELECT q, {_sql_share('n', '(SELECT sum(n) FROM ord)', ORDINARY_CHANCE)} AS u FROM (SELECT unnest(range(1, {SIZE})) AS q) LEFT JOIN (SELECT q, sum(n) AS n FROM ord GROUP BY q) USING (q)),
ratio AS (SELECT p, q, ln({_sql_share('r.n', 'rt.n', RANDOM_CHANCE)}) - ln((coalesce(o.n, 0) + {ORDINARY_WEIGHT} * u) / (coalesce(ot.n, 0) + {ORDINARY_WEIGHT})) AS w
  FROM {_GRID} JOIN singles USING (q) LEFT JOIN rand r USING (p, q) LEFT JOIN ord o USING (p, q)
  LEFT JOIN (SELECT p, sum(n) AS n FROM rand GROUP BY p) rt USING (p) LEFT JOIN (SELECT p, sum(n) AS n FROM ord GROUP BY p) ot USING (p)),
k AS (SELECT id, 3 AS rank, 'random' AS kind, string_split_regex(t, '{_RUN_SQL}') AS g, regexp_extract_all(t, '{_RUN_SQL}') AS h, regexp_extract_all(t, '{_RUN_SQL}') AS v FROM docs),
runs AS (SELECT row_number() OVER () AS n, s.* FROM ({_sql_placed('k')}) s
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.id = s.id AND base.a < s.b AND s.a < base.b)),
scored AS (SELECT c.n, sum(w) AS score FROM (
  SELECT n, strpos('{ALPHABET}', ch) AS q, coalesce(lag(strpos('{ALPHABET}', ch)) OVER (PARTITION BY n ORDER BY i), 0) AS p
  FROM (SELECT n, unnest(string_split(hit, '')) AS ch, unnest(range(length(hit))) AS i FROM runs)) c JOIN ratio USING (p, q) GROUP BY c.n),
found AS (SELECT id, rank, kind, a, b FROM base UNION ALL SELECT id, rank, kind, a, b FROM runs JOIN scored USING (n) WHERE score > {ODDS!r}),
r AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans
  FROM found GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN r USING (id)
"""
