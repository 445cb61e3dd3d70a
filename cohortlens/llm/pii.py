"""Personal data: regular expressions propose, validators confirm, context words score.

DataFrame functions only. Where a pattern matches, the pieces between its matches give the
offsets and the words before each match. Every pattern is written so that it runs in one
pass over any text (possessive repeats; a start is only tried where a run begins).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import prepare

#: Code points before a match that are searched for context words.
CONTEXT_CHARS = 48
CONTEXT_GAIN = 0.3
#: Proposals of the kinds that the method adds need this score.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of data; ``gate`` is a cheap test of the whole text, ``base`` kinds need no score."""

    name: str
    pattern: str
    gate: str
    score: float
    context: str
    base: bool = True


# What counts as which kind. The order is that of equal starts.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.6, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "tel|phone|call|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", "", 0.7, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security", False),
)
BASE = tuple(k for k in KINDS if k.base)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """The remainder of an IBAN, its first four characters moved to the end, letters as 10 to 35."""
    compact = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    step = lambda rest, c: F.when(
        c >= "A", (rest * 100 + F.ascii(c) - 55) % 97
    ).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _valid(kind: Column, hit: Column) -> Column:
    small = F.forall(F.split(hit, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3) & F.forall(
        F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").try_cast("int") <= 255
    )
    count = F.length(_digits(hit))
    return (
        F.when(kind == "ip", F.coalesce(small, F.lit(False)))
        .when(kind == "card", count.between(14, 19) & F.call_function("luhn_check", F.when(count.between(14, 19), _digits(hit)).otherwise("0")))
        .when(kind == "phone", count.between(10, 15))
        .when(kind == "iban", _mod97(hit) == 1)
        .when(kind == "ssn", ~F.substring(hit, 1, 3).isin("000", "666") & (F.substring(hit, 1, 1) != "9"))
        .otherwise(True)
    )


def _proposals(text: Column, kind: Kind) -> Column:
    """(kind, rank, gap, before, hit) of each match, then one with a null hit for the rest."""
    gated = F.when(F.contains(text, F.lit(kind.gate)), text) if kind.gate else text
    hits = F.regexp_extract_all(gated, F.lit(kind.pattern), F.lit(0)).alias("hit")
    gaps = F.split(gated, kind.pattern).alias("gap")
    found = F.transform(
        F.arrays_zip(gaps, hits),
        lambda z: F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), F.length(z["gap"]).alias("gap"),
            F.right(z["gap"], F.lit(CONTEXT_CHARS)).alias("before"), z["hit"].alias("hit"),
        ),
    )
    return F.coalesce(F.filter(found, lambda x: x["hit"].isNotNull()), F.array().cast("array<struct<rank:int,gap:int,before:string,hit:string>>"))


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id and ``spans`` (start, rank, kind, end, text, score).

    Offsets are code points of the whole text, end exclusive; spans are sorted by start, then by
    the order of `KINDS`. A null or empty text has none, so its array is empty. Repeated rows
    stay repeated and null ids stay null; other columns are not read. Spans of different
    kinds may overlap. Only matches are shuffled, never texts.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    proposed = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), *[_proposals(text, k).alias(k.name) for k in KINDS])
    together = F.concat(*[F.col(k.name) for k in KINDS])
    exploded = proposed.select("doc_id", "row", F.posexplode_outer(together).alias("place", "m")).select("doc_id", "row", "place", "m.*")
    # A match starts where the gaps and hits of its kind before it end.
    so_far = Window.partitionBy("row", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    matches = exploded.repartition("row").withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(so_far))
    kind = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1)
    pick = lambda what: F.element_at(F.array(*[F.lit(getattr(k, what)) for k in KINDS]), F.col("rank") + 1)
    near = F.lit(False)
    for number, k in enumerate(KINDS):
        near = F.when(F.col("rank") == number, F.lower("before").rlike(rf"\b(?:{k.context})")).otherwise(near)
    scored = matches.withColumn("kind", kind).withColumn(
        "score", F.least(F.lit(1.0), pick("score") + F.when(near, CONTEXT_GAIN).otherwise(0.0))
    )
    kept = _valid(F.col("kind"), F.col("hit")) & (pick("base") | (F.col("score") >= THRESHOLD))
    span = F.when(
        F.col("hit").isNotNull() & kept,
        F.struct(
            (F.col("end") - F.length("hit")).alias("start"), "rank", "kind", "end", F.col("hit").alias("text"), "score",
        ),
    )
    return scored.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("row")


def listing(spans: Column, kinds: tuple[Kind, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, comma-joined; only those of ``kinds`` if given."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*[k.name for k in kinds]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _sql_matches() -> str:
    """The proposals of each kind in DuckDB's dialect, from the stated patterns."""
    # The base patterns as they are stated, and the added ones.
    stated = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    return " UNION ALL ".join(
        f"SELECT doc_id, {n} AS rank, '{kind}' AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h FROM docs"
        for n, (kind, p) in enumerate(stated)
    )


#: The data have no IBAN or social security number in context, so ``spans`` are the base spans here.
CHECK = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_sql_matches()}),
e AS (SELECT doc_id, rank, kind, g, h, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (SELECT doc_id, rank, kind, h[i] AS hit, regexp_replace(h[i], '[^0-9]', '', 'g') AS d,
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0))::BIGINT AS a FROM e),
v AS (SELECT *, a + length(hit) AS b FROM s WHERE CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: CAST(x AS HUGEINT) <= 255))
  WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k:
    CASE WHEN k % 2 = 1 THEN CAST(d[length(d) + 1 - k] AS INT)
    WHEN CAST(d[length(d) + 1 - k] AS INT) > 4 THEN 2 * CAST(d[length(d) + 1 - k] AS INT) - 9
    ELSE 2 * CAST(d[length(d) + 1 - k] AS INT) END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 10 AND 15 ELSE true END),
r AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
  coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN r USING (doc_id)
"""
