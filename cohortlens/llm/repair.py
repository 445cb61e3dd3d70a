"""Repair of the turn structure of conversations by an auction for shortest paths.

The roles of a conversation have to read ``(s?(ua)+)?`` by their initials. Deleting, keeping and rerolling rows and
inserting empty ones have integer costs; the cheapest repair is a shortest path through a lattice with a layer for each
row and a node for each state of that pattern. The auction algorithm finds it: every node has a price, a lower bound of
its distance to the end, that never exceeds the cost of an arc plus the price at the arc's head. A path is extended
along an arc for which both are equal; where there is none, the price of the path's last node is raised to the least
of those sums and the path contracts by a node. Prices only rise, so an arc that was not tight when its tail was
extended never becomes tight while the tail stays on the path. Extending along the tight arc of the least letter
therefore leaves, once the end is reached, the least string among all cheapest repairs.

A conversation of any length is solved in chunks of `CHUNK` rows. Auctions for each state at a chunk's end give its
costs from state to state; summed from the last chunk backwards they price the chunk's end, and auctions against these
prices give the letters for each state at its start. Only these small tables are folded along a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ordered import distinct_counts
from cohortlens.llm import turns
from cohortlens.llm.common import prepare, stage
from cohortlens.llm.lines import BLANKS
from cohortlens.llm.trie import crc32_sql

CHUNK = 32

# Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}

#: States: nothing yet, after system, after user, after assistant; the role that is due in each.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 50
#: What each state costs after the last row, and the letters of the rows inserted then.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")

# A row's code: 4 x fault (0 none, 1 blank, 2 duplicate, 3 truncated) + initial (0 s, 1 u, 2 a, 3 other).
Arc = tuple[str, int, int, int]


def _arcs(code: int, state: int) -> tuple[Arc, ...]:
    """(letter, cost, layers ahead, state) of the arcs at a row, by letter."""
    fault, initial = divmod(code, 4)
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, DUE[state])]
    if fault in (0, 3):
        extra = TRUNCATED if fault == 3 else 0
        if initial == 0 and state == BEGIN:
            arcs.append(("K", extra, 1, SYSTEM))
        elif initial + 1 == DUE[state]:
            arcs.append(("K", extra, 1, DUE[state]))
        if initial + 1 != DUE[state]:
            arcs.append(("R", extra + REROLE, 1, DUE[state]))
    return tuple(sorted(arcs))


ARCS = tuple(tuple(_arcs(code, state) for state in range(4)) for code in range(16))
#: States from which the states at a chunk's end can be reached: a pattern that has begun never starts anew.
REACH = ((BEGIN,), (BEGIN, SYSTEM), (BEGIN, SYSTEM, USER, ASSISTANT), (BEGIN, SYSTEM, USER, ASSISTANT))


def auction(codes: bytes, ends: tuple[int, ...], start: int, prices: list[int]) -> tuple[int, str, int]:
    """(cost, letters, last state) of the cheapest path from ``start`` over rows ``codes`` to priced ``ends``.

    ``prices`` (4 for each layer) are raised in place and can serve another start with the same ends. The cost is
    `NEVER` where no path exists. ``ends`` must be 0 or more.
    """
    open_states = {s for e, price in enumerate(ends) if price < NEVER for s in REACH[e]}
    size, node, path, letters = 4 * len(codes), start, [], []
    while True:
        layer, state = divmod(node, 4)
        if node >= size:
            if prices[node] == ends[state] < NEVER:
                return prices[start], "".join(letters), state
            best, step, letter = ends[state], 0, ""
        else:
            best, step, letter = NEVER, 0, ""
            for name, cost, ahead, to in ARCS[codes[layer]][state]:
                if to in open_states:
                    head = 4 * (layer + ahead) + to
                    if cost + prices[head] < best:
                        best, step, letter = cost + prices[head], head, name
        if prices[node] < best:
            prices[node] = best
            if path:
                node = path.pop()
                letters.pop()
            elif best >= NEVER:
                return NEVER, "", state
        elif best >= NEVER:
            return NEVER, "", state
        else:
            path.append(node)
            letters.append(letter)
            node = step


def _prices(codes: bytes) -> list[int]:
    return [0] * (4 * len(codes) + 4)


@lru_cache(1 << 16)
def solve(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of a whole conversation."""
    cost, letters, state = auction(codes, END, BEGIN, _prices(codes))
    return cost, letters + TAIL[state]


@lru_cache(1 << 14)
def crossing(codes: bytes) -> tuple[int, ...]:
    """Costs from each state at a chunk's start to each at its end, row by row."""
    found = [[NEVER] * 4 for _ in range(4)]
    for end in range(4):
        prices = _prices(codes)
        for start in REACH[end]:
            found[start][end] = auction(codes, tuple(0 if e == end else NEVER for e in range(4)), start, prices)[0]
    return tuple(c for row in found for c in row)


@lru_cache(1 << 14)
def tracing(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """Letters and last state for each state at a chunk's start, against the prices of the states at its end."""
    prices = _prices(codes)
    return tuple(auction(codes, ends, start, prices)[1:] for start in range(4))


def _coded(hexadecimal: str) -> bytes:
    return bytes(int(c, 16) for c in hexadecimal)


def _solved(codes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solve(_coded(c)) for c in codes], columns=["cost", "audit"])


def _crossed(codes: pd.Series) -> pd.Series:
    return pd.Series([list(crossing(_coded(c))) for c in codes])


def _traced(codes: pd.Series, ends: pd.Series) -> pd.DataFrame:
    found = [tracing(_coded(c), tuple(map(int, e))) for c, e in zip(codes, ends, strict=True)]
    return pd.DataFrame({"letters": [[letters for letters, _ in f] for f in found], "states": [[state for _, state in f] for f in found]})


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _flushed(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches, bounded by number and by characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == size or chars > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_PRICED = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("ends", pa.list_(pa.int64())), ("cost", pa.int64())])
_CHOSEN = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_SHAS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the last to the first: prices at each one's end, less the smallest of them; the cost with the first."""

    def rows() -> Iterator[tuple]:
        key, ends = object(), END
        for conv_id, chunk, costs in _columns(batches, "conv_id", "chunk", "costs"):
            if conv_id != key:
                key, ends = conv_id, END
            low = min(ends)
            before = tuple(min(NEVER, *(costs[4 * s + e] + ends[e] for e in range(4))) for s in range(4))
            yield conv_id, chunk, [e - low for e in ends], before[BEGIN]
            ends = before

    return _flushed(rows(), _PRICED)


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from the first to the last: the letters from the state in which the chunk before ended."""

    def rows() -> Iterator[tuple]:
        key, cost, state, pieces = None, None, BEGIN, []
        for conv_id, chunk, traced, total in _columns(batches, "conv_id", "chunk", "traced", "cost"):
            if chunk == 0:
                if pieces:
                    yield key, cost, "".join(pieces) + TAIL[state]
                key, cost, state, pieces = conv_id, total, BEGIN, []
            pieces.append(traced["letters"][state])
            state = traced["states"][state]
        if pieces:
            yield key, cost, "".join(pieces) + TAIL[state]

    return _flushed(rows(), _CHOSEN)


def _initial(role: Column) -> Column:
    """Place of the role's first character in `INITIALS`, or one beyond."""
    place = F.position(F.left(role, F.lit(1)), F.lit(INITIALS))
    return F.when((role == "") | (place == 0), len(INITIALS)).otherwise(place - 1)


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``rows`` has conv_id, turn, role and text; role and text must not be null. A conversation's rows are taken by turn
    (null first), then role and text. A row counts by its first fault: no visible character, role and text seen in
    an earlier row, last visible character not one of ``.!?``. ``gaps`` are whole numbers missing between the turns
    (null where that is beyond 64 bits), ``illegal`` the neighbouring rows whose initials are not su, ua or au. A role
    that is empty has an initial like no other. A null conv_id is a conversation of its own. An empty table gives an
    empty table; columns beyond those named are not read.
    """
    prepare(rows.sparkSession)
    visible = F.btrim("text", F.lit(BLANKS))
    own = turns.placed(
        rows,
        {
            "blank": visible == "", "open": ~F.right(visible, F.lit(1)).isin(".", "!", "?"),
            "initial": _initial(F.col("role")),
        },
        "repair-rows",
    )
    # Rows that are the first with their role and text, by position; equal rows are combined before the shuffle.
    first = own.groupBy("conv_id", "t1", "t2").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("f_id"), F.col("pos").alias("f_pos"))
    joined = own.join(first, F.col("conv_id").eqNullSafe(F.col("f_id")) & (F.col("pos") == F.col("f_pos")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("f_pos").isNull(), 2).when(F.col("open"), 3).otherwise(0)
    coded = joined.select("conv_id", "pos", F.lower(F.hex((fault * 4 + F.col("initial")).cast("long"))).alias("code"), F.floor(F.col("pos") / CHUNK).cast("long").alias("chunk"))
    # A chunk also gets the row before it, for the pairs of neighbours.
    before = coded.where((F.col("pos") + 1) % CHUNK == 0).select("conv_id", (F.col("chunk") + 1).alias("chunk"), "pos", "code")
    grouped = coded.select("conv_id", "chunk", "pos", "code").unionByName(before).groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("held")
    )
    string = lambda a: F.array_join(F.transform(a, lambda x: x["code"]), "")
    count = lambda f: F.size(F.filter("here", lambda x: F.conv(x["code"], 16, 10).cast("int").between(4 * f, 4 * f + 3))).cast("long")
    initial = lambda x: F.conv(x["code"], 16, 10).cast("int") % 4
    pair = lambda a, b: F.concat(initial(a).cast("string"), initial(b).cast("string"))
    pairs = F.zip_with(F.slice("held", F.lit(1), F.size("held") - 1), F.slice("held", F.lit(2), F.size("held")), pair)
    chunks = stage(
        grouped.withColumn("here", F.filter("held", lambda x: x["pos"] >= F.col("chunk") * CHUNK))
        .where(F.size("here") > 0)
        .select(
            "conv_id", "chunk", string(F.col("here")).alias("codes"), *[count(f).alias(n) for f, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
            F.size(F.filter(pairs, lambda p: ~p.isin("01", "12", "21"))).cast("long").alias("illegal"),
        ),
        "repair-chunks",
    )
    counts = chunks.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    # A first chunk that is not full is a whole conversation.
    is_whole = (F.col("chunk") == 0) & (F.length("codes") < CHUNK)
    solved = F.pandas_udf(_solved, "struct<cost:bigint,audit:string>")
    crossed = F.pandas_udf(_crossed, "array<bigint>")
    trace = F.pandas_udf(_traced, "struct<letters:array<string>,states:array<int>>")
    short = chunks.where(is_whole).select("conv_id", solved("codes").alias("found")).select("conv_id", "found.cost", "found.audit")
    long = chunks.where(~is_whole)
    keyed = long.select("conv_id", "chunk", crossed("codes").alias("costs")).repartition("conv_id")
    priced = keyed.sortWithinPartitions("conv_id", F.col("chunk").desc()).mapInArrow(_backwards, "conv_id long, chunk long, ends array<long>, cost long")
    p = priced.withColumnsRenamed({"conv_id": "p_id", "chunk": "p_chunk"})
    traced = long.join(p, F.col("conv_id").eqNullSafe(F.col("p_id")) & (F.col("chunk") == F.col("p_chunk"))).select(
        "conv_id", "chunk", "cost", trace("codes", "ends").alias("traced")
    )
    folded = traced.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_forwards, "conv_id long, cost long, audit string")
    spans = rows.groupBy("conv_id").agg(F.min("turn").cast("decimal(38,0)").alias("low"), F.max("turn").cast("decimal(38,0)").alias("high"))
    distinct = distinct_counts(rows.where("turn is not null"), ["conv_id"], {"n": F.col("turn")})
    renamed = {name: df.withColumnRenamed("conv_id", f"{name}_id") for name, df in {"c": counts, "d": distinct, "s": spans}.items()}
    out = short.unionByName(folded)
    for name, df in renamed.items():
        out = out.join(df, F.col("conv_id").eqNullSafe(F.col(f"{name}_id")), "left")
    gap = (F.col("high") - F.col("low") + 1 - F.col("n")).try_cast("long")
    return out.select(
        "conv_id", F.when(F.col("n").isNull(), 0).otherwise(gap).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of repaired conversations from sorted audits and rows.

    A conversation's audit comes before its rows. Deleted rows are not given; a conversation without any row left gives
    one tuple without a place.
    """
    key, letters, at, place, state = None, "", 0, 0, BEGIN

    def inserted(upto: int) -> Iterator[tuple]:
        nonlocal at, place, state
        while at < upto and letters[at] == "I":
            state = DUE[state]
            yield key, place, ROLES[INITIALS[state - 1]], "", "I"
            at, place = at + 1, place + 1

    for conv_id, audit, role, text in _columns(batches, "conv_id", "audit", "role", "text"):
        if audit is not None:
            yield from inserted(len(letters))
            key, letters, at, place, state = conv_id, audit, 0, 0, BEGIN
            yield conv_id, None, None, None, None
            continue
        yield from inserted(len(letters))
        edit = letters[at]
        at += 1
        if edit == "D":
            continue
        if edit == "K":
            state = INITIALS.index(role[0]) + 1
        else:
            state = DUE[state]
            role = ROLES[INITIALS[state - 1]]
        yield conv_id, place, role, text, edit
        place += 1
    yield from inserted(len(letters))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _flushed((row for row in _edited(batches) if row[1] is not None), _ROWS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        key, digest = None, None
        for conv_id, place, role, text, _ in _edited(batches):
            if place is None:
                if digest is not None:
                    yield key, digest.hexdigest()
                key, digest = conv_id, hashlib.sha256()
            else:
                digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        if digest is not None:
            yield key, digest.hexdigest()

    return _flushed(rows(), _SHAS)


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order; a stream through a task, never held as a group."""
    none = F.lit(None).cast("string")
    both = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", none.alias("audit")).unionByName(
        found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"), none.alias("text"), "audit")
    )
    order = ["conv_id", "kind", "turn", "role", "text"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The conversations that the `audits` of ``rows`` give: conv_id, place (from 0), role, text, edit (K, R or I).

    A conversation whose rows are all deleted gives none. Each text is moved once.
    """
    prepare(rows.sparkSession)
    return _in_order(rows, found).mapInArrow(_rows, "conv_id long, place long, role string, text string, edit string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """SHA-256 of each of the `repaired` conversations as lines ``role:text``: conv_id, repaired_sha256.

    The digest of a conversation needs its lines one after the other; a task holds a batch of them at a time.
    """
    prepare(rows.sparkSession)
    return _in_order(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with seeded faults: (conv_id, turn, role, text), by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user. Nulls of any column
    count as one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    e = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), space), F.coalesce(F.col("text"), space)
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.when(e == 4, "user").otherwise(role).alias("role"),
            F.when(e == 1, "").when(e == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(True), F.when(e == 0, 0).when(e == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )



def _plus(x: str, cost: str | int, letters: str) -> str:
    """SQL: a state's text of nine digits of cost and letters, with an edit more."""
    return f"(lpad(CAST(CAST(left({x}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letters}')"


def _meets(states: str, initial: str) -> str:
    """SQL: keep or rerole the row from any of ``states``; nulls are states that cannot be reached."""
    kept, given = (", ".join(_plus(x, cost, letter) for x in states) for cost, letter in (("extra", "K"), ("extra + 3", "R")))
    return f"CASE WHEN fault IN (0, 3) THEN CASE WHEN ini = '{initial}' THEN least({kept}) ELSE least({given}) END END"


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DUE_SQL = "CASE WHEN (out - CASE WHEN has_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END"

CHECK = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS e FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN e = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN e = 1 THEN '' WHEN e = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(range(CASE WHEN e = 0 THEN 0 WHEN e = 3 THEN 2 ELSE 1 END)) AS copy FROM src
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini,
    trim(text, {_BLANK_SQL}) AS shown FROM d
), f AS (
  SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair,
    CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000:' AS b, NULL::VARCHAR AS s, '000000003:I' AS u, '000000006:II' AS a FROM c
  UNION ALL
  SELECT conv_id, i, b, s, least(u, {_plus('b', 3, 'I')}, {_plus('s', 3, 'I')}, {_plus('a', 3, 'I')}),
    least(a, {_plus('u', 3, 'I')}, {_plus('b', 6, 'II')}, {_plus('s', 6, 'II')})
  FROM (
    SELECT conv_id, i, {_plus('b', 4, 'D')} AS b,
      least({_plus('s', 4, 'D')}, CASE WHEN fault IN (0, 3) AND ini = 's' THEN {_plus('b', 'extra', 'K')} END) AS s,
      least({_plus('u', 4, 'D')}, {_meets('bsa', 'u')}) AS u, least({_plus('a', 4, 'D')}, {_meets('u', 'a')}) AS a
    FROM (SELECT dp.conv_id, dp.i + 1 AS i, b, s, u, a, fault, ini, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1) step
  ) rows
), best AS (
  SELECT c.*, CAST(left(least(b, a), 9) AS BIGINT) AS cost, substr(least(b, a), 11) AS audit
  FROM c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n
), l AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''
), w AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS out FROM l
), x AS (
  SELECT w.*, f.role, f.text, bool_or(out = 1 AND letter = 'K' AND ini = 's') OVER (PARTITION BY w.conv_id) AS has_s
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i AND w.letter <> 'I'
), r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role ELSE {_DUE_SQL} END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END,
    chr(10) ORDER BY p)) AS sha FROM x WHERE letter <> 'D' GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
