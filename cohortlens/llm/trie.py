"""The trie of conversation prefixes by ROLLUP over positional columns of turn ids.

A conversation is cut into blocks of `WIDTH` turns. A block is one row: the turn ids in `WIDTH` columns, and the node
at which the block begins (the prior block's last node), named by a fingerprint of all turns before. One statement,
``GROUP BY block, prior, ROLLUP (turn_1, ..., turn_n)``, then aggregates every prefix of every length at once;
``grouping_id`` tells how many of the block's turns belong to a prefix. Fingerprints are exclusive-or sums of hashes
of (position, turn id), so the prior node of every block comes from sums over blocks, not from one pass after another.

The first statement finds each node's smallest conversation, its owner. As members only get fewer with depth, a
conversation owns the nodes of its path from one depth on. Whatever a subtree sums, each node once, is therefore a sum
over the node's member conversations, which the second statement takes: no walk through the tree is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import turns
from cohortlens.llm.common import discard, prepare, stage

#: Turns of a block.
WIDTH = 4
#: Blocks whose running sums are taken in one window, and ids in one piece of a list.
BLOCKS = 1024
PIECE = 4096
SIBLINGS = 5
MAX_SHARED = 9

_TURN = "struct<t1:bigint,t2:bigint,size:bigint>"


def _wanted(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MAX_SHARED


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv_id, pos, t1, t2, size) and (conv_id, length) of rebuilt conversations, staged.

    Conversation c becomes the first h turns of conversation c - c % 5 (all if fewer, none if absent), then its own
    turns after its first h; h is crc32 of c in decimal, modulo 9. Turns are in the order of `turns.placed`; a null
    role or text counts as empty. Rows without a conv_id belong to no conversation and are left out.
    """
    empty = F.lit("")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"),
    )
    own = turns.placed(rows, {"size": F.octet_length("text").cast("long")}, "trie-turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    whole = stage(
        sizes.withColumns({"h": _wanted(F.col("conv_id")), "donor": F.col("conv_id") - F.col("conv_id") % SIBLINGS})
        .join(donors, "donor", "left")
        .withColumn("shared", F.least("h", F.coalesce("donor_n", F.lit(0))))
        .withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "donor", "n", "h", "shared", "length"),
        "trie-conversations",
    )
    cell = ["pos", "t1", "t2", "size"]
    heads = own.where((F.col("pos") < MAX_SHARED) & (F.col("conv_id") % SIBLINGS == 0)).select(F.col("conv_id").alias("donor"), *cell)
    first = whole.join(heads, "donor").where("pos < shared").select("conv_id", *cell)
    rest = (
        own.withColumn("part", turns.part_of(F.col("pos")))
        .join(turns.spread(whole, "n").select("conv_id", "part", "h", "shared"), ["conv_id", "part"])
        .where("pos >= h")
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "t1", "t2", "size")
    )
    cells = stage(first.unionByName(rest), "trie-rebuilt")
    discard(own)
    return cells, whole.select("conv_id", "length")


def _mark(pos: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn adds to the two halves of a fingerprint."""
    return F.xxhash64(F.lit(3), pos, turn["t1"], turn["t2"]), F.xxhash64(F.lit(4), pos, turn["t1"], turn["t2"])


def blocks(cells: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each conversation and block: (conv_id, block, here, last, prior, s_1, ...), staged.

    ``here`` is the number of turns of the block, ``last`` whether the conversation ends in it, ``prior`` the
    fingerprint and bytes of all turns before. A conversation without turns has one block without turns.
    """
    block, spot = F.floor(F.col("pos") / WIDTH).cast("long"), F.col("pos") % WIDTH
    turn = F.struct("t1", "t2", "size")
    mark1, mark2 = _mark(F.col("pos"), turn)
    held = cells.select("conv_id", block.alias("block"), spot.alias("spot"), "t1", "t2", "size", mark1.alias("m1"), mark2.alias("m2"))
    pick = lambda c, i: F.max(F.when(F.col("spot") == i, F.col(c))).alias(f"{c}_{i + 1}")
    wide = held.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("here"), F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.sum("size").alias("bytes"),
        *[pick(c, i) for i in range(WIDTH) for c in ("t1", "t2", "size")],
    )
    wide = stage(wide.withColumn("chunk", F.floor(F.col("block") / BLOCKS).cast("long")), "trie-wide")
    sums = {"m1": F.bit_xor, "m2": F.bit_xor, "bytes": F.sum}
    before = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        wide.groupBy("conv_id", "chunk").agg(*[f(c).alias(c) for c, f in sums.items()])
        .select("conv_id", "chunk", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c, f in sums.items()])
        .where("chunk > 0")
    )
    zero = F.lit(0).cast("long")
    part = lambda c, f: F.coalesce(f(c).over(before), zero).alias(f"{c}_before")
    cut = (
        wide.select("*", *[part(c, f) for c, f in sums.items()])
        .join(base, ["conv_id", "chunk"], "left")
        .select(
            "conv_id", "block", "here",
            F.struct(
                F.col("m1_before").bitwiseXOR(F.coalesce("m1_base", zero)).alias("f1"),
                F.col("m2_before").bitwiseXOR(F.coalesce("m2_base", zero)).alias("f2"),
                (F.col("bytes_before") + F.coalesce("bytes_base", zero)).alias("bytes"),
            ).alias("prior"),
            *[
                F.when(F.col(f"t1_{i}").isNotNull(), F.struct(F.col(f"t1_{i}").alias("t1"), F.col(f"t2_{i}").alias("t2"), F.col(f"size_{i}").alias("size"))).alias(f"s_{i}")
                for i in range(1, WIDTH + 1)
            ],
        )
    )
    part_blocks = turns.SPREAD // WIDTH
    with_length = cut.withColumn("part", F.floor(F.col("block") / part_blocks).cast("long")).join(
        turns.spread(lengths, "length"), ["conv_id", "part"]
    )
    turnless = lengths.where("length = 0").select(
        "conv_id", zero.alias("block"), zero.alias("here"),
        F.struct(zero.alias("f1"), zero.alias("f2"), zero.alias("bytes")).alias("prior"),
        *[F.lit(None).cast(_TURN).alias(f"s_{i}") for i in range(1, WIDTH + 1)], "length",
    )
    return stage(with_length.select(*turnless.columns).unionByName(turnless), "trie-blocks")


def _rollup(rows: DataFrame, measures: dict[str, str], by_level: dict[str, list[str]]) -> DataFrame:
    """One row for each node: its block, depth, fingerprint, bytes before its last turn, members, owner and measures.

    ``measures`` are SQL aggregates; each of ``by_level`` has one for every number of the block's turns, of which
    the node's own is taken.
    """
    columns = ", ".join(f"s_{i}" for i in range(1, WIDTH + 1))
    levels = [f"{sql} AS {name}_{j}" for name, sqls in by_level.items() for j, sql in enumerate(sqls)]
    wanted = ", ".join([f"{sql} AS {name}" for name, sql in measures.items()] + levels)
    rolled = rows.sparkSession.sql(
        f"SELECT block, prior, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, count(*) AS n_convs, "
        f"min(conv_id) AS conv_id, {wanted} FROM {{rows}} GROUP BY block, prior, ROLLUP ({columns})",
        rows=rows,
    )
    turn = [F.col(f"s_{i}") for i in range(1, WIDTH + 1)]
    level, depth = F.col("level"), F.col("block") * WIDTH + F.col("level")
    # Groups below a conversation's end hold null turns; the empty prefix of a later block is the prior block's last node.
    present = F.when(level == 0, F.col("block") == 0)
    for i, t in enumerate(turn):
        present = present.when(level == i + 1, t.isNotNull())
    nodes = rolled.where(present)
    f1, f2, up1, up2, bytes_before = F.col("prior.f1"), F.col("prior.f2"), F.col("prior.f1"), F.col("prior.f2"), F.col("prior.bytes")
    zero = F.lit(0).cast("long")
    for i, t in enumerate(turn):
        mark1, mark2 = _mark(F.col("block") * WIDTH + i, t)
        f1, f2 = (f.bitwiseXOR(F.when(level > i, m).otherwise(zero)) for f, m in ((f1, mark1), (f2, mark2)))
        up1, up2 = (f.bitwiseXOR(F.when(level > i + 1, m).otherwise(zero)) for f, m in ((up1, mark1), (up2, mark2)))
        bytes_before = bytes_before + F.when(level > i + 1, t["size"]).otherwise(zero)
    own = [F.element_at(F.array(*[F.col(f"{name}_{j}") for j in range(WIDTH + 1)]), (level + 1).cast("int")).alias(name) for name in by_level]
    return nodes.select(
        depth.alias("depth"), f1.alias("f1"), f2.alias("f2"), up1.alias("up1"), up2.alias("up2"),
        bytes_before.alias("bytes_before"), "n_convs", "conv_id", *measures, *own,
    )


def _lists(size: int):
    """Sorted (f1, f2, conv_id) to pieces of ``size`` comma-joined ids: (f1, f2, first, ids)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for f1, f2, conv_id in zip(*[batch.column(c).to_pylist() for c in ("f1", "f2", "conv_id")], strict=True):
                if (f1, f2) != key or len(ids) == size:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (f1, f2), []
                ids.append(conv_id)
            if out:
                yield _batch(out)
                out = []
        if ids:
            yield _batch([(*key, ids[0], ",".join(map(str, ids)))])

    return join


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("f1", "f2", "first", "ids")
    return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}, schema=_PIECES)


_PIECES = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 for each node; only the running digest is held."""
    key, digest, out = None, None, []

    def close() -> None:
        if digest is not None:
            out.append((*key, digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        f1, f2, sha = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sha, pa.string())], schema=_DIGESTS)

    for batch in batches:
        for f1, f2, ids in zip(*[batch.column(c).to_pylist() for c in ("f1", "f2", "ids")], strict=True):
            if (f1, f2) == key:
                digest.update(b"," + ids.encode())
            else:
                close()
                key, digest = (f1, f2), hashlib.sha256(ids.encode())
        if out:
            yield flush()
    close()
    if out:
        yield flush()


def _end_digests(rows: DataFrame) -> DataFrame:
    """(f1, f2, ends_sha256) of the nodes at which conversations end.

    The ids of a node are sorted and joined in many tasks, in pieces of `PIECE`; SHA-256 itself has to run over a
    node's pieces one after the other, in bounded memory.
    """
    f1, f2 = F.col("prior.f1"), F.col("prior.f2")
    for i in range(WIDTH):
        mark1, mark2 = _mark(F.col("block") * WIDTH + i, F.col(f"s_{i + 1}"))
        f1, f2 = (f.bitwiseXOR(F.when(F.col("here") > i, m).otherwise(F.lit(0).cast("long"))) for f, m in ((f1, mark1), (f2, mark2)))
    ends = rows.where("ends_at is not null").select(f1.alias("f1"), f2.alias("f2"), "conv_id")
    order = ["f1", "f2", "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_lists(PIECE), "f1 long, f2 long, first long, ids string")
    whole = pieces.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "first")
    return whole.mapInArrow(_digests, "f1 long, f2 long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what its subtree holds.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, bytes of last texts times the members beyond the first) and ends_sha256. An empty
    table has no node, not even a root. Rows of one turn are ordered by role and text; repeated rows are turns of their own;
    null roles and texts are empty ones; rows without conv_id are left out; other columns are not read. Texts of any
    length are hashed where they are read and never shuffled, but for those of different rows with one turn.
    """
    prepare(conversations.sparkSession)
    cells, lengths = rebuilt(conversations)
    cut = blocks(cells, lengths)
    ends_at = F.when(F.col("length") <= (F.col("block") + 1) * WIDTH, F.col("here"))
    rows = cut.withColumn("ends_at", ends_at)
    levels = range(WIDTH + 1)
    first = _rollup(rows, {}, {"n_ends": [f"count_if(ends_at = {j})" for j in levels]})
    owners = stage(
        first.groupBy("conv_id").agg(
            F.min("depth").alias("owned_from"), F.min("bytes_before").alias("bytes_to_own"),
            F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"),
        ),
        "trie-owners",
    )
    # A conversation that owns no node shares all of its bytes.
    sums = cells.groupBy("conv_id").agg(F.sum("size").alias("bytes"))
    known = (
        lengths.join(owners, "conv_id", "left").join(sums, "conv_id", "left")
        .select(
            "conv_id", "length", F.coalesce("owned_from", F.col("length") + 1).alias("owned_from"),
            F.coalesce("bytes_to_own", "bytes", F.lit(0)).alias("bytes_to_own"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        )
    )
    part_blocks = turns.SPREAD // WIDTH
    told = rows.drop("length").withColumn("part", F.floor(F.col("block") / part_blocks).cast("long")).join(
        turns.spread(known, "length"), ["conv_id", "part"]
    )
    depths = [f"(block * {WIDTH} + {j})" for j in levels]
    upto = [" + ".join(["prior.bytes", *[f"coalesce(s_{i}.size, 0)" for i in range(1, j)]]) for j in levels]
    second = stage(
        _rollup(
            told, {"n_leaves": "sum(leaf)"},
            {
                "saved_tokens": [f"sum(greatest(bytes_to_own - ({b}), 0))" for b in upto],
                "n_children": [f"count_if(owned_from <= {d} + 1 AND length > {d})" for d in depths],
                "begins": [f"count_if(owned_from = {d})" for d in depths],
            },
        ),
        "trie-nodes",
    )
    digests = stage(_end_digests(rows), "trie-ends")
    discard(cells, owners, cut)
    # Only where an owner's nodes begin its parent belongs to another conversation.
    root = second.where("depth = 0").select("conv_id").first()
    inner = second.where("depth > 0").select(
        F.col("depth").alias("p_depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_id")
    )
    starts = second.where("depth > 1 and begins > 0")
    under = starts.join(
        inner, (starts["up1"] == inner["p1"]) & (starts["up2"] == inner["p2"]) & (starts["depth"] - 1 == inner["p_depth"])
    ).select(*second.columns, F.col("parent_id").alias("parent_conv_id"))
    below_root = second.where("depth = 1 and begins > 0").select(
        *second.columns, F.lit(root["conv_id"] if root else None).cast("long").alias("parent_conv_id")
    )
    others = second.where("depth = 0 or begins = 0").select(
        *second.columns, F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        under.unionByName(below_root).unionByName(others)
        .join(digests, ["f1", "f2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB's dialect."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    eight = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {eight}), 4294967295)"


CHECK = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
hs AS (SELECT conv_id, l, conv_id - conv_id % 5 AS donor, ({crc32_sql('CAST(conv_id AS VARCHAR)')} % 9)::BIGINT AS h FROM own),
r AS (SELECT a.conv_id, coalesce(d.l[1:a.h], []) || a.l[a.h + 1:] AS l FROM hs a LEFT JOIN own d ON d.conv_id = a.donor),
p AS (SELECT conv_id, d, len(l) = d AS ends, md5(CAST(list_transform(l[1:d], lambda x: md5(x.role) || md5(x.text)) AS VARCHAR)) AS k,
  md5(CAST(list_transform(l[1:d - 1], lambda x: md5(x.role) || md5(x.text)) AS VARCHAR)) AS up, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS b
  FROM r, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d) u),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, any_value(up) AS up, count(*) FILTER (ends) AS ends,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS c FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(kids.c, 0) AS c FROM n LEFT JOIN kids USING (k, d)),
a AS (SELECT p.k, p.d, count(*) FILTER (m.c = 0) AS n_leaves, sum((m.n_convs - 1) * m.b) AS saved
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.k, p.d)
SELECT m.conv_id, m.d::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.c::BIGINT AS n_children,
  a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN a USING (k, d) LEFT JOIN m AS up ON up.k = m.up AND up.d = m.d - 1
"""
