"""The trie of prefixes and the repair of turn structure, held against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cohortlens.llm import catalogue, repair, trie, turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, pos string, f1 string, block string, chunk string"
EXTRA = ("p", "q", "f", "b", "c")


def made(rng, conversations=14, longest=30):
    """Awkward rows: nulls, ties, repeated rows, shared beginnings, empty and long texts, gaps in turns."""
    rows = []
    for c in [*range(conversations), 23, 45, -7]:
        own = rng.choice([0, 1, 2, 3, 5, longest])
        turn = 0
        for i in range(own):
            turn += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["user", "assistant"] if rng.random() < 0.5 else [("user", "assistant")[i % 2]])
            if rng.random() < 0.15:
                role = rng.choice(["system", "tool", "", None, "User"])
            text = rng.choice(["Hello.", "Yes?", "no end", "", None, " \t", "é漢字!", "Hello. ", f"unique {c} {i}.", "long " * 3000 + "."])
            rows.append((c, None if rng.random() < 0.1 else turn, role, text))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "no id."), (None, 2, None, None)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def least(value):
    return (value is not None, value if value is not None else 0)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((least(turn), (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns_ in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = own.get(donor, [])[:h] + turns_[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    out = set()
    for node in members:
        inside = [n for n in members if n[: len(node)] == node]
        kids = [n for n in inside if len(n) == len(node) + 1]
        leaves = [n for n in inside if not any(m[: len(n)] == n and len(m) > len(n) for m in inside)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in inside if n)
        out.add((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), len(leaves), saved,
            sha(",".join(map(str, sorted(ends.get(node, []))))),
        ))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_plain_one(spark, monkeypatch, seed):
    rows = made(random.Random(seed))
    # Small chunks, so that every border is met.
    monkeypatch.setattr(turns, "SPREAD", 8)
    monkeypatch.setattr(trie, "BLOCKS", 2)
    monkeypatch.setattr(trie, "PIECE", 2)
    found = [tuple(r) for r in trie.nodes(table(spark, rows)).collect()]
    assert len(found) == len(set(found)) and set(found) == trie_by_hand(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of many") for c in range(0, 400, 5) for t in range(11)]
    found = {tuple(r) for r in trie.nodes(table(spark, rows)).collect()}
    assert found == trie_by_hand(rows) and len(found) == 12
    assert trie.nodes(table(spark, [])).count() == 0
    assert trie.nodes(table(spark, [(None, 1, "user", "text")])).count() == 0


def cheapest_by_hand(rows):
    """Cost and letters by trying states row by row; ``rows`` are (initial, must go, truncated)."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(best):
        for state in ("", "s", "a", "u"):
            if state in best:
                cost, letters = best[state]
                offer = (cost + 3, letters + "I")
                if due[state] not in best or offer < best[due[state]]:
                    best[due[state]] = offer
        return best

    best = closed({"": (0, "")})
    for initial, gone, cut in rows:
        new = {}
        for state, (cost, letters) in best.items():
            offers = [(state, cost + 4, "D")]
            if not gone:
                extra = 3 if cut else 0
                offers.append((due[state], cost + extra + 3, "R"))
                if initial == due[state] or (initial == "s" and state == ""):
                    offers.append((initial, cost + extra, "K"))
            for to, c, letter in offers:
                if to not in new or (c, letters + letter) < new[to]:
                    new[to] = (c, letters + letter)
        best = closed(new)
    return min(best[s] for s in ("", "a") if s in best)


def repairs_by_hand(rows):
    kept, ids = defaultdict(list), {r[0] for r in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        e = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if e == 1:
            text = ""
        if e == 2:
            text = re.sub("[.!?]", "", text)
        if e == 4:
            role = "user"
        kept[c] += [(turn, role, text)] * (0 if e == 0 else 2 if e == 3 else 1)
    out = {}
    for c in ids:
        own = sorted(kept[c], key=lambda r: (least(r[0]), r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        times = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit = cheapest_by_hand([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)])
        lines, queue, state = [], list(own), ""
        for letter in audit:
            role, text = queue.pop(0)[1:] if letter != "I" else ("", "")
            if letter == "D":
                continue
            state = role[:1] if letter == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
        count = Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


@pytest.mark.parametrize("chunk", [3, repair.CHUNK])
def test_repairs_equal_the_plain_ones(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = made(random.Random(chunk))
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalogue.op12_structure_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == repairs_by_hand(rows) and len(found) == len({r[0] for r in rows})


def test_repaired_rows_are_given_in_order(spark):
    rows = table(spark, [(1, 1, "assistant", "Hi."), (1, 2, "user", "What?"), (2, 1, "user", ""), (3, 5, "system", "Be kind."), (3, 7, "user", "So."), (3, 8, "assistant", "Yes.")])
    found = repair.audits(rows)
    assert {r["conv_id"]: (r["audit"], r["cost"], r["gaps"]) for r in found.collect()} == {1: ("IKKI", 6, 0), 2: ("D", 4, 0), 3: ("KKK", 0, 1)}
    out = [tuple(r) for r in repair.repaired(rows, found).orderBy("conv_id", "place").collect()]
    assert out == [
        (1, 0, "user", "", "I"), (1, 1, "assistant", "Hi.", "K"), (1, 2, "user", "What?", "K"), (1, 3, "assistant", "", "I"),
        (3, 0, "system", "Be kind.", "K"), (3, 1, "user", "So.", "K"), (3, 2, "assistant", "Yes.", "K"),
    ]
    assert repair.audits(rows.limit(0)).count() == 0 and repair.digests(rows.limit(0), found.limit(0)).count() == 0


def test_auction_finds_the_least_cheapest_path():
    rng = random.Random(4)
    for size in (0, 1, 2, 3, 6, 12, 40):
        for _ in range(60):
            codes = bytes(rng.choice([rng.randrange(16), 1, 2]) for _ in range(size))
            rows = [("sua-"[c % 4], c // 4 in (1, 2), c // 4 == 3) for c in codes]
            assert repair.solve(codes) == cheapest_by_hand(rows)


def test_turns_beyond_64_bits_apart(spark):
    rows = table(spark, [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")])
    assert repair.audits(rows).first()["gaps"] is None


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_structure_repair"])
def test_queries_equal_their_sql_on_awkward_rows(spark, tmp_path, name):
    rows = [r for r in made(random.Random(9), longest=12) if r[2] != ""]
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    result = con.execute(catalogue.CHECKS[name])
    columns = [d[0] for d in result.description]
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    assert found.columns == columns
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in found.collect())
