import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import ann, bpe, brown, catalogue, contamination, langid, lines, pii, repeats, simhash, toxicity
from tests.llm.helpers import AWKWARD, documents, empty, key, lower, words, write

TEXTS = [t or "" for _, t, _ in AWKWARD]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# Language identification


def test_language_learns_and_rejects(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = catalogue.op1_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark, awkward):
    model = langid.fit(awkward)
    assert set(model) == {"de", "en", "es", "fr"}
    found = langid.identify(awkward, model)
    assert found.columns == [*awkward.columns, "language"]
    got = sorted(((r["doc_id"], r["text"], r["language"]["lang"]) for r in found.collect()), key=key)
    undetermined = {t for _, t, lang in got if lang == "und"}
    assert len(got) == len(AWKWARD) and undetermined == {None, "", " \t\n\x0b \n", "12345 !!! ---"}
    assert langid.fit(empty(spark)) == {} and langid.identify(empty(spark), model).count() == 0
    assert {r["language"]["lang"] for r in langid.identify(awkward, {}).collect()} == {"und"}


def test_language_under_a_shared_header(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    header = "This notice is placed before all of the texts that come from this source and it says nothing about what the texts themselves hold.\n"
    headed = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat(F.lit(header), "text")).otherwise(F.col("text")))
    model = langid.fit(headed)
    found = [r["language"] for r in langid.identify(docs.where("lang = 'fr'"), model).collect()]
    assert sum(r["lang"] == "fr" and not r["rejected"] for r in found) >= 0.95 * len(found) > 0
    # Equal excerpts count once, however many texts they come from.
    same = [(i, "one and the same", "en") for i in range(9)] + [(9, "another", "en")]
    assert sorted(langid.fit(documents(spark, same), 2)["en"].split(b"\n")) == [b"another", b"one and the same"]


def test_equal_sizes_are_rejected(spark):
    model = {"aa": b"some words", "bb": b"some words"}
    row = langid.identify(documents(spark, [(1, "any text", None)]), model).first()["language"]
    assert (row["lang"], row["score"], row["rejected"]) == ("aa", 0.0, True)


# Byte-pair encoding


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(catalogue.tokenizer_path())


@pytest.mark.parametrize("leaf", [7, 100, bpe.LEAF_CHARS])
def test_encoding_equals_that_of_the_library(awkward, reference, leaf):
    rows = bpe.encode(awkward, catalogue.tokenizer_path(), leaf_chars=leaf).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in AWKWARD)
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["source"] is None and r["row"] == "r"
        assert bpe.codec(catalogue.tokenizer_path()).decode(ids) == (r["text"] or "")


def test_tree_concatenation_is_exact(reference):
    codec, rng = bpe.codec(catalogue.tokenizer_path()), random.Random(5)
    parts = ["a", "b", "the", " ", "  ", "\n", "'s", "'", "é", "1", "23", "!!", "—", "漢字", "ab" * 30, "'re", "ing", "　"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 9)
        pieces = [codec.encode_plain(text[i : i + size]) for i in range(0, len(text), size)]
        assert codec.concat_tree(pieces) == reference.encode(text, add_special_tokens=False).ids


def test_encoding_an_empty_table(spark):
    assert bpe.encode(empty(spark), catalogue.tokenizer_path()).count() == 0


def test_bpe_query(spark, folder, corpus, reference):
    for r in catalogue.op2_bpe(spark, folder).collect():
        ids = reference.encode(corpus[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(reference.decode(ids, skip_special_tokens=False))


# Repeated byte strings


def cut_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((len(d), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def check_repeats(spark, texts):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["repeats"] for r in repeats.remove(docs).collect()}
    for i, (size, spans, kept) in enumerate(cut_by_hand(texts)):
        assert (got[i]["n_bytes"], [tuple(s) for s in got[i]["spans"]], bytes(got[i]["kept"])) == (size, spans, kept), i


def test_repeats_against_every_string(spark):
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, edge = prose(1200), prose(199)
    texts = [
        prose(500) + shared + prose(300), shared[200:700] + prose(90), prose(40) + shared[:260], prose(5) + edge, edge + prose(5),
        "x" * 450, "xy" * 300, "x" * 199, None, "", prose(3000), prose(150) + shared[1000:] + prose(150) + shared[1000:],
        *[prose(rng.randint(0, 250)) + shared[a : a + rng.randint(190, 420)] + prose(rng.randint(0, 250)) for a in range(0, 800, 37)],
    ]
    check_repeats(spark, texts)


def test_repeats_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE_BYTES", 700)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    check_repeats(spark, [long, "q" * 30 + long[600:1900], long[4700:], long[2000:2201] + "z"])


def test_repeats_of_awkward_rows(spark, awkward):
    rows = repeats.remove(awkward).collect()
    assert len(rows) == len(AWKWARD)
    twice = [r["repeats"] for r in rows if r["doc_id"] == 6]
    assert len(twice) == 2 and all(bytes(r["kept"]) == b"" and len(r["spans"]) == 1 for r in twice)
    assert repeats.remove(empty(spark)).count() == 0


def test_repeats_query(spark, folder, corpus):
    expected = dict(zip(corpus, cut_by_hand(corpus.values()), strict=True))
    for r in catalogue.op3_repeats(spark, folder).collect():
        size, spans, kept = expected[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, size - len(kept), len(spans), sha(kept))


# Personal data


def base_by_hand(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


PERSONAL = [
    "mail a.b+c@x-y.example.com, x@y no, a@b@c.de", "a@b.c_d@e.f.g", "ü 10.0.0.255 and 256.1.1.1 and 001.02.3.4.5 1.2.3.0000000255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005", "+1 (743) 555-3824; +49 30 1234567; ++1 2 3",
    "9" * 30_000, "a" * 30_000 + "@", "1." * 20_000, "漢字 x@y.zz 漢字 1.1.1.1", "", None, "x@y.zz" * 400,
    "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000 but not DE88370400440532013000",
    "his ssn is 123-45-6789", "code 123-45-6789",
]


def test_personal_data(spark):
    docs = documents(spark, [(i, t, None) for i, t in enumerate(PERSONAL)])
    rows = {r["doc_id"]: r for r in pii.find(docs).withColumn("base", pii.listing(F.col("spans"), pii.BASE)).collect()}
    for i, text in enumerate(PERSONAL):
        assert rows[i]["base"] == base_by_hand(text or ""), text
        assert all(s["text"] == text[s["start"] : s["end"]] for s in rows[i]["spans"])
    added = {(i, s["kind"], s["text"]) for i in rows for s in rows[i]["spans"] if s["kind"] in ("iban", "ssn")}
    assert added == {(12, "iban", "GB82 WEST 1234 5698 7654 32"), (12, "iban", "DE89370400440532013000"), (13, "ssn", "123-45-6789")}


def test_personal_data_of_awkward_rows(spark, awkward):
    assert pii.find(awkward).count() == len(AWKWARD) and pii.find(empty(spark)).count() == 0


# Language-model scores


def test_scores(spark, awkward):
    train = F.coalesce(F.col("doc_id") != 5, F.lit(True))
    rows = brown.score(awkward, train, classes=4).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in AWKWARD)
    tokens = [(i, [*words(t), "\n"]) for i, t, _ in AWKWARD]
    counts = Counter(w for i, own in tokens if i != 5 for w in own)
    total, distinct = sum(counts.values()), len(counts)
    base = sorted(
        (-1 if i is None else i, len(own), sum(counts[w] > 0 for w in own),
         round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6))
        for i, own in tokens
    )
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)
    assert got == base and all(r["train_tokens"] == total and r["score"] <= 0 for r in rows)


def test_score_probabilities_sum_to_one(spark):
    size, table = np.array([[5, 2], [7, 3]]), np.zeros((4, 4))
    table[0, :3], table[3, :2] = (3, 1, 2), (4, 5)
    model = brown.fit_transitions(size, table)
    assert np.allclose((10.0 ** model.transition).sum(axis=1), 1.0)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    kinds = rng.dirichlet(np.ones(2 * brown.CONTEXTS) * 0.2, 3)
    truth = rng.integers(0, 3, 300)
    vectors = np.array([rng.multinomial(40, kinds[k]) for k in truth])
    steps, values = [vectors[:3].astype(float)], []
    for _ in range(5):
        found = brown.assign(vectors, steps)
        profile = np.array([vectors[found == c].sum(axis=0) for c in range(3)], float)
        values.append(brown.likelihood(profile))
        steps.append(profile)
    assert values[-1] >= values[0]


def test_exchange_finds_classes_of_neighbours(spark):
    # Four kinds of words that follow each other in turn; only the kinds of neighbours tell a word's kind.
    rng = random.Random(5)
    kinds = [[f"w{rng.getrandbits(40):x}" for _ in range(60)] for _ in range(4)]
    rows = [(i, " ".join(rng.choice(kinds[j % 4]) for j in range(i % 4, i % 4 + 60)), None) for i in range(600)]
    # Random classes are no better than a word among 240, true ones as good as a word among 60.
    shuffled = [(i, " ".join(rng.sample(t.split(), 60)), None) for i, t, _ in rows]
    per_token = [
        brown.score(documents(spark, texts), F.col("doc_id") % 5 != 0, 5).where(~F.col("train")).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
        for texts in (rows, shuffled)
    ]
    assert per_token[0] > -math.log10(60) - 0.1 > per_token[1] + 0.3


def test_scores_without_training_rows(spark):
    rows = brown.score(documents(spark, [(1, "a b", None)]), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows] == [(3, 0, 0.0, 0.0)]
    assert brown.score(empty(spark), F.lit(True)).count() == 0


def test_scores_beat_the_base_on_held_out_texts(spark, folder):
    held = catalogue.op5_brown_lm(spark, folder).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# SimHash groups


def fingerprint_by_hand(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    head = {i: i for i in prints}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark, folder, corpus):
    prints = {i: fingerprint_by_hand(t) for i, t in corpus.items()}
    expected = groups_by_hand(prints)
    rows = catalogue.op6_simhash(spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in prints}


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (2, 3000), dtype=np.uint64)).astype(np.uint64)
    near = values ^ flips[0] ^ flips[1]
    assert all(set(a) & set(b) for a, b in zip(simhash.keys(values), simhash.keys(near), strict=True))


def test_links_and_components(spark):
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(60)]
    chain = [values[0]]
    for bit in range(0, 50, 2):
        chain.append(chain[-1] ^ (3 << bit))
    values += chain + [v ^ 1 << rng.randrange(64) for v in values[:20]]
    values += [v ^ 7 for v in values[20:40]]
    ids = dict(enumerate(sorted(set(values))))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in ids.values()], "fingerprint long")
    roots = {r["vertex"]: r["root"] for r in simhash.components(simhash.links(prints)).collect()}
    expected = groups_by_hand(ids)
    got = {i: roots.get(signed(v), signed(v)) for i, v in ids.items()}
    together = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    assert together(got) == together(expected)


def test_groups_of_awkward_rows(spark, awkward):
    rows = simhash.groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    wordless = [r for r in rows if r["fingerprint"] == 0]
    assert len(wordless) == 4 and {r["component_id"] for r in wordless} == {2}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    left = kept.collect()
    assert Counter(r["doc_id"] for r in left)[6] == 1 and len(left) == len(AWKWARD) - 4
    assert simhash.groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


# Line dedup


def lines_by_hand(texts, least):
    cut = [(t or "").split("\n") for t in texts]
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in own] for own in cut]
    seen = Counter(k for own in keys for k in set(own))
    return [
        "\n".join(x for x, k in zip(own, ks, strict=True) if not k or seen[k] < least) for own, ks in zip(cut, keys, strict=True)
    ]


def test_common_lines(spark):
    texts = [f"Same LINE \nown {i}\n\n  \tsame line\nÉ{i % 2}" for i in range(6)] + [None, "", "\n", "same line", "x\n" * 500]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    cut = lines.drop_common_lines(docs, min_docs=3)
    assert cut.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert [rows[i]["text"] for i in range(len(texts))] == lines_by_hand(texts, 3)
    assert [rows[i]["n_lines"] for i in range(len(texts))] == [(t or "").count("\n") + 1 for t in texts]
    first = {r["doc_id"]: r["text"] for r in lines.drop_common_lines(docs, 3, keep_first=True).collect()}
    assert first[0].startswith("Same LINE \nown 0") and "same" not in first[0] and "same" not in first[9]


def test_common_lines_of_awkward_rows(spark, awkward):
    rows = lines.drop_common_lines(awkward, min_docs=2).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in AWKWARD)
    assert {r["text"] for r in rows if r["doc_id"] == 6} == {AWKWARD[5][1]}  # equal rows are one document
    assert lines.drop_common_lines(empty(spark)).count() == 0


# Decontamination


def hits_by_hand(text, items, size=10):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    own = re.findall(pattern, lower(text or ""))
    hit, found = set(), set()
    for number, item in items:
        w = re.findall(pattern, lower(item or ""))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            window = w[i : i + size]
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(number))
    return len(own), len(hit), sorted(found)


def test_decontamination_query(spark, folder, corpus):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    for r in catalogue.op8_decontamination(spark, folder).collect():
        n, hit, ids = hits_by_hand(corpus[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(ids), sha(",".join(ids)))
        assert r["contaminated"] == (hit > 0)


def test_decontamination_of_awkward_rows(spark, awkward, monkeypatch):
    items = [(10, "a second ONE, quite"), (9, "ünïcödé"), (9, "plain"), (None, "tail3é"), (3, None), (4, "!?"), (5, "word1 tail1é word2")]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter((i, t, *map(str, hits_by_hand(t, [x for x in items if x[0] is not None])[::2])) for i, t, _ in AWKWARD)
    for room in (contamination.AUTOMATON_BYTES, 5):
        monkeypatch.setattr(contamination, "AUTOMATON_BYTES", room)
        rows = contamination.scan(awkward, table).collect()
        assert Counter((r["doc_id"], r["text"], str(r["contamination"]["n_words"]), str(r["contamination"]["item_ids"])) for r in rows) == expected
    first = next(r for r in rows if r["doc_id"] == 1)
    assert [r["text"][s["start"] : s["end"]] for r in [first] for s in r["contamination"]["spans"]] == ["plain", "a second one, quite", "plain"]
    assert contamination.scan(empty(spark), table).count() == 0
    assert all(r["contamination"]["n_hit"] == 0 for r in contamination.scan(awkward, table.limit(0)).collect())


# Nearest neighbours


def test_neighbours_query_recall(spark, folder):
    rows = catalogue.op9_ann(spark, folder).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    table = np.array([vectors[i] for i in ids])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q for r in own)
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(abs(r["score"] - vectors[r["vec_id"]] @ vectors[q]) < 1e-12 for r in own)
        scores = table @ vectors[q]
        scores[ids == q] = -np.inf
        hit += len({r["vec_id"] for r in own} & set(ids[np.argsort(-scores)[:20]].tolist()))
        total += 20
    assert hit >= 0.9 * total


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    index = ann.Index(codes)
    for radius in (0, 7, 20, 27):
        assert index.within(codes[5], radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[5]) <= radius).tolist()


def test_neighbours_of_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, shard string")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 9, -1.0)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0 and ann.search(df, F.col("vec_id") == 99).count() == 0


# Toxicity


def test_toxicity_on_labels_it_did_not_see(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad, poor = rng.random() < 0.3, rng.random() < 0.2
        own = [f"w{rng.randrange(400)}" for _ in range(40)] + (["vilestuff" + rng.choice("xyz")] * 2 if bad else []) + (["###"] * 9 if poor else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own), None))
        labels.append((i, int(poor), int(bad)))
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, poor int, toxic int")
    chain = toxicity.fit(docs, table.where("doc_id < 600"), ["poor", "toxic"])
    assert [k.category for k in chain.links] == ["poor", "toxic"]
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1
    found = {r["doc_id"]: r["chain"] for r in toxicity.predict(docs, chain).collect()}
    for place in (0, 1):
        right = sum(found[i][place]["flag"] == bool(label) for i, *own in labels[600:] for label in [own[place]])
        assert right >= 0.95 * 300


def test_toxicity_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(awkward, labels, ["toxic"])
    rows = toxicity.predict(awkward, chain).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["chain"][0]["p"] <= 1 for r in rows)
    assert not any(r["chain"][0]["flag"] for r in rows if not r["text"])
    nothing = toxicity.fit(awkward, labels.limit(0), ["toxic"])
    assert nothing.links == () and all(r["chain"] == [] for r in toxicity.predict(awkward, nothing).collect())
    assert toxicity.predict(empty(spark), chain).count() == 0
    one_sided = toxicity.fit(awkward, labels.where("toxic = 0"), ["toxic"])
    assert all(r["chain"][0]["p"] < 0.01 for r in toxicity.predict(awkward, one_sided).collect())


# The queries' folder form


def test_queries_on_an_empty_table(spark, tmp_path):
    folder = write(empty(spark), tmp_path)
    for name in ("op1_language_id", "op2_bpe", "op3_repeats", "op4_pii", "op5_brown_lm", "op6_simhash", "op7_line_dedup"):
        assert catalogue.QUERIES[name](spark, folder).count() == 0, name


def test_class_scores_do_not_depend_on_partitions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "7", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append({r["doc_id"]: (r["score"], r["base_score"]) for r in brown.score(docs, F.col("doc_id") % 7 != 2).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()
