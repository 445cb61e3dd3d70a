from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm import bpe, catalogue, langid
from tests.llm.helpers import AWKWARD, LONG_TEXT, documents, empty
from tests.llm.test_operators import fingerprint_by_hand, groups_by_hand, hits_by_hand, lines_by_hand


def test_the_pipeline_against_its_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clear = langid.identify(docs, langid.fit(docs)).where("not language.rejected").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in clear.collect()}
    assert 0.9 * docs.count() <= len(texts) <= docs.count()
    texts = dict(zip(texts, lines_by_hand(texts.values(), 10), strict=True))
    heads = groups_by_hand({i: fingerprint_by_hand(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if heads[i] == i}
    texts = {i: t for i, t in texts.items() if not hits_by_hand(t, items)[1]}
    library = Tokenizer.from_file(catalogue.tokenizer_path())
    expected = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == expected and len(rows) == len(expected)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows)


def test_stages_keep_columns_and_take_awkward_rows(spark, folder):
    for docs, size in ((documents(spark), len(AWKWARD)), (empty(spark), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert len(last) == docs.count() <= size and all(r["round_trip"] for r in last)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe_encode"]


def test_near_duplicates_leave_one(spark, folder):
    rows = [(i, "the same few words again and again", "en") for i in (4, 2, 9)] + [(5, "something else entirely", "en")]
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), folder).collect()
    assert Counter(r["doc_id"] for r in kept) == {2: 1, 5: 1}


def test_wrong_ids_of_a_long_text_do_not_pass(spark, folder, monkeypatch):
    encoder = bpe.leaf_encoder
    monkeypatch.setattr(bpe, "leaf_encoder", lambda path: lambda leaf: encoder(path)(F.upper(leaf)))
    encoded = corpus_pipeline.bpe_encode(spark, documents(spark, [(1, LONG_TEXT, "en")]), folder)
    with pytest.raises(Exception, match="do not decode to their text"):
        encoded.collect()
