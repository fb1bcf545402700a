"""The pipeline's stages, each on its predecessor's rows."""

import base64
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from clearwell.llm import secrets
from clearwell.llm.components import without

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").persist()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    yield out
    for df in out:
        df.unpersist()


def test_all_but_the_last_return_documents(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0


def test_decisions_take_effect(spark, stages):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in stages[:2])
    assert not [i for i in before - after if quality.get(i) == 1]
    assert not [i for i in after if quality.get(i) == 0]
    texts = Counter(r["text"] for r in stages[2].select("text").collect())
    assert max(texts.values()) == 1
    found = secrets.find_secrets(stages[4]).collect()
    assert not any(r["hex"] or r["access"] for r in found)


def test_tokens_are_those_of_the_library(stages):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for row in stages[5].collect():
        assert list(row["ids"]) == library.encode_ordinary(texts[row["doc_id"]] or "")


def test_run_equals_the_stages(spark, stages):
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r["doc_id"]: r["n_tokens"] for r in stages[5].collect()}


def test_rows_without_ids_stay_either_way(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x")], "doc_id long, text string, n string")
    gone = spark.createDataFrame([(2, 5), (2, 6), (None, 7), (9, 8)], "doc_id long, n int")
    for most in (1_000_000, 0):  # broadcast, and by shuffle
        assert sorted((r["text"], r["n"]) for r in without(docs, gone, "gone", most).collect()) == [("a", "x"), ("c", "x")]


def _odd(spark):
    """Rows of every awkward kind, with columns whose names stages use themselves."""
    plain = "the people of the town said that they would come again in the morning and that all was well with them "
    rows = [
        (None, plain * 3), (None, None), (1, plain * 3), (2, ""), (3, None), (4, " \n\t "), (5, plain * 3 + "x"), (5, plain + "y"), (6, plain), (6, plain),
        (7, plain * 400), (None, "password = hunter22secret and AKIA" + "Z" * 16), (8, "a" * 5000),
    ]
    return spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), "clash", 1, 0.5) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, item_id string, of int, score double",
    )


def test_stages_take_awkward_rows(spark):
    docs = _odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if stage is corpus_pipeline.tokens:
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
            assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
            continue
        assert out.columns == docs.columns, name
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        if stage is corpus_pipeline.mask_secrets:
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
            assert not any("hunter22secret" in (r["text"] or "") or "AKIAZ" in (r["text"] or "") for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
        else:
            assert not Counter((r["doc_id"], r["text"]) for r in rows) - texts, name
            if stage is not corpus_pipeline.quality:
                assert sum(r["doc_id"] is None for r in rows) == 3, name  # rows without an id are no copies, and these leak nothing


def test_stages_take_an_empty_table(spark):
    docs = _odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert stage is corpus_pipeline.tokens or out.columns == docs.columns


def test_the_last_stage_keeps_few_pieces_in_its_workers(spark, monkeypatch):
    """Worker caches stay while the other stages run, so they are a small part of an executor's memory."""
    given = []
    encode = corpus_pipeline.encode
    monkeypatch.setattr(corpus_pipeline, "encode", lambda *args, **more: given.append(more.get("room", 500_000)) or encode(*args, **more))
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert corpus_pipeline.tokens(spark, docs, "").count() == 2 and max(given) <= 100_000
