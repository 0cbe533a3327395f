"""The corpus pipeline over a small folder: nulls, empty and long texts, repeats, extra and clashing columns, no rows."""

import hashlib

import pytest

import corpus_pipeline
from longview.llm import bpe
from longview.llm.common import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, k int, rate double"


def _text(i: int) -> str:
    return " ".join(f"the river house and the {w}{(i * 13 + k * 7) % 97}word" for k, w in enumerate("abcdefghijkl"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, _text(i), "aa", "s", 1, None, 1.0) for i in range(60)]
    rows += [(100, _text(3), "aa", None, 1, 1, None), (101, _text(3) + " tail", None, "s", 1, 1, None)]  # an exact copy, a near one
    rows += [(200, None, "aa", "s", 0, 1, None), (201, "", "aa", "s", 0, 1, None), (202, "12 34", "aa", "s", 0, 1, None), (None, _text(70), "aa", "s", 1, 1, None)]
    rows += [(300, "the river and the house " * 200, "aa", "s", 1, 1, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages_take_effect_and_keep_the_columns(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = {"language_id": {200, 201, 202}, "exact_dedup": {100}, "ngram_jaccard": {101}, "mixing": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = cut(stage(spark, docs, folder))
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert before - left == gone[name] if name != "mixing" else left <= before and len(left) > 0  # one long text holds nearly all tokens
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(got) == docs.count()
    for r in got:
        own = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()


def test_no_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
