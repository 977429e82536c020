import re

import pytest
from pyspark.sql.types import StructType

import corpus_pipeline
from ledgerloom.llm import langid
from tests.llm.test_near import brute as brute_near
from tests.llm.test_near import corpus as near_corpus
from tests.llm.test_repeats import brute as brute_repeats
from tests.llm.test_repeats import corpus as repeats_corpus

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, bands int"


@pytest.fixture(scope="module")
def rows():
    texts = [t for _, t in near_corpus(9)] + [t for _, t in repeats_corpus(9)] + ["12 34 56", None, ""]
    return [(i, t, None if i % 7 == 0 else "en" if i % 2 else "de", "s", len(t or ""), "clash", 1) for i, t in enumerate(texts)]


def test_stages_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}

    kept = corpus_pipeline.language(spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, t in texts.items() if not re.search(r"[^\W\d_]", t or "")} == set(texts) - ids, "with two labels no score is below a half"

    unique = corpus_pipeline.near_copies(spark, kept, str(tmp_path)).cache()
    want = {int(d) for d, _, _, keep in brute_near([(i, texts[i]) for i in sorted(ids)], 5, 80) if keep}
    assert unique.columns == docs.columns and sorted(r.doc_id for r in unique.collect()) == sorted(want)

    clean = corpus_pipeline.passages(spark, unique, str(tmp_path)).cache()
    want_texts = {int(d): text for d, _, _, text in brute_repeats([(i, texts[i]) for i in sorted(want)], 13) if text}
    got = clean.collect()
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in got} == want_texts and all(r.n_chars == len(r.text) for r in got)

    packed = corpus_pipeline.packing(spark, clean, str(tmp_path)).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in packed} and tokens.keys() == want_texts.keys()

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start if r.doc_tokens <= 1024 else 0, r.doc_tokens) for r in whole if r.start == 0) == sorted((r.doc_id, 0, r.doc_tokens) for r in packed if r.start == 0)


def test_odd_rows_and_no_rows(spark, tmp_path):
    odd = [(None, "The house", None, None, None, "k", 1), (3, "The house by the river", None, None, 5, "k", 1), (3, "The house by the river", None, None, 5, "k", 1), (4, None, "en", "s", 0, "k", 1)]
    spark.createDataFrame(odd, COLUMNS).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(str(r.doc_id) for r in out) in (["3", "None"], [])
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["_id", "_pred", "lang_pred", "score", "row", "N_words", "n_removed", "a.b", "a b"])
def test_columns_of_any_name(spark, tmp_path, name):
    kind = StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add(name, "integer").add("s", StructType().add("x y", "integer"))
    words = [[f"{a}{i}" for i in range(20)] for a in ("house", "fluss")]
    docs = spark.createDataFrame([(i, " ".join(w), "en" if i else "de", i + 5, (9,)) for i, w in enumerate(words)], kind)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", name, "s"]
        assert sorted((r[0], r[1], r[3], r[4][0]) for r in docs.collect()) == [(i, " ".join(w), i + 5, 9) for i, w in enumerate(words)]


def test_stages_are_the_dealt_operators_in_order(spark, monkeypatch, tmp_path):
    called = []
    for name in ("langid.identify", "near_duplicates", "remove_repeats", "pack"):
        owner, attribute = (langid, "identify") if "." in name else (corpus_pipeline, name)
        monkeypatch.setattr(owner, attribute, lambda *a, _name=name, _whole=getattr(owner, attribute), **k: (called.append(_name), _whole(*a, **k))[1])
    spark.createDataFrame([(1, "some text", "en", "s", 9, "k", 1)], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert called == ["langid.identify", "near_duplicates", "remove_repeats", "pack"]
