import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import langid
from ledgerloom.llm.common import Block

WORDS = {"en": "the of and to in is that for was with house river stone".split(), "de": "der die und den von das mit sich des auf haus fluss".split(), "fr": "le la les des une est dans qui pour que maison pierre".split()}


def sentences(label, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[label], rng.integers(8, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return [(t, label) for k, label in enumerate(WORDS) for t in sentences(label, 80, k)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, label, "clash", 0.5) for i, (t, label) in enumerate(rows)], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


@pytest.fixture(scope="module")
def network(spark, rows):
    return langid.fit(frame(spark, rows))


def test_held_out_accuracy(spark, network):
    held = [(t, label) for k, label in enumerate(WORDS) for t in sentences(label, 40, 100 + k)]
    got = langid.identify(frame(spark, held), network, keep=["lang"]).collect()
    assert len(got) == len(held) and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_windows_cover_whole_texts():
    texts = ["", "a" * 300, None, "é" * 64, "b"]
    x, doc, length = langid.windows(Block(pa.array(texts)))
    for i, t in enumerate(texts):
        assert b"".join(bytes(w[:n]) for w, d, n in zip(x, doc, length, strict=True) if d == i) == (t or "").encode()


def test_the_answer_is_the_mean_over_windows(spark, network):
    text = " ".join(sentences("en", 9, 7)) + " " + " ".join(sentences("de", 2, 8))
    x, _, length = langid.windows(Block(pa.array([text])))
    mean = (network.probabilities(x) * length[:, None]).sum(axis=0) / length.sum()
    got = langid.identify(frame(spark, [(text, None)]), network).head()
    assert got.lang_pred == network.labels[int(mean.argmax())] and got.score == pytest.approx(float(mean.max()))


def test_tables_equal_the_convolution(network):
    x = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    features = []
    for w in langid.WIDTHS:
        e = network.p["embedding"][x]
        z = [np.concatenate([e[:, i + j] for j in range(w)], axis=1) @ network.p[f"filter{w}"] for i in range(langid.WINDOW - w + 1)]
        features.append(np.maximum(np.max(z, axis=0) + network.p[f"bias{w}"], 0))
    z = np.concatenate(features, axis=1) @ network.p["out"] + network.p["out_bias"]
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(network.probabilities(x), want, atol=1e-4)


def test_gradients():
    network = langid.Network(["a", "b"])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        network._tables = None
        return -np.log(network.probabilities(x)[np.arange(4), y]).mean()

    g = network.gradients(x, y)
    for name, at in (("out", (3, 1)), ("filter3", (5, 2)), ("bias2", (4,)), ("out_bias", (0,)), ("embedding", (int(x[0, 0]), 1))):
        step = 1e-6
        network.p[name][at] += step
        up = loss()
        network.p[name][at] -= 2 * step
        assert (up - loss()) / (2 * step) == pytest.approx(g[name][at], abs=1e-5), name
        network.p[name][at] += step


def test_odd_rows(spark, network):
    odd = [(None, "en"), ("", "en"), ("12 34 !?", "en"), ("The house", None), ("The house", None), ("der fluss " * 20000, None)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, odd), network).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred == got[4].lang_pred and got[5].lang_pred == "de"
    assert langid.identify(frame(spark, []), network).count() == 0


def test_nothing_learned(spark):
    nothing = frame(spark, [("The house", None), (None, "en")])
    assert langid.fit(nothing) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(nothing, None).collect()} == {("und", 0.0)}
