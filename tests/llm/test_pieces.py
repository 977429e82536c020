import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ledgerloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "  x ", "Hello world, this is  a test.\n\tNew   line", "<s> </s> <unk> <0x41>", "naïve café über ﬁ①", "日本語テキスト 한국어 \U0001f600", "▁ b a▁b ▁▁", " ▁", "x" * 700,
    "1234567890 3.14", "erblewh tiontion inonnd the of and", "a b　c", "\x00\x01", "repeat", "repeat", "word " * 2000, "                   y", "éä ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def frame(spark, texts, ids=None):
    rows = [(i, t, "clash", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int").repartition(3)


def test_ids_are_the_library_s_and_decode(spark, library):
    got = {r.doc_id: r for r in pieces.encode(frame(spark, TEXTS), PATH).collect()}
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "")
        assert got[i].ids == want, t
        assert got[i].n_pieces == len(want) and got[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert got[i].decoded == library.decode(want) and got[i].round_trip


def test_whole_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pieces.encode(df, PATH).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.round_trip


def test_shortest_path_equals_all_paths():
    """A small unigram machine against every way to cut a text."""
    t = object.__new__(pieces.Transducer)
    t.merges, t.prefix, t.unknown, t.bytes = False, False, 0, {}
    t.weight = {"a": 2.0, "b": 2.5, "ab": 3.0, "ba": 4.0, "aba": 6.2, "bb": 4.1}
    t.ids = {p: i for i, p in enumerate(t.weight, 1)}
    t.index()
    for n in range(1, 8):
        for text in map("".join, itertools.product("ab", repeat=n)):
            ways = [[text[i:j] for i, j in zip((0, *cut), (*cut, n), strict=True)] for k in range(n) for cut in itertools.combinations(range(1, n), k)]
            best = min(sum(t.weight[p] for p in w) for w in ways if all(p in t.weight for p in w))
            got = [p for i in t.shortest(text, {}) for p in t.weight if t.ids[p] == i]
            assert "".join(got) == text and sum(t.weight[p] for p in got) == pytest.approx(best)


def test_null_and_repeated_ids_and_no_rows(spark):
    got = pieces.encode(frame(spark, ["a b", "a b", None], [None, 7, 7]), PATH, keep_ids=False).collect()
    assert sorted((str(r.doc_id), r.n_pieces) for r in got) == [("7", 0), ("7", 2), ("None", 2)] and "ids" not in got[0]
    assert pieces.encode(frame(spark, []), PATH).count() == 0
