import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.common import Block, blocks
from ledgerloom.llm.packing import pack
from ledgerloom.llm.tokens import count_tokens
from ledgerloom.llm.units import units

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "The cat's  hat\n\n x", "<|endoftext|> a <|endoftext|>", "é é\u00a0 \u3000b \u00a0\u00a0 c", "x" * 5000, "word " * 3000,
    "\t\x0b\x1f \x1f a", "日本語 テキスト\n日本", "it's we'll 12 3.4 -- !!  \n", "a\u00a0\nb \u00a0c", " \u00a0 b", "repeat me", "repeat me",
]


@pytest.fixture(scope="module")
def expected():
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_tokens string, ids int").repartition(3)


def test_units_cover_the_texts():
    block = Block(pa.array(TEXTS))
    starts, ends, doc = units(block)
    assert b"".join(block.data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)).decode() == "".join(t or "" for t in TEXTS)
    assert [block.off[d] <= s and e <= block.off[d + 1] for s, e, d in zip(starts, ends, doc, strict=True)].count(False) == 0


def test_blocks_keep_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    for most in (1, 50, 10**6):
        got = [r for t in blocks(iter([batch, batch]), most=most) for r in t.to_pylist()]
        assert got == batch.to_pylist() * 2


def test_counts_are_the_library_s(spark, expected):
    got = {r.doc_id: r for r in count_tokens(frame(spark, TEXTS), PATH, limit=512).collect()}
    for i, ids in enumerate(expected):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((TEXTS[i] or "").encode()), len(ids) > 512)


def test_counts_with_null_and_repeated_ids_and_no_rows(spark):
    got = count_tokens(frame(spark, ["a b", "a b", None], [None, 7, 7]), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("7", 0), ("7", 2), ("None", 2)]
    assert count_tokens(frame(spark, [], []), PATH).count() == 0


def check_packed(rows, expected, size):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, ids in expected.items():
        pieces = sorted(docs[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == [*ids, 0]
        assert all(r.doc_tokens == len(ids) + 1 and r.ids_crc32 == zlib.crc32(r.ids) for r in pieces)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        n = sum(r.length for r in pieces)
        assert n <= size and all(r.sequence_length == n and r.padded_length == (n if n & (n - 1) == 0 else size) for r in pieces)
    assert sum(sum(r.length for r in p) < size for p in sequences.values()) <= 1


@pytest.mark.parametrize("size", [8, 1024])
def test_packing_keeps_every_id_once(spark, expected, size):
    rows = pack(frame(spark, TEXTS), PATH, size=size, most_open=3).collect()
    check_packed(rows, dict(enumerate(expected)), size)


def test_packing_over_more_partitions_than_one_merge_takes(spark, monkeypatch, expected):
    from ledgerloom.llm import packing

    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(7, "doc_id")
    check_packed(pack(df, PATH, size=64).collect(), dict(enumerate(expected)), 64)


def test_packing_no_rows_and_odd_ids(spark):
    assert pack(frame(spark, [], []), PATH).count() == 0
    rows = pack(frame(spark, ["a b", None, "c"], [None, 3, 3]), PATH, keep_ids=False).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("3", 1), ("3", 2), ("None", 3)]
    assert "ids" not in rows[0]
