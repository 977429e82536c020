import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bitfiles, joined
from ledgerloom.llm.bitfiles import PackedTable, bits_for, pack_bits, read_token_ids, unpack_bits, write_token_ids
from ledgerloom.llm.common import Block
from ledgerloom.llm.joined import JoinedCoder
from tests.llm.test_tokens_packing import PATH, TEXTS


@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 2**32 - 1))
@settings(max_examples=150, deadline=None)
def test_bits_come_back(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n).astype(np.uint32)
    raw = pack_bits(ids, bits)
    assert len(raw) == -(-n // 64) * bits * 8
    assert np.array_equal(unpack_bits(raw, bits)[:n], ids)
    value = int.from_bytes(raw, "little")
    assert all((value >> (i * bits)) & ((1 << bits) - 1) == int(x) for i, x in enumerate(ids[:70]))


def test_least_bits():
    assert [bits_for(v) for v in (1, 2, 3, 4, 5, 32000, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 15, 16, 16, 17]


@pytest.mark.parametrize("join_bytes", [8, 2048])
def test_joined_units_get_the_library_s_ids(monkeypatch, join_bytes):
    monkeypatch.setattr(joined, "JOIN_BYTES", join_bytes)
    texts = [*TEXTS, "Étude été naïve à l'été où é", "ß ü\nö x\x7f y ß", "a\u0085 b  c", "x <|endoftext|> y\n\nz <|endoftext|>"]
    coder = JoinedCoder(PATH)
    doc, place = coder.encode(Block(pa.array(texts)))
    ids = coder.ids_of(place)
    ends = np.cumsum(np.bincount(doc, weights=coder.counts[place], minlength=len(texts)).astype(int))
    library = Tokenizer.from_file(PATH)
    for text, begin, end in zip(texts, [0, *ends], ends):
        assert ids[begin:end].tolist() == library.encode(text or "", add_special_tokens=False).ids


def check(rows, documents, tokenizer_path=PATH):
    """``documents`` in the order that the files must have."""
    library, start, want = Tokenizer.from_file(tokenizer_path), 0, []
    for doc_id, text in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


@pytest.mark.parametrize("path", [PATH, public_tokenizers.path("word_bpe_49k.json")])
def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch, path):
    monkeypatch.setattr(bitfiles, "BLOCK_IDS", 64)
    if path != PATH:
        with pytest.raises(ValueError):  # units of lower-casing tokenizers are not those of byte-level ones
            write_token_ids(spark.createDataFrame([(1, "A")], "doc_id long, text string"), str(tmp_path), path)
        return
    documents = [(7 * i - 30, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in documents[::-1]], "doc_id long, text string, start string, IDS int").repartition(3)
    write_token_ids(df, f"file://{tmp_path}/t", PATH)
    for split in (50, 1 << 24):
        check(read_token_ids(spark, f"file://{tmp_path}/t", split).collect(), documents)
    table = PackedTable(f"{tmp_path}/t")
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read_token_ids(spark, f"{tmp_path}/t").orderBy("start").collect()])
    assert table.n_ids == len(every)
    for a, b in [(0, 1), (63, 65), (100, 100), (5, 4000), (len(every) - 3, len(every) + 9), (0, len(every))]:
        assert np.array_equal(table.ids(a, b), every[a:b])
    write_token_ids(df.limit(2), f"{tmp_path}/t", PATH)  # overwriting leaves no older shard
    left = json.loads((tmp_path / "t/manifest.json").read_text())["shards"]
    assert {f for f in os.listdir(tmp_path / "t") if f.endswith(".ids")} == {s["file"] for s in left}
    assert read_token_ids(spark, f"{tmp_path}/t").count() == 2


def test_odd_ids_ties_and_no_rows(spark, tmp_path):
    rows = [(None, "a"), (5, "b c"), (5, "b c"), (None, None), (5, "")]
    write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/t", PATH)
    got = read_token_ids(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 5, 5, 5]
    assert sorted(r.n_tokens for r in got[2:]) == [1, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    write_token_ids(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/e", PATH)
    assert read_token_ids(spark, f"{tmp_path}/e").count() == 0
    assert PackedTable(f"{tmp_path}/e").ids(0, 5).tolist() == []


def test_several_shards_a_task_and_damage(spark, tmp_path):
    from ledgerloom.llm.bitfiles import FORMAT, PackedIds

    spark.dataSource.register(PackedIds)
    rows = [(i, np.arange(i % 5, dtype="<u4").tobytes()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1)
    df.write.format(FORMAT).mode("overwrite").option("vocab_size", 4).save(f"{tmp_path}/t")
    with pytest.raises(Exception, match="outside of a vocabulary"):
        df.write.format(FORMAT).mode("overwrite").option("vocab_size", 3).save(f"{tmp_path}/t")
    assert [f for f in os.listdir(tmp_path / "t") if f.endswith(".ids")] == [s["file"] for s in bitfiles.manifest(f"{tmp_path}/t")]  # the failed job left nothing
    got = read_token_ids(spark, f"{tmp_path}/t", 7).orderBy("doc_id").collect()
    assert [bytes(r.ids) for r in got] == [raw for _, raw in rows]
    df.write.format(FORMAT).mode("append").option("vocab_size", 4).save(f"{tmp_path}/t")
    assert read_token_ids(spark, f"{tmp_path}/t").agg({"start": "max"}).head()[0] == 200 - 4
    file = tmp_path / "t" / bitfiles.manifest(f"{tmp_path}/t")[0]["file"]
    raw = bytearray(file.read_bytes())
    raw[10] ^= 255
    file.write_bytes(raw)
    with pytest.raises(OSError, match="damaged"):
        PackedTable(f"{tmp_path}/t").ids(0, 4)


def test_query(spark, tmp_path):
    from ledgerloom.llm.queries import op13_token_files

    rows = [(i, t, "en", "web", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for i, text in enumerate(TEXTS):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op13_token_files(spark, str(tmp_path)).collect())) == want
