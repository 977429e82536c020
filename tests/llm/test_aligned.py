import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from ledgerloom.llm import aligned
from ledgerloom.llm.aligned import Aligner, align, cut_groups
from tests.llm.test_tokens_packing import TEXTS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [*TEXTS, "  two  spaces ", "a ▁ b", "x▁", "<0x41> <s> </s> <unk> <|endoftext|>", "naïve façade — “quoted” …", "\x00 nul", "don't won't", "é é é", " ", "𝄞 clef　x", "tab\tand\nline\r\n", "é x", "word " * 50]


@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_groups_are_cut_at_all_common_ends(a, b):
    gap = sum(a) - sum(b)
    (b if gap > 0 else a).extend([abs(gap)] * bool(gap))
    ends = [[sum(x[: i + 1]) for i in range(len(x))] for x in (a, b)]
    common = sorted(set(ends[0]) & set(ends[1]))
    assert cut_groups(*ends) == [(ends[0].index(e) + 1, ends[1].index(e) + 1) for e in common]


def test_no_tokens_no_groups_and_far_cuts():
    assert cut_groups([], []) == []
    n = 3000
    assert len(cut_groups([2 * i for i in range(1, n)] + list(range(2 * n, 2 * n + 500)), [2 * i + 1 for i in range(n - 1)] + list(range(2 * n, 2 * n + 500)))) == 500


def by_hand(texts):
    """From whole texts, by all pairs of ends."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: i for i, c in aligned._byte_letters(pre_tokenizers)}
    docs, pairs = [], Counter()
    for text in texts:
        ids = ([], [])
        ends = ([], [])
        if text:
            whole = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(raw_a) == whole == b"".join(raw_b):
                ids = ids_a, ids_b
                ends = tuple([sum(map(len, raw[: i + 1])) for i in range(len(raw))] for raw in (raw_a, raw_b))
        links = [(x, y) for x, end in zip(ids[0], ends[0]) for y, other in zip(ids[1], ends[1]) if end == other]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(f"{','.join(map(str, ids[0][i : to[0]]))}|{','.join(map(str, ids[1][j : to[1]]))}")
            i, j = to
        pairs.update(links)
        docs.append((ids, groups, links))
    most = {}
    for (_, y), n in pairs.items():
        most[y] = max(most.get(y, 0), n)
    return [(len(ids[0]), len(ids[1]), len(g), len(ls), sum(pairs[p] == most[p[1]] for p in ls), sum(pairs[p] for p in ls), ";".join(g)) for ids, g, ls in docs]


@pytest.mark.parametrize("kept", [1 << 19, 8])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, kept):
    monkeypatch.setattr(aligned, "KEPT_UNITS", kept)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(MORE)], "doc_id long, text string, n_a string, LINKS int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in align(df, A, B).collect()}
    want = by_hand(MORE)
    assert [got[i] for i in range(len(MORE))] == want
    assert want[MORE.index("a ▁ b")][:4] == (0, 0, 0, 0) and want[4][3] > 3
    digests = {r.doc_id: r.groups for r in align(df, A, B, keep_groups=False).collect()}
    assert digests == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for i, w in enumerate(want)}


def test_every_link_is_a_pair_of_the_vocabularies():
    aligner = Aligner.at(A, B)
    assert len(aligner.pairs) < 4 * (sum(map(len, aligner.bytes_a)) + sum(map(len, aligner.bytes_b)))
    for key in aligner.pairs[:: len(aligner.pairs) // 500].tolist():
        a, b = aligner.bytes_a[key >> 32], aligner.bytes_b[key & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)


def test_null_and_repeated_ids_and_no_rows(spark):
    got = align(spark.createDataFrame([(None, "a b"), (7, "a b"), (7, None), (None, "")], "doc_id long, text string"), A, B).collect()
    assert sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum) for r in got) == [("7", 0, 0, 0), ("7", 2, 2, 4), ("None", 0, 0, 0), ("None", 2, 2, 4)]
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_given_texts(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) < 3000][:80]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in align(df, A, B).collect()}
    assert [got[i] for i in range(len(rows))] == by_hand(rows)
