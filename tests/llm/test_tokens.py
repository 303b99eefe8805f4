import json
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from framewright.llm import packing, queries, token_files, tokens

from . import docs as D


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def check_pieces(pieces, expected):
    """Every id in exactly one piece; sequences gapless and no longer than 2048."""
    sequences = defaultdict(list)
    left = list(expected)  # (doc_id, ids)
    by_doc = defaultdict(list)
    for p in pieces:
        assert p.length >= 1
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at == s[0].sequence_length
    for doc_id in {d for d, _ in left}:
        want = [ids for d, ids in left if d == doc_id]
        assert sum(p.length for p in by_doc[doc_id]) == sum(map(len, want))
        assert {p.doc_tokens for p in by_doc[doc_id]} == set(map(len, want))
        if len(want) == 1:
            at = 0
            for p in sorted(by_doc[doc_id], key=lambda p: p.start):
                assert p.start == at
                assert p.ids_crc32 == zlib.crc32(want[0][at : at + p.length].tobytes())
                at += p.length
    padded = sum(0 if (n := s[0].sequence_length) & (n - 1) == 0 else 2048 - n for s in sequences.values())
    return padded, len(sequences)


def test_pack_awkward(spark, tokenizer):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    for extra in (False, True):
        pieces = packing.pack(D.awkward(spark, extra), path).collect()
        check_pieces(pieces, [(i, ids_of(tokenizer, t, 1)) for i, t in D.TEXTS])
    assert packing.pack(D.empty(spark), path).collect() == []


def test_pack_query(spark, sf_dir, tokenizer):
    pieces = queries.op6_packing(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    padded, count = check_pieces(pieces, [(r.doc_id, ids_of(tokenizer, r.text, 1)) for r in rows])
    assert padded <= 2048


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text("aÉeé\u0301İΣ ’'tsSLl<|>.,!1²½ªº \n\x1c\xa0", max_size=80), st.sampled_from(["<|STARTOFTEXT|> a", "<|endoftext|>b C", "don't I'LL we'Ve", "x\u0301 e\u0301"])))
def test_parts_have_the_texts_ids(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    words = tokens.word_ids(queries.tokenizer_path(queries.WORD_TOKENIZER))
    assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


SCRAPS = ["\x7f", "'S", "'ll", "'RE", "I'M", "<|", "|>", "<|endoftext|>", "<|STARTOFTEXT|>", " ", "\n", "a", "B", "É", "ß", "µ", "Å", "ÿ", "²", "ª", "\u0301", "Σ", "漢", "İ", "1", "!", "\xa0", "\x85", "\xad", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SCRAPS), max_size=14).map("".join))
def test_signs_of_special_tokens_among_contractions(tokenizer, text):
    words = tokens.word_ids(queries.tokenizer_path(queries.WORD_TOKENIZER))
    assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_are_left_to_the_library():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    words, library = tokens.WordIds(path), Tokenizer.from_file(path)
    assert words.known.pattern is None
    for text in ("IT'S <|x", "  two  blanks\n", "", None, "<|endoftext|>b C"):
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_long_parts_are_not_kept():
    words = tokens.WordIds(queries.tokenizer_path(queries.WORD_TOKENIZER))
    words.ids(["b" * 5000, "short"])
    assert list(words.known) == [b"short"] and "b" * 5000 not in words.known.pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_pack_block(lengths):
    found = packing.pack_block(lengths)
    seen = [np.zeros(n, int) for n in lengths]
    for s in found:
        assert 0 < sum(p[2] for p in s) <= 2048
        for d, a, n in s:
            assert n > 0
            seen[d][a : a + n] += 1
    assert all((x == 1).all() for x in seen)
    assert sum(1 for s in found if sum(p[2] for p in s) not in (256, 512, 1024, 2048)) <= 1


def test_step_groups_balance():
    totals = [2048] * 100 + [256] * 300
    groups = packing.step_groups(totals)
    loads = np.bincount(groups, weights=totals)
    assert loads.max() - loads.min() <= 2048


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**31), st.integers(2**30, 2**60 - 1)), max_size=300))
def test_simple8b_round_trip(ids):
    words = token_files.encode(np.array(ids, np.uint64))
    assert token_files.decode(words, len(ids)).tolist() == ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(2**30, 2**60 - 1)), min_size=1, max_size=80), min_size=1, max_size=20))
def test_documents_of_a_block_decode_alone(docs):
    lengths = np.array([len(d) for d in docs])
    words, at, skips = token_files.encoded_at(np.array([i for d in docs for i in d], np.uint64), np.cumsum(lengths) - lengths)
    for d, w, k in zip(docs, at.tolist(), skips.tolist()):
        assert token_files.document(words, w, k, len(d)).tolist() == d


def test_unused_selectors_raise():
    for sel in (0, 14):
        with pytest.raises(ValueError):
            token_files.decode(np.array([sel << 60], np.uint64), 1)


def test_rows_without_id_are_dealt_to_several_shards(spark, tokenizer, tmp_path):
    rows = [(None, f"{i:03d} text") for i in range(400)] + [(1, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = files(spark, df, tmp_path, shards=8)
    assert len(got) == 401 and max(got, key=lambda r: r.start).doc_id == 1
    held = spark.read.parquet(str(tmp_path / "files")).selectExpr("shard", "size(doc_ids) AS n").collect()
    assert len(held) > 4 and sum(r.n for r in held) == 401


def test_simple8b_density():
    assert len(token_files.encode(np.zeros(600, np.uint64))) == 10
    assert len(token_files.encode(np.full(400, 30_000, np.uint64))) == 100


def files(spark, df, tmp_path, shards=3):
    path = queries.tokenizer_path(queries.WORD_TOKENIZER)
    token_files.write_token_files(df, path, str(tmp_path / "files"), shards=shards)
    return token_files.read_token_files(spark, str(tmp_path / "files")).collect()


def test_token_files_awkward(spark, tokenizer, tmp_path):
    rows = files(spark, D.awkward(spark, extra=True), tmp_path)
    order = sorted(D.TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = ids_of(tokenizer, t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_token_files_empty(spark, tmp_path):
    assert files(spark, D.empty(spark), tmp_path) == []


def test_token_files_query(spark, sf_dir, tokenizer):
    got = {r.doc_id: r for r in queries.op9_token_files(spark, sf_dir).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(tokenizer, r.text, 2)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_words_and_signs_need_no_search(tokenizer):
    """Letters, and signs behind them, are pieces without the pattern's search; only by this file's pattern, and not where case may make a special token."""
    texts = ["Word, Été. x%%% ÿªß!? don't it's' a-b 'tis A1. ---", "Word<| <|EndOfText|> <|endoftext|>. end.", "naïve… œuvre. q\x7f. e\u0301. ...", "Word, Été. 'll."]
    coder = tokens.WordIds(queries.tokenizer_path(queries.WORD_TOKENIZER))
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    store, searched = tokens._Store(tokenizer), []
    store.split = lambda text, f=store.split: searched.append(text) or f(text)
    for part in ("word", "été", "word,", "été%%%", "a-b", "it's"):
        assert store[part.encode()] == store.encode(part)
    assert searched == ["a-b", "it's"]
    settings = json.loads(tokenizer.to_str())
    assert tokens.piece_pattern(settings) == tokens.APART
    other = json.loads(tokenizer.to_str())
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S{2}|\S"
    store = tokens._Store(Tokenizer.from_str(json.dumps(other)))
    assert all(store[p] == store.encode(p.decode()) for p in (b"word.", b"words,"))
    settings["added_tokens"][0]["content"] = "<S>"
    assert tokens.piece_pattern(settings) is None
