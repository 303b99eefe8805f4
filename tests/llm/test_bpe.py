import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from framewright.llm import bpe, bpe_jobs, queries

from . import docs as D

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abt he'\n \t1", max_size=200), st.text("aeé漢🙂 =-", max_size=120)))
def test_ids_are_the_librarys(library, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder, text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3001, " " * 2500 + "x", "=" * 1200, "ab" * 900, "\n" * 300, "é" * 500, "the" * 700, "0123456789" * 90, "\u0000" * 50])
def test_long_pieces(library, encoder, text):
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_blocks_keep_matches(library, encoder):
    text = "the cat's 12 hats,  sat\n\non   mats " * 300
    want = encoder.find(text)
    got = [m for b in bpe.blocks(text, 97) for m in encoder.find(b)]
    assert got == want and "".join(bpe.blocks(text, 97)) == text


def test_states_are_bounded_within_a_piece(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 200)
    encoder = bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 20_000)))
    assert ids(encoder, text) == library.encode_ordinary(text)
    assert len(encoder.transducer.pending) <= 202 and text not in encoder.known


def test_states_can_be_dropped(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 5)
    encoder = bpe.Encoder(bpe.load_ranks(PATH), P.PATTERN)
    text = "Streaming transducers emit tokens after bounded lookahead, as they must. " * 3
    assert ids(encoder, text) == library.encode_ordinary(text) and ids(encoder, text[::-1]) == library.encode_ordinary(text[::-1])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.lists(st.integers(1, 7), max_size=30))
def test_stream_decoder_emits_whole_characters(text, sizes):
    data = text.encode("utf-8", "ignore")
    decoder = bpe.StreamDecoder([bytes([i]) for i in range(256)])
    out, at = [], 0
    for n in [*sizes, 1000]:
        part = decoder.feed(data[at : at + n])
        part.decode()  # never half a character
        out.append(part)
        at += n
    assert b"".join(out) + decoder.close() == data and len(decoder.rest) == 0


@given(st.binary(max_size=30))
def test_stream_decoder_passes_any_bytes(data):
    decoder = bpe.StreamDecoder([bytes([i]) for i in range(256)])
    assert b"".join(decoder.feed(data[i : i + 2]) for i in range(0, len(data), 2)) + decoder.close() == data


def expected(library, text):
    got = library.encode_ordinary(text or "")
    return len(got), hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_awkward(spark, library):
    for extra in (False, True):
        rows = bpe_jobs.encode_decode(D.awkward(spark, extra), PATH, P.PATTERN).collect()
        assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows] == [(i, *expected(library, t)) for i, t in D.TEXTS]
    assert bpe_jobs.encode_decode(D.empty(spark), PATH, P.PATTERN).collect() == []


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])
