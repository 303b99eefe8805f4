import hashlib

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from framewright.llm import queries, winnow

from . import docs as D

G, W = winnow.GRAM, winnow.WINDOW


def brute(hashes, window=W):
    """Positions chosen: the rightmost least of every window."""
    n, out = len(hashes), set()
    for s in range(max(1, n - window + 1)):
        part = hashes[s : s + window]
        low = min(part)
        out.add(s + max(i for i, h in enumerate(part) if h == low))
    return sorted(out)


def grams(text, gram=G, word=winnow.WORD):
    """The rolling hash, word by word: turned by a bit, the word that leaves taken out, the next one put in."""
    data = text.encode()
    n = max(len(data), gram)
    own = [xxhash.xxh64_intdigest(data[i : i + word], 42) for i in range(n - word + 1)]
    turn = lambda h, k: (h << k % 64 | h >> 64 - k % 64) % (1 << 64)
    out = {}
    for begin in range(min(word, n)):  # runs that begin a word apart roll together
        h = 0
        for at, i in enumerate(range(begin, len(own), word)):
            h = turn(h, 1) ^ own[i] ^ (turn(own[i - gram], gram // word) if at >= gram // word else 0)
            if at >= gram // word - 1:
                out[i + word - gram] = h - (1 << 64) if h >> 63 else h
    return [out[i] for i in range(n - gram + 1)]


def check(text, prints):
    h = grams(text)
    assert [(p["pos"], p["hash"]) for p in prints] == [(i, h[i]) for i in brute(h)]


@pytest.mark.parametrize("text", ["", "a", "short", "x" * 46, "x" * 47, "x" * 48, "abcab" * 30, "The quick brown fox — jumps über den Zaun. " * 7, "ab" * 5000, "0123456789abcdef" * 600 + "end"])
def test_chosen_are_the_least_of_every_window(spark, text):
    rows = winnow.chosen(spark.createDataFrame([(1, text)], "id int, t string"), ["id"], ["t"]).collect()
    assert len(rows) == 1
    check(text, rows[0].t_prints)


def test_common_runs_share_a_print(spark):
    shared = "this run is common to both of the texts, and it is long enough"
    assert len(shared) >= G + W - 1
    rows = winnow.chosen(spark.createDataFrame([(1, "one " * 9 + shared + " tail"), (2, "other words before " + shared)], "id int, t string"), ["id"], ["t"]).collect()
    one, two = ({p["hash"] for p in r.t_prints} for r in rows)
    assert one & two


def edited(rows):
    """rows: (doc_id, text) by id -> edited texts."""
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out.append(t[: len(t) - half] + n[:half])
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def verify(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = sorted(((i, t or "") for i, t in rows), key=key)
    want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(rows, edited(rows)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    prints = {(r.doc_id, r.n_chars): {p["hash"] for p in r.prints} for r in got}
    after = {(str(r.doc_id), r.n_chars, r.edited_sha256): {p["hash"] for p in r.edited_prints} for r in got}
    near = []
    for (i, t), (j, n), e in zip(rows, rows[1:] + rows[:1], edited(rows)):
        own = prints[i, len(t)]
        near.append((str(i), len(t), jaccard(own, after[str(i), len(t), hashlib.sha256(e.encode()).hexdigest()]), jaccard(own, prints[j, len(n)])))
    for g, w in zip(sorted((str(r.doc_id), r.n_chars, r.near_edited, r.near_next) for r in got), sorted(near), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


def test_awkward(spark):
    for extra in (False, True):
        verify(winnow.with_neighbours(D.awkward(spark, extra)).collect(), D.TEXTS)
    assert winnow.with_neighbours(D.empty(spark)).collect() == []
    one = winnow.with_neighbours(D.awkward(spark).where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1


@pytest.mark.parametrize("gram, word", [(1, 1), (7, 1), (6, 3), (4, 4), (16, 4), (20, 4)])
def test_rolling_hashes(spark, gram, word):
    texts = ["", "a", "ab", "the cat sat on the mat", "é漢🙂" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", winnow.rolling(F.col("t").cast("binary"), gram, word).alias("h")).collect():
        assert r.h == grams(r.t, gram, word)


def test_many_rows_without_id_are_cut_by_their_beginnings(spark):
    rows = [(None, f"{i * 7919 % 1000:03d} some text " + "x" * i) for i in range(300)] + [(i, f"text {i}") for i in range(20)] + [(7, f"more {i} " + "y" * i) for i in range(60)] + [(None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select(F.coalesce("doc_id", F.lit(winnow.LEAST)).alias("_key"), winnow._beginning(F.coalesce("text", F.lit(""))).alias("_sub"))
    bounds, first = winnow._ranges(keyed)
    assert sum(k == winnow.LEAST for k, _ in bounds) > 5 and sum(k == 7 for k, _ in bounds) > 1 and first == (winnow.LEAST, 0)
    assert {tuple(r) for r in keyed.collect()} >= set(bounds)
    verify(winnow.with_neighbours(df).collect(), rows)


def test_ids_beyond_the_exact_range_of_doubles(spark):
    rows = [((1 << 62) + i, f"text {i}" * 5) for i in range(200)]
    verify(winnow.with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    verify(winnow.with_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), rows)
    got = queries.op2_fingerprints(spark, sf_dir).collect()
    texts = dict(rows)
    seen = {}
    for r in got:
        assert seen.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len({r.fingerprint for r in got}) == len(set(texts.values()))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**40), 2**40), max_size=40))
def test_ranges(spark_ranges, bounds):
    bounds = sorted(bounds)
    keys = sorted({b + d for b in bounds for d in (-1, 0, 1)} | {0})
    place = F.struct(F.col("k").alias("key"), F.lit(5).cast("long").alias("sub"))
    rows = spark_ranges.createDataFrame([(k,) for k in keys], "k long").select("k", winnow._range_of(place, [(b, winnow.LEAST) for b in bounds]).alias("r")).collect()
    assert all(r.r == sum(b <= r.k for b in bounds) for r in rows)


@pytest.fixture(scope="module")
def spark_ranges(spark):
    return spark
