import re
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from framewright.llm import queries, simhash

from . import docs as D


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    p = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= budget):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


near = st.lists(st.one_of(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4).map(lambda s: sum(1 << b for b in s))), max_size=60, unique=True)


@settings(max_examples=80, deadline=None)
@given(near, st.integers(0, 2))
def test_trie_links_connect_what_brute_force_does(values, budget):
    prints = np.sort(np.array(values, np.uint64))
    root = simhash.trie_links(np.zeros(len(prints), np.int64), prints, budget)
    assert [int(r) for r in root] == brute_components(range(len(prints)), prints, budget)


def test_trie_links_keep_keys_apart(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 8)
    rng = np.random.default_rng(1)
    keys = np.repeat(np.arange(20), 30)
    prints = rng.integers(0, 64, 600).astype(np.uint64)
    order = np.lexsort((prints, keys))
    prints = prints[order]
    root = simhash.trie_links(keys, prints, 1)
    for k in range(20):
        assert [int(r) - 30 * k for r in root[keys == k]] == brute_components(range(30), prints[keys == k], 1)


def cluster(rng, size):
    """Fingerprints near one centre, and far ones."""
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(size)]
    return sorted({(0xDEADBEEF12345678 ^ f) for f in flips} | {int(x) for x in rng.integers(0, 2**63, size // 4)})


def test_links_and_components(spark, monkeypatch):
    prints = cluster(np.random.default_rng(3), 300)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for budget in (0, 1, 2):
        want = brute_components(range(len(prints)), prints, budget)
        for bucket in (10_000, 20):  # 20: buckets go the other way
            monkeypatch.setattr(simhash, "BUCKET", bucket)
            edges = simhash.links(df, budget)
            root = {r.node: r.root for r in simhash.components(edges).collect()}
            got = [root.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
            same = {}
            assert len(set(got)) == len(set(want)) and all(same.setdefault(g, w) == w for g, w in zip(got, want))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    rows = simhash.components(edges).collect()
    assert {r.node for r in rows} == set(range(201)) and {r.root for r in rows} == {0}
    assert simhash.components(edges.where("a < 0")).collect() == []


def test_awkward(spark):
    for extra in (False, True):
        rows = simhash.near_duplicates(D.awkward(spark, extra)).collect()
        prints = [brute_print(t) for _, t in D.TEXTS]
        want = brute_components([i for i, _ in D.TEXTS], prints)
        assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows) == Counter(zip((i for i, _ in D.TEXTS), prints, want))
    assert simhash.near_duplicates(D.empty(spark)).collect() == []


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, sf_dir).collect())
    assert got == [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, want)]


def test_keep_first(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = simhash.near_duplicates(docs)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in near.collect()}


def test_keep_first_of_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "other words here"), (None, "a b c d"), (None, None)]
    kept = simhash.keep_first(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.fp) for r in kept) == [(-1, "", "x"), (-1, "a b c d", "x"), (1, "a b c d", "x"), (3, "other words here", "x")]
