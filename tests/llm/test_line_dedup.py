import re
from collections import Counter

from framewright.llm import line_dedup

from . import docs as D


def key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate({c: c + 32 for c in range(65, 91)})


def brute(texts, n):
    lines = [(t or "").split("\n") for t in texts]
    found = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for ls in lines:
        kept = [x for x in ls if not key(x) or found[key(x)] < n]
        out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
    return sorted(out)


def test_awkward(spark):
    for n in (1, 2, 3, 5, 100):
        for extra in (False, True):
            got = line_dedup.drop_frequent_lines(D.awkward(spark, extra), n).collect()
            assert sorted((r.text or "", r.n_lines, r.n_dropped) for r in got) == brute([t for _, t in D.TEXTS], n)
            assert Counter(r.doc_id for r in got) == Counter(i for i, _ in D.TEXTS)


def test_shuffled_join_agrees(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = line_dedup.drop_frequent_lines(docs, 5).collect()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    two = line_dedup.drop_frequent_lines(docs, 5).collect()
    assert sorted(one) == sorted(two)
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in one) == brute([r.text for r in docs.collect()], 5)


def test_empty(spark):
    assert line_dedup.drop_frequent_lines(D.empty(spark)).collect() == []


def test_other_columns_pass_through(spark):
    docs = D.awkward(spark, extra=True)
    got = line_dedup.drop_frequent_lines(docs, 2)
    assert got.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {(r._t, r.h, r.a, r.key) for r in got.collect()} == {("clash",) * 4}
