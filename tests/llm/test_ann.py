import math
from collections import defaultdict

import numpy as np
import pytest

from framewright.llm import ann, queries

from . import docs as D  # noqa: F401


def brute(rows, every=20, k=20):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids]) if len(ids) else np.zeros((0, 1))
    out = {}
    for i in ids[ids % every == 0]:
        s = x @ ok[i]
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(i)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def grouped(found):
    out = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    index = ann.Index(rng.normal(size=(6, 2)), rng.normal(size=(5, 2)))
    q = rng.normal(size=4)
    order = index.walk(q, [1] * 30, 30)
    d = [-(index.first[c // 5] @ q[:2]) - (index.second[c % 5] @ q[2:]) for c in order]
    assert sorted(order) == list(range(30)) and d == sorted(d)
    assert len(index.walk(q, [3] * 30, 7)) == 3 and index.walk(q, [0] * 30, 7) == []


def test_query_recall(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want, got = brute(rows), grouped(queries.op8_ann(spark, sf_dir).collect())
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9
    vecs = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert q not in dict(near)
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(s == pytest.approx(float(vecs[q] @ vecs[i]), abs=1e-12) for i, s in near)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int, score string, a int")


def test_awkward(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(400, 900)]  # one vector, many rows
    rows += [(1000, None), (1020, []), (1040, [0.0] * 4), (1060, [1.0, None, 2.0, 3.0]), (1080, [math.nan, 1.0, 1.0, 1.0]), (1100, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1120, [-0.0, 2.0, 0.0, 1.0])]
    got = grouped(ann.search(frame(spark, [(i, v, 0, 1, "x", 2) for i, v in rows])).collect())
    want = brute(rows)
    assert set(got) == set(want) and recall(got, want) > 0.9
    assert all(near == sorted(near, key=lambda p: (-p[1], p[0])) for near in got.values())  # ties go to the smaller id


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])]
    got = grouped(ann.search(frame(spark, [(i, v, 0, 1, "x", 2) for i, v in few])).collect())
    assert got == {0: [(20, 1.0), (1, 0.5)], 20: [(0, 1.0), (1, 0.5)]}
    assert ann.search(frame(spark, [])).collect() == []
    assert ann.search(frame(spark, [(0, [1.0, 2.0], 0, 1, "x", 2)])).collect() == []
    assert ann.search(frame(spark, [(0, None, 0, 1, "x", 2)])).collect() == []


def test_unequal_lengths(spark):
    """Vectors of another length than most take no part; of equally many lengths the shorter one counts."""
    rows = [(i, [float(i + 1), 1.0, 2.0]) for i in range(30)] + [(100 + i, [1.0, float(i)]) for i in range(5)] + [(200, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, every=20, k=5).collect()
    assert {r.query_id for r in got} == {0, 20} and max(r.vec_id for r in got) < 30 and len(got) == 10
    even = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [1.0, 2.0]), (21, [1.0, 3.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(even, every=20, k=5).collect()] == [(0, 1)]
