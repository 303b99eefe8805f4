import random

import corpus_pipeline as C
from framewright.llm import resemblance

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The least (doc_id, place) of each component of exact resemblance 0.8 or more."""
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (not a or len(a & b) >= 0.8 * len(a | b)):
                root[up(i)] = up(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[up(i)] = min(least.get(up(i), d), d)
    return sorted(least.values())


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], FIELDS)
    return C.near_duplicate_stage(spark, df, None).collect()


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.random()}"
    return " ".join(words)


def test_stage_against_brute_force(spark):
    rng, rows = random.Random(1), []
    for size in (3, 30, 60, 200, 1000):
        for _ in range(12):
            words = [f"w{rng.randrange(3000)}" for _ in range(size)]
            rows += [" ".join(words)] + [edited(rng, words, round(size * p)) for p in (0.005, 0.01, 0.015, 0.03, 0.1)]
    rows = list(enumerate(rows + ["", None, " "]))
    assert sorted(r.doc_id for r in run(spark, rows)) == brute_kept(rows)


def test_a_hub_and_its_edits(spark):
    """Copies that resemble their source and not each other, and a bucket above the cap."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = list(enumerate([" ".join(words)] + [edited(rng, words, 6) for _ in range(60)]))
    assert [r.doc_id for r in run(spark, rows)] == [0] == brute_kept(rows)
    rows = list(enumerate([" ".join(words)] + [edited(rng, words, 1) for _ in range(3 * resemblance.CAP)]))
    assert [r.doc_id for r in run(spark, rows)] == [0] == brute_kept(rows)


def test_rows_that_share_an_id(spark):
    """Each component keeps one document, also where texts of two components have one id."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    assert sorted(r.text for r in run(spark, [(1, a), (1, b), (2, a), (1, a)])) == [a, b]


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Nothing is passed over where buckets are larger than a task pairs by itself."""
    for name, value in (("CAP", 3), ("BLOCK", 8), ("PROBES", 2)):
        monkeypatch.setattr(resemblance, name, value)
    rng, rows = random.Random(4), []
    shared = [f"s{rng.randrange(3000)}" for _ in range(120)]
    for _ in range(12):  # families that share a passage and are no copies of each other, with copies within each
        words = shared + [f"w{rng.randrange(3000)}" for _ in range(60)]
        rows += [" ".join(words)] + [edited(rng, words, n) for n in (1, 2, 3, 6)]
    rows = list(enumerate(rows))
    assert sorted(r.doc_id for r in run(spark, rows)) == brute_kept(rows)
