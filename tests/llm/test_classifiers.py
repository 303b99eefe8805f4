import zlib

import numpy as np
import pytest

from framewright.llm import langid, quality, queries
from framewright.llm.sample import label_sample

from . import docs as D

SF = "/root/testdata/sf0.01"


def test_sample_is_bounded_and_stable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = label_sample(docs, "lang", 5)
    assert [r.doc_id for r in one] == [r.doc_id for r in label_sample(docs.repartition(7), "lang", 5)]
    assert {r.label for r in one} == {"en", "de", "fr", "es"}
    assert max(sum(r.label == x for r in one) for x in ("en", "de")) <= 5
    assert label_sample(docs.where("false"), "lang", 5) == []


def test_forward_pass_is_the_brute_force_one():
    rng = np.random.default_rng(2)
    w, n = quality.WIDTH, quality.FILTERS
    net = quality.Network(rng.normal(0, 1, (w, 256, n)).astype(np.float32), rng.normal(0, 1, n).astype(np.float32), rng.normal(0, 1, n).astype(np.float32), 0.3)
    texts = [b"", b"a", b"some bytes here", bytes(range(256)) * 300, b"tail"]
    want = []
    for t in texts:
        t = (t + b"\0" * (w - quality.STEP)).ljust(w, b"\0")
        best = np.max([sum(net.tables[j, t[p + j]] for j in range(w)) for p in range(0, len(t) - w + 1, quality.STEP)], axis=0)
        want.append(1 / (1 + np.exp(-float(np.maximum(best + net.bias, 0) @ net.weights + net.offset))))
    assert net.scores(texts) == pytest.approx(want, abs=1e-4)


def brute_scores(net, texts):
    """Every response at every place of every text, one text at a time."""
    out, w = [], quality.WIDTH
    for t in texts:
        t = (t + b"\0" * (w - quality.STEP)).ljust(w, b"\0")
        data = np.frombuffer(t, np.uint8)
        places = np.arange(0, len(t) - w + 1, quality.STEP)
        best = sum(net.tables[j][data[places + j]].astype(np.float64) for j in range(w)).max(0)
        out.append(1 / (1 + np.exp(-float(np.maximum(best + net.bias, 0) @ net.weights + net.offset))))
    return out


def test_quality_query_against_brute_force(spark, sf_dir):
    net = queries.quality_network(spark, sf_dir)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_quality(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    want = dict(zip(texts, brute_scores(net, texts.values())))
    assert [r.score for r in rows] == pytest.approx([want[r.doc_id] for r in rows], abs=1e-4)


def test_gradients_are_those_of_small_steps(monkeypatch):
    """Also through max-pooling, in pieces and as a whole."""
    rng = np.random.default_rng(3)
    w, n = quality.WIDTH, 4
    net = quality.Network(rng.normal(0, 1, (w, 256, n)), rng.normal(0, 1, n), rng.normal(0, 1, n), 0.0)
    texts, y = [bytes(rng.integers(97, 110, k).astype(np.uint8)) for k in (3, 40, 200)], np.array([1.0, 0.0, 1.0])

    def loss():
        z = np.array([np.maximum(net.strongest(quality.places_of([t])[0])[0].astype(np.float64) + net.bias, 0) @ net.weights for t in texts]) + 0.3
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = quality.gradients(net, 0.3, texts, y)
    monkeypatch.setattr(quality, "PLACES", 16)
    for a, b in zip(grads, quality.gradients(net, 0.3, texts, y)):
        assert a == pytest.approx(b)
    tops = np.argsort(-np.abs(grads[0]).ravel())[:10]
    for values, g, at in ((net.tables, grads[0], tops), (net.bias, grads[1], range(n)), (net.weights, grads[2], range(n))):
        for i in at:
            was = values.ravel()[i]
            values.ravel()[i] = was + 1e-3
            up = loss()
            values.ravel()[i] = was - 1e-3
            down = loss()
            values.ravel()[i] = was
            assert (up - down) / 2e-3 == pytest.approx(g.ravel()[i], abs=2e-3)


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, "x" * 10 * i, i % 2) for i in range(1, 41)] + [(100, "y" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    for most in (10_000, 2000, 600):
        found = label_sample(df, "label", 50, most)
        for label in (0, 1):
            assert 0 < sum(len(r.text) for r in found if r.label == label) <= most // 2
    assert len(label_sample(df, "label", 50)) > 30 and label_sample(df, "label", 50, 1) == []


def test_fit_on_a_text_of_20_mb_takes_little_memory(spark):
    import tracemalloc

    rng = np.random.default_rng(4)
    long = rng.integers(97, 123, 20_000_000).astype(np.uint8).tobytes()
    tracemalloc.start()
    net = quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), np.ones(quality.FILTERS, np.float32), 0.0)
    quality.gradients(net, 0.0, [long, b"short"], np.array([1.0, 0.0]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150_000_000


def test_quality_query_holds_out(spark):
    rows = queries.op3_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_awkward(spark):
    docs = D.awkward(spark, extra=True)
    labels = docs.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 1 WHEN doc_id > 8 THEN 0 END AS quality")
    net = quality.fit(labels)
    rows = quality.score(docs, net, "score").collect()
    assert len(rows) == len(D.TEXTS) and all(0 < r.score < 1 for r in rows)
    assert rows[1].score == rows[2].score  # null and empty
    one_label = quality.fit(labels.where("quality = 1"))
    assert quality.score(docs, one_label).first().quality_score > 0.99
    none = quality.fit(labels.where("false"))
    assert quality.score(docs, none).first().quality_score == pytest.approx(0.5)
    assert quality.score(D.empty(spark), net).collect() == []


def brute_language(dictionaries, text):
    """Sizes of all pieces under each dictionary, each with a compressor of its own."""
    import zstandard

    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0
    data, sizes = text.lower().encode(), {}
    for lang, d in dictionaries.items():
        make = lambda d=d: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[lang] = sum(len(make().compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))
    best, second = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
    margin = (sizes[second] - sizes[best]) / sizes[best]
    return best, 1 / (1 + np.exp(-margin / langid.MARGIN_UNIT)), margin


def test_language_query_against_brute_force(spark, sf_dir):
    dictionaries = queries.language_dictionaries(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        lang, score, margin = brute_language(dictionaries, texts[r.doc_id])
        assert (r.lang_pred, r.rejected) == (lang, margin < langid.NARROW) and (r.score, r.margin) == pytest.approx((score, margin))


def test_language_keeps_clashing_columns(spark):
    df = D.awkward(spark).selectExpr("*", "'a' AS _found", "'b' AS _FOUND_", "'c' AS Rejected")
    rows = langid.identify(df, {"xx": b"some words", "yy": b"other words"}).collect()
    assert len(rows) == len(D.TEXTS) and all((r["_found"], r["_FOUND_"]) == ("a", "b") and isinstance(r["rejected"], bool) for r in rows)


def test_dictionary_takes_the_middle_of_long_texts(spark):
    long = "a" * 50_000 + "b" * langid.DICTIONARY_BYTES + "c" * 50_000
    df = spark.createDataFrame([(1, long, "xx"), (2, "short", "yy")], "doc_id long, text string, lang string")
    assert langid.fit(df) == {"xx": b"b" * langid.DICTIONARY_BYTES, "yy": b"short"}


def test_language_query_holds_out(spark):
    rows = queries.op10_language_id(spark, SF).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_language_awkward(spark):
    dictionaries = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for extra in (False, True):
        rows = langid.identify(D.awkward(spark, extra), dictionaries).collect()
        for r in rows:
            letters = any(map(str.isalpha, r.text or ""))
            assert (r.lang_pred == "und") == (not letters) and r.rejected == (r.lang_margin < langid.NARROW)
    assert langid.identify(D.empty(spark), dictionaries).collect() == []
    assert {r.lang_pred for r in langid.identify(D.awkward(spark), {}).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(D.awkward(spark), {"xx": b""}).collect()} == {"und", "xx"}
    assert langid.fit(D.empty(spark)) == {}
