from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from framewright.llm import langid, queries

from . import docs as D
from .test_line_dedup import brute
from .test_resemblance import brute_kept
from .test_tokens import check_pieces, ids_of


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, f in C.STAGES:
        rows = f(spark, docs, sf_dir)
        out.append((docs.collect(), rows.collect()))
        docs = spark.createDataFrame(out[-1][1], rows.schema)
    return out


def test_quality(spark, sf_dir, stages):
    before, after = stages[0]
    net = queries.quality_network(spark, sf_dir)
    want = {r.doc_id for r, s in zip(before, net.scores([(r.text or "").encode() for r in before])) if s >= C.QUALITY}
    assert {r.doc_id for r in after} == want and 0 < len(want) < len(before)


def test_language(spark, sf_dir, stages):
    before, after = stages[1]
    model = langid.Model(queries.language_dictionaries(spark, sf_dir))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.predict(r.text)[2] >= langid.NARROW}


def test_lines(stages):
    before, after = stages[2]
    texts = [t for t, _, _ in brute([r.text for r in before], 10)]
    assert sorted(r.text or "" for r in after) == sorted(texts)
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    """Links are texts that share 0.8 or more of their distinct 5-word shingles, by comparing all with all."""
    before, after = stages[3]
    assert sorted(r.doc_id for r in after) == brute_kept([(r.doc_id, r.text) for r in before])


CLASHING = ("row", "_score", "score", "rejected", "lang_pred", "lang_score", "lang_margin", "n_lines", "n_dropped", "s", "node", "root", "__nth", "key", "_found", "a.b")


def test_own_columns_keep_their_values(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(f"own {c} "), F.col("doc_id").cast("string")))
    columns = docs.columns
    for name, f in C.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[c] == f"own {c} {r.doc_id}" for r in rows for c in CLASHING), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert C.packing_stage(spark, docs, sf_dir).count()


def test_packing(stages):
    before, after = stages[4]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path(queries.WORD_TOKENIZER))
    check_pieces(after, [(r.doc_id, ids_of(tokenizer, r.text, 1)) for r in before])


def test_run_gives_the_same(spark, sf_dir, stages):
    assert Counter((r.doc_id, r.start) for r in C.run(spark, sf_dir).select("doc_id", "doc_tokens", "start").distinct().collect() if r.start == 0) == Counter((r.doc_id, 0) for r in stages[4][0])


def test_awkward(spark, sf_dir):
    docs = D.awkward(spark, extra=True)
    for _, f in C.STAGES[:-1]:
        docs = f(spark, docs, sf_dir)
    assert docs.columns == D.awkward(spark, extra=True).columns
    C.packing_stage(spark, docs, sf_dir).collect()
    empty = D.empty(spark)
    for _, f in C.STAGES:
        empty = f(spark, empty, sf_dir)
    assert empty.collect() == []
