"""A training-data pipeline over `documents`: quality, language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of `documents`. Thresholds are the operators'
own. Null and empty texts are judged like any other: the language stage drops
texts without a letter. Rows without doc_id are kept by every stage that keeps
their text. An empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.llm import langid, line_dedup, packing, quality, queries, resemblance
from framewright.llm.common import table, written

#: Least quality score of a document that stays, as the classifier's query predicts.
QUALITY = 0.3


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no operator's own columns meet others of the same name."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], **now: Column) -> DataFrame:
    """What `carried` packed, with these columns; those in `now` get new values."""
    return rows.select(*(now.get(c, F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.score(carried(docs), queries.quality_network(spark, sf_dir), "score")
    return unpacked(scored.where(F.col("score") >= QUALITY), docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with a narrow margin, go."""
    found = langid.identify(carried(docs), queries.language_dictionaries(spark, sf_dir))
    return unpacked(found.where(~F.col("rejected")), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go, everywhere; n_chars follows the text."""
    out = line_dedup.drop_frequent_lines(carried(docs), min_docs=10)
    if "n_chars" not in docs.columns:
        return unpacked(out, docs.columns)
    return unpacked(out, docs.columns, n_chars=F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id. Links: 0.8 or more of the 5-word shingles shared."""
    return unpacked(resemblance.keep_first(carried(docs)), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_path(queries.WORD_TOKENIZER), end_id=1)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

#: No SQL expresses a network, compression or a tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
