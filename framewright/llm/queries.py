"""The registered queries of this subpackage: thin, each through its operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe_jobs, langid, line_dedup, lm, packing, quality, simhash, token_files, winnow
from .common import _written, held_out, in_training, shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.with_neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", winnow.as_text(out["prints"]).alias("fingerprint"), winnow.as_text(out["edited_prints"]).alias("edited_fingerprint"), "near_edited", "near_next")


def quality_network(spark: SparkSession, sf_dir: str) -> quality.Network:
    """Fitted on labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labels = labels.where(in_training(labels["doc_id"], 5, 0) & labels["quality"].isNotNull())
    return quality.fit(docs.join(labels, "doc_id"), "quality")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality_network(spark, sf_dir), "score")
    return out.select("doc_id", held_out(out["doc_id"], 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_jobs.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm.score(docs, in_training(docs["doc_id"], 7, 2))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), end_id=1)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, budget=2)
    return out.select("doc_id", simhash.hex_of(out["fp"]).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    _written.append((spark, path))
    token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), path, end_id=2)
    return token_files.read_token_files(spark, path)


def language_dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, bytes]:
    """Of documents whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.fit(docs.where(in_training(docs["doc_id"], 4, 2)), "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.identify(docs, language_dictionaries(spark, sf_dir))
    return out.select("doc_id", held_out(out["doc_id"], 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), "rejected")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_line_dedup": op1_line_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_ann": op8_ann,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, line, pos,
                translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), frequent AS (
            SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
    """,
}
