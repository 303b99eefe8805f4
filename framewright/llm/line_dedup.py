"""Line dedup: lines found in many documents lose every copy, everywhere.

Lines are exploded, keyed and hashed; distinct documents per hash are counted
with map-side partial sums; what reaches the threshold is dropped by position.
Only hashes and positions are shuffled by key; texts move once, to meet the
positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, ascii_lower, cut, text_of

#: Rows up to which the table of frequent lines (16 bytes each) is broadcast; beyond it, it is joined by shuffle.
BROADCAST_ROWS = 500_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hash(line: Column) -> Column:
    """128 bits of the line's key, null for keys without a code point."""
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs with `text` freed of frequent lines, and `n_lines`, `n_dropped` (long).

    Every input row is one document, also where rows repeat; they count apart and
    are all returned. A null or empty text has one empty line, stays empty and
    loses nothing. Keys that are empty never count. An empty table gives an empty
    table. Other columns pass through; own `n_lines` or `n_dropped` are replaced.
    """
    lines = F.split(text_of(docs), "\n")
    # The text's hash stands beside doc_id, so that rows which share an id, or have none, keep their own positions.
    keyed = docs.withColumns({"__line_hash": F.xxhash64(text_of(docs)), "__lines": lines}).withColumn("__line_id", docs["doc_id"] if "doc_id" in docs.columns else F.lit(None).cast("long"))
    hashes = F.transform("__lines", _hash)
    frequent = cut(
        keyed.select(F.explode(F.array_distinct(hashes)).alias("h"))
        .where("h is not null")
        .groupBy("h.a", "h.b").count()
        .where(F.col("count") >= min_docs)
        .select("a", "b")
    )
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    gone = (
        keyed.select("__line_id", "__line_hash", F.posexplode(hashes).alias("p", "h"))
        .where("h is not null")
        .select("__line_id", "__line_hash", "p", "h.a", "h.b")
        .join(frequent, ["a", "b"], "left_semi")
        .groupBy("__line_id", "__line_hash").agg(F.collect_set("p").alias("__line_gone"))
        .select(F.col("__line_id").alias("__line_id2"), F.col("__line_hash").alias("__line_hash2"), "__line_gone")
    )
    at = keyed.join(gone, F.col("__line_id").eqNullSafe(F.col("__line_id2")) & (F.col("__line_hash") == F.col("__line_hash2")), "left")
    gone_at = F.coalesce("__line_gone", F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone_at), lambda i: F.get("__lines", i)), "\n")
    return at.withColumns({
        "text": F.when(F.size(gone_at) == 0, F.col("text")).otherwise(kept),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.size(gone_at).cast("long"),
    }).select(*[f"`{c}`" for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
