"""A bounded, deterministic sample of labelled rows, to fit classifiers on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def label_sample(rows: DataFrame, label: str, per_label: int, max_bytes: int | None = None) -> list:
    """At most per_label rows (label, text) of each label value, drawn by the hash of doc_id.

    Hash values are dealt into per_label bins a label and the least of each bin is
    taken: a few numbers a bin are gathered, whatever the table's size, and only
    the rows chosen are then fetched. Null labels and null texts are never drawn;
    of rows that share an id and a label, the shortest text, then the first by
    order, is drawn. With max_bytes, each label has an equal share of them: rows
    are taken in the order of their hashes, and those that don't fit into what is
    left of the share are passed over. Labels must be few: the driver holds a row
    for each bin of each.
    """
    h = F.xxhash64("doc_id")
    usable = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col(label).alias("label"), "text")
    spark = rows.sparkSession
    # The texts stay out of the first step, and the others look up hashes alone, so that no text moves to meet its label.
    found = usable.groupBy("label", F.pmod(h, F.lit(per_label)).alias("bin")).agg(F.min(h).alias("h")).select("label", "h").collect()
    drawn = lambda keys: usable.join(F.broadcast(spark.createDataFrame(sorted({(r.h,) for r in keys}), "h long")), h == F.col("h"), "left_semi").withColumn("h", h)
    if not found:
        return []
    size = F.octet_length("text")
    sizes = {(r.label, r.h): r.bytes for r in drawn(found).groupBy("label", "h").agg(F.min(size).alias("bytes")).collect()}
    chosen = sorted((r for r in found), key=lambda r: (str(r.label), r.h))
    left = {r.label: math.inf if max_bytes is None else max_bytes // len({c.label for c in chosen}) for r in chosen}
    wanted = []
    for r in chosen:
        if sizes[r.label, r.h] <= left[r.label]:
            left[r.label] -= sizes[r.label, r.h]
            wanted.append(r)
    if not wanted:
        return []
    pairs = {(r.label, r.h) for r in wanted}
    shortest = F.min_by("text", F.struct(size, "text")).alias("text")
    texts = drawn(wanted).groupBy("label", "doc_id", "h").agg(shortest).orderBy("h", "label").collect()
    return [r for r in texts if (r.label, r.h) in pairs]
