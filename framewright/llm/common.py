"""What the operators share: the shared folder, written intermediates, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same small rows, kept in the checkpoint folder: a short lineage that survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read back. The files go with `clear`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete what `written` has left so far, once no result that reads it is needed; else it goes when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM has already gone; the folder's owner clears it
            return


atexit.register(clear)


#: Rows of a table that are broadcast for the keys that more than one in HOT rows has: there are fewer such keys than HOT.
HOT = 1000


def join_hot(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with values on key, which is unique in values; column `n` of values says how many of the rows have the key.

    Keys of more than one in HOT rows are broadcast, fewer than HOT; so no key that
    many rows share is dealt to one task. Column n stays out of the result.
    """
    total = values.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    some = F.broadcast(values.where(hot).drop(n))
    often = rows.join(some, key)
    return often.unionByName(rows.join(some.select(key), key, "left_anti").join(values.where(~hot).drop(n), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """name, or name with as many lines appended as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """df's columns but those of these names."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def text_of(df: DataFrame) -> Column:
    """Null texts count as empty."""
    return F.coalesce(df["text"], F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; Spark's own lower() is exact, and faster, where all is ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def in_training(doc_id: Column, folds: int, held: int) -> Column:
    """crc32 of doc_id as text, modulo folds, is not the held-out remainder. Rows without an id train."""
    return ~held_out(doc_id, folds, held)


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))
