"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.bloom import WORDS, block_of, bloom, may_have, n_blocks

#: Bits of a filter of keys for each of them, and the most blocks that it has: 8 MB of bits, however many keys.
FILTER_BITS, FILTER_BLOCKS = 12, 1 << 18
#: Bytes of rows that Spark hands to a Python worker at a time, and Spark's own limit as a session shows it.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, "67108864b"
#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a temporary folder serves them all."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one in local mode; on a cluster that is an error, as each machine would have its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named and not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there; see ``shared_folder``.

    Spark removes the files once nothing refers to them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python BATCH_BYTES at a time, unless it has a limit of its own.

    With Spark's limit a worker holds the texts of a whole partition several times over, as does the executor beside it, and the worker keeps that memory for as long as
    it is used again. No result depends on how rows are dealt over batches.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARK_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str, text: str) -> Column:
    """Rows with one key have the same id and text, so every operator gives them the same result."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("\x01"))), 256)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def sifted(rows: DataFrame, key: str, keys: DataFrame, own: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is surely not in the column ``own`` of ``keys``, null among them, and those whose key may be; both columns of one type.

    A Bloom filter of FILTER_BLOCKS blocks at most is broadcast, so that an exact join after it shuffles few of the rows that have no partner. With more keys than it
    has bits for, more rows go on to that join. ``keys`` is counted and read: it should be written already.
    """
    blocks = n_blocks(keys.count(), FILTER_BITS, FILTER_BLOCKS)
    block, *words = free(rows, "block", *WORDS)
    filter_ = bloom(keys, own, blocks).withColumnsRenamed(dict(zip(["block", *WORDS], [block, *words])))
    probed = rows.withColumn(block, block_of(F.col(key), blocks)).join(F.broadcast(filter_), block, "left")
    hit = may_have(F.col(key), words)
    return probed.where(~hit).select(*rows.columns), probed.where(hit).select(*rows.columns)
