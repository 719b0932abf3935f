"""The folder that driver and executors share, tables written there on the way, and joins that bear hot keys."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Where neither is, a temporary folder in local mode, where driver and executors are one process; on a cluster that is an error, as each
    machine would have its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "file://" + tempfile.mkdtemp(prefix="shared-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that what reads it twice computes it once and survives lost executors.

    Spark removes the files once nothing refers to them where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined by ``keys`` with ``one``, which has at most one row for each, where very many rows may share a key.

    Rows are dealt over as many parts as there are shuffle partitions, by the hash of ``by``; ``one`` gets a row for each (key, part) that
    occurs, a table that map-side combination keeps small. A key of a third of all rows is then every task's work.
    """
    part = free(rows, "part")[0]
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*by), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return dealt.join(dealt.select(*keys, part).distinct().join(one, keys), [*keys, part], how).drop(part)
