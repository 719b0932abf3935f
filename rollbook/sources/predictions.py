"""The stored predictions: hash buckets below a folder, each rewritten only when its names change, each with a Bloom filter of its names."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.bloom import block_of, bloom, may_have
from rollbook.operators.inference import KEY, STORED, numbered_batches, upsert
from rollbook.sources import commits
from rollbook.sources.shared import cut

#: Buckets of a store, given when it is made; the log's entries name one folder for each.
BUCKETS = 64
#: Bits of the filter for each name.
BITS = 12
SCHEMA = "name string, country_id string, name_mode string, gender string, probability double, count bigint, queried_at string, bucket int"
FILTER = "bucket int, blocks bigint, block bigint, w0 int, w1 int, w2 int, w3 int, w4 int, w5 int, w6 int, w7 int"


def bucket_of(n: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")


def _name() -> Column:
    """What the filter holds: the whole key."""
    return F.concat_ws("\x00", *KEY)


def save(spark: SparkSession, root: str, new: DataFrame, buckets: int = BUCKETS) -> int:
    """Add or replace predictions; the number of buckets that were read and written.

    Only the buckets of the new names are read, merged by ``upsert`` and written as a new version; the commit's entry takes the other buckets over
    from the one before. Two writers at once: the one that loses its number reads the winner's buckets and merges again. A row without a
    name, country or mode is an error. The list of touched buckets is at most ``buckets`` numbers.
    """
    ok = F.when(F.col("name").isNull() | F.col("country_id").isNull() | F.col("name_mode").isNull(), F.raise_error(F.lit("a prediction without a key")).cast("string")).otherwise(F.col("name"))
    rows = new.select(*STORED).withColumn("name", ok)
    touched = 0

    def entry(before: dict | None) -> dict:
        nonlocal touched
        n = before["buckets"] if before else buckets
        dealt = cut(rows.withColumn("bucket", bucket_of(n)))
        own = [r.bucket for r in dealt.select("bucket").distinct().collect()]
        folders = dict(before["folders"]) if before else {}
        version, touched = uuid.uuid4().hex, len(own)
        merged = upsert(_rows(spark, root, {b: folders[str(b)] for b in own if str(b) in folders}), dealt).withColumn("bucket", bucket_of(n))
        merged = cut(merged.repartition("bucket"))
        merged.write.partitionBy("bucket").parquet(f"{root}/{version}/rows")
        sizes = merged.groupBy("bucket").agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count("*") * BITS / 256)).alias("blocks"))
        keyed = merged.join(F.broadcast(sizes), "bucket").withColumn("key", _name())  # a row a bucket
        bloom(keyed, "key", F.col("blocks"), ("bucket", "blocks")).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{version}/filter")
        folders |= {str(b): version for b in own}
        return {"buckets": n, "folders": folders, "versions": sorted(set(folders.values()))}

    commits.commit(spark, root, entry)
    return touched


def _parts(spark: SparkSession, root: str, folders: dict, kind: str, schema: str) -> DataFrame:
    by_version = {}
    for bucket, version in folders.items():
        by_version.setdefault(version, []).append(int(bucket))
    parts = [spark.read.schema(schema).option("basePath", f"{root}/{v}/{kind}").parquet(*[f"{root}/{v}/{kind}/bucket={b}" for b in sorted(own)]) for v, own in sorted(by_version.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _rows(spark: SparkSession, root: str, folders: dict) -> DataFrame:
    return _parts(spark, root, folders, "rows", SCHEMA).select(*STORED)


def load(spark: SparkSession, root: str) -> DataFrame:
    """All stored predictions; none before the first ``save``."""
    entries = commits.history(spark, root)
    return _rows(spark, root, entries[-1][1]["folders"] if entries else {})


def missing(spark: SparkSession, root: str, asked: DataFrame, country: str = "BR", mode: str = "full", name: str = "query_name") -> DataFrame:
    """Distinct names without a stored answer, in batches: name, batch, pos; an answer without a gender is an answer.

    The filters settle most names that are new without a look at the store; only names that they let pass are joined with it.
    """
    entries = commits.history(spark, root)
    names = asked.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    if not entries:
        return numbered_batches(names)
    n, folders = entries[-1][1]["buckets"], entries[-1][1]["folders"]
    filters = _parts(spark, root, folders, "filter", FILTER)
    sizes = filters.select("bucket", "blocks").distinct()
    keyed = names.withColumns({"country_id": F.lit(country), "name_mode": F.lit(mode)}).withColumns({"key": _name(), "bucket": bucket_of(n)})
    keyed = keyed.join(F.broadcast(sizes), "bucket", "left").withColumn("block", block_of(F.col("key"), F.col("blocks")))  # a row a bucket
    probed = cut(keyed.join(filters.drop("blocks"), ["bucket", "block"], "left").select("name", may_have(F.col("key")).alias("possible")))
    stored = _rows(spark, root, folders).where((F.col("country_id") == country) & (F.col("name_mode") == mode)).select("name")
    left = probed.where("possible").select("name").join(stored, "name", "left_anti")
    return numbered_batches(probed.where("NOT possible").select("name").union(left))
