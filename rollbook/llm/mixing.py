"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import cut, free, n_words

#: Documents of one source and size are dealt over 16 ** SUB_DIGITS sub-groups, so that no window holds a hot group whole.
SUB_DIGITS = 3


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes``: one row per source with source and source_size. Sources in code point order, null last, get
    ``weights`` in turn and share ``share`` of all sizes by weight; a target stops at ``cap`` times its source's
    size and what is over goes to the others by weight until none is above. That end state has one level, target =
    min(cap * size, level * weight), which sorting by cap * size / weight finds without a loop.

    An empty table gives no rows; sources without words get the target 0.
    """
    by_name, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    by_level = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    return (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("cap_level", cap * F.col("source_size") / F.col("weight"))
        # the level if all earlier sources in this order are capped and the others are not; the true one is the highest
        .withColumn("level", (share * F.sum("source_size").over(whole) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(whole))
        .select("source", "source_size", F.least(cap * F.col("source_size"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document: doc_id, text_key, source, size, source_size, target, copies.

    Every document of a source has target / source_size expected copies. Their prefix sum within the source, in the
    order (size, MD5 of id and seed, id), plus one random offset per source crosses floor(end) - floor(start) integer
    boundaries at a document; so many copies are taken. In the order of sizes the copies spread evenly over short
    and long documents, which holds the taken words near the target. The offset is a hash of source and seed: reruns
    agree.

    The prefix sum is made of three small steps, as no task may hold a hot source: counts by (source, size), by
    sub-group of one size, then ranks within the sub-group.

    Null text: size 0. Null source: a source of its own, last. Repeated rows: each row is a document of its own;
    rows that agree in id and text are told apart only by their rank. Other columns of ``docs`` play no part.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    base = base.withColumn("mixed", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed))))).withColumn("sub", F.substring("mixed", 1, SUB_DIGITS))
    base = cut(base)  # the texts are read once
    subs = base.groupBy("source", "size", "sub").agg(F.count("*").alias("n"))
    levels = subs.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(levels.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    goals = goals.withColumns({
        "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
        "offset": F.conv(F.substring(F.md5(F.concat_ws(":", F.col("source"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0),
    })
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = lambda df, *keys: df.withColumn("start", F.coalesce(F.sum("n").over(earlier(*keys)), F.lit(0))).drop("n")
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    levels = starts(levels, "source", "size").alias("l").join(goals.alias("g"), same("l", "g", "source")).select("l.*", "source_size", "target", "rate", "offset")
    subs = (
        starts(subs, "source", "size", "sub").alias("s").join(levels.alias("l"), same("s", "l", "source", "size"))
        .select("s.source", "s.size", "s.sub", (F.col("s.start") + F.col("l.start")).alias("start"), "source_size", "target", "rate", "offset")
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "sub").orderBy("mixed", "doc_id"))
    placed = base.withColumn("rank", rank).alias("b").join(subs.alias("s"), same("b", "s", "source", "size", "sub"))
    end = F.floor(F.col("rate") * (F.col("start") + F.col("rank")) + F.col("offset"))
    begin = F.floor(F.col("rate") * (F.col("start") + F.col("rank") - 1) + F.col("offset"))
    return placed.select("doc_id", "b.source", "b.size", "source_size", "target", "rank", (end - begin).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (see ``copies``), rows of 0 copies gone.

    All columns and their order stay. Needs ids that tell documents apart; of several rows with one id, each gets
    the copies of its own rank in the order of their text hash.
    """
    size, n, own_id, own_source, own_size, nth, times, copy = free(docs, "size_", "n_", "own_id", "own_source", "own_size", "nth", "times", "copy_")
    taken = copies(docs, doc_id, text, source, **options).select(
        F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size), F.col("copies").alias(times), "rank")
    taken = taken.withColumn(nth, F.row_number().over(Window.partitionBy(own_id, own_source, own_size).orderBy("rank"))).drop("rank")
    rows = docs.withColumn(size, n_words(F.col(text)))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy(doc_id, source, size).orderBy(F.xxhash64(text))))
    on = F.col(doc_id).eqNullSafe(F.col(own_id)) & F.col(source).eqNullSafe(F.col(own_source)) & (F.col(size) == F.col(own_size)) & (F.col(n) == F.col(nth))
    return rows.join(taken.where(F.col(times) > 0), on).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    got = copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


ORACLE_SQL = {"op7_mixing": r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, 2.0::DOUBLE * source_size / weight AS cap_level FROM g),
m AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::BIGINT - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY cap_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(weight) OVER (ORDER BY cap_level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(max(level) OVER (), 0) * weight) AS target FROM m),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(concat_ws(':', source, '7')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(concat_ws(':', doc_id::VARCHAR, '7')), doc_id) AS place FROM d)
SELECT n.doc_id, n.size, r.source_size, r.target,
    ((floor(r.rate * n.place + r.shift) - floor(r.rate * (n.place - 1) + r.shift)) * n.size)::BIGINT AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""}
