"""Audit of filters that overlap: what each takes, in every order, from one product of histograms and incidence matrices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import free, table

FILTERS = "ABCDE"
MASKS, BITS = 1 << len(FILTERS), {f: 1 << i for i, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The columns of the matrices: (order, step).
STEPS = [(order, step) for order in ORDERS for step in range(1, len(FILTERS) + 1)]
BLANK = "[\\x20\\x09-\\x0D]+"


def matrices() -> dict[str, np.ndarray]:
    """The incidence of each of the 32 sets of failed filters (rows) with each of the 600 steps (columns): whether a document of that
    set is kept after the step, removed by it, redundant (fails its filter, removed earlier) or fails its filter alone."""
    out = {k: np.zeros((MASKS, len(STEPS)), np.int64) for k in ("kept", "removed", "redundant", "unique_fails")}
    for column, (order, step) in enumerate(STEPS):
        before = sum(BITS[f] for f in order[: step - 1])
        own = BITS[order[step - 1]]
        for mask in range(MASKS):
            gone, fails = bool(mask & before), bool(mask & own)
            out["kept"][mask, column] = not gone and not fails
            out["removed"][mask, column] = fails and not gone
            out["redundant"][mask, column] = fails and gone
            out["unique_fails"][mask, column] = mask == own
    return out


def text_mask(text: Column) -> Column:
    """The bits of A to D for a text without null."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda name, fails: F.when(fails, BITS[name]).otherwise(0)
    return bit("A", n < 100) + bit("B", 100 * distinct < 80 * n) + bit("C", 100 * upper > 10 * F.length(text)) + bit("D", text.rlike("[#$%&*|]"))


def histogram(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters that they fail, and of them those that a label calls good
    (quality 1) or toxic.

    What is shuffled are digests, ids and masks. E (the text is that of a lesser id) is settled by a join on (digest, id) with the
    least id of each digest, so neither a text nor an id that very many rows share is one task's work; labels meet at most a row for each
    (id, part, mask).
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(content, 256).alias("digest"), text_mask(content).alias("mask"))
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeated, BITS["E"]).otherwise(0)).alias("mask"), "n")
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    marked = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked("quality"), marked("toxic"))
    labelled = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).cast("long")
    return rows.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), labelled("quality").alias("good"), labelled("toxic").alias("toxic"))


def outcomes(counts: DataFrame) -> DataFrame:
    """The audit from a ``histogram``: a row for each part, order and step; see ``audit``.

    A part's histogram is at most 32 rows; the parts of an Arrow batch are stacked and multiplied at once.
    """
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    tables = matrices()
    order, step = [o for o, _ in STEPS], np.array([s for _, s in STEPS], np.int32)
    own = np.array([FILTERS.index(o[s - 1]) for o, s in STEPS])
    same = (own[:, None] == own[None, :]).astype(np.int64)

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hist = np.zeros((3, len(batch), MASKS), np.int64)
            for i, cells in enumerate(batch["cells"]):
                for x in cells:
                    hist[:, i, x["mask"]] = x["n"], x["good"], x["toxic"]
            made = {name: hist[0] @ m for name, m in tables.items()}
            made |= {"good_lost": hist[1] @ tables["removed"], "toxic_lost": hist[2] @ tables["removed"], "shapley": made["removed"] @ same}
            for i, name in enumerate(batch["part"]):
                yield pd.DataFrame({"part": name, "filter_order": order, "step": step, **{k: v[i] for k, v in made.items()}})

    return stacked.mapInPandas(product, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step and what that step's filter does to the part's documents: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    Null texts are empty ones (they fail A). Null and empty parts are one part, ''. Rows without an id never fail E and have no label; of
    rows with one id and one text none repeats the other. Repeated rows each count. An id with several labels is good or toxic if one of
    them says so. Texts are read whole, however long. Other columns play no part. No documents: no rows. A part with labels alone has none.
    """
    return outcomes(histogram(docs, labels, doc_id, text, part))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = {"op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
k AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w LEFT JOIN k ON doc_id = id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, b)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, bits[step] AS own, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost FROM h, s GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""}
