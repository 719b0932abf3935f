"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.hashed import mixed, words_of
from rollbook.llm.shared import cut, shuffle_parts, sifted, small_batches

#: Signature: BANDS * ROWS coordinates. A pair at similarity 0.8 shares no band with a chance of (1 - 0.8 ** 4) ** 28 < 4e-7.
BANDS, ROWS = 28, 4
#: A candidate whose signatures agree in fewer than this share of coordinates below the similarity asked for is not looked at
#: (at 112 coordinates and 0.8 that is over five standard deviations).
LEEWAY = 0.2
#: Shingles are hashed to this many places (a power of two), which the two permutations shuffle.
PLACES = 1 << 20
#: In buckets of so many documents at most all pairs of different components are tried.
SMALL = 16
#: Tasks that the rows of one band are dealt over where they meet the least document of its bucket.
SALTS = 4
#: Bytes of text that are hashed together.
CHUNK = 1 << 18

def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each lower-cased text's shingles of ``width`` words."""
    words = words_of(texts)
    h, counts = words.hash, words.counts
    with np.errstate(over="ignore"):
        joint = h.copy()
        for k in range(1, width):
            n = max(0, len(h) - k)  # texts may have fewer words than a shingle, even together
            joint[:n] = mixed(joint[:n] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        at = 0
        for n in counts:
            if n >= width:
                yield np.unique(joint[at : at + n - width + 1])
            elif n:
                whole = np.uint64(n)
                for x in h[at : at + n]:
                    whole = mixed(np.array([whole * np.uint64(0xA0761D6478BD642F) + x]))[0]
                yield np.array([whole])
            else:
                yield h[:0]
            at += n


@lru_cache(1)
def _windows(coordinates: int, seed: int) -> np.ndarray:
    ring = np.random.default_rng(seed).permutation(PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((ring, ring[: coordinates - 1])), coordinates)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """Circulant MinHash of a non-empty set: coordinate k is the least pi[(sigma(x) + k) mod PLACES] over the set.

    sigma, an affine permutation of the places, breaks up what order the hashes have; pi is one random permutation,
    and its circular shift by k stands for the k-th permutation, so a window of pi holds all values of one shingle.
    """
    with np.errstate(over="ignore"):
        place = ((hashes * np.uint64(2862933555777941757) + np.uint64(3037000493)) >> np.uint64(44)).astype(np.int64) & (PLACES - 1)
    ring, out = _windows(coordinates, seed), None
    for i in range(0, len(place), 4096):
        least = ring[place[i : i + 4096]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def bands(sig: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    parts = sig.reshape(n_bands, n_rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mixed(np.arange(1, n_bands + 1, dtype=np.uint64))
        for k in range(n_rows):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, k])
    return h.view(np.int64)


def _lower(text) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""  # bytes.lower: A-Z alone


def _lowered(texts: Iterable) -> list[bytes]:
    return [_lower(t) for t in texts]


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the documents that are among ``ids``, and of few others; the rest of the texts isn't shuffled."""
    return sifted(texts.select(F.col("doc_id").alias("id"), "text"), "id", cut(ids.distinct()), "id")[1]


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (of the shingle set), bands, sketch (the last byte of each coordinate); null if empty."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, at = _lowered(batch["text"]), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                    size += len(texts[end])
                    end += 1
                rows = []
                for h in shingle_sets(texts[at:end], width):
                    full = len(h) > 0
                    sig = signature(h, n_bands * n_rows) if full else None
                    rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), bands(sig, n_bands, n_rows), sig.astype(np.uint8).tobytes()) if full else (0, None, None, None))
                out = pd.DataFrame(rows, columns=["n_shingles", "digest", "bands", "sketch"])
                out.insert(0, "doc_id", batch["doc_id"].to_numpy()[at:end])
                yield out
                at = end

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(each, f"doc_id {dict(rows.dtypes)['doc_id']}, n_shingles long, digest binary, bands array<long>, sketch binary")


def pair_set(text: bytes, width: int) -> set:
    words = text.split()  # at the same six blanks
    return set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else {tuple(words)} if words else set()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    The pairs are written first: of the texts only those go to the joins that a filter of the pairs' documents lets through.
    """
    pairs = cut(pairs)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, set()
        for batch in batches:
            keep = []
            for a, b in zip(map(_lower, batch["text_a"]), map(_lower, batch["text_b"])):
                if a != last:
                    last, mine = a, pair_set(a, width)
                other = pair_set(b, width)
                both = len(mine & other)
                keep.append(100 * both >= percent * (len(mine) + len(other) - both) > 0)
            yield batch.loc[keep, ["a", "b"]]

    ids = _texts_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    rows = pairs.join(ids.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(ids.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    kind = dict(pairs.dtypes)["a"]
    return rows.select("a", "b", "text_a", "text_b").mapInPandas(each, f"a {kind}, b {kind}")


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree well enough to be worth their texts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("sketch_a", "sketch_b"))
                yield batch.loc[(x == y).mean(axis=1) >= percent / 100 - LEEWAY, ["a", "b"]]

    kind = dict(pairs.dtypes)["a"]
    own = lambda c: sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").mapInPandas(each, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b): node, component (its least node), for every node with a link.

    Alternates the large-star and small-star steps on the edge table until every edge leads to the least node of its
    component; each is a grouped minimum, merged before it is shuffled, and a join. The join deals the links of one node
    to one task, as two numbers each, unless adaptive execution splits them. The table never grows. It is small
    beside the documents and kept in fewer partitions.
    """
    few = max(2, shuffle_parts(links.sparkSession) // 8)

    def marked(df: DataFrame) -> DataFrame:
        return cut(df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().coalesce(few))

    def settled(df: DataFrame) -> bool:
        roles = df.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        return roles.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    edges = marked(links)
    while not settled(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = marked(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = marked(edges.join(least, "a").select("b", "m").toDF("a", "b").union(least.select("a", "m").toDF("a", "b")))
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component").distinct())


def _other(entries: DataFrame, *more: str) -> DataFrame:
    """``entries`` as the second of two documents."""
    return entries.select("band", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"), *[F.col(c).alias(f"{c}_b") for c in more])


def _in_small(entries: DataFrame, sizes_fit) -> DataFrame:
    """Pairs (a, b) of different components in buckets of SMALL at most."""
    pairs = entries.withColumnRenamed("rep", "a").join(_other(entries), "band")
    return pairs.where((F.col("a") < F.col("b")) & (F.col("component") != F.col("component_b")) & sizes_fit(F.col("n"), F.col("n_b"))).select("a", "b")


def _in_large(entries: DataFrame, texts: DataFrame, width: int, percent: int, sizes_fit) -> DataFrame:
    """Pairs (a, b) of different components in larger buckets that may still be links; see ``near_duplicates``."""
    heads = entries.groupBy("band").agg(F.min("rep").alias("a"))
    groups = components(entries.join(heads, "band").select("a", F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    kind = dict(entries.dtypes)["rep"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                few = batch.iloc[a : a + 200]
                yield pd.DataFrame({"rep": few["rep"], "cluster": few["cluster"], "shingles": [h.view(np.int64) for h in shingle_sets(_lowered(few["text"]), width)]})

    groups = cut(groups)
    own = groups.join(_texts_of(texts, groups.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep"), "rep").dropDuplicates(["rep"]).mapInPandas(each, f"rep {kind}, cluster {kind}, shingles array<long>")
    rows = cut(own).select("rep", "cluster", F.explode("shingles").alias("shingle"))
    df = rows.groupBy("cluster", "shingle").agg(F.count("*").alias("df"))
    sides = entries.select("rep", "n", "component").distinct()
    # the shingles of a document from rare to common; ties in one order for all
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    placed = rows.join(df, ["cluster", "shingle"]).withColumn("place", place).join(sides, "rep")
    shared = lambda share, whole: F.floor((share * F.col("n") + whole - 1) / whole)  # noqa: E731  the share of n, rounded up
    head = placed.where(F.col("place") <= F.col("n") - shared(percent, 100) + 1).withColumn("first", F.col("place") <= F.col("n") - shared(2 * percent, 100 + percent) + 1)
    key = ["cluster", "shingle"]
    several = head.groupBy(*key).agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select(*key)
    head = cut(head.join(several, key))
    b = head.select(*key, F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"), F.col("place").alias("place_b"))
    pairs = head.where("first").withColumnRenamed("rep", "a").join(b, key).where(F.col("component") != F.col("component_b"))
    least = F.struct("n", "a") < F.struct("n_b", "b")
    reach = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    fits = sizes_fit(F.col("n"), F.col("n_b")) & ((100 + percent) * reach >= percent * (F.col("n") + F.col("n_b")))
    return pairs.where(least & fits).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets (``width`` lower-cased
    words); component_id is the least id reachable, kept is doc_id = component_id.

    1. Documents with one shingle set (digest of all its hashes) form a class; only its least id goes on.
    2. Classes that share a band are candidates. Each is first held against the least class of its bucket: that makes
       as many pairs as bucket entries, however large a bucket is.
    3. What lies in one bucket and not yet in one component is paired across components; members of one component
       need no more pairs. Buckets of SMALL at most make few. In the larger ones, buckets that share documents are
       a cluster, whose documents have their shingles in one order, from rare to common. Two sets that reach the
       similarity share a shingle among the first of each: of the smaller among its n - 2s / (1 + s) * n + 1 first, of the
       larger among its n - s * n + 1 first; and from there on enough shingles must be left in both. Shingles that only
       documents of one component have in front make no pairs. So two families that share bands but are not similar
       enough meet in the shingles that set them apart, not in all their pairs. No pair that shares a band and may
       link two components is left out.

    Every pair is confirmed on the full sets of words. Null, empty and blank texts: 0 shingles, linked with nothing.
    Repeated rows are copies of each other. A row without id is never the least of its class; it counts as not kept. A very
    long text is hashed by itself, whole. Other columns of ``docs``, whatever their names, play no part. An empty table gives
    an empty one. ``LEEWAY`` is the share by which estimated similarity may fall below the one asked for; 1 looks at all candidates.
    """
    small_batches(docs.sparkSession)
    found = cut(signatures(docs, doc_id, text, width, n_bands, n_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classes = found.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).where("rep IS NOT NULL")
    classes = cut(classes)
    entries = classes.select("rep", "n", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("last")).where("c.rep < last")
    salted = buckets.select("band", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    entries = cut(entries.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["band", "salt"]).drop("salt"))
    sizes_fit = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    stars = entries.where(F.col("rep") != F.col("centre")).where(sizes_fit(F.col("n"), F.col("centre_n"))).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    joined = components(confirmed(likely(stars, classes, percent), texts, width, percent))

    named = entries.select("band", "rep", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    counts = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main")).where("parts > 1")
    open_ = cut(named.join(mixed.select("band", "size", "main"), "band"))
    crossed = _in_small(open_.where(F.col("size") <= SMALL), sizes_fit).union(_in_large(open_.where(F.col("size") > SMALL), texts, width, percent, sizes_fit))
    crossed = crossed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = confirmed(likely(crossed, classes, percent), texts, width, percent)
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    by_class = classes.select("digest", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = found.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
