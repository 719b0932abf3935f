"""URL filters: host and path rules, then a list of blocked URLs behind a blocked Bloom filter. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import free, shuffle_parts, table

#: (verdict, host, path). A rule holds for its host and all below it where the path starts with the rule's; the longest wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A block of the filter: so many words of 32 bits; a URL sets one bit in each.
LANES, LANE_BITS = 8, 5
#: Bits of the filter for each listed URL, and the most blocks there are. The filter is broadcast: with MAX_BLOCKS blocks it has
#: 8 MB of bits (some 25 MB as Spark's rows), however long the list. A list of over 5.6 million URLs has fewer bits for each, so more
#: URLs go on to the exact join; the result is the same.
BITS, MAX_BLOCKS = 12, 1 << 18
#: Hosts that the query's list is taken from: those with one of these words in a label.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
NOISE = r"^(utm_[^=]*|ref)(=|$)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling for what is taken as one page; null for what has no host.

    Scheme, fragment, ``www.`` or ``m.``, default ports, a last ``/`` or ``.html``, and the parameters utm_* and ref go; the other
    parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    kept = F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(NOISE))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that holds, else null. Of equally long ones the first given wins. One expression a
    rule: meant for a list that people keep by hand; long lists of URLs go into the filter."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last one made is tested first
        holds = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        chosen = F.when(holds, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def places(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each of the block's words."""
    mixed = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(mixed, LANE_BITS * k).bitwiseAND((1 << LANE_BITS) - 1).cast("int")) for k in range(LANES)]
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)), bits


def bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """block, w0 ... w7: the filter of the column ``key``, a row for each block that any key falls into; and the number of blocks."""
    n_blocks = max(1, min(MAX_BLOCKS, -(-n_keys * BITS // (LANES << LANE_BITS))))
    block, bits = places(F.col(key), n_blocks)
    rows = keys.select(block.alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(LANES)]), n_blocks


def judged(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``block`` or ``allow``), a row for each row.

    A rule decides where one holds; else a URL is blocked if its canonical form is that of a URL in ``listed``. Those are put into
    the filter; only URLs that it does not rule out are shuffled, to an exact join with the list. A canonical URL that very
    many rows share is dealt over as many tasks as there are shuffle partitions: the join's key has a part of the row's hash, and the
    listed side gets a row for each (URL, part) that occurs.

    Null URLs, and those without ``://``, have an empty host and path, no rule, and are allowed; null ones in the list block nothing. Very long
    URLs are taken whole. Repeated rows are judged alike and all stay; repetitions in the list change nothing. No pages: no rows. No
    list: what no rule blocks is allowed. Columns of ``pages`` named host, path, rule or verdict are replaced, others stay whatever
    their names.
    """
    spark, parts = pages.sparkSession, shuffle_parts(pages.sparkSession)
    found, key, part, block = free(pages, "found_", "key_", "part_", "block")
    lanes = free(pages, *[f"w{k}" for k in range(LANES)])
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    source = F.col(url)
    rows = pages.select(*own, host_of(source).alias("host"), path_of(source).alias("path"))
    rows = rows.withColumn(found, rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn(key, F.when(F.col(found).isNull(), canonical(source)))
    keys = listed.select(canonical(F.col(listed_url)).alias(key)).where(F.col(key).isNotNull()).distinct()
    table_, n_blocks = bloom(keys, key, keys.count())
    table_ = table_.select(F.col("block").alias(block), *[F.col(f"w{k}").alias(lane) for k, lane in enumerate(lanes)])
    where, bits = places(F.col(key), n_blocks)
    hit = F.col(key).isNotNull()
    for lane, bit in zip(lanes, bits):
        hit = hit & (F.col(lane).bitwiseAND(bit) != 0)
    probed = rows.withColumn(block, where).join(F.broadcast(table_), block, "left")  # at most MAX_BLOCKS rows
    hit = F.coalesce(hit, F.lit(False))
    out = lambda df, verdict: df.select(*own, "host", "path", F.col(f"{found}.rule").alias("rule"), verdict.alias("verdict"))
    sure = out(probed.where(~hit), F.coalesce(F.col(f"{found}.verdict"), F.lit("allow")))
    possible = probed.where(hit).drop(block, *lanes).withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in own]), F.lit(parts)))
    dealt = possible.select(key, part).distinct().join(keys, key)
    known = free(possible, "known_")[0]
    exact = possible.join(dealt.withColumn(known, F.lit(True)), [key, part], "left")
    return sure.union(out(exact, F.when(F.col(known), "block").otherwise("allow")))


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of the query: URLs of pages on hosts with a label that has one of LISTED_WORDS between hyphens."""
    return pages.where(host_of(F.col("url")).rlike(rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)")).select("url")


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
_BLOCKING = ", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")
ORACLE_SQL = {"op11_url_filter": rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{NOISE}'))) AS kept FROM pages),
c AS (SELECT page_id, host, path, CASE WHEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') <> '' THEN
    regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/|\.html)$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key, {_RULE} AS rule FROM u),
l AS (SELECT DISTINCT key FROM c WHERE key IS NOT NULL AND regexp_matches(host, '(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)'))
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKING}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""}
