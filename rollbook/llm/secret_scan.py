"""Secret scan with corpus-wide ownership frequency of the candidate values."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import cut, free, row_key, small_batches
from rollbook.sources.shared import spread_join

#: The kinds in the order that breaks ties. ``live`` is what the method adds. Fixed values.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is what [0-9a-f]+ finds and its length check keeps
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Other values that may be credentials: long runs without blanks that have letters and digits.
OTHER = re.compile(r"[A-Za-z0-9+_-]{20,}")
#: A value is live-looking with so many characters, at least so many bits of entropy a character, letters and digits.
LEAST_LENGTH, LEAST_BITS = 16, 2.8
#: A value that texts of more owners, or of more repositories, than this hold is a widely copied example: a leaked value is copied to a few
#: places, a sample to many. All copies of one text count as one text of one owner and repository.
MOST_OWNERS, MOST_REPOS = 3, 8
#: ``redact`` leaves a value only if more owners than this hold it; what is merely an example by the counts above may still be a leak.
WIDE_OWNERS = 8


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base kinds, in code points."""
    found, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def live_looking(value: str) -> bool:
    if len(value) < LEAST_LENGTH or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def candidates(text: str) -> list[tuple[str, int, int, int, int, str, bool]]:
    """(kind, start, end, first and end of the value, digest, live-looking): base kinds, and ``live`` for other values."""
    out = []
    for kind, start, end, value in base_spans(text):
        at = text.index(value, start, end) if kind != "assign" else end - len(value)
        out.append((kind, start, end, at, end, hashlib.sha256(value.encode()).hexdigest(), live_looking(value)))
    known = [(x[3], x[4]) for x in out]
    for m in OTHER.finditer(text):
        if live_looking(m[0]) and all(m.end() <= a or b <= m.start() for a, b in known):
            out.append(("live", m.start(), m.end(), m.start(), m.end(), hashlib.sha256(m[0].encode()).hexdigest(), True))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(key, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), repo, owner, *c) for key, repo, owner, text in zip(batch["row_key"], batch["repo"], batch["owner"], batch["text"]) if text for c in candidates(text)]
        yield pd.DataFrame(rows, columns=["row_key", "copy", "repo", "owner", "kind", "start", "end", "value_start", "value_end", "digest", "live_looking"])


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """Every candidate of every text with how far its value is spread.

    row_key, kind, start, end, value_start, value_end, digest, live_looking, n_repos, n_owners, copied, verdict: ``live`` for
    a live-looking value that texts of at most MOST_OWNERS owners and MOST_REPOS repositories hold, ``example`` for one
    that more hold, ``plain`` for the rest. Values are never returned, only their SHA-256.

    A text that occurs many times counts once, with the least owner and repository it has: copies of a document don't
    make its values examples. The counts are of distinct (value, repository) and (value, owner) pairs, merged before
    they are shuffled by value; findings of a value that very many texts hold are dealt over all tasks. A null repository or owner is one of its own.
    """
    small_batches(docs.sparkSession)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    known = lambda c: F.coalesce(as_col(c).cast("string"), F.lit("\x00"))
    rows = docs.select(row_key(doc_id, text).alias("row_key"), known(repo).alias("repo"), known(owner).alias("owner"), F.col(text).alias("text"))
    found = rows.mapInPandas(_scan, "row_key string, copy string, repo string, owner string, kind string, start int, end int, value_start int, value_end int, digest string, live_looking boolean").distinct()
    found = cut(found)  # the texts are read once
    texts = found.groupBy("digest", "copy").agg(F.min(F.struct("owner", "repo")).alias("first"))
    pairs = texts.select("digest", "first.repo", "first.owner").distinct()
    spread = pairs.groupBy("digest").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    copied = (F.col("n_owners") > MOST_OWNERS) | (F.col("n_repos") > MOST_REPOS)
    verdict = F.when(~F.col("live_looking"), "plain").when(~F.col("copied"), "live").otherwise("example")
    return spread_join(found, spread, ["digest"], ["row_key", "start"], "inner").withColumn("copied", copied).withColumn("verdict", verdict).drop("copy", "repo", "owner").distinct()


def _span(kind: Column, start: str, end: str) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
    return F.struct(F.col(start).alias("start"), rank.alias("rank"), F.col(end).alias("end"), F.concat_ws(":", kind, F.col(start), F.col(end)).alias("said"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans, n_owners, n_repos.

    Base spans always stay. For each candidate with the verdict ``live`` (see ``findings``) the span of its value is
    added as kind live; an example adds none. n_owners and n_repos are those of the row's most widely spread value. Null and empty texts have no spans and the digest of the empty
    string. Repeated rows get the same spans. A very long text is searched whole. Columns of ``docs`` beyond those named play no part.
    """
    found = findings(docs, doc_id, text, repo, owner)
    base = F.col("kind") != "live"
    spans = found.groupBy("row_key").agg(
        F.count_if(F.col("kind") == "assign").alias("n_assign"), F.count_if(F.col("kind") == "access").alias("n_access"), F.count_if(F.col("kind") == "hex").alias("n_hex"),
        F.count_if(F.col("verdict") == "example").alias("n_example"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos"),
        F.collect_set(F.when(base, _span(F.col("kind"), "start", "end"))).alias("base"),
        F.collect_set(F.when(F.col("verdict") == "live", _span(F.lit("live"), "value_start", "value_end"))).alias("live"),
    )
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: x["said"]), ",")
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key")).join(spans, "row_key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "doc_id", *[number(F.col(c)).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.sha2(F.coalesce(said(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(said(F.concat("base", "live")), F.lit("")).alias("spans"),
        number(F.size("live")).alias("n_live"), number(F.col("n_example")).alias("n_example"),
        number(F.col("n_owners")).alias("n_owners"), number(F.col("n_repos")).alias("n_repos"),
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: Column | str = "source", owner: Column | str = "source", mask: str = "[secret]") -> DataFrame:
    """``docs`` with each found value of ``text`` replaced by ``mask`` unless more than WIDE_OWNERS owners hold it; all other rows stay.

    Values of the base kinds need not look live (short passwords, passphrases). Overlapping values are masked as one. No row
    goes; null and empty texts stay as they are. All columns stay, in their order, whatever their names. An empty table stays empty.
    """
    key, found, live = free(docs, "key", "found", "live")
    spans = F.array_sort(F.collect_set(F.struct("value_start", "value_end")))
    masked = findings(docs, doc_id, text, repo, owner).where(F.col("n_owners") <= WIDE_OWNERS).groupBy(F.col("row_key").alias(found)).agg(spans.alias(live))
    step = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["value_end"]).alias("at"),
        F.when(x["value_start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, x["value_start"] - acc["at"]), F.lit(mask))).alias("out"),
    )
    cleaned = F.aggregate(live, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    rows = docs.withColumn(key, row_key(doc_id, text)).join(masked, F.col(key) == F.col(found), "left")
    return rows.withColumn(text, F.when(F.col(live).isNotNull(), cleaned).otherwise(F.col(text))).select(*docs.columns)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, repo=F.concat_ws("/", "source", "lang"), owner="source")
