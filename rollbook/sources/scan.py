"""Finding documents, dropping copies of their content, and looking for credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.sources.shared import spread_join

#: Credentials that must not be published. The first three are fixed values; the last is our own, wider one for keys in settings.
SECRETS = {
    "token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "fine_grained_token": r"github_pat_[A-Za-z0-9_]{30,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "api_key": r"(?im)^[A-Z_]*API_KEY\s*=\s*[\"']?[A-Za-z0-9_-]{16,}",
}


def discover_documents(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """path, length of all files below ``root`` with the suffix in either case, by path; contents are not read."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length").orderBy("path")


def content_dedup(documents: DataFrame, content: str = "content", archived: str = "archived", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``order`` columns, digest, archived, kept. Loose documents are all kept, even copies of each other; an archived one goes
    if a loose one or an earlier archived one has its content. Only digests are shuffled."""
    rows = documents.select(*order, F.col(archived).alias("archived"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.bool_or(~F.col("archived")).alias("loose"), F.min(F.when(F.col("archived"), F.struct(*order))).alias("first"))
    kept = ~F.col("archived") | (~F.col("loose") & (F.struct(*order) == F.col("first")))
    return spread_join(rows, first, ["digest"], list(order)).select(*order, "digest", "archived", kept.alias("kept"))


def secret_scan(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, rule of each distinct content with a credential (under its least key); never the content."""
    digest = F.sha2(F.col(text).cast("binary"), 256)
    hits = documents.select(key, digest.alias("digest"), F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(r)) for r, p in SECRETS.items()])).alias("rules")).where(F.size("rules") > 0)
    return hits.groupBy("digest").agg(F.min(key).alias(key), F.first("rules").alias("rules")).select(key, F.explode("rules").alias("rule"))
