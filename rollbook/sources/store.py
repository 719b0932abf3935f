"""Snapshots, report tables and publications. A new version is written aside, then committed to the folder's log."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.privacy import kept_settings, pseudonymize
from rollbook.operators.quality import ENVELOPE, PUBLIC_SCHEMA, PUBLIC_VERSION, check_envelope, check_pair, check_schema, violations
from rollbook.operators.summary import PUBLIC
from rollbook.sources import commits
from rollbook.sources.shared import cut

SCHEMA_VERSION = 2
EMPTY_HEADER = "sem_dados"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def write_snapshot(records: DataFrame, root: str, settings: dict, key: bytes | None = None) -> str:
    """Pseudonymised records and settings as a new version below ``root``; earlier ones stay readable until it is whole."""
    spark, version = records.sparkSession, uuid.uuid4().hex
    pseudonymize(records, key).write.parquet(f"{root}/{version}/records")
    meta = [(SCHEMA_VERSION, json.dumps(kept_settings(settings)), _now())]
    spark.createDataFrame(meta, "schema_version int, settings string, created_at string").coalesce(1).write.parquet(f"{root}/{version}/meta")
    commits.commit(spark, root, {"version": version})
    return version


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    """Records and settings of the current version. Version 1 held names; it is pseudonymised on the way in."""
    version = commits.latest(spark, root)["version"]
    meta, rows = spark.read.parquet(f"{root}/{version}/meta").first(), spark.read.parquet(f"{root}/{version}/records")
    if meta["schema_version"] not in (1, SCHEMA_VERSION):
        raise ValueError(f"unknown snapshot version: {meta['schema_version']}")
    return (pseudonymize(rows) if meta["schema_version"] == 1 else rows), json.loads(meta["settings"])


def snapshot_time(spark: SparkSession, root: str) -> str:
    """When the current version was written."""
    return spark.read.parquet(f"{root}/{commits.latest(spark, root)["version"]}/meta").first()["created_at"]


def privacy_floor(stored: dict, minimum: int) -> int:
    """The group size that holds for a rebuilt report: never looser than what was stored."""
    return max(int(stored.get("MIN_GROUP_SIZE", minimum)), minimum)


def write_report_table(rows: DataFrame, path: str) -> None:
    """CSV with a header; a table without rows is the header EMPTY_HEADER alone."""
    if rows.isEmpty():
        rows = rows.sparkSession.range(0).select(F.lit("").alias(EMPTY_HEADER))
    rows.write.option("header", True).csv(path)


def read_report_table(spark: SparkSession, path: str) -> DataFrame:
    """A written report table, all cells as text; empty cells are null."""
    return spark.read.option("header", True).csv(path)


def read_public_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of a published CSV; empty cells are null, a malformed cell is an error."""
    return spark.read.schema(PUBLIC_SCHEMA).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def publish(rows: DataFrame, root: str, analysis_at: str | None = None) -> str:
    """Validate, write CSV and JSON of one new version, compare the two, then point at it. A failure leaves the old one.

    The rows are computed once: sums of reals that are made again, in another order of the shuffle, may differ in the last digit.
    The envelope beside them holds the format's version, the time of the publication, and ``analysis_at``, the time of
    the snapshot that the rows are of; the same as the former where they come straight from records.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    rows, now = rows.select(*PUBLIC), _now()
    check_schema(rows)
    rows = cut(rows)
    envelope = dict(zip(ENVELOPE, (PUBLIC_VERSION, now, analysis_at or now)))
    check_envelope(envelope)
    if not violations(rows).isEmpty():
        raise ValueError("rows break the public schema")
    rows.write.option("header", True).csv(f"{root}/{version}/csv")
    rows.write.option("ignoreNullFields", False).json(f"{root}/{version}/json")
    spark.createDataFrame([tuple(envelope.values())], "schema_version int, generated_at string, analysis_at string").coalesce(1).write.json(f"{root}/{version}/envelope")
    check_pair(read_public_csv(spark, f"{root}/{version}/csv"), spark.read.schema(PUBLIC_SCHEMA).json(f"{root}/{version}/json"))
    commits.commit(spark, root, {"version": version})
    return version


def read_publication(spark: SparkSession, root: str) -> DataFrame:
    return read_public_csv(spark, f"{root}/{commits.latest(spark, root)["version"]}/csv")


def read_envelope(spark: SparkSession, root: str) -> dict:
    """The current publication's envelope, checked."""
    envelope = spark.read.json(f"{root}/{commits.latest(spark, root)["version"]}/envelope").first().asDict()
    check_envelope(envelope)
    return envelope
