"""The whole report as one job: all tables from one set of records, written below one folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.operators.cohorts import match_cohorts, summarize_cohorts, time_to_graduation
from rollbook.operators.privacy import protect, protected_series, review_summary
from rollbook.operators.summary import compare_periods, public_of, report_sets, series_of
from rollbook.sources.shared import cut
from rollbook.sources.store import EMPTY_HEADER, privacy_floor, publish, read_report_table, read_snapshot, snapshot_time, write_report_table

TABLES = ("temporal", "temporal_by_course", "summaries", "comparison", "cohorts", "durations", "review")
#: Columns that name a row of a report table.
ROW = ("level", "tipo_registro", "curso_normalizado", "ano", "periodo", "periodo_ingresso", "grupo", "motivo")


def report_tables(records: DataFrame, review: DataFrame | None = None, minimum: int = 5, min_followup: int | None = None, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Name -> table, suppressed. The comparison runs on the suppressed series.

    ``rows`` are the ``report_sets`` of the records: they and the matches are written once, and every table is made of those two; no
    table goes back to the records but for the matched people's probabilities. ``min_followup`` leaves cohorts of less or unknown follow-up out.
    """
    rows = cut(report_sets(records)) if rows is None else rows
    matches = cut(match_cohorts(records))
    kind = "tipo_registro"
    series = protected_series(series_of(rows), [kind], minimum)
    one = lambda k: series.where(F.col(kind) == k)
    unclear = matches.where("status = 'ambiguous'").select(F.lit("matching ambíguo").alias("motivo"))
    reviews = unclear if review is None else review.select("motivo").union(unclear)
    return {
        "temporal": series,
        "temporal_by_course": protected_series(series_of(rows, by_course=True), [kind, "curso_normalizado"], minimum),
        "summaries": protect(rows, minimum, ("level", kind)),
        "comparison": compare_periods(one("ingressante"), one("concluinte")),
        "cohorts": protect(summarize_cohorts(records, matches, min_followup), minimum),
        "durations": protect(time_to_graduation(records.sparkSession, matches), minimum),
        "review": review_summary(reviews),
    }


def run(records: DataFrame, folder: str, review: DataFrame | None = None, minimum: int = 5, min_followup: int | None = None, analysis_at: str | None = None) -> list[str]:
    """Write all tables and the public table below ``folder``; the tables' names."""
    rows = cut(report_sets(records))
    tables = report_tables(records, review, minimum, min_followup, rows)
    for name, table in tables.items():
        write_report_table(table, f"{folder}/{name}")
    publish(public_of(rows), f"{folder}/public", analysis_at)
    return list(tables)


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that ``run`` wrote, as text; those without rows are left out."""
    tables = {name: read_report_table(spark, f"{folder}/{name}") for name in TABLES}
    named = lambda table: table.fillna("", ["level"]) if "level" in table.columns else table  # noqa: E731 the total's level is ''
    return {name: named(table) for name, table in tables.items() if table.columns != [EMPTY_HEADER]}


def rebuild(spark: SparkSession, snapshot: str, folder: str, minimum: int = 5, min_followup: int | None = None) -> list[str]:
    """The report from stored records alone, under the stricter of the stored and the given group size; the publication says of which snapshot."""
    records, settings = read_snapshot(spark, snapshot)
    return run(records, folder, None, privacy_floor(settings, minimum), min_followup, snapshot_time(spark, snapshot))


def melted(tables: dict[str, DataFrame]) -> DataFrame:
    """report, row, metric, value, text: every cell of the tables, numbers in value and words in text; row has the columns of ROW, joined by bars."""
    def cells(name: str, table: DataFrame) -> DataFrame:
        kinds = dict(table.dtypes)
        words = ("privacidade", "latest_graduation_period", "latest_graduation_period_course")
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ROW if c in kinds])
        each = [
            F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("value") if c in words else F.col(c).cast("double").alias("value"), (F.col(c) if c in words else F.lit(None)).cast("string").alias("text"))
            for c in table.columns if c not in ROW]
        return table.select(F.lit(name).alias("report"), row.alias("row"), F.explode(F.array(*each)).alias("x")).select("report", "row", "x.*")

    return reduce(DataFrame.union, [cells(name, table) for name, table in tables.items()])
