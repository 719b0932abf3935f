"""Tables behind charts: series by period, cohort shares, durations, composition. Gaps stay null; small groups are hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.periods import period_index
from rollbook.operators.cohorts import match_cohorts, summarize_cohorts, time_to_graduation
from rollbook.operators.privacy import protect
from rollbook.operators.summary import summarize, temporal


def in_range(df: DataFrame, column: str = "periodo", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose period lies between the two, both included; either may be open. An inverted range is an error."""
    place = lambda p: int(p[:4]) * 2 + int(p[5]) - 1
    if start and end and place(start) > place(end):
        raise ValueError("the range ends before it starts")
    if start:
        df = df.where(period_index(F.col(column)) >= place(start))
    return df.where(period_index(F.col(column)) <= place(end)) if end else df


def aligned(series: DataFrame, keys: tuple[str, ...] = ("tipo_registro",), period: str = "periodo") -> DataFrame:
    """Every series on the union of all periods; where a series has no row its values are null. The axis and the list of
    series are short, aggregated tables."""
    axis, kinds = series.select(period).distinct(), series.select(*keys).distinct()
    return kinds.join(axis, F.lit(True)).join(series, [*keys, period], "left")


def series_table(records: DataFrame, minimum: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
    """Count, female share, its interval in % and coverage in % by kind and period, aligned and protected."""
    rows = protect(temporal(in_range(records, "periodo", start, end)), minimum, ("tipo_registro",))
    bound = lambda c: F.when(F.col("resolvidos") > 0, 100 * F.col(c) / F.col("resolvidos"))
    return aligned(rows).select(
        "tipo_registro", "periodo", "total", "female_percent_resolved", bound("interval95_lower_resolved").alias("lower_percent"), bound("interval95_upper_resolved").alias("upper_percent"), (100 * F.col("cobertura")).alias("coverage_percent"))


def cohort_match_share(records: DataFrame, minimum: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
    """Share of unique matches by cohort. The range is of entry periods alone; later graduates all count."""
    rows = protect(summarize_cohorts(records, in_range(match_cohorts(records), "periodo_ingresso", start, end)), minimum)
    return rows.select("curso_normalizado", "periodo_ingresso", (100 * F.col("match_proportion")).alias("match_percent"), "followup_semesters")


def course_duration(records: DataFrame, minimum: int = 5) -> DataFrame:
    rows = time_to_graduation(records.sparkSession, match_cohorts(records)).where("grupo <> 'global'")
    return protect(rows, minimum).select("grupo", "n", "media_semestres", "min_semestres", "max_semestres")


def composition(records: DataFrame, kind: str, by_year: bool = False, minimum: int = 5) -> DataFrame:
    """Female and male share of the resolved records of one kind and their coverage, as a whole or by year.

    The coverage of the whole is shown only where the whole is."""
    keys = ["ano"] if by_year else []
    rows = protect(summarize(records.where(F.col("tipo_registro") == kind), keys), minimum)
    return rows.select(*keys, "female_percent_resolved", "male_percent_resolved", (100 * F.col("cobertura")).alias("coverage_percent"), "privacidade")
