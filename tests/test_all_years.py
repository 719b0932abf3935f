"""Queries over whole tables: all years, all tables of the report."""

import numpy as np
from pyspark.sql import functions as F

from rollbook.jobs import report
from rollbook.operators import summary
from rollbook.queries import QUERIES
from rollbook.sources import bridge, store

FOLDER = "/root/testdata/sf0.001"


def test_summary_of_all_years_against_the_recurrence(spark):
    rows = bridge.records(spark, FOLDER).select("ano", "p_female").collect()
    pmf = np.ones(1)
    for q in (r.p_female for r in rows if r.p_female is not None):
        pmf = np.convolve(pmf, [1 - q, q])
    got, cdf = QUERIES["summarize_whole"](spark, FOLDER).first(), np.cumsum(pmf)
    assert len({r.ano for r in rows}) == 7 and got.total == len(rows) and got.resolvidos == len(pmf) - 1
    assert (got.interval95_lower_resolved, got.interval95_upper_resolved) == (np.argmax(cdf >= 0.025), np.argmax(cdf >= 0.975))


def test_distributions_of_all_years_against_the_recurrence(spark):
    rec = bridge.records(spark, FOLDER).withColumn("key", F.concat("curso_normalizado", "tipo_registro", "periodo"))
    groups, got = {}, {}
    for r in rec.select("key", "p_female").collect():
        groups.setdefault(r.key, []).append(r.p_female)
    for r in QUERIES["poisson_binomial_whole"](spark, FOLDER).collect():
        got.setdefault(r.key, {})[r.k] = r.mass
    assert set(got) == set(groups)
    for key, qs in groups.items():
        pmf = np.ones(1)
        for q in qs:
            pmf = pmf if q is None else np.convolve(pmf, [1 - q, q])
        assert np.allclose([got[key][k] for k in range(len(pmf))], pmf, atol=1e-6) and len(got[key]) == len(pmf)


def test_the_report_has_all_tables_and_its_options_hold(spark):
    rec = bridge.records(spark, FOLDER)
    rows = report.melted(report.report_tables(rec)).collect()
    assert {r.report for r in rows} == set(report.TABLES)
    followed = report.melted(report.report_tables(rec, min_followup=6)).where("report = 'cohorts' AND metric = 'followup_semesters'").collect()
    every = [r.value for r in rows if r.report == "cohorts" and r.metric == "followup_semesters"]
    assert 0 < len(followed) < len(every) and all(r.value is None or r.value >= 6 for r in followed)


def test_a_rebuilt_report_keeps_the_stored_floor(spark, tmp_path):
    rec, at = bridge.records(spark, FOLDER), f"file://{tmp_path}"
    store.write_snapshot(rec, f"{at}/snapshot", {"MIN_GROUP_SIZE": 7})
    report.rebuild(spark, f"{at}/snapshot", f"{at}/rebuilt", minimum=5)
    totals = [int(r.total) for r in report.read(spark, f"{at}/rebuilt")["summaries"].where("total IS NOT NULL").collect()]
    sizes = [r.total for r in summary.report_sets(rec).collect()]
    assert min(totals) >= 7 and len(totals) == sum(n >= 7 for n in sizes) and any(5 <= n < 7 for n in sizes)
    assert store.read_envelope(spark, f"{at}/rebuilt/public")["analysis_at"] == store.snapshot_time(spark, f"{at}/snapshot")
    assert store.read_publication(spark, f"{at}/rebuilt/public").count() == summary.public_rows(rec).count()
