"""Small cases with known answers."""

import hashlib
import hmac
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.functions import periods, text
from rollbook.operators import charts, cohorts, distribution, extract, inference, privacy, quality, summary
from rollbook.sources import scan, store

RECORD = "record_id long, tipo_registro string, curso_normalizado string, periodo string, ano int, nome_chave string, p_female double, probability double, count long, confidence_class string"


def records(spark, rows):
    """rows: (kind, course, period, name, p_female)"""
    full = [(i, k, c, p, int(p[:4]), n, q, q, 10 if q is not None else None, inference.NONE if q is None else inference.HIGH) for i, (k, c, p, n, q) in enumerate(rows)]
    df = spark.createDataFrame(full, RECORD)
    return df.withColumns({"period_idx": periods.period_index(F.col("periodo")), "p_male": 1 - F.col("p_female")})


# --- names and periods


def test_names(spark):
    df = spark.createDataFrame([("JÚLIO CÉSAR TESTE",), ("  ana   téste ",), ("ANA-TESTE, SILVA",), ("a_b",), (None,)], "n string")
    rows = df.select(text.normalize_name("n").alias("a"), text.name_key("n").alias("b")).collect()
    assert [r.b for r in rows] == ["JULIO CESAR TESTE", "ANA TESTE", "ANA TESTE SILVA", "A B", None]
    assert rows[1].a == "ana téste" and rows[4].a is None
    valid = spark.createDataFrame([("ANA D'ÁVILA",), ("Ana",), ("ANA 2",), ("",), (None,), ("JOSÉ-MARIA",)], "n string").select(text.valid_name(F.col("n"))).collect()
    assert [r[0] for r in valid] == [True, False, False, False, False, True]
    with pytest.raises(Exception, match="empty name"):
        spark.createDataFrame([("  ",)], "n string").select(text.query_name(F.col("n"))).collect()


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_token(spark, key):
    got = spark.createDataFrame([("ANA É",)], "n string").select(text.hmac_token(F.col("n"), key)).first()[0]
    assert got == hmac.new(key, "ANA É".encode(), hashlib.sha256).hexdigest()


def test_periods(spark):
    df = spark.createDataFrame([("2019/1", "2019/2"), ("2019/1", "2020/2"), (None, "2020/1")], "a string, b string")
    assert [r[0] for r in df.select(periods.semester_difference(F.col("a"), F.col("b"))).collect()] == [1, 3, None]
    with pytest.raises(Exception, match="not a period"):
        spark.createDataFrame([("2020/3",)], "a string").select(periods.period_index(F.col("a"))).collect()


# --- distributions


def recurrence(qs):
    pmf = np.ones(1)
    for q in qs:
        pmf = np.convolve(pmf, [1 - q, q])
    return pmf


def masses(dist):
    """All masses of each group, in order; the places are 0, 1, 2 ... and the cumulative ones their sums."""
    out = {}
    for r in distribution.cumulative(dist, ["g"]).orderBy("g", "k").collect():
        own = out.setdefault(r.g, [])
        assert r.k == len(own)
        own.append(r.mass)
        assert abs(sum(own) - r.cdf) < 1e-9
    return out


def test_distribution_by_enumeration(spark):
    qs = [0.2, 0.7, 0.9]
    want = np.zeros(4)
    for outcome in itertools.product((0, 1), repeat=3):
        want[sum(outcome)] += np.prod([q if x else 1 - q for x, q in zip(outcome, qs)])
    df = spark.createDataFrame([("a", q) for q in qs] + [("b", 0.0), ("b", 1.0), ("b", 1.0), ("c", None)], "g string, p_female double")
    rows = {r.g: r for r in distribution.with_quantiles(distribution.distributions(df, ["g"]), {"low": 0.025, "high": 0.975, "none": 0.0, "all": 1.0}).collect()}
    mass = masses(distribution.distributions(df, ["g"]))
    assert np.allclose(mass["a"], want) and (rows["a"].low, rows["a"].high, rows["a"].none, rows["a"].all) == (1, 3, 0, 3)
    assert np.allclose(mass["b"], [0, 0, 1, 0]) and mass["c"] == [1.0] and rows["c"].draws == 0
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(Exception, match="probability"):
            distribution.distributions(spark.createDataFrame([("a", bad)], "g string, p_female double"), ["g"]).collect()


def test_distribution_against_the_recurrence(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{k}": np.round(rng.random(rng.integers(1, 900)), int(rng.integers(1, 5))) for k in range(12)}
    df = spark.createDataFrame([(g, float(q)) for g, qs in groups.items() for q in qs], "g string, p_female double")
    for g, mass in masses(distribution.distributions(df, ["g"])).items():
        assert np.abs(np.array(mass) - recurrence(groups[g])).max() < 1e-12


def test_monte_carlo(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 0.3), ("c", 0.6)], "g string, p_female double")
    assert tuple(distribution.monte_carlo_difference(df, "g", "a", "b", iterations=2500).first()) == (100, 100, 100)
    assert tuple(distribution.monte_carlo_difference(df, "g", "x", "b", iterations=10).first()) == (None, None, None)
    one = distribution.monte_carlo_difference(df, "g", "c", "b", iterations=3000, seed=1).first()
    assert one == distribution.monte_carlo_difference(df.repartition(7), "g", "c", "b", iterations=3000, seed=1).first()
    with pytest.raises(ValueError):
        distribution.monte_carlo_difference(df, "g", "a", "b", iterations=0)


# --- summaries


def test_summary(spark):
    row = summary.summarize(records(spark, [("ingressante", "X", "2019/1", "A", 0.8), ("ingressante", "X", "2019/1", "B", None)])).first()
    assert (row.cobertura, row.expected_female, row.conservative_percent_upper) == (0.5, 0.8, 100) and row.expected_male == pytest.approx(0.2) and row.variance_female == pytest.approx(0.16)
    assert (row.expected_female_percent_total_min, row.expected_female_percent_total_max) == (pytest.approx(40), pytest.approx(90))
    row = summary.summarize(records(spark, [("ingressante", "X", "2019/1", "A", None)])).first()
    assert row.female_percent_resolved is None and row.interval95_lower_resolved is None and row.conservative_percent_upper == 100
    row = summary.summarize(records(spark, [])).first()
    assert row.total == 0 and row.cobertura is None


def test_change_and_suppression(spark):
    rec = records(spark, [("ingressante", "X", "2019/1", "A", 0.8), ("ingressante", "X", "2020/2", "B", 0.6)]).cache()
    rows = sorted(summary.temporal(rec).collect(), key=lambda r: r.periodo)
    assert [r.variacao_pp for r in rows] == [None, pytest.approx(-20)]
    hidden = privacy.protected_series(summary.temporal(rec), ["tipo_registro"], 5).collect()
    assert all(r.total is None and r.variacao_pp is None and r.privacidade == privacy.SMALL and r.periodo for r in hidden)
    nine = records(spark, [("ingressante", "X", "2019/1", str(i), 0.5 if i == 0 else None) for i in range(9)])
    row = privacy.protect(summary.summarize(nine, ["periodo"])).first()
    assert row.total == 9 and row.female_percent_resolved is None and row.privacidade == privacy.FEW_RESOLVED
    assert privacy.protect(summary.summarize(records(spark, []))).first().privacidade is None
    with pytest.raises(ValueError):
        privacy.protect(rec, 0)


def test_public_rows_and_rules(spark):
    rec = records(spark, [("ingressante", "X", "2019/1", "A", 0.8), ("ingressante", "X", "2019/2", "B", 0.2), ("ingressante", "X", "2019/2", "C", None)])
    rows = summary.public_rows(rec).cache()
    assert rows.count() == 6 and quality.violations(rows).isEmpty()
    year = rows.where("agrupamento = 'ano' AND curso = 'X'").first()
    assert (year.total, year.resolvidos, year.expected_female, year.female_percent_resolved, year.interval95_lower_resolved, year.interval95_upper_resolved) == (3, 2, 1, 50, 0, 2)
    broken = {"total": F.lit(-1), "resolvidos": F.lit(4), "cobertura": F.lit(0.1), "female_percent_resolved": F.lit(99.0), "curso": F.lit("=FORMULA()"), "periodo": F.lit("a.pdf"), "variance_female": F.lit(float("nan")), "agrupamento": F.lit("mes")}
    for column, value in broken.items():
        assert not quality.violations(rows.withColumn(column, value.cast(dict(rows.dtypes)[column]))).isEmpty(), column
    with pytest.raises(ValueError):
        quality.violations(rows.withColumn("extra", F.lit(1)))
    assert {r.rule for r in quality.violations(rows.union(rows)).collect()} == {"key"}


def test_charts(spark):
    rec = records(spark, [("ingressante", "X", "2019/1", "A", 0.8), ("ingressante", "X", "2019/1", "D", 0.8), ("concluinte", "X", "2025/2", "A", None)])
    rows = {(r.tipo_registro, r.periodo): r.total for r in charts.series_table(rec, 1).collect()}
    assert rows == {("ingressante", "2019/1"): 2, ("ingressante", "2025/2"): None, ("concluinte", "2019/1"): None, ("concluinte", "2025/2"): 1}
    assert charts.cohort_match_share(rec, 1, "2019/1", "2019/1").first().match_percent == 50
    with pytest.raises(ValueError):
        charts.in_range(rec, "periodo", "2020/1", "2019/1")


# --- cohorts


def test_matching(spark):
    entrant, graduate = ("ingressante", "X", "2019/1"), ("concluinte", "X", "2025/2")
    one = lambda rows: {r.entrant_id: r for r in cohorts.match_cohorts(records(spark, rows)).collect()}
    got = one([(*entrant, "ANA", 0.9), (*graduate, "ANA", None), (*entrant, "JOAO", 0.2)])
    assert (got[0].status, got[0].graduate_id, got[0].semesters_to_graduation, got[2].status) == ("exact_unique", 1, 13, "not_found")
    assert one([(*entrant, "ANA", 0.9), (*graduate, "ANA", None), ("concluinte", "X", "2024/1", "ANA", None)])[0].status == "ambiguous"
    assert {r.status for r in one([(*entrant, "ANA", 0.9), ("ingressante", "X", "2020/1", "ANA", 0.9), (*graduate, "ANA", None)]).values()} == {"ambiguous"}
    assert one([(*entrant, "ANA", 0.9), ("concluinte", "X", "2019/1", "ANA", None), ("concluinte", "Y", "2025/2", "ANA", None)])[0].status == "not_found"
    assert one([(*entrant, "ANA", 0.9), ("ingressante", "X", "2025/2", "ANA", 0.9), (*graduate, "ANA", None)])[0].status == "exact_unique"


def test_matching_equals_the_join_on_a_hot_name(spark):
    rng = np.random.default_rng(0)
    rows = [(("ingressante", "concluinte")[int(rng.integers(2))], f"C{rng.integers(3)}", f"{2000 + int(rng.integers(9))}/{1 + int(rng.integers(2))}", "HOT" if rng.random() < 0.3 else f"N{rng.integers(60)}", 0.5) for _ in range(400)]
    rec = records(spark, rows)
    pairs = [(r.entrant_id, r.graduate_id) for r in cohorts.match_candidates(rec).collect()]
    by_e, by_g = {}, {}
    for e, g in pairs:
        by_e.setdefault(e, []).append(g)
        by_g.setdefault(g, []).append(e)
    for r in cohorts.match_cohorts(rec).collect():
        own = by_e.get(r.entrant_id, [])
        exact = len(own) == 1 and len(by_g[own[0]]) == 1
        assert (r.status, r.graduate_id) == (("exact_unique", own[0]) if exact else ("ambiguous" if own else "not_found", None))


def test_followup(spark):
    rec = records(spark, [("ingressante", "X", "2025/2", "A", 0.5), ("concluinte", "X", "2020/1", "B", None), ("ingressante", "Y", "2019/1", "C", 0.5)])
    rows = {r.curso_normalizado: r for r in cohorts.summarize_cohorts(rec, cohorts.match_cohorts(rec)).collect()}
    assert rows["X"].followup_semesters == 0 and rows["Y"].followup_semesters is None
    assert cohorts.summarize_cohorts(rec, cohorts.match_cohorts(rec), 1).count() == 0
    assert [r.n for r in cohorts.time_to_graduation(spark, cohorts.match_cohorts(rec)).collect()] == [0]


# --- predictions


def test_prediction_classes(spark):
    df = spark.createDataFrame([("female", 0.95), ("male", 0.8), ("female", 0.6), (None, None)], "gender string, probability double")
    rows = inference.apply_prediction(df).collect()
    assert [r.confidence_class for r in rows] == [inference.HIGH, inference.MEDIUM, inference.LOW, inference.NONE]
    assert [r.p_female for r in rows] == [0.95, pytest.approx(0.2), 0.6, None]
    with pytest.raises(ValueError):
        inference.apply_prediction(df, 0.5, 0.9)


def test_store(spark):
    row = lambda n, g, at, country="BR", mode="full": (n, country, mode, g, 0.9 if g else None, 1, at)
    schema = "name string, country_id string, name_mode string, gender string, probability double, count long, queried_at string"
    kept = inference.upsert(spark.createDataFrame([row("A", "male", "1"), row("B", None, "1")], schema), spark.createDataFrame([row("A", "female", "2"), row("C", "male", "1", "US")], schema))
    assert {(r.name, r.gender) for r in kept.collect()} == {("A", "female"), ("B", None), ("C", "male")}
    asked = spark.createDataFrame([(f"N{i:03d}",) for i in range(101)] + [("A",), ("B",)], "query_name string")
    batches = inference.missing(asked, kept).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in batches} == {0: 100, 1: 1}
    assert inference.lookup(asked.where("query_name = 'A'"), kept, country="US").first().known is False


# --- extraction


def page(rows, header="ANO/SEMESTRE : 2019 / 1", total=2, title=extract.TITLES["ingressante"]):
    return "\n".join([title, "CIÊNCIA DA COMPUTAÇÃO", header, "SEQ NOME", *rows, f"Subtotal de matriculados: {total}", f"Total: {total}"])


ANA, JULIO = "1 ANA TESTE Vestibular VESTIBULAR NOTURNO", "2 JÚLIO CÉSAR TESTE Vestibular VESTIBULAR NOTURNO"


def extracted(spark, *pages, **more):
    out = extract.extract(spark.createDataFrame([("d", i, p) for i, p in enumerate(pages, 1)], "doc_id string, page_no int, text string"), **more)
    return out.records.orderBy("pagina", "numero_sequencial").collect(), {r.code for r in out.warnings.collect()}, out.documents.first(), out.review.count()


def test_roster(spark):
    rows, codes, doc, _ = extracted(spark, page([ANA, JULIO]))
    assert [(r.nome_chave, r.periodo, r.turno, r.tipo_ingresso, r.curso_normalizado) for r in rows] == [("ANA TESTE", "2019/1", "NOTURNO", "Vestibular", "CIENCIA DA COMPUTACAO"), ("JULIO CESAR TESTE", "2019/1", "NOTURNO", "Vestibular", "CIENCIA DA COMPUTACAO")]
    assert not codes and doc.status == "OK" and not doc.blocking
    _, codes, doc, _ = extracted(spark, page([ANA, JULIO]), page([ANA, JULIO]))
    assert (doc.registros_brutos, doc.registros_unicos, doc.duplicacoes_removidas, doc.status) == (4, 2, 2, "OK")


@pytest.mark.parametrize("pages, n, code, blocking", [
    ([page([ANA, JULIO], total=3)], 2, "total_mismatch", True),
    ([page([ANA, "2 ANA TESTE Vestibular VESTIBULAR NOTURNO"])], 2, "homonym", False),
    ([page([ANA, "1 JÚLIO TESTE Vestibular VESTIBULAR NOTURNO"])], 2, "sequence_conflict", True),
    ([page(["1 ANA TESTE Sorteio X NOTURNO"])], 0, "no_columns", True),
    ([page([ANA, JULIO], header="ANO/SEMESTRE : 2019 / 12")], 0, "bad_period", True),
    ([page([ANA, JULIO]), "X\nANO/SEMESTRE: 2020 / 3\n3 BIA TESTE Vestibular NOTURNO"], 2, "no_context", True),
    ([page([ANA, JULIO]), "3 BIA TESTE Vestibular NOTURNO"], 3, "total_mismatch", True),
    ([page([ANA, JULIO]), None], 2, "no_text", True),
    (["nothing to see"], 0, "unknown_kind", True),
    ([page(["7"])], 0, "lone_sequence", True),
])
def test_roster_warnings(spark, pages, n, code, blocking):
    rows, codes, doc, review = extracted(spark, *pages)
    assert len(rows) == n and code in codes and doc.blocking == blocking and doc.status == "WARNING" and review == (2 if code == "homonym" else 0)


def test_wrapped_name_and_alias(spark):
    title, header = extract.TITLES["concluinte"], "CONCLUINTES NO ANO/SEMESTRE: 2025/2"
    rows = ["2 BIA TESTE NOTURNO", "MARIA DA", "3 NOTURNO", "SILVA TESTE", "4 CAIO TESTE NOTURNO"]
    got, _, _, _ = extracted(spark, page(rows, header, 3, title), aliases={"Ciência da Computação": "Computação"})
    assert [(r.numero_sequencial, r.nome_chave, r.curso_normalizado) for r in got] == [(2, "BIA TESTE", "COMPUTACAO"), (3, "MARIA DA SILVA TESTE", "COMPUTACAO"), (4, "CAIO TESTE", "COMPUTACAO")]
    rows[-1] = "5 CAIO TESTE NOTURNO"
    got, codes, doc, _ = extracted(spark, page(rows, header, 3, title))
    assert len(got) == 2 and "bad_name" in codes and doc.blocking


# --- sources


def test_title_over_page_breaks(spark):
    title, far = extract.TITLES["ingressante"], "X" * 200
    words = title.split()
    pages = {
        "whole": ["a", f"{far} {title} {far}"], "broken": [f"{far} {' '.join(words[:2])}", f"{' '.join(words[2:])} {far}"], "three": [f"{far} {words[0]}", words[1], "", f"{' '.join(words[2:])} {far}"],
        "apart": [f"{words[0]} {far}", " ".join(words[1:])], "both": [title, extract.TITLES["concluinte"]], "blank": ["", None],
    }
    rows = [(d, i, t) for d, texts in pages.items() for i, t in enumerate(texts, 1)]
    got = {r.doc_id: (r.kind, r.empty) for r in extract.detect_kind(spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(3)).collect()}
    found = ("ingressante", False)
    assert got == {"whole": found, "broken": found, "three": found, "apart": (None, False), "both": (None, False), "blank": (None, True)}


def test_reuse_changes_nothing(spark):
    pages = spark.createDataFrame([("d", 1, page(["1 ANA NOTURNO", "2 ANA NOTURNO"]))], "doc_id string, page_no int, text string")
    tables = lambda x: [sorted(df.collect(), key=str) for df in (x.documents, x.warnings, x.review, x.records)]
    want = tables(extract.extract(pages))
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    assert tables(extract.extract(pages, reuse=True)) == want and len(want[1]) > 0
    assert held() <= before


def test_overlaps_by_themselves_are_those_of_the_warnings(spark):
    rows = [("a", 1, page([ANA, ANA, JULIO])), ("b", 1, page([ANA])), ("c", 1, page([JULIO.replace("2", "3"), JULIO.replace("2", "3")]))]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text string")
    got = extract.extract(pages).overlaps
    assert sorted(r.doc_id for r in got.collect()) == ["a", "b"]
    assert sorted(r.doc_id for r in extract.extract(pages, reuse=True).warnings.where("code = 'overlap'").collect()) == ["a", "b"]


@pytest.mark.parametrize("change", [{"schema_version": 2}, {"analysis_at": "yesterday"}, {"rows": 1}])
def test_envelope(change):
    good = {"schema_version": 1, "generated_at": "2026-01-01T00:00:00+00:00", "analysis_at": "2026-01-01T00:00:00"}
    quality.check_envelope(good)
    with pytest.raises(ValueError):
        quality.check_envelope(good | change)


def test_content_dedup(spark):
    rows = [(1, "A", False), (2, "A", True), (3, "B", True), (4, "B", True), (5, "A", False)]
    got = {r.doc_id: r.kept for r in scan.content_dedup(spark.createDataFrame(rows, "doc_id long, content string, archived boolean")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_secret_scan(spark):
    rows = [(1, "ghp_" + "a" * 20), (2, "ghp_" + "a" * 20), (3, "-----BEGIN " + "PRIVATE KEY-----"), (4, "x\nMY_API_KEY = 'abcdefghijklmnop'"), (5, "plain"), (6, None)]
    got = {(r.doc_id, r.rule) for r in scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "token"), (3, "private_key"), (4, "api_key")}


def test_snapshot_and_publication(spark, tmp_path):
    rec = records(spark, [("ingressante", "X", "2019/1", "ANA", 0.9), ("concluinte", "X", "2025/2", "ANA", None), ("ingressante", "X", "2019/1", "JOAO", 0.2)])
    root = f"file://{tmp_path}/snap"
    store.write_snapshot(rec, root, {"MIN_GROUP_SIZE": 7, "SECRET": 1})
    rows, settings = store.read_snapshot(spark, root)
    assert settings == {"MIN_GROUP_SIZE": 7} and store.privacy_floor(settings, 5) == 7 and rows.where("nome_chave IN ('ANA', 'JOAO')").count() == 0
    status = lambda r: sorted((m.entrant_id, m.status) for m in cohorts.match_cohorts(r).collect())
    assert status(rows) == status(rec)
    first = {r.nome_chave for r in rows.collect()}
    store.write_snapshot(rec, root, {})
    assert not first & {r.nome_chave for r in store.read_snapshot(spark, root)[0].collect()}
    public, out = summary.public_rows(rec).cache(), f"file://{tmp_path}/public"
    store.publish(public, out)
    assert quality.difference(store.read_publication(spark, out), public).isEmpty()
    with pytest.raises(ValueError):
        store.publish(public.withColumn("total", F.col("total") + 1), out)
    assert store.read_publication(spark, out).count() == public.count()
    store.write_report_table(public.where("false"), f"file://{tmp_path}/none")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("column, kind", [("total", "string"), ("interval95_lower_resolved", "double"), ("cobertura", "bigint"), ("curso", "bigint"), ("variance_female", "string")])
def test_a_public_column_of_another_kind_is_refused(spark, column, kind):
    rows = spark.createDataFrame([], quality.PUBLIC_SCHEMA)
    quality.check_schema(rows.withColumn("total", F.col("total").cast("int")))
    with pytest.raises(ValueError, match=column):
        quality.check_schema(rows.withColumn(column, F.col(column).cast(kind)))


def test_stored_settings():
    given = {"NAME_MODE": "first", "BATCH_SIZE": 50, "MIN_GROUP_SIZE": 5, "API_KEY": "x", "other": 1}
    assert privacy.kept_settings(given) == {"NAME_MODE": "first", "BATCH_SIZE": 50, "MIN_GROUP_SIZE": 5}


def test_a_publication_computes_its_rows_once(spark, tmp_path):
    """Rows that come out otherwise each time, as sums do in another order of the shuffle; and a large group, whose parts add up but for the last digit."""
    import random

    again = F.udf(lambda: 1.0 + random.random(), "double").asNondeterministic()
    public = summary.public_rows(records(spark, [("ingressante", "X", "2020/1", "A", 0.25), ("concluinte", "Y", "2021/2", "B", 0.75)])).withColumn("variance_female", again())
    store.publish(public, f"file://{tmp_path}/p")
    assert store.read_publication(spark, f"file://{tmp_path}/p").count() == public.count()


def test_parts_of_a_large_count_add_up_to_its_precision(spark):
    big = {"total": 50_000_000, "resolvidos": 50_000_000, "nao_identificados": 0}
    public = summary.public_rows(records(spark, [("ingressante", "X", "2020/1", "A", 0.25)])).withColumns({k: F.lit(v).cast("long") for k, v in big.items()})
    real = {"expected_female": 20_000_000.3, "expected_male": 29_999_999.70000001, "female_percent_resolved": 40.0000006, "male_percent_resolved": 59.9999994, "cobertura": 1.0}
    public = public.withColumns({k: F.lit(v) for k, v in real.items()})
    assert quality.violations(public).isEmpty()
    assert {r.rule for r in quality.violations(public.withColumn("expected_male", F.lit(29_999_998.7))).collect()} == {"estimates", "shares"}


def test_every_character_has_the_key_of_python(spark):
    """Each character alone and within a name, the plain ones without Python; the surrogates are no characters."""
    import unicodedata

    letters = [chr(c) for c in [*range(1, 0x3100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D500)] if not 0xD800 <= c < 0xE000]
    rows = [x for c in letters for x in (c, f" a{c}B{c} ")]
    got = spark.createDataFrame([(x,) for x in rows], "n string").select("n", text.name_key("n").alias("key"), text.normalize_name("n").alias("name")).collect()
    wrong = [r for r in got if r.key != text._key(r.n) or r.name != " ".join(unicodedata.normalize("NFC", r.n).split())]
    assert len(got) == len(rows) and not wrong


def test_latin_texts_never_reach_python(spark, monkeypatch):
    """Page texts in Latin letters with accents: what Python gets of them is null."""
    @F.udf("string")
    def strict(x):
        if x is not None and x != "\u0391":
            raise ValueError(x)
        return x

    monkeypatch.setattr(text, "_key_any", strict)
    monkeypatch.setattr(text, "_normalize_any", strict)
    pages = [("d", 1, "RELAÇÃO DE ALUNOS INGRESSANTES\nCURSO: Ciência\nANO/SEMESTRE: 2020 / 1\n1 JOSÉ DA CONCEIÇÃO Vestibular NOTURNO"), ("e", 1, "\u0391")]
    rows = extract.detect_kind(spark.createDataFrame(pages, "doc_id string, page_no int, text string")).collect()
    assert {r.doc_id: r.kind for r in rows} == {"d": "ingressante", "e": None}


def test_the_gate_reads_documents_once(spark):
    """Its four parts are made of one written table: nothing of the extraction is left in the plan."""
    from rollbook import queries

    assert "Join" not in queries.run_gate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
