"""Groups, documents and names that hold a large share of all rows."""

import itertools
import random
import re
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.operators import cohorts, distribution, extract, inference, summary
from rollbook.sources import commits, predictions, shared


@pytest.fixture
def as_dealt(spark):
    """Shuffled partitions stay as they are, so that rows can be counted by task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def shares(df):
    """The share of the rows that each task has, the largest first."""
    n = sorted((r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()), reverse=True)
    return [x / sum(n) for x in n]


# --- distributions


def test_all_rows_of_a_large_distribution(spark):
    """200,000 draws of 50,000 distinct probabilities; the recurrence in a window of 10 standard deviations beside it."""
    q = F.pmod(F.xxhash64(F.col("id") % 50_000), F.lit(1_000_003)) / 1_000_003
    df = spark.range(200_000).select(q.alias("p_female"))
    got = distribution.cumulative(distribution.distributions(df, []), []).orderBy("k").toPandas()
    assert got.k.tolist() == list(range(200_001)) and abs(got.mass.sum() - 1) < 1e-9 and (got.cdf.diff().dropna() > -1e-12).all()
    qs = np.sort(df.toPandas().p_female.to_numpy())
    pmf, mean, var = np.zeros(len(qs) + 40), 0.0, 0.0
    pmf[0] = 1
    for x in qs:
        mean, var = mean + x, var + x * (1 - x)
        low, high = max(1, int(mean - 10 * var**0.5) - 30), int(mean + 10 * var**0.5) + 30
        own = pmf[low:high] * (1 - x) + pmf[low - 1:high - 1] * x
        pmf[0] *= 1 - x
        pmf[low:high] = own
    at = np.arange(int(mean - 6 * var**0.5), int(mean + 6 * var**0.5), 7)
    assert np.abs(got.mass.to_numpy()[at] - pmf[at]).max() < 1e-12
    assert np.abs(got.cdf.to_numpy()[at] - np.cumsum(pmf)[at]).max() < 1e-9


@pytest.mark.parametrize("draws", [10_000, 10_001, 70_000])
def test_no_size_changes_the_form(spark, draws):
    got = distribution.cumulative(distribution.distributions(spark.range(draws).select(F.lit(0.5).alias("p_female")), []), []).toPandas()
    assert sorted(got.k) == list(range(draws + 1)) and got.cdf.max() <= 1 + 1e-9


def test_a_hot_group_is_dealt_over_the_nodes_of_the_tree(spark, as_dealt):
    cells = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") / 20_000).alias("__q"), F.lit(1).cast("long").alias("__n"))
    parts = distribution._folded(cells, ["g"], ["__q", "__n"], F.pmod(F.xxhash64("__q"), F.lit(16)), distribution._of_cells)
    assert sorted(r["__salt"] for r in parts.collect()) == list(range(16)) and max(r.draws for r in parts.collect()) < 3000
    whole = distribution.merged(parts, ["g"], F.col("__salt"), 16).first()
    assert whole.draws == 20_000 and abs(sum(whole.mass) - 1) < 1e-9 and abs(whole.mean - 19_999 / 2) < 1e-3


def test_the_lattice_is_what_each_set_gives_by_itself(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(3), rng.choice([None, 0.0, 1.0, 0.25, 0.6, 0.61]), 1 + rng.randrange(4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "kind string, course string, year int, p_female double, n long")
    sets = [(), ("course",), ("year",), ("course", "year")]
    for s, states in summary.lattice(df, ["course", "year"], sets, ("kind",)).items():
        keys = ["kind", *s]
        want = {tuple(r[k] for k in keys): r for r in distribution.distributions(df, keys, "p_female", "n").collect()}
        got = {tuple(r[k] for k in keys): r for r in states.collect()}
        assert set(got) == set(want)
        for k, r in got.items():
            assert (r.draws, r.offset) == (want[k].draws, want[k].offset) and np.allclose(r.mass, want[k].mass, atol=1e-13)


def differences(p, q):
    """All values of 100 * (B / n_b - A / n_a) with their probability, by enumeration."""
    out = {}
    for xs in itertools.product((0, 1), repeat=len(p) + len(q)):
        a, b = sum(xs[:len(p)]), sum(xs[len(p):])
        mass = np.prod([y if x else 1 - y for x, y in zip(xs, p + q)])
        d = round(100 * (b / len(q) - a / len(p)), 9)
        out[d] = out.get(d, 0) + mass
    return sorted(out.items())


def test_exact_difference(spark):
    p, q = [0.3, 0.6, 0.85], [0.1, 0.5, 0.7, 0.9]
    df = spark.createDataFrame([("a", x) for x in p] + [("b", x) for x in q] + [("a", None), ("c", 0.5)], "g string, p_female double")
    alphas = {f"p{k}": k / 20 + 1e-6 for k in range(20)}
    got, values = distribution.exact_difference(df, "g", "a", "b", alphas).first(), differences(p, q)
    cdf = np.cumsum([m for _, m in values])
    for k, alpha in alphas.items():
        assert got[k] == pytest.approx(values[int(np.argmax(cdf >= alpha))][0])
    assert distribution.exact_difference(df, "g", "a", "z", alphas).first().p0 is None


def test_simulation_depends_on_neither_partitions_nor_other_cells(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", (k % 40) / 40) for k in range(600)] + [("z", 0.5)] * 50, "g string, p_female double")
    draws = lambda d: distribution.monte_carlo_difference(d, "g", "a", "b", iterations=2500, seed=9).first()
    one = draws(df)
    assert one == draws(df.where("g <> 'z'").repartition(13)) == draws(df.coalesce(1))
    exact = distribution.exact_difference(df, "g", "a", "b", {"low": 0.47, "high": 0.53}).first()
    assert exact.low <= one.p50 <= exact.high


# --- extraction


def plain_context(pages, kind):
    """pages: texts in order. (page, i) -> (course, year, half) of the last header."""
    pattern = extract.PERIOD if kind == "ingressante" else extract.GRADUATE_PERIOD
    pattern, context, out = re.compile(pattern.replace("(?iU)", "(?i)")), None, {}
    for n, text in enumerate(pages, 1):
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        for i, line in enumerate(lines):
            if "ANO/SEMESTRE" in line.upper():
                m, before = pattern.search(line), lines[i - 1] if i else ""
                course = re.sub(r"(?i)^CURSO\s*:\s*", "", before) if before and not re.search("(?i)" + extract.NO_COURSE.replace("(?iU)", ""), before) else None
                context = (course, int(m[1]), int(m[2])) if m else (None, None, None)
            out[n, i] = context
    return out


@pytest.mark.parametrize("size", [1, 7, 1024])
@pytest.mark.parametrize("kind", ["ingressante", "concluinte"])
def test_context_over_pages_and_blocks(spark, monkeypatch, size, kind):
    monkeypatch.setattr(extract, "PAGES", size)
    rng, word = random.Random(size), "" if kind == "ingressante" else "CONCLUINTES NO "
    header = lambda: rng.choice([f"CURSO: C{rng.randrange(9)}\n{word}ANO/SEMESTRE: {2000 + rng.randrange(9)}/{1 + rng.randrange(2)}", f"{word}ANO/SEMESTRE: sem data", f"1 X\n{word}ano/semestre : 2001 / 2", "ANO/SEMESTRE"])
    pages = [None if rng.random() < 0.1 else "\n".join(header() if rng.random() < 0.06 else f"{k} LINE" for k in range(rng.randrange(8))) for _ in range(60)]
    rows = [("d", n, t) for n, t in enumerate(pages, 1)] + [("other", n, "1 LINE") for n in range(1, 5)]
    kinds = spark.createDataFrame([("d", kind), ("other", kind), ("unknown", None)], "doc_id string, kind string")
    got = extract.with_context(spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(5), kinds).collect()
    want = plain_context(pages, kind)
    assert {(r.page_no, r.i): r.context and tuple(r.context) for r in got if r.doc_id == "d"} == want
    assert all(r.context is None for r in got if r.doc_id == "other") and sum(r.doc_id == "d" for r in got) == len(want)


def test_a_huge_document_is_dealt_over_tasks(spark, monkeypatch, as_dealt):
    monkeypatch.setattr(extract, "PAGES", 32)
    big = spark.range(1, 2001).select(F.lit("big").alias("doc_id"), F.col("id").cast("int").alias("page_no"), F.when(F.col("id") == 1, F.lit(f"{extract.TITLES['ingressante']}\nCURSO: X\nANO/SEMESTRE: 2019/1")).otherwise(F.lit("1 A\n2 B\n3 C")).alias("text"))
    small = spark.range(1, 4001).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit(1).alias("page_no"), F.lit(f"{extract.TITLES['ingressante']}\n1 A\n2 B").alias("text"))
    pages = big.union(small)
    rows = extract.with_context(pages, extract.detect_kind(pages))
    own = rows.where("doc_id = 'big'")
    assert own.count() == 3 + 1999 * 3 and own.where("page_no > 1 AND context.year = 2019 AND context.course = 'X'").count() == 1999 * 3
    assert shares(own)[0] < 0.25 and shares(rows)[0] < 0.2


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_titles_over_the_ends_of_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(extract, "PAGES", size)
    title = extract.TITLES["concluinte"].split()
    texts = {"spread": ["x"] * 35 + [w for word in title for w in (word, "")] + ["y"] * 4, "cut": ["x", *title[:2], "z", *title[2:]], "far": ["a"] * 9 + [" ".join(title)]}
    rows = [(d, n, t) for d, pages in texts.items() for n, t in enumerate(pages, 1)]
    got = {r.doc_id: r.kind for r in extract.detect_kind(spark.createDataFrame(rows, "doc_id string, page_no int, text string").repartition(4)).collect()}
    assert got == {"spread": "concluinte", "cut": None, "far": "concluinte"}


# --- names and stores


def test_candidate_lists_of_a_shared_name_are_linear(spark, as_dealt):
    n = 50_000
    who = F.when(F.col("id") % 2 == 0, "ingressante").otherwise("concluinte")
    rows = spark.range(2 * n).select(F.col("id").alias("record_id"), who.alias("tipo_registro"), F.lit("X").alias("curso_normalizado"), F.when(F.col("id") < 20, F.lit("B")).otherwise(F.lit("A")).alias("nome_chave"), (4000 + F.col("id") % 10).cast("int").alias("period_idx"))
    index = cohorts.candidate_index(rows)
    assert index.entrants.count() == n and index.graduates.agg(F.sum(F.size("ids"))).first()[0] == n
    assert shares(index.entrants)[0] < 0.2
    counts = {(r.p, r.n) for r in index.entrants.where("entrant_id >= 20").select((F.col("entrant_id") % 10).alias("p"), "n").distinct().collect()}
    per = (n * 2 - 20) // 10
    assert counts == {(p, per * len([q for q in range(1, 10, 2) if q > p])) for p in range(0, 10, 2)}
    page = cohorts.candidate_pages(index, 100, page=3).where("entrant_id = 20").first().candidate_ids
    later = sorted((4000 + k % 10, k) for k in range(21, 2 * n, 2))
    assert page == [k for _, k in later[300:400]]
    few = rows.where("nome_chave = 'B'")
    got = {r.entrant_id: r.candidate_ids for r in cohorts.candidate_lists(cohorts.candidate_pages(cohorts.candidate_index(few), 3)).collect()}
    assert got == {e: ";".join(map(str, [g for g in range(1, 20, 2) if g % 10 > e % 10])) for e in range(0, 20, 2) if e % 10 < 9}


def test_candidates_of_negative_ids_stand_in_order(spark):
    rows = spark.createDataFrame([(1, "ingressante", "X", "A", 1), *[(k, "concluinte", "X", "A", 2) for k in (-30, -4, -1, 0, 5)]], "record_id long, tipo_registro string, curso_normalizado string, nome_chave string, period_idx int")
    assert cohorts.candidate_pages(cohorts.candidate_index(rows)).first().candidate_ids == [-30, -4, -1, 0, 5]


def test_a_key_is_made_once_however_many_ranges(spark):
    """Ranges are found by halving: 64 times as many of them must not take many times as long."""
    rows = spark.range(0, 60_000, 1, 4).select(F.concat_ws("-", F.lit("key"), F.format_string("%020d", "id")).alias("key"))

    def seconds(ranges):
        head = inference._range_head(rows, "key", ranges)
        began = time.perf_counter()
        found = rows.groupBy(head.alias("head")).count().collect()
        assert {r.head for r in found} == set(range(ranges))
        return time.perf_counter() - began

    seconds(16)
    assert seconds(1024) < 3 + 5 * seconds(16)


@pytest.mark.parametrize("bounds", [[0], [0, 1], [-5, 0, 3], list(range(0, 70, 7)), list(range(64))])
def test_every_range_is_found(spark, bounds):
    got = spark.range(-10, 80).select("id", inference._found(F.col("id"), bounds).alias("head")).collect()
    assert all(r.head == sum(b <= r.id for b in bounds) for r in got)


def test_numbers_do_not_depend_on_the_plan(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(0, 100_000, 1, 7).select((F.col("id") * 7919 % 100_003).alias("key"), F.lit(1).alias("head"), F.lit(2).alias("within"), F.lit(3).alias("before"))
        got = inference.numbered(rows, "key", 11)
        assert got.columns == ["key", "head", "within", "before", "nth"] and got.where("head <> 1 OR within <> 2 OR before <> 3").isEmpty()
        pairs = got.orderBy("key").select("key", "nth").collect()
        assert [r.nth for r in pairs] == list(range(100_000))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_two_writers_have_one_order(spark, tmp_path):
    root, done = f"file://{tmp_path}/log", []

    def write(k):
        for n in range(4):
            done.append((commits.commit(spark, root, lambda before: {"version": f"v{k}-{n}", "sum": (before or {"sum": 0})["sum"] + 1}, keep=100)))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    log = commits.history(spark, root)
    assert sorted(done) == [n for n, _ in log] == list(range(12)) and [e["sum"] for _, e in log] == list(range(1, 13))


def test_old_versions_and_failed_attempts_go(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    for k in range(4):
        spark.range(k + 1).write.parquet(f"{root}/v{k}")
        commits.commit(spark, root, {"version": f"v{k}"})
    spark.range(1).write.parquet(f"{root}/attempt")
    assert commits.versions(spark, root) == ["attempt", "v2", "v3"] and [n for n, _ in commits.history(spark, root)] == [2, 3]
    assert commits.clean(spark, root, stale=0) == ["attempt"] and commits.latest(spark, root) == {"version": "v3"}


def test_the_prediction_table_touches_its_own_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/predictions"
    row = lambda name, p, at: (name, "BR", "full", None if p is None else "female", p, 1, at)
    frame = lambda rows: spark.createDataFrame(rows, "name string, country_id string, name_mode string, gender string, probability double, count long, queried_at string")
    assert predictions.load(spark, root).count() == 0
    names = spark.createDataFrame([(f"N{k}",) for k in range(300)], "query_name string")
    assert predictions.missing(spark, root, names).count() == 300
    predictions.save(spark, root, frame([row(f"N{k}", None if k % 5 == 0 else 0.9, "1") for k in range(250)]), buckets=16)
    before = commits.latest(spark, root)["folders"]
    touched = predictions.save(spark, root, frame([row("N1", 0.6, "2"), row("N2", 0.7, "0"), row("new", 0.8, "2")]))
    after = commits.latest(spark, root)["folders"]
    assert touched <= 3 and sum(before[b] != after[b] for b in before) == touched
    stored = {r.name: r.probability for r in predictions.load(spark, root).collect()}
    assert len(stored) == 251 and (stored["N1"], stored["N2"], stored["new"], stored["N5"]) == (0.6, 0.9, 0.8, None)
    left = predictions.missing(spark, root, names)
    assert sorted(r.name for r in left.collect()) == sorted(f"N{k}" for k in range(250, 300))
    assert predictions.missing(spark, root, names, country="US").count() == 300
    with pytest.raises(Exception, match="without a key"):
        predictions.save(spark, root, frame([row(None, 0.5, "3")]))


def test_spread_joins_give_what_joins_give(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(999, None)], "id long, key string").withColumn("part", F.lit("own"))
    one = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "key string, value int")
    for how in ("left", "inner"):
        got, want = shared.spread_join(rows, one, ["key"], ["id"], how), rows.join(one, "key", how)
        assert sorted(map(tuple, got.select("id", "key", "part", "value").collect()), key=str) == sorted(map(tuple, want.select("id", "key", "part", "value").collect()), key=str)
