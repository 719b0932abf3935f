"""URL filters, the Merkle manifest and the filter audit against plain versions and their SQL."""

import hashlib
import re
import zlib
from itertools import permutations

import duckdb
import pytest

from rollbook.llm import filter_audit, merkle, url_filter


def same(got, want):
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got) == key(want)


@pytest.mark.parametrize("module, name", [(url_filter, "op11_url_filter"), (merkle, "op12_merkle"), (filter_audit, "op13_filter_audit")])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, module, name, sf):
    c = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got, want = getattr(module, name)(spark, f"/root/testdata/{sf}").toPandas(), c.execute(module.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    same(got[sorted(got.columns)].astype(object).where(got.notna(), None).values, want[sorted(want.columns)].astype(object).where(want.notna(), None).values)


# --- URLs

URLS = [
    None, "", "no scheme/en/", "http://", "https:///en/1", "http://A.Com/x", "http://a.com", "http://com/", "https://example.com/en/1", "https://m.Example.com/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en/1",
    "https://notexample.com/en/1", "http://b.net/es/2?x=1", "http://b.net/de/2", "http://net/fr/", "http://b.org/p.html?utm_source=q&b=2&a=1#top", "https://www.b.org:443/p/?a=1&b=2&ref=z", "http://b.org/p?a=1", "ftp://c.org/x://y.net/es/",
    "http://d.org/" + "x" * 20_000, "http://ÄB.org/q", "http://e.org#a?b=1", "http://e.org?b=1#c", "http://e.org/\nen/",
]
LISTED = ["http://m.b.org/p?b=2&a=1", "HTTP://D.ORG/" + "x" * 20_000 + "/", None, "no url", "http://e.org?b=1", "http://e.org?b=1", "https://example.com/en/1"]


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2], m[3] or "") if m else ("", "", "")


def plain_form(url):
    host, path, query = parts(url)
    host = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", host))
    kept = sorted(p for p in query[1:].split("&") if p and not re.match(r"(utm_[^=]*|ref)(=|$)", p))
    return host + re.sub(r"(/|\.html)$", "", path) + ("?" + "&".join(kept) if kept else "") if host else None


def plain_verdict(url, listed):
    host, path, _ = parts(url)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    return host, path, None, "block" if plain_form(url) in {plain_form(x) for x in listed} - {None} else "allow"


@pytest.mark.parametrize("blocks", [1, url_filter.MAX_BLOCKS])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", blocks)  # one block: the filter lets nearly all pass, the join decides
    listed = LISTED + [f"http://other.org/{k}" for k in range(800)]
    schema = "page_id long, url string, host string, key_ string, block long, w0 int, known_ int"
    rows = [(i, u, "x", "k", 1, 1, 1) for i, u in enumerate(URLS)] + [(3, URLS[16], "x", "k", 1, 1, 1)] * 300 + [(None, URLS[16], None, None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = url_filter.judged(pages, spark.createDataFrame([(u,) for u in listed], "url string"))
    same(got.select("page_id", "url", "host", "path", "rule", "verdict").collect(), [(r[0], r[1], *plain_verdict(r[1], listed)) for r in rows])
    assert {"key_", "block", "w0", "known_"} <= set(got.columns)


def test_no_urls(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://casino.org/")], "page_id long, url string")
    assert url_filter.judged(none, some).collect() == []
    assert [r.verdict for r in url_filter.judged(some, none).collect()] == ["allow"]
    assert [r.verdict for r in url_filter.judged(some, some).collect()] == ["block"]


def test_of_equally_long_rules_the_first_wins(spark):
    row = spark.createDataFrame([("http://a.org/x",)], "url string")
    for rules, verdict in (([("block", "org", "/x"), ("allow", "a.org", "/")], "allow"), ([("allow", "org", "/x"), ("block", "org", "/x")], "allow"), ([("block", "org", "/x"), ("allow", "org", "/x")], "block")):
        assert url_filter.judged(row, row.where("false"), rules=rules).first().verdict == verdict


def test_the_filter_has_all_its_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    made, n = url_filter.bloom(keys, "key", 5000)
    others = spark.range(5000, 25_000).select(F.concat(F.lit("k"), "id").alias("key"))

    def hits(df):
        where, bits = url_filter.places(F.col("key"), n)
        held = df.withColumn("block", where).join(made, "block")
        for k, bit in enumerate(bits):
            held = held.where(F.col(f"w{k}").bitwiseAND(bit) != 0)
        return held.count()

    assert hits(keys) == 5000 and hits(others) < 20_000 * 0.02


# --- the manifest


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def plain_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(digests, fanout):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def plain_steps(levels, place, fanout):
    out = []
    for level in levels[:-1]:
        first = place - place % fanout
        out.append(("".join(level[first:place]), "".join(level[place + 1:first + fanout])))
        place //= fanout
    return out


def plain_manifest(rows, fanout=2, each=7):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, order = {}, {}
    for g in names:
        order[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in order[g]], fanout)
    top = plain_tree([trees[g][-1][0] for g in names], fanout)
    for seat, g in enumerate(names):
        for place, r in enumerate(order[g]):
            steps = plain_steps(trees[g], place, fanout) + plain_steps(top, seat, fanout)
            changed = list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % each == 0:
                changed[3] += 1
            acc = plain_leaf(changed)
            for left, right in steps:
                acc = h(left, acc, right)
            yield r[0], plain_leaf(r), trees[g][-1][0], top[-1][0], h(*[a + b for a, b in steps]), acc, acc == top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, place long, size long, digest string, rank long"
WIDE = [(k * 37 % 1009, f"s{k % 3}", ["en", "é", "", None, "zz"][min(k % 9, 4)], None if k % 11 == 0 else k, "t" * (k % 5)) for k in range(700)]
ODD = [(None, None, None, None, None)] * 3 + [(None, "a", "en", 5, "x"), (-5, "a", "en", 5, "é\n😀"), (-(1 << 63), "", "en", -1, ""), ((1 << 63) - 1, "a", "en", 0, "y" * 100_000), (7, "a", "lone", 1, "z")] + [(42, "a", "en", 5, "copy")] * 9 + [(42, "b", "en", 5, "copy"), (42, "a", "en", 6, "copy")]


@pytest.mark.parametrize("fanout, pack", [(2, 256), (2, 4), (3, 9), (5, 5)])
def test_manifest(spark, monkeypatch, fanout, pack):
    monkeypatch.setattr(merkle, "PACK", pack)
    monkeypatch.setattr(merkle, "RUN", 4)
    monkeypatch.setattr(merkle, "BUCKET", 5 if pack < 256 else 100_000)
    rows = WIDE + ODD
    docs = spark.createDataFrame([(*r, "g", 1, 2, "d", 3) for r in rows], SCHEMA)
    same(merkle.manifest(docs, fanout).collect(), plain_manifest(rows, fanout))


@pytest.mark.parametrize("rows", [[], WIDE[:1], ODD[:3]])
def test_small_manifests(spark, rows):
    docs = spark.createDataFrame([(*r, "g", 1, 2, "d", 3) for r in rows], SCHEMA)
    same(merkle.manifest(docs).collect(), plain_manifest(rows))


def test_ranks_of_sparse_keys(spark):
    keys = [None, *[(k * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(500)]]
    rows = [("g" if (k or 0) % 3 else "h", k, h(str(k)), 1 + (k or 0) % 4) for k in keys]
    got = {(r.grp, r.key): (r.rank, r.size) for r in merkle.ranked(spark.createDataFrame(rows, "grp string, key long, tie string, n long"), "grp", "key", "tie").collect()}
    for grp in "gh":
        own, at = sorted((r for r in rows if r[0] == grp), key=lambda r: (r[1] is not None, r[1] or 0)), 0
        for r in own:
            assert got[grp, r[1]] == (at, sum(x[3] for x in own))
            at += r[3]


# --- the audit


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang), labels: (doc_id, quality, toxic)"""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failed.append((lang or "", i, {k for k, v in fails.items() if v}))
    for part in {p for p, *_ in failed}:
        own, rows, taken = [x for x in failed if x[0] == part], [], {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                rest = [x for x in left if f not in x[2]]
                redundant = sum(f in x[2] for x in own) - len(gone)
                rows.append((part, "".join(order), step, len(rest), len(gone), redundant, sum(x[2] == {f} for x in own), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone), f))
                taken[f] = taken.get(f, 0) + len(gone)
                left = rest
        yield from [(*r[:9], taken[r[9]]) for r in rows]


def test_audit(spark, odd, odd_rows):
    more = [(50 + k % 7, "Shouted WORDS # " * (k % 40), ["en", "de", ""][k % 3]) for k in range(60)] + [(None, "same", "en")] * 3 + [(9, "same", "en")] * 2 + [(8, "same", None), (10, "same", "de")]
    labels = [(3, 1, 0), (3, 0, 1), (9, 1, 1), (50, 1, None), (51, None, 1), (None, 1, 1), (777, 1, 1)]
    docs = [(r[0], r[1], r[2]) for r in odd_rows] + more
    frame = odd.select("doc_id", "text", "lang", "n_chars").union(spark.createDataFrame([(*r, 0) for r in more], "doc_id long, text string, lang string, n_chars long"))
    got = filter_audit.audit(frame.withColumnsRenamed({"n_chars": "mask"}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    same(got, plain_audit(docs, labels))


def test_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).collect() == []


def test_the_matrices_add_up():
    m = filter_audit.matrices()
    assert all(x.shape == (32, 600) for x in m.values())
    for mask in range(32):
        for k in range(0, 600, 5):  # a document is removed once or kept to the end
            assert m["removed"][mask, k:k + 5].sum() + m["kept"][mask, k + 4] == 1
            assert (m["removed"] + m["redundant"])[mask, k:k + 5].sum() == bin(mask).count("1")
