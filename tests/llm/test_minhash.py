import random
import re

import numpy as np
import pytest

from rollbook.llm import minhash


def shingles(text, width):
    """Written anew: words between the six blanks, A-Z in lower case."""
    words = [w for w in re.split("[ \t\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width=2, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) > 0 and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(n, edits, seed=0):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(4000)}" for _ in range(150)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = rng.choice(["the", "of", f"v{rng.randrange(300)}"])
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("edits", [6, 14, 22])
def test_large_group_of_near_copies(spark, edits):
    rows = near_copies(160, edits) + [(1000 + i, t) for i, t in near_copies(20, 9, 5)]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert found(minhash.op3_minhash(spark, small)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, odd_rows):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i and by_id[i].kept for i in (0, 1, 2))
    assert by_id[3].n_shingles == 1 and by_id[5].component_id == 4 and not by_id[5].kept and by_id[11].component_id == 10
    assert not by_id[None].kept


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_signature_agrees_with_the_definition():
    hashes = np.unique(np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64))
    ring = np.random.default_rng(1).permutation(minhash.PLACES)
    with np.errstate(over="ignore"):
        place = ((hashes * np.uint64(2862933555777941757) + np.uint64(3037000493)) >> np.uint64(44)).astype(np.int64) & (minhash.PLACES - 1)
    want = [ring[(place + k) % minhash.PLACES].min() for k in range(minhash.BANDS * minhash.ROWS)]
    assert minhash.signature(hashes).tolist() == want


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_two_families_that_share_bands_make_few_pairs(spark, monkeypatch):
    """Half-similar families: what is compared must not grow with the product of their sizes."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(110)]
    rows = []
    for family in range(2):
        own = [f"f{family}x{k}" for k in range(16)]
        for i in range(150):
            words = own + common
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
            rows.append((family * 1000 + i, " ".join(words)))
    seen = []
    likely = minhash.likely
    monkeypatch.setattr(minhash, "likely", lambda pairs, *more: (seen.append(pairs.count()), likely(pairs, *more))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df)) == brute(rows)
    assert seen[-1] < 20 * len(rows)


@pytest.mark.parametrize("width", [2, 5])
def test_chunks_of_fewer_words_than_a_shingle(width):
    for texts in ([b""], [b"one"], [b"a b"], [b"a few words", b""], [b"one two three four"], [b"a", b"b"]):
        got = list(minhash.shingle_sets(texts, width))
        assert [len(x) for x in got] == [max(1, n - width + 1) if (n := len(t.split())) else 0 for t in texts]
