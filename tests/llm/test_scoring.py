import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import quality_mil, toxicity
from rollbook.llm.hashed import words_of

FULL = "/root/testdata/sf0.1"


def numeric(loss, params, names, eps=1e-3):
    out = {}
    for k in names:
        g = np.zeros_like(params[k], np.float64)
        for i in np.ndindex(params[k].shape):
            was = params[k][i]
            params[k][i] = was + eps
            up = loss()
            params[k][i] = was - eps
            g[i] = (up - loss()) / (2 * eps)
            params[k][i] = was
        out[k] = g
    return out


def test_gradients_of_the_attention_classifier():
    rng = np.random.default_rng(0)
    x, counts, y = rng.standard_normal((9, quality_mil.N_MEASURES)), np.array([4, 2, 3]), np.array([1.0, 0.0, 1.0])
    params = {k: v.astype(np.float64) for k, v in quality_mil.fit(x.astype(np.float32), counts, np.ones(3)).items() if k not in ("mean", "spread")}
    params["out"] = rng.standard_normal(quality_mil.CODE)

    def loss():
        z = quality_mil._scored(params, x, counts)[0]
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, kept = quality_mil._scored(params, x, counts)
    grads = quality_mil._gradients(params, x, counts, kept, quality_mil.sigmoid(z) - y)
    for k, want in numeric(loss, params, ["look", "gate", "pick", "out", "code_b"]).items():
        assert np.allclose(grads[k], want, atol=1e-4), k


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    s, n = toxicity.STATE, 3
    params = {f"u_{d}": rng.standard_normal((s, 3 * s)) * 0.3 for d in "fb"} | {"attend": rng.standard_normal((2 * s, s)) * 0.3, "attend_b": rng.standard_normal(s), "pick": rng.standard_normal(s), "out": rng.standard_normal(2 * s), "out_b": np.zeros(1)}
    gates = {d: rng.standard_normal((40, 3 * s)) for d in "fb"}
    at, on, y = rng.integers(0, 40, (n, toxicity.WINDOW)), np.arange(toxicity.WINDOW) < np.array([[toxicity.WINDOW], [5], [1]]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = toxicity.forward(params, gates, at, on)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    kept = {}
    z = toxicity.forward(params, gates, at, on, kept)
    grads, _ = toxicity.backward(params, kept, on, toxicity.sigmoid(z) - y)
    for k, want in numeric(loss, params, ["u_f", "u_b", "attend", "pick", "out"]).items():
        assert np.allclose(grads[k], want, atol=2e-2, rtol=5e-2), k


def test_a_window_starts_at_every_word():
    counts = np.array([0, 1, toxicity.WINDOW - 1, toxicity.WINDOW, toxicity.WINDOW + 1, 48, 1000])
    every = toxicity.Windows(counts)
    first, size, text = every.at(np.arange(len(every)))
    begin = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        starts = (first[text == k] - begin[k]).tolist()
        assert starts == list(range(max(1, n - toxicity.WINDOW + 1))) and set(size[text == k]) == {min(n, toxicity.WINDOW)}


def plain_logit(model, words):
    """The network of one window, word by word, from its formulas."""
    inputs = []
    for w in words:
        core = w
        while core and toxicity.NO_LETTER[core[0]]:
            core = core[1:]
        while core and toxicity.NO_LETTER[core[-1]]:
            core = core[:-1]
        key = words_of([core]).hash[0] if core else None
        at = np.flatnonzero(model["vocabulary"] == key) if core else []
        word = model["words"][at[0]] * model["trust"][at[0]] if len(at) else np.zeros(toxicity.WORD_DIM)
        one = words_of([w])
        grams = model["grams"][toxicity.gram_places(one, np.array([0]))[0]].mean(axis=0)
        inputs.append(np.concatenate((word, grams)).astype(np.float64))
    sig, s = lambda x: 1 / (1 + np.exp(-x)), toxicity.STATE
    both = []
    for side in "fb":
        h, out = np.zeros(s), []
        for x in inputs if side == "f" else inputs[::-1]:
            gate, pre = x @ model[f"w_{side}"] + model[f"b_{side}"], h @ model[f"u_{side}"]
            r, z = sig(gate[:s] + pre[:s]), sig(gate[s:2 * s] + pre[s:2 * s])
            h = (1 - z) * np.tanh(gate[2 * s:] + r * pre[2 * s:]) + z * h
            out.append(h)
        both.append(out if side == "f" else out[::-1])
    if not words:
        return float(model["out_b"][0])
    states = [np.concatenate(x) for x in zip(*both)]
    pull = np.array([np.tanh(x @ model["attend"] + model["attend_b"]) @ model["pick"] for x in states])
    weight = np.exp(pull - pull.max()) / np.exp(pull - pull.max()).sum()
    return sum(w * x for w, x in zip(weight, states)) @ model["out"] + model["out_b"][0]


def test_scores_against_a_plain_network():
    rng = np.random.default_rng(2)
    words = [b"alpha", b"be,", b"(gamma)", "d\u00e9lta!".encode(), b"om3ga", b"x", b"123", b"--", b"longerword", b"alpha."]
    texts = [b" ".join(rng.choice(words, n)) for n in (0, 1, 5, 11, 12, 13, 40, 200)]
    model = toxicity.fit(texts, np.array([0.0, 1, 0, 1, 0, 1, 0, 1]))
    for text, score in zip(texts, toxicity.scores(model, texts)):
        own = text.split()
        logits = [plain_logit(model, own[a:a + toxicity.WINDOW]) for a in range(max(1, len(own) - toxicity.WINDOW + 1))]
        assert np.isclose(score, 1 / (1 + np.exp(-max(logits))), atol=1e-4)


def test_windows_in_rows_against_windows_in_columns():
    """The same logits as ``forward`` gives, for inputs from none to such as take every function to its ends."""
    rng, n, s = np.random.default_rng(4), 300, toxicity.STATE
    some = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    params = {"u_f": some(s, 3 * s), "u_b": some(s, 3 * s), "attend": some(2 * s, s), "attend_b": some(s), "pick": some(s), "out": some(2 * s), "out_b": some(1)}
    at, on = np.arange(n)[:, None] + np.arange(toxicity.WINDOW), np.ones((n, toxicity.WINDOW), bool)
    for scale in (0, 1, 30, 1000):
        gates = {side: some(n + toxicity.WINDOW - 1, 3 * s) * np.float32(scale) for side in "fb"}
        got = toxicity._logits(params, {side: np.ascontiguousarray(x.T) for side, x in gates.items()}, n)
        assert np.allclose(got, toxicity.forward(params, gates, at, on), atol=1e-4)


def test_the_model_holds_only_words_that_learn():
    texts = [f"common words here only{k}".encode() for k in range(20)] + [b"", b"12 !!"]
    model = toxicity.fit(texts, np.array([1.0, 0.0] * 11))
    assert sorted(model["vocabulary"]) == sorted({int(h) for h in toxicity.cores(words_of([b"common words here only"]))}) and len(model["words"]) == 4
    for few in ([], [b""], [b"one", b"two"], [b"12", b"!!"]):  # no word has a vector of its own
        model = toxicity.fit(few, np.array([1.0, 0.0][: len(few)]), 0.5)
        assert len(model["vocabulary"]) == 0 and np.isfinite(toxicity.scores(model, [b"one more", b"", b"12"])).all()


def test_only_attention_takes_exponentials(monkeypatch):
    """Gates are tanhs: a block has one exponential for each window and word, and no reciprocals."""
    rng, n, s = np.random.default_rng(5), 100, toxicity.STATE
    some = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    params = {"u_f": some(s, 3 * s), "u_b": some(s, 3 * s), "attend": some(2 * s, s), "attend_b": some(s), "pick": some(s), "out": some(2 * s), "out_b": some(1)}
    seen = {"exp": 0, "reciprocal": 0}

    class Counted:
        def __getattr__(self, name):
            if name in seen:
                return lambda x, *args, **more: (seen.__setitem__(name, seen[name] + x.size), getattr(np, name)(x, *args, **more))[1]
            return getattr(np, name)

    monkeypatch.setattr(toxicity, "np", Counted())
    toxicity._logits(params, {side: some(3 * s, n + toxicity.WINDOW - 1) for side in "fb"}, n)
    assert seen == {"exp": toxicity.WINDOW * n, "reciprocal": 0}


def test_each_start_is_a_task_of_its_own(spark, monkeypatch):
    """Two starts in one task take twice as long as two tasks."""
    import types

    few = spark.createDataFrame([(k, k % 2, f"text {k}") for k in range(4000)], "__id long, label int, text string").repartition(7)
    seen = {}

    def held(self, *keys):
        seen["tasks"] = sorted(r.n for r in self.groupBy(F.spark_partition_id()).agg(F.count_distinct("seed").alias("n")).collect())
        raise StopIteration

    frame = type(few)
    real = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *keys: held(types.SimpleNamespace(groupBy=lambda *k: real(self, *k)), *keys) if keys == ("seed",) else real(self, *keys))
    for _ in range(3):
        with pytest.raises(StopIteration):
            toxicity.fitted(few.withColumn("text", F.concat("text", F.lit(" x"))), 0.5)
        assert seen["tasks"] == [1] * toxicity.STARTS


def test_digits_and_symbols_reach_the_network():
    model = toxicity.fit([b"an 1d10t !!", b"a good day"] * 10, np.array([1.0, 0.0] * 10))
    a, b, c = toxicity.scores(model, [b"1d10t", b"day", b"!!"])
    assert len({round(float(x), 6) for x in (a, b, c)}) == 3 and a > b


def held_out(spark, query, label, folds, held):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{FULL}/labels.parquet").collect()}
    got = query(spark, FULL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    return [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_documents(spark):
    pairs = held_out(spark, quality_mil.op2_quality_mil, "quality", 5, 0)
    good, bad = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_toxicity_on_held_out_documents(spark):
    pairs = held_out(spark, toxicity.op10_toxicity, "toxic", 4, 2)
    bad, clean = [p for p, y in pairs if y == 1], [p for p, y in pairs if y == 0]
    assert sum(bad) >= 0.9 * len(bad) and sum(clean) <= 0.03 * len(clean)


@pytest.mark.parametrize("score", [quality_mil.score_documents, toxicity.score_documents])
def test_odd_rows(spark, odd, odd_rows, empty, score):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, 0), (10, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id in (4, 5)}
    assert len(same) == 1 and len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    assert not [r for r in got if r.doc_id is None][0].held_out
    assert score(empty, labels).collect() == []
    assert len({r.score for r in score(odd, labels.where("doc_id < 0")).collect()}) >= 1


def test_passages_are_measured_each_by_itself():
    rng = np.random.default_rng(1)
    text = b" ".join(rng.choice([b"Word", b"a", b"$12", b"long" * 6, b"line\nbreak"], 200))
    x, counts = quality_mil.passages([b"", text, b"one"])
    words = text.split()
    assert counts.tolist() == [1, -(-len(words) // quality_mil.PASSAGE), 1] and not x[0].any()
    for k in range(counts[1]):
        part = words[k * quality_mil.PASSAGE : (k + 1) * quality_mil.PASSAGE]
        whole = b"".join(part)
        assert np.isclose(x[1 + k, 0], sum(65 <= c <= 90 for c in whole) / len(whole)) and np.isclose(x[1 + k, 2], sum(48 <= c <= 57 for c in whole) / len(whole))
        base = len(quality_mil.CLASSES)
        assert np.isclose(x[1 + k, base + 1], np.mean([len(w) > 20 for w in part])) and np.isclose(x[1 + k, base + 2], np.mean([len(w) == 1 for w in part]))
        assert np.isclose(x[1 + k, base + 4], 1 - len(set(part)) / len(part))


def test_the_sample_has_one_row_for_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.sampled(docs, labels, "doc_id", "text", "toxic", F.lit(True), {1: 10, 0: 10})
    assert got[["text", "label"]].values.tolist() == [["text 0", 1], [None, 0]]
    few = toxicity.sampled(docs, labels, "doc_id", "text", "toxic", F.lit(True), {1: 10, 0: 10}, 6)
    assert few.equals(got) and not len(toxicity.sampled(docs, labels, "doc_id", "text", "toxic", F.lit(True), {1: 10, 0: 10}, 5))
