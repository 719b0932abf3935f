"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.hashed import Adam, byte_class, chunks, mixed, sigmoid, words_of
from rollbook.llm.toxicity import sampled

#: Words of a passage; passages do not overlap.
PASSAGE = 64
#: Sizes of a passage's code and of the attention.
CODE, ATTEND = 12, 8
#: The fit takes at most so many labelled documents of each class (those with the least hash of the id), each whole.
FIT_GOOD, FIT_BAD = 3_000, 1_500
EPOCHS = 60
CHUNK = 1 << 22

#: Classes of bytes whose shares a passage's measures hold. Fixed values.
CLASSES = (
    byte_class(range(65, 91)), byte_class(range(97, 123)), byte_class(range(48, 58)), byte_class(b"#*$%&|<>"), byte_class(b"|"), byte_class(b"!"),
    byte_class(b".,;:?"), byte_class(b"{}[]()=_/\\@~^+"), byte_class(range(128, 256)),
)
N_MEASURES = len(CLASSES) + 9


def _bytes(texts: Iterable) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _seen_before(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an equal key came earlier in the same group."""
    key = mixed(keys + mixed(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage of every text, and the number of passages of each text.

    Shares of the byte classes among the bytes of the words; mean word length, share of long and of one-letter words,
    words equal to the one before, words seen earlier in the passage, three-word windows seen earlier in the text, lines per
    word, length of the passage and of the text. A text without words has one passage of zeros.
    """
    words = words_of(texts)
    n_passages = np.maximum(1, -(-words.counts // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    out = np.zeros((n_passages.sum(), N_MEASURES), np.float32)
    if not len(words.start):
        return out, n_passages
    doc = np.repeat(np.arange(len(texts)), words.counts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(words.counts) - words.counts, words.counts)
    passage = first[doc] + within // PASSAGE
    lead = np.flatnonzero(np.diff(passage, prepend=-1))
    which, n = passage[lead], np.diff(np.append(lead, len(passage)))
    tail = lead + n - 1
    a, b = words.start[lead], words.end[tail]
    length = (words.end - words.start).astype(np.float32)
    size = np.add.reduceat(length, lead)
    for k, members in enumerate(CLASSES):
        total = np.concatenate(([0], np.cumsum(members[words.data], dtype=np.int32)))
        out[which, k] = (total[b] - total[a]) / size
    share = lambda on: np.add.reduceat(on.astype(np.float32), lead) / n
    lines = np.concatenate(([0], np.cumsum(words.data == 10, dtype=np.int32)))
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (within[1:] > 0)
    three = words.hash.copy()
    with np.errstate(over="ignore"):
        three[2:] = mixed(words.hash[2:] + mixed(words.hash[1:-1] + mixed(words.hash[:-2])))
    again = _seen_before(three, doc) & (within >= 2)
    more = (
        size / n / 10, share(length > 20), share(length == 1), share(same), share(_seen_before(words.hash, passage)), share(again),
        (lines[b] - lines[a]) / n, np.log1p(n) / 4, np.log1p(words.counts[doc[lead]]) / 8,
    )
    for k, values in enumerate(more):
        out[which, len(CLASSES) + k] = values
    return out, n_passages


def _scored(params: dict, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logit of each bag of passages: gated attention weights add up the passages' codes."""
    lead = np.cumsum(counts) - counts
    code = np.tanh(x @ params["code"] + params["code_b"])
    look, gate = np.tanh(code @ params["look"]), sigmoid(code @ params["gate"])
    raw = (look * gate) @ params["pick"]
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, lead), counts))
    weight = raw / np.repeat(np.add.reduceat(raw, lead), counts)
    bag = np.add.reduceat(weight[:, None] * code, lead, axis=0)
    return bag @ params["out"] + params["out_b"], {"code": code, "look": look, "gate": gate, "weight": weight, "bag": bag, "lead": lead}


def _gradients(params: dict, x: np.ndarray, counts: np.ndarray, kept: dict, d_logit: np.ndarray) -> dict:
    code, look, gate, weight = (kept[k] for k in ("code", "look", "gate", "weight"))
    grads = {"out": kept["bag"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_bag = np.repeat(d_logit[:, None] * params["out"], counts, axis=0)
    d_weight = (d_bag * code).sum(axis=1)
    d_raw = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, kept["lead"]), counts))
    grads["pick"] = (look * gate).T @ d_raw
    d_both = d_raw[:, None] * params["pick"]
    d_look, d_gate = d_both * gate * (1 - look * look), d_both * look * gate * (1 - gate)
    grads |= {"look": code.T @ d_look, "gate": code.T @ d_gate}
    d_code = (weight[:, None] * d_bag + d_look @ params["look"].T + d_gate @ params["gate"].T) * (1 - code * code)
    return grads | {"code": x.T @ d_code, "code_b": d_code.sum(axis=0)}


def _spans(counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Rows of the chosen bags, one after the other."""
    n = counts[which]
    return np.repeat((np.cumsum(counts) - counts)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 0) -> dict:
    """Learn from bags of passages and the labels of their documents. With labels of one class, or none, the score is
    the share of good documents everywhere."""
    rng = np.random.default_rng(seed)
    some = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    params = {"code": some(N_MEASURES, CODE), "code_b": np.zeros(CODE, np.float32), "look": some(CODE, ATTEND), "gate": some(CODE, ATTEND), "pick": some(ATTEND), "out": some(CODE), "out_b": np.array([np.log(share / (1 - share))], np.float32)}
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(N_MEASURES), np.ones(N_MEASURES))
    model = {**params, "mean": mean.astype(np.float32), "spread": spread.astype(np.float32)}
    if not 0 < labels.sum() < len(labels):
        params["out"][:] = 0
        return model
    x, adam = scaled(model, x), Adam(params, 0.01, 1e-3)
    for epoch in range(EPOCHS):
        adam.rate = 0.01 if epoch < EPOCHS * 2 // 3 else 0.002
        order = rng.permutation(len(labels))
        for a in range(0, len(order), 128):
            which = order[a : a + 128]
            rows = x[_spans(counts, which)]
            logit, kept = _scored(params, rows, counts[which])
            adam.step(_gradients(params, rows, counts[which], kept, ((sigmoid(logit) - labels[which]) / len(which)).astype(np.float32)))
    return model


def scaled(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["spread"], -8, 8)


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    x, counts = passages(texts)
    return sigmoid(_scored(model, scaled(model, x), counts)[0].astype(np.float64))


def training_bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bags = []
    for a, b in chunks(texts, CHUNK):
        x, counts = passages(texts[a:b])
        bags.append((x, counts))
    return np.concatenate([np.zeros((0, N_MEASURES), np.float32), *(x for x, _ in bags)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in bags)])


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; held_out: crc32 of the id as text mod folds = held.

    Learns from labels of rows that aren't held out alone (see ``sampled``), all passages of each. Null and empty texts are one
    passage of zeros and get its score. A null id is not held out. Repeated rows get the same score. Without labels all
    scores are one half. A very long text is worked on by itself, all its passages in numpy arrays. Other columns of
    ``docs``, whatever their names, play no part. An empty table gives an empty one.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % folds
    few = sampled(docs, labels, doc_id, text, label, fold("__id") != held, {1: FIT_GOOD, 0: FIT_BAD})
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_bags(_bytes(few["text"])), few["label"].to_numpy(np.float64)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _bytes(batch["text"])
            for a, b in chunks(texts, CHUNK):
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[a:b], "held_out": batch["held_out"].to_numpy()[a:b], "score": scores(model.value, texts[a:b])})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInPandas(each, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op2_quality_mil(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
