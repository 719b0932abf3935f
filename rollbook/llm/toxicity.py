"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.hashed import NO_LETTER, Adam, Words, chunks, mixed, sigmoid, words_of

#: Words of a window. A window starts at every word that has so many from it on.
WINDOW = 12
#: Sizes of the recurrent state, of the word and of the character inputs; places of the character n-grams.
STATE, WORD_DIM, CHAR_DIM, GRAMS = 8, 8, 8, 1 << 14
GRAM_SIZES = (3, 4, 5)
#: The fit takes at most so many labelled documents of each class (those with the least hash of the id), with all their
#: windows and words; and of those, in the order of the hash, as many as have so many bytes of text together.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1_500, 2_500, 64 << 20
#: A word has a vector of its own if so many further documents of the fit have it. What fewer say tells little about others;
#: such words, as those the fit has never met, come by their characters.
TRUST = 2
#: Passes, windows of a step, rates of the first and the second half, and starts of the fit, of which the one with the least loss is taken.
EPOCHS, STEP, RATES, STARTS = 6, 64, (0.003, 0.0012), 3
#: Bytes of text, windows, and words that are worked on together.
CHUNK, BLOCK, BATCH = 1 << 21, 4096, 16_384


def _bytes(texts: Iterable) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def windows(counts: np.ndarray) -> np.ndarray:
    """How many windows each text has: one at every word with WINDOW words from it on; a text of fewer words, or none, has one of all its words."""
    return 1 + np.maximum(0, counts - WINDOW)


class Windows:
    """All windows of some texts, by number, without a row for each."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.n = counts, windows(counts)
        self.ends, self.words = np.cumsum(self.n), np.cumsum(counts) - counts

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def at(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start (over all words), length and text of the windows of these numbers."""
        text = np.searchsorted(self.ends, which, "right")
        return self.words[text] + which - (self.ends[text] - self.n[text]), np.minimum(WINDOW, self.counts[text]), text


def cores(words: Words) -> np.ndarray:
    """The hash of each word without what stands before its first and after its last letter; 0 for a word without letters."""
    letters = np.flatnonzero(~NO_LETTER[words.data])
    low, high = np.searchsorted(letters, words.start), np.searchsorted(letters, words.end)
    letters, has = np.append(letters, 0), high > low
    return np.where(has, words.span_hash(np.where(has, letters[low], words.start), np.where(has, letters[np.maximum(high, 1) - 1] + 1, words.start)), np.uint64(0))


def gram_places(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the character n-grams of the chosen words, one after the other, and how many each word has.

    N-grams of bytes; those at a word's start or end differ from those inside. A word shorter than the least size
    has one, the word.
    """
    start, end = words.start[which], words.end[which]
    places, owner = [], []
    for size in GRAM_SIZES:
        n = np.maximum(0, end - start - size + 1)
        if size == GRAM_SIZES[0]:
            n = np.maximum(n, 1)
        who = np.repeat(np.arange(len(which)), n)
        a = start[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        b = np.minimum(a + size, end[who])
        edge = (a == start[who]).astype(np.uint64) + np.uint64(2) * (b == end[who]).astype(np.uint64)
        places.append((mixed(words.span_hash(a, b) + edge) & np.uint64(GRAMS - 1)).astype(np.int32))
        owner.append(who)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order], np.bincount(owner, minlength=len(which))


class Inputs:
    """The distinct words of some texts: the place of their letters in the vocabulary (-1: none) and the n-grams of all their characters."""

    def __init__(self, words: Words, vocabulary: np.ndarray):
        _, first, self.of_word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.known = _found(vocabulary, cores(words)[first])
        self.grams, self.n_grams = gram_places(words, first)

    def embedded(self, params: dict) -> np.ndarray:
        ends = np.cumsum(self.n_grams)
        out = np.zeros((len(self.known), WORD_DIM + CHAR_DIM), np.float32)
        for a in range(0, len(out), BATCH):
            n = self.n_grams[a : a + BATCH]
            first = ends[a] - n[0]
            own = params["grams"][self.grams[first : first + n.sum()]]
            out[a : a + BATCH, WORD_DIM:] = np.add.reduceat(own, np.cumsum(n) - n, axis=0) / n[:, None]
            known = self.known[a : a + BATCH]
            out[a : a + BATCH, :WORD_DIM] = params["words"][known] * np.where(known >= 0, params["trust"][known], 0)[:, None]
        return out


def _found(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted vocabulary; -1 where it has none."""
    if not len(vocabulary):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where((vocabulary[at] == hashes) & (hashes != 0), at, -1)


class Lesson(Inputs):
    """What the fit keeps of its documents: the place of each word among the distinct ones, how many each text has, and
    the vocabulary. Windows are laid out a block at a time (``placed``)."""

    def __init__(self, texts: list[bytes], labels: np.ndarray):
        parts, counts, seen, flags = [], [], [], []
        for a, b in chunks(texts, CHUNK):
            words = words_of(texts[a:b])
            core = cores(words)
            pairs = np.unique(np.stack((core, np.repeat(np.arange(a, b), words.counts).astype(np.uint64))), axis=1)
            pairs = pairs[:, pairs[0] != 0]
            seen.append(pairs[0])
            flags.append(labels[pairs[1].astype(np.int64)])
            counts.append(words.counts)
            distinct, first, of_word = np.unique(words.hash, return_index=True, return_inverse=True)
            parts.append((of_word.astype(np.int32), distinct, core[first], *gram_places(words, first)))
        joined = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.windows = Windows(np.concatenate(counts) if counts else np.zeros(0, np.int64))
        all_words, first = np.unique(joined(1), return_index=True)
        n_grams = joined(4).astype(np.int64)
        self.grams, self.n_grams = _picked(joined(3), n_grams, first), n_grams[first]
        self.of_word = np.concatenate([np.searchsorted(all_words, p[1]).astype(np.int32)[p[0]] for p in parts]) if parts else np.zeros(0, np.int32)
        seen, flags = (np.concatenate(x) if x else np.zeros(0) for x in (seen, flags))
        words, place, n_docs = np.unique(seen, return_inverse=True, return_counts=True)
        toxic = np.bincount(place, flags, len(words)) if len(words) else np.zeros(0)
        self.vocabulary = words.astype(np.uint64)
        self.trust = (np.maximum(n_docs - 1, 0) >= TRUST).astype(np.float32)
        n1 = labels.sum()
        self.odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((n_docs - toxic + 0.5) / (len(labels) - n1 + 1))
        self.known = _found(self.vocabulary, joined(2)[first])

    def narrow(self) -> np.ndarray:
        """Leave the words that have no vector of their own out of the vocabulary, as they would never learn; the places of those that stay."""
        stay = np.flatnonzero(self.trust)
        place = np.full(len(self.trust) + 1, -1)  # the last is for words without letters
        place[stay] = np.arange(len(stay))
        self.vocabulary, self.trust, self.odds, self.known = self.vocabulary[stay], self.trust[stay], self.odds[stay], place[self.known]
        return stay

    def placed(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _placed(*self.windows.at(which)[:2], self.of_word)


def _picked(grams: np.ndarray, n_grams: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The n-grams of the chosen words, one after the other."""
    begin, n = (np.cumsum(n_grams) - n_grams)[which], n_grams[which]
    return grams[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def forward(params: dict, x: dict[str, np.ndarray], at: np.ndarray, on: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """Logit of each window. x: input gates of each distinct word by direction; at: words of each window; on: which are there."""
    return _run(params, lambda side, t: x[side][at[:, t]], on, kept)


def _run(params: dict, gate_of, on: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """``forward`` by gate_of(side, t), the input gates of all windows at a step."""
    n, length = on.shape
    states, pick = np.empty((length, n, 2 * STATE), np.float32), params["pick"]
    full = on.all(axis=0)
    for d, side in enumerate("fb"):
        h, u = np.zeros((n, STATE), np.float32), params[f"u_{side}"]
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            gate, pre = gate_of(side, t), h @ u
            rz = sigmoid(gate[:, : 2 * STATE] + pre[:, : 2 * STATE])
            r, z = rz[:, :STATE], rz[:, STATE:]
            new = np.tanh(gate[:, 2 * STATE :] + r * pre[:, 2 * STATE :])
            if kept is not None:
                kept[side, t] = (h, r, z, new, pre[:, 2 * STATE :])
            after = new + z * (h - new)
            h = after if full[t] else np.where(on[:, t, None], after, h)
            states[t, :, d * STATE : (d + 1) * STATE] = h
    seen = np.tanh(states.reshape(-1, 2 * STATE) @ params["attend"] + params["attend_b"]).reshape(length, n, -1)
    weight = np.exp(np.where(on.T, np.clip(seen @ pick, -30, 30), -np.inf))
    weight /= np.maximum(weight.sum(axis=0), 1e-30)  # without words nothing is pooled
    if kept is not None:
        states, seen, weight = states.transpose(1, 0, 2), seen.transpose(1, 0, 2), weight.T
        pooled = np.einsum("nt,nth->nh", weight, states)
        kept |= {"states": states, "seen": seen, "weight": weight, "pooled": pooled}
        return pooled @ params["out"] + params["out_b"]
    return ((states.reshape(-1, 2 * STATE) @ params["out"]).reshape(length, n) * weight).sum(axis=0) + params["out_b"]


def _logits(params: dict, gates: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Logit of n full windows that start one word after the other. gates: input gates by direction, a row for each gate and a column for each of the
    n + WINDOW - 1 words, so that every step works on whole rows. The sigmoids are tanhs of half their input: the halves are in the weights."""
    states = np.empty((WINDOW, 2 * STATE, n), np.float32)
    act, new, pre = np.empty((2 * STATE, n), np.float32), np.empty((STATE, n), np.float32), np.empty((3 * STATE, n), np.float32)
    half = np.repeat(np.array([0.5, 1], np.float32), [2 * STATE, STATE])[:, None]
    for d, side in enumerate("fb"):
        u, of = params[f"u_{side}"].T * half, gates[side] * half
        h = np.zeros((STATE, n), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            gate = of[:, t : t + n]
            np.matmul(u, h, out=pre)
            np.add(gate[: 2 * STATE], pre[: 2 * STATE], out=act)
            np.tanh(act, out=act)
            act *= np.float32(0.5)
            act += np.float32(0.5)
            np.multiply(act[:STATE], pre[2 * STATE :], out=new)
            new += gate[2 * STATE :]
            np.tanh(new, out=new)
            after = states[t, d * STATE : (d + 1) * STATE]
            np.subtract(h, new, out=after)
            after *= act[STATE:]
            after += new
            h = after
    attend, bias, pick = np.ascontiguousarray(params["attend"].T), params["attend_b"][:, None], params["pick"]
    weight, value, seen = np.empty((WINDOW, n), np.float32), np.empty((WINDOW, n), np.float32), np.empty((STATE, n), np.float32)
    for t in range(WINDOW):
        np.matmul(attend, states[t], out=seen)
        seen += bias
        np.tanh(seen, out=seen)
        np.matmul(pick, seen, out=weight[t])
        np.matmul(params["out"], states[t], out=value[t])
    np.exp(np.clip(weight, -30, 30, out=weight), out=weight)
    return (value * weight).sum(axis=0) / weight.sum(axis=0) + params["out_b"]


def every_logit(params: dict, gates: dict[str, np.ndarray], of_word: np.ndarray, every: Windows) -> np.ndarray:
    """The logit of each of a text's windows, all texts one after the other.

    Windows that start one word after the other share their words' input gates: a block takes them once, in the order of the words, and each step is a
    slice of them. Of the windows that such a block has, those that run over the end of a text are left out; texts of less than a window's words come
    by themselves.
    """
    out = np.empty(len(every), np.float32)
    short = every.counts < WINDOW
    windows_of = lambda mask: np.repeat(mask, every.n)
    starts = np.repeat(every.words, every.n) + np.arange(len(every)) - np.repeat(every.ends - every.n, every.n)
    full = np.flatnonzero(windows_of(~short))
    begin = starts[full]
    for a in range(0, len(of_word) - WINDOW + 1, BLOCK):
        b = min(a + BLOCK, len(of_word) - WINDOW + 1)
        low, high = np.searchsorted(begin, (a, b))
        if low < high:
            own = {side: np.ascontiguousarray(gates[side][of_word[a : b + WINDOW - 1]].T) for side in "fb"}
            out[full[low:high]] = _logits(params, own, b - a)[begin[low:high] - a]
    rest = np.flatnonzero(windows_of(short))
    for a in range(0, len(rest), BLOCK):
        start, size, _ = every.at(rest[a : a + BLOCK])
        out[rest[a : a + BLOCK]] = forward(params, gates, *_placed(start, size, of_word))
    return out


def backward(params: dict, kept: dict, on: np.ndarray, d_logit: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """Gradients of the parameters, and of the input gates of every window and step by direction."""
    states, seen, weight, pooled = kept["states"], kept["seen"], kept["weight"], kept["pooled"]
    grads = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * params["out"]
    d_states = weight[..., None] * d_pooled[:, None]
    d_weight = np.einsum("nh,nth->nt", d_pooled, states)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    grads["pick"] = np.einsum("nt,ntk->k", d_score, seen)
    d_seen = d_score[..., None] * params["pick"] * (1 - seen * seen)
    grads["attend"], grads["attend_b"] = np.einsum("nth,ntk->hk", states, d_seen), d_seen.sum(axis=(0, 1))
    d_states = d_states + d_seen @ params["attend"].T
    d_gates = {}
    for d, side in enumerate("fb"):
        u, d_u = params[f"u_{side}"], 0
        d_h, d_x = 0, np.zeros((*on.shape, 3 * STATE), np.float32)
        for t in range(WINDOW - 1, -1, -1) if side == "f" else range(WINDOW):
            h, r, z, new, pre = kept[side, t]
            d_h = d_h + d_states[:, t, d * STATE : (d + 1) * STATE]
            d_new_h = d_h * on[:, t, None]
            d_n = d_new_h * (1 - z) * (1 - new * new)
            d_r, d_z = d_n * pre * r * (1 - r), d_new_h * (h - new) * z * (1 - z)
            d_x[:, t] = np.concatenate((d_r, d_z, d_n), axis=1)
            d_pre = np.concatenate((d_r, d_z, d_n * r), axis=1)
            d_u = d_u + h.T @ d_pre
            d_h = d_h * ~on[:, t, None] + d_new_h * z + d_pre @ u.T
        grads[f"u_{side}"], d_gates[side] = d_u, d_x
    return grads, d_gates


def _gates(params: dict, embedded: np.ndarray) -> dict[str, np.ndarray]:
    return {side: embedded @ params[f"w_{side}"] + params[f"b_{side}"] for side in "fb"}


def _or_blank(embedded: np.ndarray) -> np.ndarray:
    """The inputs; where no text has a word, one of zeros that stands in for words that aren't there."""
    return embedded if len(embedded) else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)


def _placed(first: np.ndarray, size: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)
    on = step < size[:, None]
    return np.append(of_word, 0)[np.where(on, first[:, None] + step, len(of_word))], on


def fit(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 0) -> dict:
    """Train on documents and their labels (0 or 1) by Adam.

    A document's logit is its highest window's. Each epoch scores all windows, then learns from the highest ones of
    each document. What is returned is the mean of the parameters over all steps of the second half, as single steps' differ much. Word vectors start with the log odds of the word in their first place, the bias with those of
    ``share``, the share of toxic documents among all labelled ones (default: among these). With labels of one class
    only, or none, the network stays at that share.
    """
    rng = np.random.default_rng(seed)
    lesson, n1 = Lesson(texts, labels), labels.sum()
    n_words = len(lesson.vocabulary)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lesson.windows.n)
    some = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    params = {"words": (rng.standard_normal((max(1, n_words), WORD_DIM)) * 0.05).astype(np.float32), "grams": (rng.standard_normal((GRAMS, CHAR_DIM)) * 0.05).astype(np.float32)}
    params["words"][:n_words, 0] = np.clip(lesson.odds, -4, 4) / 2
    stay = lesson.narrow()
    params["words"] = params["words"][stay] if len(stay) else params["words"][:1]
    params["trust"] = np.append(lesson.trust, np.float32(0))[: len(params["words"])]
    for side in "fb":
        params |= {f"w_{side}": some(WORD_DIM + CHAR_DIM, 3 * STATE), f"u_{side}": some(STATE, 3 * STATE), f"b_{side}": np.zeros(3 * STATE, np.float32)}
    share = (n1 + 0.5) / (len(labels) + 1) if share is None else share
    params |= {"attend": some(2 * STATE, STATE), "attend_b": np.zeros(STATE, np.float32), "pick": some(STATE), "out": some(2 * STATE), "out_b": np.array([np.log(share / (1 - share))], np.float32)}
    model = params | {"vocabulary": lesson.vocabulary}
    if not 0 < n1 < len(labels):
        params["out"][:] = 0
        return model
    trained, adam = {k: params[k] for k in params}, Adam({k: v for k, v in params.items() if k != "trust"}, 0.01)
    mean, n_steps = {k: np.zeros_like(v) for k, v in adam.params.items()}, 0
    weigh = np.where(labels == 1, 0.5 * len(labels) / n1, 0.5 * len(labels) / (len(labels) - n1))  # both classes weigh the same
    for epoch in range(EPOCHS):
        logit = every_logit(trained, _gates(trained, _or_blank(lesson.embedded(trained))), lesson.of_word, lesson.windows)
        highest = _highest(logit, text, 2)
        adam.rate = RATES[0] if epoch < EPOCHS // 2 else RATES[1]
        rng.shuffle(highest)
        for a in range(0, len(highest), STEP):
            which = highest[a : a + STEP]
            at, on = lesson.placed(which)
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(on.shape)
            few = _Some(lesson, used if len(lesson.known) else used[:0])
            embedded, kept = _or_blank(few.embedded(trained)), {}
            out = forward(trained, _gates(trained, embedded), at, on, kept)
            y = labels[text[which]]
            grads, d_gates = backward(trained, kept, on, ((sigmoid(out) - y) * weigh[text[which]] / len(which)).astype(np.float32))
            d_embedded = np.zeros_like(embedded)
            for side in "fb":
                d_word = np.zeros((len(used), 3 * STATE), np.float32)
                np.add.at(d_word, at[on], d_gates[side][on])
                grads |= {f"w_{side}": embedded.T @ d_word, f"b_{side}": d_word.sum(axis=0)}
                d_embedded += d_word @ trained[f"w_{side}"].T
            grads |= few.gradients(trained, d_embedded[: len(few.known)])
            adam.step(grads)
            if epoch >= EPOCHS // 2:
                n_steps += 1
                for k, held in mean.items():
                    held += (trained[k] - held) / n_steps
    for k, held in mean.items():
        trained[k][...] = held
    return model


def _highest(logit: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """The windows with the k highest logits of each text."""
    order = np.lexsort((-logit, text))
    first = np.searchsorted(text, np.arange(text[-1] + 1))
    return order[np.arange(len(order)) - first[text] < k]


class _Some(Inputs):
    """Some of the distinct words of other inputs."""

    def __init__(self, inputs: Inputs, which: np.ndarray):
        self.known, self.n_grams = inputs.known[which], inputs.n_grams[which]
        self.grams = _picked(inputs.grams, inputs.n_grams, which)

    def gradients(self, params: dict, d_embedded: np.ndarray) -> dict:
        word, grams = np.zeros_like(params["words"]), np.zeros_like(params["grams"])
        on = self.known >= 0
        np.add.at(word, self.known[on], d_embedded[on, :WORD_DIM] * params["trust"][self.known[on], None])
        np.add.at(grams, self.grams, np.repeat(d_embedded[:, WORD_DIM:] / self.n_grams[:, None], self.n_grams, axis=0))
        return {"words": word, "grams": grams}


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    """Score of each text: its highest window's. A text without words has one window that pools nothing."""
    words = words_of(texts)
    best = np.full(len(texts), -np.inf, np.float32)
    inputs, every = Inputs(words, model["vocabulary"]), Windows(words.counts)
    gates = _gates(model, _or_blank(inputs.embedded(model)))
    np.maximum.at(best, np.repeat(np.arange(len(texts)), every.n), every_logit(model, gates, inputs.of_word, every))
    return sigmoid(best.astype(np.float64))


def sample_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learns: Column, n_by_class: dict[int, int], most_bytes: int | None = None) -> DataFrame:
    """text and label (by id) of a bounded sample of labelled documents: of each class the given number with the least hash.

    One row for each sampled id and class; where several rows share an id it is the one with the least text. With ``most_bytes`` those that come first by
    hash, as long as their texts have no more bytes together.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where(F.col("__id").isNotNull()).where(learns)
    parts = [known.where(F.col("__label") == c).distinct().orderBy(F.xxhash64("__id"), "__id").limit(n) for c, n in n_by_class.items()]
    few = parts[0]
    for part in parts[1:]:
        few = few.union(part)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id")  # bounded by n_by_class
    rows = rows.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    if most_bytes is not None:  # a window over the sample alone
        before = Window.orderBy(F.xxhash64("__id"), "__id", "__label").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__sum", F.sum(F.coalesce(F.octet_length("__text"), F.lit(0))).over(before)).where(F.col("__sum") <= most_bytes).drop("__sum")
    return rows.orderBy("__id", "__label").select("__id", F.col("__label").alias("label"), F.col("__text").alias("text"))


def sampled(*args, **more) -> pd.DataFrame:
    """``sample_rows`` on the driver."""
    return sample_rows(*args, **more).toPandas()


def loss(model: dict, texts: list[bytes], labels: np.ndarray) -> float:
    """Mean log loss of the texts' scores, both classes weighing the same."""
    p = np.clip(scores(model, texts), 1e-7, 1 - 1e-7)
    parts = [-np.log(p[labels == 1]), -np.log(1 - p[labels == 0])]
    return float(sum(x.mean() for x in parts if len(x)))


def fitted(few: DataFrame, share: float) -> dict:
    """The model of a bounded sample (``sample_rows``): the one of STARTS starts that has the least loss on it. Each start is a task, which is run again
    if its executor is lost; its matrices are multiplied by one thread, as Spark asks of its workers."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__id", "label"])
        texts, y, seed = _bytes(rows["text"]), rows["label"].to_numpy(np.float64), int(rows["seed"].iloc[0])
        model = fit(texts, y, share, seed)
        return pd.DataFrame({"seed": [seed], "loss": [loss(model, texts, y)], "model": [pickle.dumps(model)]})

    starts = few.withColumn("seed", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    # with ranges to spare every seed has one of its own; with STARTS of them the sampled bounds often put two in one task
    best = starts.repartitionByRange(16 * STARTS, "seed").groupBy("seed").applyInPandas(one, "seed int, loss double, model binary").agg(F.min_by("model", F.struct("loss", "seed")).alias("model")).first()["model"]
    return pickle.loads(best) if best is not None else fit([], np.zeros(0), share)


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; held_out: crc32 of the id as text mod folds = held.

    Learns from labels of rows that aren't held out alone (see ``sampled``), all windows and words of each, within FIT_BYTES. Null and empty
    texts get the network's score of a window without words. A null id is not held out. Repeated rows get the same
    score. Windows overlap at every word. Without labels every text of words scores one half, the odds of no labels. A very long text is worked
    on by itself, its windows a block at a time. Other columns of ``docs``, whatever their names, play no part. An empty table
    gives an empty one.
    """
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % folds
    few = sample_rows(docs, labels, doc_id, text, label, fold("__id") != held, {1: FIT_TOXIC, 0: FIT_CLEAN}, FIT_BYTES)
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where(fold("__id") != held)
    toxic, rows = known.agg(F.count_if(F.col("__label") == 1), F.count("__label")).first()
    model = docs.sparkSession.sparkContext.broadcast(fitted(few, (toxic + 0.5) / (rows + 1)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = _bytes(batch["text"])
            for a, b in chunks(texts, CHUNK):
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[a:b], "held_out": batch["held_out"].to_numpy()[a:b], "score": scores(model.value, texts[a:b])})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    out = rows.mapInPandas(each, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
