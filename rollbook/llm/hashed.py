"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def byte_class(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: The six blanks between words, and all that is neither an ASCII letter nor part of a longer character.
BLANK = byte_class([32, *range(9, 14)])
NO_LETTER = byte_class(b for b in range(128) if not chr(b).isalpha())


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _UNBASE))


@dataclass
class Words:
    data: np.ndarray  # all bytes
    start: np.ndarray  # of each word
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words of each text
    total: np.ndarray  # prefix hashes, from which those of any span follow
    unpower: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[end] - self.total[start]) * self.unpower[start] + (end - start).astype(np.uint64))


def words_of(texts: list[bytes], blank: np.ndarray = BLANK) -> Words:
    """The runs of non-blank bytes of all texts, with a 64-bit hash each."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(blank[data], prepend=True))
    start, end = edge[::2], edge[1::2]
    power, unpower = powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = Words(data, start, end, start, np.diff(np.searchsorted(start, ends), prepend=0), total, unpower)
    out.hash = out.span_hash(start, end)
    return out


def chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Spans of texts of about ``most`` bytes; a longer text is a span of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            fixed = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.params[k] -= self.rate * (fixed + self.decay * self.params[k])
