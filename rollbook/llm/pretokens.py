"""Pre-tokens of many texts at once as numpy arrays, and numbers for the words that a worker has met."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Letters and numbers among the characters up to U+024F, and the blanks there. Fixed values.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\t-\r \x85\xa0"
#: A text with other characters than these (Latin and general punctuation) is cut by the tokenizers library itself.
BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")
#: Stands between texts that are cut together; such a text is never plain.
EDGE = "￿"
#: What may follow an apostrophe as one pre-token with it. Fixed values.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _BLANK, _EDGE = range(5)


def _classes() -> np.ndarray:
    out = np.full(1 << 16, _OTHER, np.uint8)
    for pattern, kind in ((LETTERS, _LETTER), (NUMBERS, _NUMBER), (BLANKS, _BLANK)):
        out[[ord(m[0]) for m in re.finditer(f"[{pattern}]", "".join(map(chr, range(0x250))))]] = kind
    out[ord(EDGE)] = _EDGE
    return out


CLASSES = _classes()
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Cut:
    """The pre-tokens of some plain texts: ``start`` and ``end`` of each in ``joined``, ``counts`` of each text."""

    def __init__(self, texts: list[str], by_word: bool):
        """``by_word``: words apart from blanks, digits one by one; else a word brings the space before it along."""
        self.joined = EDGE + EDGE.join(texts) + EDGE
        self.codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        kind = CLASSES[self.codes]
        new = kind[1:] != kind[:-1]
        if by_word:
            new |= kind[1:] == _NUMBER
        start = np.flatnonzero(new) + 1
        end, kind = np.append(start[1:], len(self.codes)), kind[start]
        self._suffixes(start, end, kind, by_word)
        if not by_word:
            start, end, kind = self._spaces(start, end, kind)
        on = (kind < (_BLANK if by_word else _EDGE)) & (start < end)
        self.start, self.end = start[on], end[on]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(self.start, ends + 1), prepend=0)

    def _suffixes(self, start: np.ndarray, end: np.ndarray, kind: np.ndarray, by_word: bool) -> None:
        """An apostrophe where a pre-token begins takes its suffix from the letters after it."""
        at = np.flatnonzero((self.codes[start[:-1]] == 39) & (end[:-1] - start[:-1] == 1) & (kind[1:] == _LETTER))
        if not by_word:
            at = at[self.codes[start[at] - 1] != 32]
        first, second = self.codes[end[at]], self.codes[end[at] + 1]
        take = np.zeros(len(at), np.int64)
        for s in SUFFIXES:
            take[(first == ord(s[0])) & (second == ord(s[-1]) if len(s) > 1 else first == ord(s))] = len(s)
        end[at] += take
        start[at + 1] += take

    def _spaces(self, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blanks before a word: the last one, if a space, goes with the word, else it stands alone; the rest is one."""
        at = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _EDGE))
        joins = self.codes[end[at] - 1] == 32
        start[at[joins] + 1] -= 1
        end[at[joins]] -= 1
        apart = at[~joins & (end[at] - start[at] > 1)]
        end[apart] -= 1
        return np.insert(start, apart + 1, end[apart]), np.insert(end, apart + 1, end[apart] + 1), np.insert(kind, apart + 1, _BLANK)

    def words(self, which: np.ndarray) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]


class Known:
    """Numbers words from 0 as they come; ``learn`` is told of the new ones in the order of their numbers.

    Words of up to 16 characters below U+0100 are found by their very characters in a table with one word a place; all
    others, and those whose place is taken, by a dictionary. After ``most`` words it starts anew.
    """

    PLACES = 1 << 20

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], most: int):
        self.learn, self.forget, self.most = learn, forget, most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.place = np.full(self.PLACES, -1, np.int32)
        self.key = np.zeros((3, 1 << 16), np.uint64)  # two halves of the characters, length

    def of(self, words: list[str]) -> list[int]:
        new = list(dict.fromkeys(w for w in words if w not in self.number))
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.learn(new)
        return [self.number[w] for w in words]

    def fresh(self) -> None:
        """Start anew if there are too many words. Numbers given earlier don't hold any longer."""
        if len(self.number) > self.most:
            self.clear()
            self.forget()

    def of_cut(self, cut: Cut) -> np.ndarray:
        """The number of each word of ``cut``."""
        size = cut.end - cut.start
        narrow = np.zeros(len(cut.codes) + 16, np.uint8)
        narrow[: len(cut.codes)] = cut.codes
        eight = np.ndarray((len(cut.codes) + 8,), "<u8", narrow, strides=(1,))
        low = eight[cut.start] & _KEEP[np.minimum(size, 8)]
        high = eight[cut.start + 8 if len(cut.start) else cut.start] & _KEEP[np.clip(size - 8, 0, 8)]
        short = size <= 16
        wide = np.flatnonzero(cut.codes[1:-1] > 255) + 1
        if len(wide):
            holder = np.searchsorted(cut.start, wide, "right") - 1
            holder = holder[holder >= 0]
            short[holder] = False  # a blank between words may name its neighbour: that is only slower
        at = (((low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)) + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)
        number = self.place[at]
        number[(self.key[0, number] != low) | (self.key[1, number] != high) | (self.key[2, number] != size.astype(np.uint64)) | ~short] = -1
        rest = np.flatnonzero(number < 0)
        if len(rest):
            known = len(self.number)
            number[rest] = self.of(cut.words(rest))
            if len(self.number) > self.key.shape[1]:
                self.key = np.concatenate((self.key, np.zeros((3, max(len(self.number), self.key.shape[1])), np.uint64)), axis=1)
            new = rest[(number[rest] >= known) & short[rest]]
            self.key[0, number[new]], self.key[1, number[new]], self.key[2, number[new]] = low[new], high[new], size[new]
            new = new[self.place[at[new]] < 0]
            self.place[at[new]] = number[new]
        return number
