"""Hashed word and character n-gram features, computed once per distinct word.

A text is its words (split at white space).  A word's features are the word
itself and its character n-grams with boundary marks, hashed to ``buckets``
numbers; pairs of neighbouring words may be features too.  As every model here is
linear in them, a task keeps for each word the sum of its features' values; a text
then costs one look-up per word, and one per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character codes of words with boundary marks, sizes and ends of words, and each code's word."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, sizes, np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)


def _own_numbers(codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A word's own number: position-weighted sum of its codes."""
    place = (np.arange(len(codes)) - (ends - sizes)[owner]).astype(np.uint64)
    weighted = (codes + _MIX) * (place * _MULT + np.uint64(1) | np.uint64(1))
    weighted ^= weighted >> np.uint64(29)
    return np.add.reduceat(weighted, ends - sizes) * _MULT


@dataclass(frozen=True)
class FeatureSpace:
    """How words become feature numbers."""

    buckets: int = 1 << 16
    low: int = 3
    high: int = 5
    lower: bool = False
    whole_word: bool = True
    #: The word bigram of a word with itself, one feature (number 0) for all words.
    repeats: bool = False
    #: Pairs of neighbouring words.
    bigrams: bool = False

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        return (text.lower() if self.lower else text).split()

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, feature number) of every feature of the given words."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, sizes, ends, owner = _marked(words)
        room = ends[owner] - np.arange(len(codes))
        found_word, found = [], []
        with np.errstate(over="ignore"):
            rolling = codes.copy()
            for n in range(2, self.high + 1):
                rolling = rolling[: len(codes) - n + 1] * _MULT + codes[n - 1 :]
                if n >= self.low:
                    at = np.nonzero(room[: len(rolling)] >= n)[0]
                    found_word.append(owner[at])
                    found.append(self._bucket(rolling[at] + np.uint64(n)))
            if self.whole_word:
                found_word.append(np.arange(len(words)))
                found.append(self._bucket(_own_numbers(codes, sizes, ends, owner)))
        return np.concatenate(found_word), np.concatenate(found)

    def word_hashes(self, words: list[str]) -> np.ndarray:
        """A 64-bit number of each word."""
        if not words:
            return np.zeros(0, np.uint64)
        codes, sizes, ends, owner = _marked(words)
        with np.errstate(over="ignore"):
            return _own_numbers(codes, sizes, ends, owner)

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Feature numbers of pairs of words, from their 64-bit numbers."""
        with np.errstate(over="ignore"):
            return self._bucket(first * _MULT + (second ^ _MIX))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
        return (h % np.uint64(self.buckets)).astype(np.int64)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def blocks_of(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters, or one longer text."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > chars:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class WordSums:
    """Per-text sums of word values, with the values of words kept between batches.

    ``values`` maps a list of distinct words to a matrix, one row per word.  The
    store is emptied when it holds ``most`` words, so a worker's memory is bounded.
    """

    def __init__(
        self, space: FeatureSpace, values: Callable[[list[str]], np.ndarray], width: int, repeat: np.ndarray | None = None, pair: np.ndarray | None = None, most: int = 120_000
    ):
        self.space, self.values, self.width, self.repeat, self.pair, self.most = space, values, width, repeat, pair, most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.table = np.zeros((0, self.width))
        self.hashes = np.zeros(0, np.uint64)

    def sums(self, texts: list[str | None], distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sums, number of words) of each text; ``distinct`` counts each word of a text once."""
        out, counts = np.zeros((len(texts), self.width)), np.zeros(len(texts), np.int64)
        for a, b in blocks_of(texts):
            if len(self.numbers) > self.most:
                self._clear()
            known = len(self.numbers)
            number = self.numbers.__getitem__
            ids: list[int] = []
            for k in range(a, b):
                words = self.space.words(texts[k])
                if distinct:
                    words = set(words)
                ids.extend(map(number, words))
                counts[k] = len(words)
            if len(self.numbers) > known:
                fresh = list(self.numbers)[known:] if known else list(self.numbers)
                made = [self.values(fresh[i : i + 10_000]) for i in range(0, len(fresh), 10_000)]
                self.table = np.concatenate([self.table, *made])
                if self.pair is not None:
                    self.hashes = np.concatenate([self.hashes, self.space.word_hashes(fresh)])
            owner = np.repeat(np.arange(b - a), counts[a:b])
            idx = np.array(ids, dtype=np.int64)
            for c in range(self.width):
                out[a:b, c] = np.bincount(owner, weights=self.table[idx, c], minlength=b - a)
            if self.repeat is not None and len(idx):
                same = (idx[1:] == idx[:-1]) & (owner[1:] == owner[:-1])
                out[a:b] += np.bincount(owner[1:][same], minlength=b - a)[:, None] * self.repeat
            if self.pair is not None and len(idx):
                inside = owner[1:] == owner[:-1]
                of, h = owner[1:][inside], self.hashes[idx]
                number_of_pair = self.space.pairs(h[:-1][inside], h[1:][inside])
                for c in range(self.width - 1):
                    out[a:b, c] += np.bincount(of, weights=self.pair[number_of_pair, c], minlength=b - a)
                out[a:b, -1] += np.bincount(of, minlength=b - a)
        return out, counts


def linear_values(space: FeatureSpace, weights: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    """Word values for a table of feature weights (buckets x outputs): the sums of
    their features' weights, and in a last column how many features there are."""

    def values(words: list[str]) -> np.ndarray:
        owner, feature = space.features(words)
        out = np.empty((len(words), weights.shape[1] + 1))
        for c in range(weights.shape[1]):
            out[:, c] = np.bincount(owner, weights=weights[feature, c], minlength=len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    return values


def sparse_rows(space: FeatureSpace, texts: list[str | None], distinct: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature numbers, counts) of each text, for training."""
    out = []
    for t in texts:
        words = space.words(t)
        if not words:
            out.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        owner, feature = space.features(list(seen))
        per_word = np.ones(len(seen)) if distinct else np.fromiter(seen.values(), float, len(seen))
        dense = np.bincount(feature, weights=per_word[owner], minlength=space.buckets)
        if space.repeats:
            dense[0] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        if space.bigrams and len(words) > 1:
            h = space.word_hashes(list(seen))[np.array([*map({w: k for k, w in enumerate(seen)}.__getitem__, words)])]
            dense += np.bincount(space.pairs(h[:-1], h[1:]), minlength=space.buckets)
        keep = np.nonzero(dense)[0]
        out.append((keep, dense[keep]))
    return out
