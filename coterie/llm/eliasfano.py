"""Elias-Fano sequences and the two-level n-gram trie in memory-mapped files."""

from __future__ import annotations

import json
import os

import numpy as np


class EliasFano:
    """A non-decreasing sequence of n integers under a universe u: the low log2(u / n) bits of each value
    packed side by side, the high parts in unary. Access and successor search work on arrays of queries
    and touch only the words they need, so the two bit arrays can stay in a mapped file."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.r_[0, np.cumsum(ones)]
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = v & np.uint64((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            spill = (at & 63) + low_bits > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - shift[spill]))
        top = (v >> np.uint64(low_bits)).astype(np.int64)
        places = top + np.arange(n)
        size = int(top[-1]) + n + 1 if n else 1
        bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").view(np.uint64))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero bit."""
        sums = self.ones if one else self.zeros
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 1 << 15):
            own = k[at : at + (1 << 15)]
            word = np.searchsorted(sums, own, side="right") - 1
            word = np.minimum(word, len(self.high) - 1)
            w = np.asarray(self.high[word])
            bits = np.unpackbits((w if one else ~w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rank = np.cumsum(bits, axis=1, dtype=np.uint8)
            out[at : at + (1 << 15)] = word * 64 + (rank < (own - sums[word] + 1)[:, None]).sum(1)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        up = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | up) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        top = (self._select(i, True) - i).astype(np.uint64)
        return (top << np.uint64(self.low_bits)) | self._lows(i)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each target the place of the first value that isn't less (n if none), and whether it is equal."""
        t = targets.astype(np.uint64)
        if not self.n:
            return np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        top, low = (t >> np.uint64(self.low_bits)).astype(np.int64), t & np.uint64((1 << self.low_bits) - 1)
        last = int(self.access(np.array([self.n - 1]))[0]) >> self.low_bits
        beyond = top > last
        top = np.minimum(top, last)
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - (top - 1), 0)
        stop = self._select(top, False) - top
        a, b = start, stop
        while True:  # the low parts ascend inside a bucket
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            less = open_ & (self._lows(np.minimum(mid, self.n - 1)) < low)
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        a = np.where(beyond, self.n, a)
        found = ~beyond & (a < stop)
        found &= self._lows(np.minimum(a, self.n - 1)) == low
        return a, found

    def save(self, folder: str, name: str) -> dict:
        for part in ("low", "high"):
            np.save(os.path.join(folder, f"{name}-{part}.npy"), getattr(self, part))
        return {"n": self.n, "low_bits": self.low_bits}

    @classmethod
    def open(cls, folder: str, name: str, head: dict) -> EliasFano:
        parts = (np.load(os.path.join(folder, f"{name}-{p}.npy"), mmap_mode="r") for p in ("low", "high"))
        return cls(head["n"], head["low_bits"], *parts)


#: Codes of probabilities: 0 is none, 1 to 255 are equal steps down from 1 in log10 over a span of decades.
#: Rounding is downward, so that a context's probabilities never sum to more than one.
SPAN = 7.0
STEPS = 254
STEP = SPAN / STEPS


def span_of(weight: np.ndarray) -> np.ndarray:
    """The span of a context in which one occurrence has the probability 1 / weight: at least SPAN, and so
    wide that no occurrence falls below the last code. Both sides know the weight."""
    return np.maximum(SPAN, np.log10(np.maximum(weight, 1.0)))


def quantise(p: np.ndarray, span: np.ndarray | float = SPAN) -> np.ndarray:
    """Codes of the probabilities; what lies below the span is rounded down to none."""
    with np.errstate(divide="ignore"):
        code = 1 + np.ceil(-np.log10(p) * (STEPS / span) - 1e-9)
    return np.where((p > 0) & (code <= STEPS + 1), np.clip(code, 1, STEPS + 1), 0).astype(np.uint8)


def probability(code: np.ndarray, span: np.ndarray | float = SPAN) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(span / STEPS) * (code.astype(np.float64) - 1)), 0.0)


class Trie:
    """Contexts (sorted ids), monotone pointers to their followers, and the followers' quantised
    probabilities. A follower is stored relative to its context: the id plus the last stored value of
    the context before, which makes the level one non-decreasing sequence; a query adds the same and
    searches the successor inside the context's range."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, followers: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.followers, self.codes = contexts, pointers, followers, codes

    @classmethod
    def write(cls, folder: str, context: np.ndarray, follower: np.ndarray, codes: np.ndarray) -> None:
        """context, follower: ids sorted as pairs."""
        first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
        stop = np.r_[first, len(context)].astype(np.uint64)
        step = follower[np.r_[first[1:] - 1, len(follower) - 1]].astype(np.uint64) + np.uint64(1) if len(first) else np.empty(0, np.uint64)
        base = np.r_[np.uint64(0), np.cumsum(step)[:-1]] if len(first) else step
        relative = follower.astype(np.uint64) + np.repeat(base, np.diff(stop).astype(np.int64))
        head = {name: EliasFano.build(values).save(folder, name) for name, values in (("contexts", context[first]), ("pointers", stop), ("followers", relative))}
        np.save(os.path.join(folder, "codes.npy"), codes)
        with open(os.path.join(folder, "head.json"), "w") as f:
            json.dump(head, f)

    @classmethod
    def open(cls, folder: str) -> Trie:
        with open(os.path.join(folder, "head.json")) as f:
            head = json.load(f)
        return cls(*(EliasFano.open(folder, name, head[name]) for name in ("contexts", "pointers", "followers")), np.load(os.path.join(folder, "codes.npy"), mmap_mode="r"))

    def lookup(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Codes of the pairs; 0 where the trie hasn't them."""
        out = np.zeros(len(context), np.uint8)
        k, known = self.contexts.successor(context)
        q = np.flatnonzero(known)
        if not len(q):
            return out
        k, inverse = np.unique(k[q], return_inverse=True)
        start, stop = self.pointers.access(k).astype(np.int64), self.pointers.access(k + 1).astype(np.int64)
        base = np.where(start > 0, self.followers.access(np.maximum(start - 1, 0)) + np.uint64(1), np.uint64(0))
        at, equal = self.followers.successor(base[inverse] + follower[q].astype(np.uint64))
        inside = equal & (at >= start[inverse]) & (at < stop[inverse])
        out[q[inside]] = self.codes[at[inside]]
        return out
