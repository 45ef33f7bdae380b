"""Merging of byte pairs in numpy, for vocabularies of the byte-level kind.

Many short sequences lie end to end in one array. Each round looks up the rank of every neighbouring pair, finds
each sequence's lowest rank and merges all its occurrences at once. A long sequence would need a round over all of
it for every rank it uses; it is worked rank by rank instead, with the places of each rank kept in a bucket.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa

#: Sequences over so many symbols are merged by buckets.
LONG = 2048
_NONE = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The ranked merges of a vocabulary file."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.symbol, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, byte in _byte_letters().items():
            self.symbol[byte], self.last[byte] = vocab[letter], vocab[letter + suffix]
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pair = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.pair[:, 0] * self.width + self.pair[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        # most keys are found by one look into a table of hashes; a key whose place is taken is found by bisection
        self.place = np.zeros(1 << 18, np.int32)
        hashed = self._hash(self.keys)
        _, first = np.unique(hashed, return_index=True)
        self.place[hashed[first]] = first
        self.shared = np.zeros(1 << 18, bool)
        self.shared[np.delete(hashed, first)] = True

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        """The rank of each pair, or ``_NONE``."""
        hashed = self._hash(key)
        at = self.place[hashed]
        other = np.flatnonzero(self.shared[hashed] & (self.keys[at] != key))
        at[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pretokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive, end to end, and how many each pre-token has."""
        bounds = np.frombuffer(pretokens.buffers()[1], np.int32)[pretokens.offset : pretokens.offset + len(pretokens) + 1]
        data = np.frombuffer(pretokens.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        sizes = np.diff(bounds).astype(np.int64)
        ends = np.cumsum(sizes)
        sym = self.symbol[data]
        tail = ends[sizes > 0] - 1
        sym[tail] = self.last[data[tail]]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        done = []
        for i in np.flatnonzero(sizes > LONG).tolist():
            left = self._merge_long(sym[ends[i] - sizes[i] : ends[i]])
            done.append((left, np.full(len(left), i)))
        if done:
            short = (sizes <= LONG)[seq]
            sym, seq = sym[short], seq[short]
        while len(sym) > 1:
            inside = seq[1:] == seq[:-1]
            rank = np.where(inside, self._rank(sym[:-1] * self.width + sym[1:]), _NONE)
            starts = np.flatnonzero(np.r_[True, ~inside])
            least = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            lowest = np.repeat(least, lengths)
            alive = lowest < _NONE
            done.append((sym[~alive], seq[~alive]))
            hit = np.flatnonzero((rank == lowest[:-1]) & alive[:-1])
            if not len(hit):
                sym, seq = sym[:0], seq[:0]
                break
            # of overlapping occurrences (a run of one symbol) every second merges, from the left
            gap = np.r_[True, np.diff(hit) > 1]
            run_start = hit[gap][np.cumsum(gap) - 1]
            hit = hit[(hit - run_start) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            alive[hit + 1] = False
            sym, seq = sym[alive], seq[alive]
        done.append((sym, seq))
        sym, seq = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(pretokens))

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One sequence, its pairs in buckets by rank, from the lowest; a merge only looks at its neighbours again."""
        sym = sym.copy()
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[-1] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            rank = self._rank(sym[at] * self.width + sym[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, some in zip(rank[cuts].tolist(), np.split(at, cuts[1:]) if len(rank) else [], strict=True):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(heap, r)
                buckets[r].append(some)

        put(np.arange(len(sym) - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(buckets.pop(r)))
            a, b = self.pair[r]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if a == b and len(at) > 1:
                gap = np.r_[True, at[1:] != after[at[:-1]]]
                run = np.arange(len(at)) - np.flatnonzero(gap)[np.cumsum(gap) - 1]
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = after[gone]
            inner = at[after[at] >= 0]
            before[after[inner]] = inner
            put(np.unique(np.concatenate([inner, before[at][before[at] >= 0]])))
        return sym[sym >= 0]
