"""Distributed merge sort of strings that never compares a known common prefix again.

A task sorts its strings to a run and cuts it at the bounds of the parts. A piece of a run is
front coded: of every string only the bytes after the prefix that it shares with the string
before it, and the length of that prefix. Pieces of a part are merged by a loser tree whose
players carry the length of the prefix they share with the last string put out: of two players
the one that shares more is smaller, without a look at a byte; only equal lengths are compared,
from that length on. So the order comes out with each string's common prefix with its
predecessor, and with its successor.

Equal strings of one run travel once: the others are settled in the run and are dealt over all
parts with their payload only, so a string that occurs everywhere is in the tree once per run.
Bounds come from a bounded sample and only deal out the work.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard

Arrays = dict[str, np.ndarray]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share `known` bytes for certain."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8 if x else n


def neighbour_prefixes(strings: list[bytes], size: np.ndarray) -> np.ndarray:
    """Length of the prefix that each string shares with the one before; `size` has their lengths."""
    out = np.zeros(len(strings), np.int64)
    data = b"".join(strings) + bytes(8)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each on
    start = np.cumsum(size) - size
    most = np.minimum(size[:-1], size[1:])
    left, known = np.arange(len(most)), 0
    while len(left):  # pairs that share the first `known` bytes
        x = words[start[left] + known] ^ words[start[left + 1] + known]
        low = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1  # its lowest bit set
        n = known + np.where(x == 0, 8, low >> 3)
        done = (x != 0) | (n >= most[left])
        out[left[done] + 1] = np.minimum(n, most[left])[done]
        left, known = left[~done], known + 8
    return out


def run_pieces(keys: list[bytes], payload: Arrays, bounds: list[bytes],
               settled: Arrays | None = None) -> Iterator[tuple[int, bytes]]:
    """(part, piece) of one sorted run; rows of `settled` are dealt over the parts besides.

    Part p holds the strings from bounds[p - 1] up to below bounds[p].
    """
    n_parts = len(bounds) + 1
    order = sorted(range(len(keys)), key=keys.__getitem__)
    strings = [keys[i] for i in order]
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    shared = neighbour_prefixes(strings, size)
    again = (shared == size) & (shared == np.append(-1, size[:-1])[:len(size)])
    head = np.flatnonzero(~again)
    group = np.cumsum(~again) - 1
    at, copies = np.array(order, np.int64)[head], np.array(order, np.int64)[again]
    rank = (np.arange(len(order)) - head[group])[again]
    multi = np.zeros(len(head), bool)
    multi[group[again]] = True
    strings = [strings[i] for i in head.tolist()] if len(copies) else strings
    size, shared = size[head], shared[head]
    edges = [0, *[bisect_left(strings, b) for b in bounds], len(strings)]
    copy_part = (rank * 7919 + copies) % n_parts
    by_part = np.argsort(copy_part, kind="stable")
    copies, copy_part = copies[by_part], copy_part[by_part]
    copy_edges = np.searchsorted(copy_part, np.arange(n_parts + 1))
    settled = settled or {}
    n_settled = len(next(iter(settled.values()))) if settled else 0
    settled_part = np.arange(n_settled) * n_parts // max(n_settled, 1)
    done_edges = np.searchsorted(settled_part, np.arange(n_parts + 1))
    press = zstandard.ZstdCompressor(level=1)
    for part in range(n_parts):
        lo, hi = edges[part], edges[part + 1]
        own = copies[copy_edges[part]:copy_edges[part + 1]]
        done = slice(done_edges[part], done_edges[part + 1])
        if lo == hi and not len(own) and done.start == done.stop:
            continue
        known = shared[lo:hi].copy()
        known[:1] = 0
        tails = [s[n:] for s, n in zip(strings[lo:hi], known.tolist(), strict=True)]
        piece = (known.astype(np.uint16), (size[lo:hi] - known).astype(np.uint16),
                 b"".join(tails), multi[lo:hi], {k: v[at[lo:hi]] for k, v in payload.items()},
                 {k: v[own] for k, v in payload.items()},
                 {k: v[done] for k, v in settled.items()})
        yield part, press.compress(pickle.dumps(piece, protocol=5))


def opened(piece: bytes) -> tuple:
    """shared, length, tails, multi, payload, copies and settled of a piece."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(piece))


class LoserTree:
    """Merge of front-coded runs; iterate for (run, index in it, string, common prefix)."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray, bytes]]):
        self.runs = [(s.tolist(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).tolist(), t)
                     for s, n, t in runs]
        self.compared = 0  # comparisons that had to look at bytes

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        runs, k = self.runs, 1
        while k < len(runs):
            k *= 2
        string: list[bytes | None] = [None] * k
        known, at = [-1] * k, [0] * k  # a run that is through knows -1 and loses
        for r, (shared, edge, tails) in enumerate(runs):
            if shared:
                string[r], known[r] = tails[:edge[1]], 0

        def play(a: int, b: int) -> tuple[int, int]:
            x, y = string[a], string[b]
            if x is None or y is None or known[a] != known[b]:
                return (a, b) if known[a] >= known[b] else (b, a)
            self.compared += 1
            n = common_prefix(x, y, known[a])
            if x[n:n + 1] <= y[n:n + 1]:
                known[b] = n
                return a, b
            known[a] = n
            return b, a

        loser, winner = [0] * k, [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
        top = winner[1] if k > 1 else 0
        compared = 0
        while (now := string[top]) is not None:
            shared, edge, tails = runs[top]
            i = at[top]
            yield top, i, now, known[top]
            i += 1
            at[top] = i
            if i < len(shared):
                p = shared[i]
                string[top] = now[:p] + tails[edge[i]:edge[i + 1]]
            else:
                p = -1
                string[top] = None
            known[top] = p
            node = (top + k) >> 1
            while node:
                other = loser[node]
                q = known[other]
                if p < q:
                    loser[node], top, p = top, other, q
                elif p == q and p >= 0:
                    compared += 1
                    x, y = string[top], string[other]
                    u, v = x[p:p + 1], y[p:p + 1]
                    if u == v:
                        n = common_prefix(x, y, p)
                        if x[n:n + 1] <= y[n:n + 1]:
                            known[other] = n
                        else:
                            known[top] = n
                            loser[node], top = top, other
                    elif u > v:
                        loser[node], top = top, other
                node >>= 1
        self.compared += compared
