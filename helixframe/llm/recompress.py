"""Recompression of word sequences: globally consistent names for runs and pairs, and the anchors they give.

A sequence of words is rewritten in rounds. A round first names each maximal run of one symbol, then each pair (a, b)
whose left symbol falls in one half of the alphabet and whose right symbol in the other. A name is a hash of what it
names and of the round, so every task of every executor gives the same name to the same thing: names are global without
an exchange. Equal stretches of words are therefore rewritten alike, except near their ends.

How near is kept beside each symbol: the stretch of words that its making looked at. If that stretch lies inside a
window, then every window of the same words has the same symbol at the same place. A window's anchor is, among such
symbols, one of the highest round, of those the least by hash, of those the leftmost. Its key covers the symbol and all
the words that it depends on. So equal windows have equal anchors, and windows whose key is met once in the corpus
cannot repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from helixframe.llm.textblocks import mix

ROUNDS = 2
_BASE = 0x2545F4914F6CDD1D
_RUN, _PAIR, _COIN = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Symbols:
    """name; words [start, end); what it depends on, words [low, high); doc."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the symbols to the left and right depend on. At a document's ends: a word outside, that no window has."""
    far = np.int64(1) << 40
    left_low, left_high, right_low, right_high = s.low.copy(), s.high.copy(), s.low.copy(), s.high.copy()
    same = s.doc[1:] == s.doc[:-1]
    left_low[1:] = np.where(same, s.low[:-1], -far)
    left_high[1:] = np.where(same, s.high[:-1], s.high[1:])
    right_high[:-1] = np.where(same, s.high[1:], far)
    right_low[:-1] = np.where(same, s.low[1:], s.low[:-1])
    if len(s.name):
        left_low[0], right_high[-1] = -far, far
    return left_low, left_high, right_low, right_high


def name_runs(s: Symbols, k: int) -> Symbols:
    """Each maximal run of two or more equal symbols becomes one. Every symbol looks at both neighbours for that."""
    if not len(s.name):
        return s
    ll, lh, rl, rh = _neighbours(s)
    low, high = np.minimum(np.minimum(s.low, ll), rl), np.maximum(np.maximum(s.high, lh), rh)
    first = np.ones(len(s.name), bool)
    first[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(first)))
    name = np.where(n > 1, mix(s.name[at] * _RUN + n.astype(np.uint64) + np.uint64(k)), s.name[at])
    return Symbols(name, s.start[at], s.end[at + n - 1], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), s.doc[at])


def name_pairs(s: Symbols, k: int) -> Symbols:
    """Each pair of a left-half and a right-half symbol becomes one; the halves are drawn anew for each round."""
    if len(s.name) < 2:
        return s
    right = ((mix(s.name + np.uint64(k * int(_COIN) % 2**64)) >> np.uint64(17)) & np.uint64(1)).astype(bool)
    joined = np.zeros(len(s.name), bool)  # with the next
    joined[:-1] = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1])
    taken = np.zeros(len(s.name), bool)
    taken[1:] = joined[:-1]
    ll, lh, rl, rh = _neighbours(s)
    # one that stays alone has looked at the neighbour that it could have joined
    low = np.where(joined, np.minimum(s.low, rl), np.where(right, np.minimum(s.low, ll), np.minimum(s.low, rl)))
    high = np.where(joined, np.maximum(s.high, rh), np.where(right, np.maximum(s.high, lh), np.maximum(s.high, rh)))
    at = np.flatnonzero(~taken)
    both = joined[at]
    mate = np.minimum(at + 1, len(s.name) - 1)
    name = np.where(both, mix(s.name[at] * _PAIR + mix(s.name[mate] + np.uint64(k))), s.name[at])
    return Symbols(name, s.start[at], np.where(both, s.end[mate], s.end[at]), low[at], high[at], s.doc[at])


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of every round, the words first."""
    i = np.arange(len(words), dtype=np.int64)
    s = Symbols(words, i, i + 1, i, i + 1, doc)
    out = [s]
    for k in range(1, rounds + 1):
        s = name_pairs(name_runs(s, k), k)
        out.append(s)
    return out


class Stretches:
    """Hashes of stretches of words, from sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(words * np.multiply.accumulate(up)[:n], dtype=np.uint64)))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))


def window_anchors(words: np.ndarray, doc: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of window, key of its anchor, first word of its anchor) for every window of one document."""
    n = len(words)
    starts = np.flatnonzero(doc[: max(0, n - width + 1)] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    best, at = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.full(n, -1, np.int64)
    open_ = np.zeros(n, bool)
    open_[starts] = True
    levels, stretch = parse(words, doc, rounds), Stretches(words)
    for k in range(rounds, -1, -1):
        s = levels[k]
        left = np.concatenate(([0], np.cumsum(open_)))
        first, last = np.maximum(s.high - width, 0), s.low  # windows that hold what the symbol depends on
        may = np.flatnonzero((s.high - s.low <= width) & (last >= 0) & (last < n))
        may = may[left[last[may] + 1] > left[first[may]]]
        if not len(may):
            continue
        key = mix(s.name[may] + stretch(s.low[may], s.high[may]) + np.uint64(k + 1))
        order = np.lexsort((s.start[may], key))[::-1]  # painted last: the least key, leftmost
        count = (last[may] - first[may] + 1)[order]
        put = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[may][order], count)
        own = np.repeat(order, count)
        fill = open_[put]
        put, own = put[fill], own[fill]
        best[put] = key[own]
        at[put] = s.start[may][own]
        open_[put] = False
        if not open_.any():
            break
    return starts, best[starts], at[starts]
