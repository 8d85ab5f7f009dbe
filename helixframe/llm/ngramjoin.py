"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links make.

A document is the set of its distinct word n-grams (hashed). Sets of one size band that are similar enough differ in at
most k elements. The domain of n-grams is cut into n1 parts, and each part into n2 smaller ones; as k differences cannot
reach all parts, some part has at most k2 of them, and some n2 - k2 of its smaller parts have none. A signature is the
hash of a set's elements in such a choice of smaller parts, so linked sets share one. A set near the upper end of its
band also signs for the band above.

Signatures of few elements say little and would join sets that share a common line only. So there are ``spare`` parts
more than needed: a set that has at most so many parts with a weak signature leaves its weak signatures out (some strong
one is still shared); other sets keep all of theirs.

Sets are nodes, named by a hash of their elements; equal sets are one node from the first pass on. The members of each
signature are a group; groups of equal members are one. Within a group, members whose parity sketches allow a link are
joined (the sketch gives a lower bound of the number of differing elements, so no link is lost), and only a spanning
forest of these joins leaves the task. Groups cut into blocks of bounded rows; each pair of blocks is one unit of work.

What is so connected is a family: a group of near-copies, mostly. Links are found within families, exactly, by the same
search over the sets themselves; again a spanning forest of the links is all that is emitted.

Texts are read three times and stay where they are, but for those of families, whose sets are sent to their blocks.

Defined results: null or empty texts have no set and stay alone; fewer than n words make one n-gram, the whole sequence;
rows that repeat an id are one document if their sets are equal, else their groups are joined through the id; a null id
takes no part and has a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, small_or_shuffled, stored, with_keys
from helixframe.llm.components import connected_components
from helixframe.llm.textblocks import WordHasher, frugal, grams, mix, slices, text_bytes

#: Bounds of a family's block: sets and bytes of their elements; and of a signature group's.
BLOCK_SETS, BLOCK_BYTES, BLOCK_MEMBERS = 4096, 32 << 20, 4096
#: Rows that a task works on at once; a signature with more members than GIANT is passed on without gathering them.
_ROWS, GIANT = 200_000, 65_536
#: Words of a sketch.
_LEAST, _MOST = 4, 128


@dataclass(frozen=True)
class Scheme:
    """Similarity num / den and the enumeration for it."""

    num: int
    den: int
    k2: int
    n2: int
    weak: int
    spare: float
    growth: float = 1.5

    def tolerance(self, a, b):
        """Most differing elements of linked sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper ends of the bands up to ``largest``; the parts of each; the spare ones among them. No parts: equal sets only."""
        top = [1]
        while top[-1] < largest:
            top.append(max(top[-1] + 1, int(top[-1] * self.growth)))
        ends = np.array(top)
        k = self.tolerance(ends, ends)
        need = k // (self.k2 + 1) + 1
        spare = (need * self.spare).astype(np.int64) + 1
        return ends, np.where(k > 0, need + spare, 0), spare


def scheme(num: int, den: int) -> Scheme:
    return Scheme(num, den, 0, 1, 3, 0.1) if num / den >= 0.88 else Scheme(num, den, 1, 3, 2, 0.15)


def text_sets(column: pa.Array, hasher: WordHasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of the distinct n-grams of each text, sorted; shorter texts have one element for all their words."""
    raw, off = text_bytes(column)
    starts, ends, row = hasher.spans(raw, off)
    words = hasher.hashes(raw, starts, ends)
    g, doc, _ = grams(words, row, n)
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(count[i] + 1)
        for w in words[first[i] : first[i] + count[i]]:
            h = mix(np.array([h + w]))[0]
        g, doc = np.append(g, h), np.append(doc, i)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], g[keep]


def sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values by group, modulo 2**64."""
    low = np.bincount(group, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(row: np.ndarray, element: np.ndarray, n_rows: int, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for sets given as sorted (row, element)."""
    size = np.bincount(row, minlength=n_rows)
    ends, parts, spare = s.bands(int(size.max(initial=1)) * s.den // s.num + 1)
    band, top = np.searchsorted(ends, size), np.searchsorted(ends, size * s.den // s.num)
    out_row, out_sig = [], []
    x = mix(element + np.uint64(0x51ED270B))
    which, fine, value = (x >> np.uint64(33)).astype(np.int64), (x & np.uint64(0xFFFF)).astype(np.int64) % s.n2, mix(element)
    for up in range(int((top - band).max(initial=0)) + 1):
        b = band + up
        live = (size > 0) & (b <= top)
        n1 = np.where(live, parts[np.minimum(b, len(parts) - 1)], 0)
        base = np.cumsum(n1) - n1
        total = int(n1.sum())
        if not total:
            continue
        use = n1[row] > 0
        group = (base[row[use]] + which[use] % n1[row[use]]) * s.n2 + fine[use]
        value_of = sums(group, value[use], total * s.n2).reshape(total, s.n2)
        count_of = np.bincount(group, minlength=total * s.n2).reshape(total, s.n2)
        owner = np.repeat(np.arange(n_rows), n1)
        part = np.arange(total) - base[owner]
        picks = list(combinations(range(s.n2), s.n2 - s.k2))
        sig = [mix(value_of[:, p].sum(1, dtype=np.uint64) + mix((b[owner] * 64 + k).astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64))) for k, p in enumerate(picks)]
        weak = [count_of[:, p].sum(1) < s.weak for p in picks]
        poor = np.bincount(owner, np.any(weak, 0), n_rows)
        rich = poor <= spare[np.minimum(b, len(spare) - 1)]
        for g, w in zip(sig, weak, strict=True):
            keep = ~(w & rich[owner])
            out_row.append(owner[keep])
            out_sig.append(g[keep])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_sig)


def sketches(row: np.ndarray, element: np.ndarray, size: np.ndarray, s: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits of all sets, where each set begins): for classes of elements, is their number in the set odd.

    A set has about four times as many classes as a set of its size tolerates differing elements.
    """
    need = np.maximum(4 * s.tolerance(size, size), 1)
    width = np.clip(1 << np.ceil(np.log2(need / 64)).astype(np.int64).clip(0), _LEAST, _MOST)
    begin = np.concatenate(([0], np.cumsum(width)))
    kind = (mix(element + np.uint64(77)) & (width[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(begin[row] * 64 + kind, minlength=int(begin[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), begin


class Sketches:
    """Parity sketches of several sets, and a lower bound of how many elements differ."""

    def __init__(self, words: np.ndarray, begin: np.ndarray):
        self.words, self.begin, self.width = words, begin[:-1], np.diff(begin)

    def folded(self, at: np.ndarray, width: int) -> np.ndarray:
        """The sketches of some sets at a width that none of them is below: classes that fall together are added."""
        out = np.empty((len(at), width), np.uint64)
        for w in np.unique(self.width[at]):
            these = np.flatnonzero(self.width[at] == w)
            rows = self.words[self.begin[at[these], None] + np.arange(w)]
            out[these] = np.bitwise_xor.reduce(rows.reshape(len(these), w // width, width), 1)
        return out

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For pairs of sets: at least so many elements are in one of the two only."""
        out, least = np.zeros(len(x), np.int64), np.minimum(self.width[x], self.width[y])
        for w in np.unique(least):
            these = np.flatnonzero(least == w)
            step = max(1, (1 << 20) // int(w))
            for part in (these[i : i + step] for i in range(0, len(these), step)):
                out[part] = np.bitwise_count(self.folded(x[part], int(w)) ^ self.folded(y[part], int(w))).sum(1)
        return out


def may_link(a, b, apart, s: Scheme):
    """Can sets of sizes a and b that differ in at least ``apart`` elements link?"""
    return (apart <= s.tolerance(a, b)) & (s.num * np.maximum(a, b) <= s.den * np.minimum(a, b))


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of a graph whose neighbours ``near(node, among)`` tells. side: only pairs of different sides count."""
    out: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            u = todo.pop()
            among = np.ones(len(left), bool) if side is None else side[left] != side[u]
            at = np.flatnonzero(among)
            hit = at[near(u, left[at])] if len(at) else at
            found = left[hit]
            out += [(u, int(v)) for v in found]
            todo += found.tolist()
            left = np.delete(left, hit)
    return out


def links(sets: list[np.ndarray], s: Scheme, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sorted sets; with sides, of those between sets of different sides."""
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    words, cut = sketches(np.repeat(np.arange(len(sets)), size), flat, size, s)
    narrow = Sketches(words, cut)
    least = int(narrow.width.min(initial=_MOST))
    rows = narrow.folded(np.arange(len(sets)), least)

    def near(u: int, among: np.ndarray) -> np.ndarray:
        may = may_link(size[u], size[among], np.bitwise_count(rows[among] ^ rows[u]).sum(1, dtype=np.int64), s)
        at = np.flatnonzero(may)
        own = sets[u]
        for part in (at[i : i + 256] for i in range(0, len(at), 256)):
            v = among[part]
            who = np.repeat(np.arange(len(v)), size[v])
            there = flat[np.arange(len(who)) + np.repeat(begin[v] - (np.cumsum(size[v]) - size[v]), size[v])]
            place = np.minimum(np.searchsorted(own, there), len(own) - 1)
            both = np.bincount(who, own[place] == there, len(v)).astype(np.int64)
            may[part] = s.den * both >= s.num * (size[u] + size[v] - both)
        return may

    return spread(len(sets), near, side)


def _facts(n: int, s: Scheme, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHasher(3, lower=True)
        for batch in batches:
            for b in slices(batch, "text"):
                row, g = text_sets(b.column("text"), h, n)
                size = np.bincount(row, minlength=len(b)).astype(np.int64)
                s1, s2 = set_names(row, g, len(b), seed)
                words, begin = sketches(row, g, size, s)
                yield pa.record_batch([b.column("doc_id"), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _binary(words, begin * 8)], names=["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return run


def set_names(row: np.ndarray, element: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set. The first names it as a node."""
    return mix(sums(row, mix(element + np.uint64(seed)), n)), sums(row, mix(element ^ np.uint64(0x5DEECE66D)), n)


def _binary(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column, and where each value begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data.slice(int(off[0]), int(off[-1] - off[0])), kind) if data is not None else np.zeros(0, kind)
    return flat, (off - off[0]) // size


def _signature_rows(n: int, s: Scheme, seed: int):
    """(sig, node) of each different set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, signed = WordHasher(3, lower=True), set()
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                row, g = text_sets(b.column("text"), h, n)
                node = set_names(row, g, len(b), seed)[0]
                new = np.zeros(len(b), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in signed:
                        signed.add(x)
                        new[i] = True
                at, sig = signatures(row[new[row]], g[new[row]], len(b), s)
                for i in range(0, len(at), _ROWS):
                    yield pa.record_batch([pa.array(sig[i : i + _ROWS].view(np.int64)), pa.array(node[at[i : i + _ROWS]].view(np.int64))], names=["sig", "node"])

    return run


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, n): the members of each signature that has several, once for each set of members; n is their number.

    Rows come sorted by (sig, node). The members of a giant signature pass by under its own name, with a null n.
    """
    seen: set[int] = set()

    def out(grp: np.ndarray, node: np.ndarray, n: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(grp), _ROWS):
            part = slice(i, i + _ROWS)
            yield pa.record_batch([pa.array(grp[part].view(np.int64)), pa.array(node[part]), pa.nulls(len(grp[part]), pa.int64()) if n is None else pa.array(n[part])], names=["grp", "node", "n"])

    def whole(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        n = np.diff(np.append(first, len(sig)))
        name = mix(np.add.reduceat(mix(node.view(np.uint64)), first) + n.astype(np.uint64))
        use = np.flatnonzero(n > 1)
        use = use[np.unique(name[use], return_index=True)[1]]
        if len(seen) > _ROWS:
            seen.clear()
        fresh = []
        for k, x in zip(use.tolist(), name[use].tolist(), strict=True):
            if x not in seen:
                seen.add(x)
                fresh.append(k)
        use = np.array(fresh, np.int64)
        at = np.arange(n[use].sum()) + np.repeat(first[use] - (np.cumsum(n[use]) - n[use]), n[use])
        yield from out(np.repeat(name[use], n[use]), node[at], np.repeat(n[use], n[use]))

    sig, node, giant = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    kept: list[pa.RecordBatch] = []

    def gathered() -> tuple[np.ndarray, np.ndarray]:
        more = [(b.column("sig").to_numpy(), b.column("node").to_numpy()) for b in kept]
        kept.clear()
        return np.concatenate([sig, *(x for x, _ in more)]), np.concatenate([node, *(x for _, x in more)])

    for b in batches:
        kept.append(b)
        if sum(map(len, kept)) < _ROWS:
            continue
        sig, node = gathered()
        if giant is not None:
            end = int(np.argmax(sig != giant)) if (sig != giant).any() else len(sig)
            yield from out(sig[:end], node[:end], None)
            sig, node = sig[end:], node[end:]
            if not len(sig):
                continue
            giant = None
        last = len(sig) - int(np.argmax(sig[::-1] != sig[-1])) if sig[0] != sig[-1] else 0
        if last:
            yield from whole(sig[:last], node[:last])
        sig, node = sig[last:], node[last:]
        if len(sig) > GIANT:
            giant = sig[0]
            yield from out(sig, node, None)
            sig, node = sig[:0], node[:0]
    sig, node = gathered()
    if giant is not None:
        end = int(np.argmax(sig != giant)) if (sig != giant).any() else len(sig)
        yield from out(sig[:end], node[:end], None)
        sig, node = sig[end:], node[end:]
    if len(sig):
        yield from whole(sig, node)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, so many at once at least, with no group of equal keys cut."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        kept.append(b)
        if sum(map(len, kept)) < rows:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        other = np.zeros(len(t), bool)
        for k in keys:
            c = t.column(k).to_numpy()
            other |= c != c[-1]
        cut = len(t) - int(np.argmax(other[::-1])) if other.any() else 0
        if cut:
            yield t.slice(0, cut)
        kept = t.slice(cut).to_batches()
    if kept and (t := pa.Table.from_batches(kept).combine_chunks()).num_rows:
        yield t


def near_pairs(key: np.ndarray, side: np.ndarray, size: np.ndarray, sk: Sketches, s: Scheme, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what may link within each run of equal keys; where a run has two sides, across them."""
    n = len(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(first, n))
    two = np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first)
    big = (count > small) | two
    xs, ys = [], []
    for f, c, t in zip(first[big].tolist(), count[big].tolist(), two[big].tolist(), strict=True):
        own = np.arange(f, f + c)
        rows, a = sk.folded(own, int(sk.width[own].min())), size[own]
        near = lambda u, among: may_link(a[u], a[among], np.bitwise_count(rows[among] ^ rows[u]).sum(1, dtype=np.int64), s)  # noqa: B023, E731
        found = np.array(spread(c, near, side[own] if t else None), np.int64).reshape(-1, 2)
        xs.append(found[:, 0] + f)
        ys.append(found[:, 1] + f)
    # all pairs of the small ones, by distance; of these a forest
    end = np.repeat(np.where(big, 0, first + count), count)
    px, py = [], []
    for d in range(1, int(count[~big].max(initial=1))):
        x = np.flatnonzero(np.arange(n) + d < end)
        x = x[s.num * np.maximum(size[x], size[x + d]) <= s.den * np.minimum(size[x], size[x + d])]
        x = x[sk.apart(x, x + d) <= s.tolerance(size[x], size[x + d])]
        px.append(x)
        py.append(x + d)
    if px:
        x, y, label = np.concatenate(px), np.concatenate(py), np.arange(n)
        while len(x):
            least = np.minimum(label[x], label[y])
            if (label[x] == least).all() and (label[y] == least).all():
                break
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
        moved = np.flatnonzero(label != np.arange(n))
        xs.append(moved)
        ys.append(label[moved])
    return np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)])


def _near_rows(s: Scheme):
    """Rows come sorted by (grp, i, j, block, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("grp", "i", "j"), 20_000):
            b = t.to_batches()[0]
            grp, i, j, block, node, size = (b.column(c).to_numpy().astype(np.int64) for c in ("grp", "i", "j", "block", "node", "n_shingles"))
            new = np.ones(len(b), bool)  # a group of equal members can come from several tasks
            new[1:] = (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (node[1:] != node[:-1])
            key = np.cumsum(np.concatenate(([0], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))[new]
            words, begin = _bytes(b.column("sketch"), np.uint64)
            sk = Sketches(words, begin)
            sk.begin, sk.width, node, size = sk.begin[new], sk.width[new], node[new], size[new]
            x, y = near_pairs(key, block[new], size, sk, s)
            if len(x):
                pairs = np.unique(np.stack((node[x], node[y]), 1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _set_rows(n: int, seed: int):
    """The sets of the texts that are members of families. An id can have several texts: only that of its node counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHasher(3, lower=True)
        for batch in batches:
            for b in slices(batch, "text"):
                row, g = text_sets(b.column("text"), h, n)
                cut = np.searchsorted(row, np.arange(len(b) + 1))
                own = pa.array(set_names(row, g, len(b), seed)[0].view(np.int64) == b.column("node").to_numpy())
                names = ["family", "g", "node", "rep"]
                yield pa.record_batch([*(b.column(c) for c in names), _binary(g, cut * 8)], names=[*names, "elements"]).filter(own)

    return run


def _link_rows(s: Scheme):
    """Rows come sorted by (family, i, j); a group is held in memory, two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ("family", "i", "j"), 2_000):
            b, out = t.to_batches()[0], []
            family, i, j, block, rep = (b.column(c).to_numpy().astype(np.int64) for c in ("family", "i", "j", "block", "rep"))
            flat, begin = _bytes(b.column("elements"), np.uint64)
            edge = np.flatnonzero(np.concatenate(([True], (family[1:] != family[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            for x, y in zip(edge, np.append(edge[1:], len(b)), strict=True):
                sets = [flat[begin[k] : begin[k + 1]] for k in range(x, y)]
                found = links(sets, s, None if i[x] == j[x] else block[x:y])
                out += [(rep[x + u], rep[x + v]) for u, v in found]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, g: str) -> DataFrame:
    """Each row once for every pair of blocks (i, j) that its own block is part of; ``g`` blocks make up its key."""
    own = F.pmod(F.xxhash64("node"), F.col(g)).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(g) - 1).cast("int"))))
    return rows.drop(g).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


def _named(own: DataFrame, n: int, s: Scheme) -> tuple[DataFrame, int]:
    """The sets of all rows, named so that no two different ones have one name, and the seed of the names."""
    seed = 0
    while True:
        facts = stored(own.sparkSession, own.mapInArrow(frugal(_facts(n, s, seed)), "doc_id long, n_shingles long, s1 long, s2 long, sketch binary"), "sets")
        if facts.filter("n_shingles > 0").groupBy("s1").agg(F.min("s2").alias("x"), F.max("s2").alias("y")).filter("x <> y").isEmpty():
            return facts, seed
        discard(facts)
        seed += 1


def groups(docs: DataFrame, *, num: int = 8, den: int = 10, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; sets link when intersection / union >= num / den."""
    spark, s = docs.sparkSession, scheme(num, den)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts, seed = _named(own, n, s)
    real = facts.filter("n_shingles > 0 and doc_id is not null")
    # the least id of each set stands for it
    nodes = stored(spark, real.groupBy(F.col("s1").alias("node")).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = own.filter("doc_id is not null and text is not null").mapInArrow(frugal(_signature_rows(n, s, seed)), "sig long, node long")
    grouped = signed.repartition(parts, "sig").sortWithinPartitions("sig", "node").mapInArrow(frugal(_group_rows), "grp long, node long, n long")
    grouped = stored(spark, grouped, "groups")
    giant = grouped.filter("n is null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    giant_n = giant.count()
    sized = grouped.filter("n is not null").unionByName(grouped.filter("n is null").drop("n").join(small_or_shuffled(giant, giant_n), "grp"))
    sized = sized.withColumn("g", F.ceil(F.col("n") / BLOCK_MEMBERS)).drop("n").join(nodes.drop("rep"), "node")
    near = _dealt(sized, "g").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block", "node")
    families = connected_components(near.select("grp", "i", "j", "block", "node", "n_shingles", "sketch").mapInArrow(frugal(_near_rows(s)), "a long, b long"))
    discard(grouped)
    members = families.select("node", F.col("component").alias("family")).join(nodes.drop("sketch"), "node")
    blocks = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int").alias("g"))
    members = stored(spark, members.join(blocks, "family").select(F.col("rep").alias("doc_id"), "rep", "node", "family", "g"), "members")
    held = with_keys(own.filter("text is not null"), members, ["doc_id"], members.count(), 48)
    held = held.select("family", "g", "node", "rep", "text").mapInArrow(frugal(_set_rows(n, seed)), "family long, g int, node long, rep long, elements binary")
    dealt = _dealt(held, "g").repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "rep")
    found = dealt.select("family", "i", "j", "block", "rep", "elements").mapInArrow(frugal(_link_rows(s)), "a long, b long")
    # an id that several sets have joins them
    owned = real.select("doc_id", F.col("s1").alias("node")).distinct().join(nodes.select("node", "rep"), "node").filter("rep <> doc_id").select("doc_id", "rep")
    owned = owned.unionByName(nodes.select(F.col("rep").alias("doc_id"), "rep"))
    several = owned.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    shared = owned.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    joined = connected_components(found.union(shared))
    labels = stored(spark, nodes.select("node", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("node").alias("s1"), F.coalesce("component", "rep").alias("component")), "classes")
    alone = F.col("n_shingles") == 0
    out = facts.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & ~alone, F.col("s1")).alias("s1")).join(small_or_shuffled(labels, labels.count()), "s1", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
