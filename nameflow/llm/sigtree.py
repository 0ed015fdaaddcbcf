"""N-gram Jaccard join by signature trees, exact for its threshold.

1. Every document's set of word shingles becomes sorted 64-bit fingerprints; documents of equal sets are
   one class, known by a fingerprint of the set.
2. Two sets that reach the threshold share a minimum number of their lowest shingles (prefix filter with
   overlap).  Classes whose prefix has fewer shingles in common with all other classes together cannot link;
   what remains are the survivors.  Shingles travel as compressed arrays, a row per slice of
   documents and shard of shingles; a shingle repeated in a slice is sent once.
3. Survivors order their shingles from the rarest (frequency among survivors) and tie to others through the
   first of them: the components of that graph are blocks, so a passage of any number of documents puts
   none of them together.
4. In a block the sets are leaves of a signature tree.  A node holds its subtree's range of set sizes and its
   OR-combined bitmap of hashed shingles, with the highest multiplicity per bit.  A dual traversal drops pairs of
   nodes whose sizes are too far apart, whose bitmaps cannot overlap enough, or whose documents are
   all one component already; what reaches the leaves is compared exactly.  It goes depth first over batches of PAIRS
   node pairs, so its memory does not grow with the pairs.  Blocks of more than CHUNK sets or CHUNK_TOKENS shingles
   are cut by set size and lowest shingle into chunks; a chunk's root is a node like any other, pairs of roots
   that may overlap enough are found first, and only those chunks are joined, each pair in a task of its own.
5. The links, a spanning forest of each block, give the components.

Defined results: null and empty texts have an empty set, link with nothing and are their own
component; rows of a null id have a null component and link with nothing; rows of one id are one node;
repeated rows stay repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .blobs import pack, steps, totals, unpack
from .components import components
from .shared import parallelism, remove, session, shared_folder, split_join, written

#: Sets, and shingles of them, per task side beyond which a block is cut.
CHUNK, CHUNK_TOKENS = 4000, 2_000_000
#: Bits of a chunk's root; in a task's own tree they follow the sizes of its sets.
ROOT_BINS = 4096
FANOUT = 8
#: Pairs of nodes that are looked at together.
PAIRS = 4096
#: Shingles that a task sends off together.
BUNDLE = 1_500_000
#: Tasks over which the pairs of roots of one block are dealt.
ROOT_SALTS = 16


class Threshold:
    """Links of percent * |A or B| <= 100 * |A and B|."""

    def __init__(self, percent: int):
        self.p = percent

    def least(self, n):
        """Shingles that a set of n shares at least with any that it links with, which has as many at least."""
        return (self.p * n + 99) // 100

    def overlap(self, total):
        """Shingles in common that two sets of so many together need."""
        return -(-self.p * total // (100 + self.p))

    def prefix(self, n):
        """(length of the prefix, shingles of it that must be shared)"""
        spare = n - self.least(n)
        return np.minimum(n, spare + 1 + spare), 1 + self.least(n) - self.least(self.least(n))


def sets(part: tx.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle fingerprints of each row end to end, first of each row)"""
    words = part.words()
    g, doc = tx.grams(words.hashes(), words, n, short=True)
    first = np.searchsorted(doc, np.arange(len(part) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        g[a:b].sort()
    keep = np.ones(len(g), dtype=bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[keep], np.searchsorted(doc[keep], np.arange(len(part) + 1))


def set_fingerprints(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first).astype(tx.U64)
    a = tx.mix(tx.sums_by(first, tx.mix(g ^ tx.U64(tx.GRAM[50]))) + n * tx.U64(tx.GRAM[51]))
    b = tx.mix(tx.sums_by(first, tx.mix(g + tx.U64(tx.GRAM[52]))) ^ n)
    return a.view(np.int64), b.view(np.int64)


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.slices(b.column(1)):
                g, first = sets(part, n)
                fa, fb = set_fingerprints(g, first)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(int(part.rows[0]), len(part)), pa.array(np.diff(first)), pa.array(fa), pa.array(fb)], names=["doc_id", "n", "fa", "fb"])

    return run


def _send(shards: int, tokens: np.ndarray, owner: np.ndarray, **more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs by shard: a shard's tokens (their upper 32 bits, sorted) and their owners."""
    shard = (tokens % tx.U64(shards)).astype(np.int64)
    key = (shard << 32) | (tokens >> tx.U64(32)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, own = key[order], owner[order]
    at = np.searchsorted(key, np.arange(shards + 1) << 32)
    for s in range(shards):
        a, b = int(at[s]), int(at[s + 1])
        if a < b:
            yield s, pack(key=steps(key[a:b] & 0xFFFFFFFF), owner=own[a:b], **more)


def _prefixes(n: int, limit: Threshold, shards: int):
    """Blobs (shard, prefix shingles with their classes) of the distinct sets of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, ...]] = []

        def bundle() -> pa.RecordBatch:
            tokens, take, fa, fb, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            got = list(_send(shards, tokens, np.repeat(np.arange(len(take)), take), fa=fa, fb=fb, n=size))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for part in tx.slices(b.column(0)):
                g, first = sets(part, n)
                fa, fb = set_fingerprints(g, first)
                size = np.diff(first)
                if len(sent) > 1_000_000:
                    sent.clear()
                rows = []
                for k, f in enumerate(zip(fa.tolist(), fb.tolist(), strict=True)):
                    if size[k] and f not in sent:
                        sent.add(f)
                        rows.append(k)
                if not rows:
                    continue
                rows = np.array(rows)
                take, _ = limit.prefix(size[rows])
                held.append((tx.gather(g, first[rows], take), take, fa[rows], fb[rows], size[rows]))
                if sum(len(h[0]) for h in held) > BUNDLE:
                    yield bundle()
        if held:
            yield bundle()

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each entry's run, first entry of each run) of a sorted array"""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fa, fb, n, shared): how many of a class's prefix shingles of these shards other classes have too."""
    by: dict[int, list[bytes]] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by.setdefault(s, []).append(x)
    for s in list(by):
        key, owner, classes = _numbered(by.pop(s))
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        keep = np.ones(len(key), dtype=bool)
        keep[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner = key[keep], owner[keep]
        run, first = _runs(key)
        several = np.diff(np.append(first, len(key)))[run] > 1
        count = np.bincount(owner[several], minlength=len(classes))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([*(pa.array(classes[f][some]) for f in ("fa", "fb", "n")), pa.array(count[some], pa.int64())], names=["fa", "fb", "n", "shared"])


def _numbered(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, number of its class) of every entry of a shard, and the classes"""
    parts, at = [], 0
    kind = [("fa", np.int64), ("fb", np.int64), ("n", np.int64)]
    for x in blobs:
        got = unpack(x)
        own = np.empty(len(got["fa"]), kind)
        for f, _ in kind:
            own[f] = got[f].astype(np.int64)
        parts.append((totals(got["key"]).astype(np.uint32), (got["owner"] + at).astype(np.int32), own))
        at += len(own)
    classes, number = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
    owner = np.concatenate([p[1] for p in parts])
    return np.concatenate([p[0] for p in parts]), number.astype(np.int32)[owner], classes


_SLICE = "slice bigint, ids binary, blob binary"


def _survivor_sets(n: int):
    """Rows of many survivors each: their ids and sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in tx.slices(b.column(1)):
                g, first = sets(part, n)
                ids = b.column(0).slice(int(part.rows[0]), len(part)).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([ids.tobytes()], pa.binary()), pa.array([_pack_sets(g, first)], pa.binary())], names=["slice", "ids", "blob"])
                at += 1

    return run


def _pack_sets(g: np.ndarray, first: np.ndarray) -> bytes:
    return pack(n=np.diff(first), g=g)


def _unpack_sets(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    got = unpack(blob)
    return got["g"].astype(tx.U64) if got["g"].dtype != tx.U64 else got["g"], np.concatenate([[0], np.cumsum(got["n"])]).astype(np.int64)


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, _ = _unpack_sets(blob)
                got = list(_send(shards, g, np.zeros(len(g), np.int8)))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int32()), pa.array([at] * len(got), pa.int64()), pa.array([x for _, x in got], pa.binary())], names=["shard", "slice", "blob"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies among survivors (at most 65535 counts on), in the order asked."""
    by: dict[int, list] = {}
    for b in batches:
        for s, at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            by.setdefault(s, []).append((at, totals(unpack(x)["key"])))
    for s in list(by):
        group = by.pop(s)
        key = np.concatenate([k for _, k in group])
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        df = np.minimum(count, 65535)[inverse]
        ends = np.cumsum([len(k) for _, k in group])
        blobs = [pack(df=df[e - len(k) : e]) for e, (_, k) in zip(ends.tolist(), group, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([s] * len(group), pa.int32()), pa.array([at for at, _ in group], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "slice", "blob"])


_TIE = "token bigint, u bigint, v bigint"


def _ties(limit: Threshold, shards: int):
    """From slices with their answers: ties of documents to their rarest shingles.  Within a slice
    documents of one shingle are tied at once and only the first goes on with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, blob, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(ids, dtype="<i8")
                g, first = _unpack_sets(blob)
                key = ((g % tx.U64(shards)).astype(np.int64) << 32) | (g >> tx.U64(32)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                df = np.empty(len(g), np.int64)
                df[order] = np.concatenate([unpack(a["blob"])["df"] for a in sorted(answers, key=lambda a: a["shard"])])
                doc = np.repeat(np.arange(len(ids)), np.diff(first))
                order = np.lexsort((g, df, doc))
                n = np.diff(first)
                rank = np.arange(len(g)) - np.repeat(first[:-1], n)
                keep = order[rank < np.repeat(n - limit.least(n) + 1, n)]
                keep = keep[df[keep] > 1]
                token, who = g[keep].view(np.int64), ids[doc[keep]]
                order = np.lexsort((who, token))
                token, who = token[order], who[order]
                number, start = _runs(token)
                lead = who[start][number]
                edge = np.unique(np.stack([who[who != lead], lead[who != lead]]), axis=1)
                m = len(start)
                u, v = np.concatenate([who[start], edge[0]]), np.concatenate([who[start], edge[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token[start], edge[0]])), pa.array(u), pa.array(v)], names=["token", "u", "v"]) if m else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["token", "u", "v"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[], [], []]
    for b in batches:
        for k in range(3):
            held[k].append(b.column(k).to_numpy())
    if not held[0]:
        return
    token, u, v = (np.concatenate(x) for x in held)
    own = u == v  # a document with its shingle
    order = np.lexsort((u[own], token[own]))
    t, who = token[own][order], u[own][order]
    number, start = _runs(t)
    lead = who[start][number]
    edge = np.concatenate([np.stack([who, lead])[:, who != lead], np.stack([u[~own], v[~own]])], axis=1)
    edge = np.unique(edge, axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(edge[0]), pa.array(edge[1])], names=["u", "v"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, n, x) of every survivor; x: how far its lowest shingle lies in the distribution of the lowest of n, so alike
    for near copies, and even over 0 to 1 for others."""
    for b in batches:
        for ids, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            g, first = _unpack_sets(blob)
            n = np.diff(first)
            lowest = g[first[:-1]].astype(np.float64) / 2.0**64
            x = -np.expm1(n * np.log1p(-np.minimum(lowest, 1 - 1e-12)))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, dtype="<i8")), pa.array(n), pa.array(x)], names=["u", "n", "x"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, tokens) of every survivor."""
    for b in batches:
        for ids, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            g, first = _unpack_sets(blob)
            ids = np.frombuffer(ids, dtype="<i8")
            raw = pa.py_buffer(np.ascontiguousarray(g, dtype="<u8"))
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(first * 8), raw]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), tokens], names=["u", "tokens"])


class SignatureTree:
    """Levels of nodes over sets, the leaves first; FANOUT consecutive nodes form one of the next level."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.low, self.high, self.bits = [sizes], [sizes], [bits]
        while len(self.low[-1]) > FANOUT:
            cut = np.arange(0, len(self.low[-1]), FANOUT)
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.bits.append(np.maximum.reduceat(self.bits[-1], cut, axis=0))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, limit: Threshold) -> np.ndarray:
        """Whether a pair of sets under the nodes i and j may link."""
        low, high, bits = self.low[level], self.high[level], self.bits[level]
        need = needed(low[i], low[j], limit)
        ok = np.minimum(high[i], high[j]) >= need
        step = max(1, (1 << 22) // bits.shape[1])
        for a in range(0, len(i), step):
            k = np.flatnonzero(ok[a : a + step]) + a
            ok[k] = np.minimum(bits[i[k]], bits[j[k]]).sum(axis=1, dtype=np.int64) >= need[k]
        return ok


def needed(low_i: np.ndarray, low_j: np.ndarray, limit: Threshold) -> np.ndarray:
    """Shingles in common that sets of so many at least need."""
    return np.maximum(limit.overlap(low_i + low_j), np.maximum(limit.least(low_i), limit.least(low_j)))


def bitmaps(tokens: list[np.ndarray], n: np.ndarray, bins: int) -> np.ndarray:
    """[set, bit]: how many of a set's shingles hash to each bit"""
    cell = np.repeat(np.arange(len(tokens)) * bins, n) + (tx.mix(np.concatenate(tokens)) % tx.U64(bins)).astype(np.int64)
    return np.bincount(cell, minlength=len(tokens) * bins).reshape(-1, bins).astype(np.uint16 if n.max() < 65536 else np.uint32)


def block_links(tokens: list[np.ndarray], limit: Threshold, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted token sets.  cross: with it, only pairs of unequal
    values need to be linked (others are another task's)."""
    # near sets side by side: by their lowest shingles
    order = np.array(sorted(range(len(tokens)), key=lambda k: tokens[k][:2].tolist()))
    tokens = [tokens[k] for k in order.tolist()]
    n = np.array([len(t) for t in tokens], dtype=np.int64)
    side = cross[order] if cross is not None else None
    root = list(range(len(tokens)))
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a == b or 100 * min(n[x], n[y]) < limit.p * max(n[x], n[y]):
            return
        s, t = (tokens[x], tokens[y]) if n[x] <= n[y] else (tokens[y], tokens[x])
        at = np.searchsorted(t, s)
        both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        if 100 * both >= limit.p * (n[x] + n[y] - both):
            root[max(a, b)] = min(a, b)
            out.append((x, y))

    def labels(level: int) -> np.ndarray:
        """The component of each node's sets, or -1 if they have several"""
        label = np.array(root)
        while (label != (up := label[label])).any():
            label = up
        for _ in range(level):
            cut = np.arange(0, len(label), FANOUT)
            lo, hi = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
            label = np.where(lo == hi, lo, -1)
        return label

    # twice the mean size in bits keeps chance overlaps low, whatever the sets' sizes
    tree = SignatureTree(n, bitmaps(tokens, n, 1 << max(6, int(2 * n.mean()).bit_length())))
    if len(tokens) > FANOUT:
        # links between neighbours first: what is one component needs no further look
        for x in range(1, len(tokens)):
            join(x, x - 1)
            if x % FANOUT == 0 and x >= FANOUT:
                join(x, x - FANOUT)
            if find(x) != find(0):
                join(x, 0)
    a, b = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
    level = len(tree.low) - 1
    todo = [(level, *np.triu_indices(len(tree.low[level])))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > PAIRS:
            todo.append((level, i[PAIRS:], j[PAIRS:]))
            i, j = i[:PAIRS], j[:PAIRS]
        label = labels(level)
        keep = (label[i] != label[j]) | (label[i] < 0)
        i, j = i[keep], j[keep]
        keep = tree.possible(level, i, j, limit)
        i, j = i[keep], j[keep]
        if level:
            x, y = (i[:, None] * FANOUT + a).ravel(), (j[:, None] * FANOUT + b).ravel()
            below = len(tree.low[level - 1])
            keep = (x < below) & (y < below) & (x <= y)
            todo.append((level - 1, x[keep], y[keep]))
            continue
        keep = i != j
        if side is not None:
            keep &= side[i] != side[j]
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            join(x, y)
    return [(int(order[x]), int(order[y])) for x, y in out]


def _join_blocks(limit: Threshold):
    """Rows (task key, u, side, tokens) sorted by key: links of every task's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, tokens = None, [], [], []

        def done() -> tuple[list, list]:
            if len(ids) < 2:
                return [], []
            cross = np.array(sides) if min(sides) != max(sides) else None
            if cross is None and sides[0] > 0:
                return [], []
            got = block_links(tokens, limit, cross)
            return [ids[x] for x, _ in got], [ids[y] for _, y in got]

        for b in batches:
            u, v = [], []
            for k, i, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if k != key:
                    x, y = done()
                    u += x
                    v += y
                    key, ids, sides, tokens = k, [], [], []
                ids.append(i)
                sides.append(s)
                tokens.append(np.frombuffer(t, dtype="<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        u, v = done()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


_ROOT = "block bigint, chunk string, grade int, low bigint, high bigint, bits binary"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, chunk, grade, tokens), those of a chunk together: its root's range of sizes and bitmap."""
    key, low, high, bits = None, 0, 0, None

    def row() -> pa.RecordBatch:
        (block, chunk, grade), types = key, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        values = (block, chunk, grade, low, high, bits.astype("<u2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in _ROOT.split(", ")])

    for b in batches:
        for block, chunk, grade, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (block, chunk, grade) != key:
                if key:
                    yield row()
                key, low, high, bits = (block, chunk, grade), 1 << 60, 0, np.zeros(ROOT_BINS, np.int64)
            own = np.frombuffer(t, dtype="<u8")
            low, high = min(low, len(own)), max(high, len(own))
            # a root holds multiplicities up to 65535; a bit beyond that counts as full for any pair
            more = np.bincount((tx.mix(own) % tx.U64(ROOT_BINS)).astype(np.int64), minlength=ROOT_BINS)
            bits = np.maximum(bits, np.minimum(more, 65535))
    if key:
        yield row()


def _root_pairs(limit: Threshold):
    """Rows (block, a, b, and both roots): the pairs of chunks whose roots may overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low_a, high_a, low_b, high_b = (b.column(k).to_numpy() for k in (3, 4, 6, 7))
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u2").reshape(-1, ROOT_BINS) for k in (5, 8))
            both = np.minimum(x, y)
            need = needed(low_a, low_b, limit)
            ok = (np.minimum(high_a, high_b) >= need) & ((both.sum(axis=1, dtype=np.int64) >= need) | (both == 65535).any(axis=1))
            yield b.select([0, 1, 2]).filter(pa.array(ok))

    return run


def _block_tasks(members: DataFrame, single: DataFrame, limit: Threshold, shards: int, folder: str) -> DataFrame:
    """members (u, n, x, block) -> (task, u, side, tokens): the sets of every task.  Sides: equal
    0: all pairs of the task; 1 and 2: pairs of unequal sides."""
    ratio = 100 / limit.p
    grade = F.floor(F.log(ratio, F.col("n").cast("double")) + F.lit(1e-9)).cast("int")
    sized = members.withColumn("grade", grade)
    pieces = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_TOKENS)).cast("int")
    counted = lambda df, by, name: written(df.groupBy(*by).agg(pieces.alias(name), F.count("*").alias("all")), f"{folder}/{name}")
    blocks = counted(sized, ["block"], "pieces")
    sized = split_join(sized, blocks.where("all > 1"), ["block"], "all").drop("all")
    whole = sized.where("pieces = 1").select("u", F.col("block").cast("string").alias("task"), F.lit(0).alias("side"))
    whole = whole.join(single, "u").select("task", "u", "side", "tokens")
    if not blocks.where("pieces > 1").limit(1).count():
        return whole
    # by size, then by lowest shingle, then (many sets of one lowest shingle) by id
    big = sized.where("pieces > 1").drop("pieces")
    cell = ["block", "grade"]
    big = split_join(big, counted(big, cell, "q"), cell, "all").drop("all").withColumn("slot", F.least(F.floor(F.col("x") * F.col("q")), F.col("q") - 1).cast("int"))
    cell = ["block", "grade", "slot"]
    big = split_join(big, counted(big, cell, "r"), cell, "all")
    chunk = F.concat_ws(":", "grade", "slot", F.pmod(F.xxhash64("u"), F.col("r")))
    cut = written(big.select("u", "block", "grade", chunk.alias("chunk")).distinct().join(single, "u").repartition(shards, "block", "chunk").sortWithinPartitions("block", "chunk"), f"{folder}/chunks")
    roots = written(cut.select("block", "chunk", "grade", "tokens").repartition(shards, "block", "chunk").sortWithinPartitions("block", "chunk").mapInArrow(_roots, _ROOT), f"{folder}/roots")
    a = roots.select("block", *(F.col(c).alias(f"{c}_a") for c in ("chunk", "grade", "low", "high", "bits")))
    b = roots.select("block", *(F.col(c).alias(f"{c}_b") for c in ("chunk", "grade", "low", "high", "bits")))
    # sizes of linked sets are at most one grade apart, up to rounding: two grades are joined with each
    a = a.withColumn("salt", F.pmod(F.xxhash64("chunk_a"), F.lit(ROOT_SALTS)).cast("int"))
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ROOT_SALTS - 1))))
    near = a.join(b, ["block", "salt"]).where("grade_b between grade_a and grade_a + 2 and (grade_a < grade_b or chunk_a <= chunk_b)")
    near = near.select("block", "chunk_a", "chunk_b", "low_a", "high_a", "bits_a", "low_b", "high_b", "bits_b").mapInArrow(_root_pairs(limit), "block bigint, chunk_a string, chunk_b string")
    sides = F.when(F.col("chunk_a") == F.col("chunk_b"), F.array(F.struct(F.col("chunk_a").alias("chunk"), F.lit(0).alias("side"))))
    sides = sides.otherwise(F.array(F.struct(F.col("chunk_a").alias("chunk"), F.lit(1).alias("side")), F.struct(F.col("chunk_b").alias("chunk"), F.lit(2).alias("side"))))
    plan = near.select("block", F.concat_ws("|", "block", "chunk_a", "chunk_b").alias("task"), F.explode(sides).alias("s")).select("block", "task", "s.chunk", "s.side")
    split = cut.join(plan, ["block", "chunk"]).select("task", "u", "side", "tokens")
    return whole.union(split)


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach (docs as given, a row each)."""
    spark, limit = session(docs), Threshold(percent)
    folder, shards = shared_folder(spark, "sigtree"), parallelism(docs)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    about = written(docs.mapInArrow(_describe(n), "doc_id bigint, n bigint, fa bigint, fb bigint"), f"{folder}/about")
    key = ["fa", "fb", "n"]
    all_classes = written(about.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), f"{folder}/classes")
    classes = all_classes.where("rep is not null")
    sent = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(n, limit, shards), "shard int, blob binary")
    shared = sent.repartitionById(shards, F.col("shard")).mapInArrow(_shared, "fa bigint, fb bigint, n bigint, shared bigint")
    p = F.lit(percent)
    least = F.floor((p * F.col("n") + 99) / 100)
    need = 1 + least - F.floor((p * least + 99) / 100)
    survive = shared.groupBy(*key).agg(F.sum("shared").alias("shared")).where(F.col("shared") >= need)
    left = written(classes.join(survive.select(*key), key, "left_semi").select("rep"), f"{folder}/survivors")
    texts = docs.join(left.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    kept = written(texts.mapInArrow(_survivor_sets(n), _SLICE), f"{folder}/sets")
    asked = kept.select("slice", "blob").mapInArrow(_ask(shards), "shard int, slice bigint, blob binary")
    answers = asked.repartitionById(shards, F.col("shard")).mapInArrow(_answer, "shard int, slice bigint, blob binary")
    answers = answers.groupBy("slice").agg(F.collect_list(F.struct("shard", "blob")).alias("answers"))
    ties = kept.join(answers, "slice").select("ids", "blob", "answers").mapInArrow(_ties(limit, shards), _TIE)
    near = components(ties.repartition(shards, "token"), "blocks", before=_meet)
    single = kept.select("ids", "blob").mapInArrow(_single, "u bigint, tokens binary")
    sizes = kept.select("ids", "blob").mapInArrow(_places, "u bigint, n bigint, x double").distinct()
    roots = near.select(F.col("component").alias("node"), "component").distinct()
    members = written(near.union(roots).toDF("u", "block").join(sizes, "u"), f"{folder}/members")
    rows = _block_tasks(members, single, limit, shards, folder).repartition(shards, "task").sortWithinPartitions("task", "side", "u")
    links = components(rows, "links", before=_join_blocks(limit))
    named = written(classes.join(links.toDF("rep", "component"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"), "rows"), f"{folder}/named")
    # the result reads these two tables alone
    remove(spark, *(f"{folder}/{x}" for x in ("classes", "survivors", "sets", "members", "pieces", "q", "r", "chunks", "roots")))
    some = split_join(about.where("n > 0"), named, key, "rows", "left").select("doc_id", "n", "component")
    found = some.union(about.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
