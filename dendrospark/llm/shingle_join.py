"""Self-join of documents on the Jaccard similarity of their word shingles: a count-vector R-tree over shards.

A document is a set of shingle hashes. Hashing the shingles into ``GROUPS``
groups and counting each group's makes it a point. For two points the sum of the
smaller coordinates bounds the overlap from above, and so does, for a box of
points, the sum over the smaller of a query's counts and the box's upper corner.
A pair reaches the threshold t only if its overlap is at least t/(1+t) of the
two sizes together, so boxes and points whose bound is less are passed over.

One tree over everything could not be searched in parallel without comparing
all with all. The points are therefore dealt to shards, each with a tree of its
own: a set of n shingles goes to the shards of its n - ceil(t n) + 1 first
shingles in one global order. Two sets that reach t share one of those, whatever
the order, so no pair is lost; the first of those they share has a place in both
sets from which enough shingles are left, so a pair is looked at only where that holds.
The order puts shingles of crowded buckets last:
a fixed-size table of counts over all shingles (``BUCKETS`` numbers, 1 MB a task) tells
which, so passages that many documents share open no large shards.

Steps, each a Spark job over all documents:

1. vectors: per document the size, the digest of the word sequence, the
   count vector; and the table of counts. Documents of equal digest are one class
   from here on, represented by the smallest id.
2. postings: the shard keys of each class; shards of one class go at once.
3. first round: in every shard each class takes the best bound among those before
   it. The best of a class over all its shards is verified on the shingle
   sets; links give first components.
4. second round: the other candidates of small shards (``SMALL`` classes or fewer)
   are verified if they lie in different components; large shards that still hold
   several components search all pairs of different components, bound the
   candidates by finer counts, then compare those left exactly in place and pass
   on only links that join components. Shingle sets go only to the shards where a
   document has a candidate left. Pairs inside a component need no check, as the
   result is which documents are connected.

A shard larger than ``CHUNK`` is cut in chunks of similar sizes; the second round
takes chunk pairs, unless both chunks hold one and the same component or their
sizes are too far apart. Shards whose bucket counts more than ``HOT`` shingles are first
dealt to several tasks by the document's hash. So no shard is gathered in one task,
and a large group of near copies costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, mapped, mixed, release, salted_fold, slices, text_bytes, word_hashes, word_spans, written

WIDTH = 5
GROUPS = 64
BUCKETS = 1 << 18
CHUNK = 512
HOT = 1 << 16  # rows of a shard that one task takes at any rate; see tasks_of
LOWS = 8
LEAF = 32
BROADCAST_ROWS = 1_000_000
BLOOM_BITS = 1 << 20
BLOOM_A_ID = 8
# A word byte is any but space and U+0009 to U+000D.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def need(total: np.ndarray | int, num: int = 3, den: int = 4) -> np.ndarray:
    """Least overlap of two sets of together ``total`` elements whose Jaccard similarity is num/den or more."""
    return -(-num * np.asarray(total, np.int64) // (num + den))


def prefix_size(n: int, num: int = 3, den: int = 4) -> int:
    return n - -(-num * n // den) + 1


def shingles(raw: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row the distinct shingle hashes, ascending, and a 2x64-bit digest of the word sequence."""
    begin, end, rows = word_spans(raw, starts, IS_WORD)
    words = word_hashes(raw, begin, end)
    n = np.diff(rows)
    all_ = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        all_ += mixed(words[i : len(all_) + i] + _ODD[i % 5]) * _ODD[i % 5]
    all_ = mixed(all_)
    sets, digests = [], np.zeros((len(n), 2), np.uint64)
    place = np.arange(int(n.max()) if len(n) else 0, dtype=np.uint64)
    p1, p2 = mixed(place + _ODD[0]) | np.uint64(1), mixed(place + _ODD[1]) | np.uint64(1)
    for k, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        size = b - a
        w = words[a:b]
        digests[k] = (w * p1[:size]).sum() + np.uint64(size), (mixed(w + _ODD[2]) * p2[:size]).sum()
        if size >= width:
            s = np.sort(all_[a : b - width + 1])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif size:
            sets.append(mixed(np.array([(mixed(w) * _ODD[:size]).sum() + np.uint64(size)], np.uint64)))
        else:
            sets.append(w)
    return sets, mixed(digests)


def vector(s: np.ndarray) -> bytes:
    """Counts of ``GROUPS`` groups, a byte each, or four where one needs more."""
    v = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return v.astype(np.uint8 if v.max() < 256 else "<u4").tobytes()


def fine_vector(s: np.ndarray) -> bytes:
    """Counts of as many groups (a power of two) as make two to four shingles a group; a byte each, 255 for that many or more."""
    groups = max(GROUPS, 1 << max(0, (len(s) - 1) // 4).bit_length())
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def fine_bound_ok(a: bytes, b: bytes, num: int = 3, den: int = 4) -> bool:
    """Whether the bound of two fine vectors lets a pair through; the finer one is folded to the other's groups."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if x.max(initial=0) == 255 or y.max(initial=0) == 255:
        return True
    total = int(x.sum() + y.sum())
    g = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, g).sum(axis=0), y.reshape(-1, g).sum(axis=0)).sum()) >= need(total, num, den)


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(46)).astype(np.int64)


def keys(s: np.ndarray, counts: np.ndarray, crowded: int) -> np.ndarray:
    """The first shingles of a set, as many as a shared one is certain in: uncrowded by hash, then crowded by count."""
    k = prefix_size(len(s))
    c = counts[bucket(s)]
    plain = s[c <= crowded]
    if len(plain) >= k:
        return plain[:k]
    rest = s[c > crowded]
    return np.concatenate([plain, rest[np.lexsort((rest, c[c > crowded]))[: k - len(plain)]]])


VECTORS = "doc_id long, n int, d1 long, d2 long, vec binary, fine binary, counts binary"


def vectors(docs: DataFrame) -> DataFrame:
    """Step 1; rows with ``counts`` carry a task's table of counts instead of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, 1):
            sets, digests = shingles(*text_bytes(batch.column(1)))
            if any(map(len, sets)):
                counts += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS)
            d = digests.view(np.int64)
            cols = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([vector(s) for s in sets], pa.binary()), pa.array([fine_vector(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "d1", "d2", "vec", "fine", "counts"])
        yield counts_row(counts)

    return mapped(docs, run, VECTORS)


def counts_row(counts: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    data = counts.astype("<u4" if counts.max() < 2**32 else "<u8").tobytes()
    blank = pa.nulls(1, pa.binary())
    return pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.int32()), none, none, blank, blank, pa.array([data], pa.binary())], names=["doc_id", "n", "d1", "d2", "vec", "fine", "counts"])


def counts_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * BUCKETS else "<u8").astype(np.int64)


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column(6):
            total += counts_of(data.as_py())
    yield counts_row(total)


def tasks_of(counts: np.ndarray) -> np.ndarray:
    """Tasks that the shards of each bucket are dealt to: one, but for buckets with more than ``HOT`` shingles that also have more than four times the mean.

    Many shards share a bucket once the table is large, and none is hot for that. A
    shard dealt to one task has at most four buckets' share of the table's rows.
    """
    most = max(HOT, int(np.ceil(4 * counts.mean())))
    return np.maximum(1, -(-counts // most))


def postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, salt, doc_id, place) for each shard a document goes to; place is 2^32 times the set's size and the shingle's place in the order; salt is above 0 for shards that are dealt to several tasks."""
    mean = counts.mean()
    shared = docs.sparkSession.sparkContext.broadcast((counts, int(mean + 6 * np.sqrt(mean) + 8), tasks_of(counts)))  # BUCKETS numbers at any scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crowded, dealt = shared.value
        for batch in slices(batches, 1):
            sets, _ = shingles(*text_bytes(batch.column(1)))
            ks = [keys(s, table, crowded) if len(s) else s for s in sets]
            size = [len(k) for k in ks]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if sum(size):
                key, doc = np.concatenate(ks), np.repeat(ids, size)
                place = np.repeat([len(s) for s in sets], size) << 32 | np.concatenate([np.arange(k) for k in size])
                tasks = dealt[bucket(key)]
                salt = np.where(tasks > 1, 1 + (mixed(doc.view(np.uint64)) % np.maximum(tasks, 1).astype(np.uint64)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(doc), pa.array(place)], names=["key", "salt", "doc_id", "place"])

    return mapped(docs, run, "key long, salt int, doc_id long, place long")


def members(posts: DataFrame) -> DataFrame:
    """(key, chunk, doc_id, at) of shards with at least two documents; ``at`` is the shard's shingle's place in the document's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, held = None, 0, None  # the shard before, its rows so far, and its first row while that is alone
        for batch in batches:
            key, salt, doc, at = (batch.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            at = at & 0xFFFFFFFF
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
            size = np.diff(np.r_[first, len(key)])
            place = np.arange(len(key)) - np.repeat(first, size)
            total = np.repeat(size, size)
            cut = int(size[0]) if (key[0], salt[0]) == last else 0
            place[:cut] += seen
            total[:cut] += seen
            out = (total >= 2) | (salt > 0)
            rows = [key[out], (salt[out].astype(np.int64) << 32) + place[out] // CHUNK, doc[out], at[out]]
            if cut and held is not None:
                rows = [np.r_[a, b] for a, b in zip((last[0], 0, *held), rows, strict=True)]
            seen = int(size[-1]) + (seen if cut and len(size) == 1 else 0)
            last, held = (key[-1], salt[-1]), ((doc[-1], at[-1]) if seen == 1 and not salt[-1] else None)
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in rows[:3]), pa.array(rows[3].astype(np.int32))], names=["key", "chunk", "doc_id", "at"])

    return mapped(posts.repartition("key", "salt").sortWithinPartitions("key", "salt", "place", "doc_id"), run, "key long, chunk long, doc_id long, at int")


class Tree:
    """A two-level R-tree over count vectors: leaves of neighbours in size and in the most spread-out group, each with its box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.var(axis=0)
        lead = int(spread.argmax()) if len(points) else 0
        by_size = np.argsort(sizes, kind="stable")
        strip = LEAF * max(1, round(np.sqrt(-(-len(sizes) // LEAF))))
        self.order = np.concatenate([part[np.argsort(points[part, lead], kind="stable")] for part in (by_size[i : i + strip] for i in range(0, len(by_size), strip))])
        self.leaves = [self.order[i : i + LEAF] for i in range(0, len(self.order), LEAF)]
        self.points, self.sizes = points, sizes
        self.high = np.stack([points[leaf].max(axis=0) for leaf in self.leaves])
        self.least = np.array([sizes[leaf].min() for leaf in self.leaves])
        self.most = np.array([sizes[leaf].max() for leaf in self.leaves])

    def search(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound with a query reaches what is needed, and the bounds."""
        near = (4 * self.most >= 3 * n) & (3 * self.least <= 4 * n)
        at = np.flatnonzero(near)
        at = at[np.minimum(self.high[at], q).sum(axis=1) >= need(n + self.least[at])]
        if not len(at):
            return at, at
        rows = np.concatenate([self.leaves[i] for i in at])
        bound = np.minimum(self.points[rows], q).sum(axis=1)
        ok = bound >= need(n + self.sizes[rows])
        return rows[ok], bound[ok]


def pairs_of(size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs inside many small runs at once."""
    left, right = [], []
    for s in np.unique(size):
        i, j = np.triu_indices(int(s), 1)
        at = first[size == s]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of whole runs (equal in the first ``width`` columns) of batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
        if not t.num_rows:
            continue
        cols = [t.column(i).to_numpy() for i in range(width)]
        change = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        rest = t.slice(cut)
        if cut:
            yield table_columns(t.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield table_columns(rest)


def table_columns(t: pa.Table) -> list[np.ndarray]:
    out = []
    for c, name in zip(t.columns, t.column_names, strict=True):
        if name in ("shingles", "fine"):
            out.append(c.to_pylist())
        elif pa.types.is_list(c.type):
            c = c.combine_chunks()
            ends = c.offsets.to_numpy()
            out.append(np.split(c.flatten().to_numpy(), (ends[1:-1] - ends[0])))
        elif pa.types.is_binary(c.type):
            data = c.to_pylist()
            wide = np.array([len(d) > GROUPS for d in data])
            points = np.zeros((len(data), GROUPS), np.int32 if wide.any() else np.int16)
            points[~wide] = np.frombuffer(b"".join([d for d in data if len(d) == GROUPS]), np.uint8).reshape(-1, GROUPS)
            points[wide] = np.frombuffer(b"".join([d for d in data if len(d) > GROUPS]), "<u4").reshape(-1, GROUPS)
            out.append(points)
        else:
            out.append(c.to_numpy())
    return out


SMALL = 16


def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, chunk, n, doc_id, vec, at) sorted by the first four: all candidates in shards of up to ``SMALL``, else per document the best before it.

    A pair whose first shared shingle this is has at most what is left from it on in common.
    """
    for key, chunk, n, doc, points, at in units(batches, 2):
        rest = n - at
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
        size = np.diff(np.r_[first, len(key)])
        few = size <= SMALL
        i, j = pairs_of(size[few], first[few])
        ahead = np.minimum(rest[i], rest[j]) >= need(n[i] + n[j])
        i, j = i[ahead], j[ahead]
        a, b, bound = [], [], []
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            m = np.minimum(points[x], points[y]).sum(axis=1)
            ok = m >= need(n[x] + n[y])
            a.append(x[ok])
            b.append(y[ok])
            bound.append(m[ok])
        for f, s in zip(first[~few], size[~few], strict=True):
            tree = Tree(points[f : f + s], n[f : f + s])
            for k in range(1, s):
                rows, m = tree.search(points[f + k], int(n[f + k]))
                ok = (rows < k) & (np.minimum(rest[f + rows], rest[f + k]) >= need(n[f + rows] + n[f + k]))
                if ok.any():
                    rows, m = rows[ok], m[ok]
                    value = m / (n[f + rows] + n[f + k])
                    best = np.lexsort((rows, -value))[0]
                    a.append(np.array([f + rows[best]]))
                    b.append(np.array([f + k]))
                    bound.append(np.array([m[best]]))
        yield candidate_rows(doc, n, a, b, bound)


def candidate_rows(doc, n, a, b, bound) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    a, b, bound = (np.concatenate([empty, *x]).astype(np.int64) for x in (a, b, bound))
    x, y, v = doc[a], doc[b], bound / (n[a] + n[b])
    swap = x > y
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((-v, x, y))
    x, y, v = x[order], y[order], v[order]
    once = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)]
    return pa.RecordBatch.from_arrays([pa.array(x[once].astype(np.int64)), pa.array(y[once].astype(np.int64)), pa.array(v[once])], names=["a", "b", "bound"])


def overlaps(sets: list[np.ndarray], block: int = 1 << 21) -> np.ndarray:
    """Exact overlaps of all the sets, summed over blocks of the shingles that at least two of them hold."""
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[codes] > 1
    column = (np.cumsum(counts > 1) - 1)[codes[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    wide = max(1, block // len(sets))
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def open_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], int, np.ndarray, np.ndarray]]:
    """From rows (key, ca, cb, side, n, doc_id, comp, vec, ...) sorted by the first five: per unit of several
    components its columns, its first row and the tree's candidates of different components."""
    for cols in units(batches, 3):
        key, ca, cb, side, n, _, comp, points = cols[:8]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])])
        for f, s in zip(first, np.diff(np.r_[first, len(key)]), strict=True):
            one = ca[f] == cb[f]
            split = f + s if one else f + int(np.searchsorted(side[f : f + s], 1))
            base = f if one else split
            if base == f + s or split == f or (comp[f : f + s] == comp[f]).all():
                continue
            tree = Tree(points[base : f + s], n[base : f + s])
            a, b = [], []
            for q in range(f, split):
                rows, _ = tree.search(points[q], int(n[q]))
                rows = rows + base
                rows = rows[(comp[rows] != comp[q]) & ((rows > q) if one else True)]
                a.append(np.full(len(rows), q))
                b.append(rows)
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield cols, f, x, y


def fine_ok(fine: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``fine_bound_ok`` of many index pairs, those of equal lengths at once."""
    used, at = np.unique(np.r_[x, y], return_inverse=True)
    length = np.array([len(fine[i]) for i in used])
    place = np.zeros(len(used), np.int64)
    of = {}
    for size in np.unique(length):
        mine = np.flatnonzero(length == size)
        place[mine] = np.arange(len(mine))
        of[int(size)] = np.frombuffer(b"".join([fine[i] for i in used[mine]]), np.uint8).reshape(-1, size)
    i, j = at[: len(x)], at[len(x) :]
    ok = np.zeros(len(x), bool)
    for p, q in np.unique(np.c_[length[i], length[j]], axis=0).tolist():
        pairs, g = np.flatnonzero((length[i] == p) & (length[j] == q)), min(p, q)
        step = max(1, (1 << 20) // max(p, q))
        for k in range(0, len(pairs), step):
            some = pairs[k : k + step]
            u, v = of[p][place[i[some]]], of[q][place[j[some]]]
            full = (u == 255).any(axis=1) | (v == 255).any(axis=1)
            u, v = (w.astype(np.int32).reshape(len(some), -1, g).sum(axis=1) for w in (u, v))
            ok[some] = full | (np.minimum(u, v).sum(axis=1) >= need(u.sum(axis=1) + v.sum(axis=1)))
    return ok


def contenders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, ca, cb, side, doc_id, comp) of ``open_units`` with a candidate that finer counts let through.

    A pair that also shares a smaller key, as far as both rows' ``lows`` tell, is
    left to that shard. The shard of a pair's smallest shared key never passes it on.
    """
    for cols, f, x, y in open_units(batches):
        used, at = np.unique(np.r_[x, y], return_inverse=True)
        elsewhere = overlaps([low[low < cols[0][f]] for low in (cols[9][i] for i in used)])
        here = elsewhere[at[: len(x)], at[len(x) :]] == 0
        x, y = x[here], y[here]
        if not len(x):
            continue
        near = fine_ok(cols[8], x, y)
        used = np.unique(np.r_[x[near], y[near]])
        if len(used):
            names = ["key", "ca", "cb", "side", "doc_id", "comp"]
            yield pa.RecordBatch.from_arrays([pa.array(cols[i][used]) for i in (0, 1, 2, 3, 5, 6)], names=names)


def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of different components among ``open_units``, whose last column is the shingle sets.

    The tree's candidates are compared exactly here, and of the links found in a
    unit only those that join its components are passed on.
    """
    for (_, _, _, _, n, doc, comp, _, data), _, x, y in open_units(batches):
        used = np.unique(np.r_[x, y])
        m = overlaps([unpacked(data[i]) for i in used])
        both = m[np.searchsorted(used, x), np.searchsorted(used, y)].astype(np.int64)
        linked = 4 * both >= 3 * (n[x] + n[y] - both)
        x, y = x[linked], y[linked]
        labels, label = np.unique(np.r_[comp[x], comp[y]], return_inverse=True)
        keep = forest(len(labels), label[: len(x)], label[len(x) :])
        yield pa.RecordBatch.from_arrays([pa.array(doc[x[keep]].astype(np.int64)), pa.array(doc[y[keep]].astype(np.int64))], names=["a", "b"])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of pairs that join what the pairs before them have not."""
    parent, keep = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return keep


CANDIDATES = "a long, b long, bound double"


def maybe_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of all given ids, and of a few others.

    A Bloom filter of fixed size over the ids goes to every task, so that only
    texts that may be asked for become rows; the join that follows is exact. The
    filter has ``BLOOM_A_ID`` bits an id, between ``BLOOM_BITS`` and 128 times that (16 MB).
    """
    bits = 4
    size = min(BLOOM_BITS << 7, max(BLOOM_BITS, 1 << (BLOOM_A_ID * ids.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size, bool)
        for batch in batches:
            got[slots(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(got).tobytes()], pa.binary())], names=["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for data in batch.column(0):
                got |= np.frombuffer(data.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], names=["bits"])

    def slots(v: np.ndarray) -> np.ndarray:
        h = mixed(v.astype(np.int64).view(np.uint64) + _ODD[3])
        return np.concatenate([((h >> np.uint64(i * 11)) & np.uint64(size - 1)).astype(np.int64) for i in range(bits)])

    folded = salted_fold(mapped(ids.select("doc_id"), fill, "bits binary"), either).collect()[0][0]
    shared = docs.sparkSession.sparkContext.broadcast(folded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for batch in slices(batches, 1):
            v = batch.column(0).to_numpy(zero_copy_only=False)
            keep = have[slots(v)].reshape(bits, -1).all(axis=0)
            if keep.any():
                batch = batch.filter(pa.array(keep))
                sets, _ = shingles(*text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(s) for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return mapped(docs, run, "doc_id long, shingles binary")


def packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def common(p: np.ndarray, q: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def meeting(pairs: DataFrame, values: DataFrame, name: str, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose two values pass ``test``. Values meet by pair, so a document in many pairs makes no hot key."""
    side = F.explode(F.array(*[F.struct(F.col(c).alias("doc_id"), F.lit(k).alias("side")) for k, c in enumerate("ab")])).alias("s")
    rows = pairs.select("a", "b", side).select("a", "b", "s.*").join(values, "doc_id").select("a", "b", "side", name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = [], []
            for x, y, side, data in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3), strict=True):
                if side == 0:
                    if last != (x, y):
                        last, held = (x, y), data.as_py()
                elif held is not None and last == (x, y):
                    if test(held, data.as_py()):
                        a.append(x)
                        b.append(y)
                    held = None
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return mapped(rows.repartition("a", "b").sortWithinPartitions("a", "b", "side"), run, "a long, b long")


def sets_ok(a: bytes, b: bytes, num: int = 3, den: int = 4) -> bool:
    x, y = unpacked(a), unpacked(b)
    both = common(x, y)
    return den * both >= num * (len(x) + len(y) - both)


def verified(docs: DataFrame, pairs: DataFrame, fine: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: a bound from finer counts first, then the shingle sets of those it lets through."""
    near = written(meeting(pairs, fine, "fine", fine_bound_ok), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    out = written(meeting(near, maybe_sets(docs, ids), "shingles", sets_ok), "links")
    discard(near)
    release(docs.sparkSession)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link at a Jaccard similarity of 3/4 over distinct ``WIDTH``-word
    shingles (a shorter text is one shingle). Null, empty and wordless texts have
    no shingles, link with nothing and are their own component. Rows that repeat
    an id stand for one document: each is returned with its own size, and their
    links are the id's. A null id gives a row with a null component. An empty
    table gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    known = docs.where("doc_id is not null")
    made = written(vectors(docs), "vectors")
    counts = counts_of(salted_fold(made.where("counts is not null"), added).collect()[0]["counts"])
    points = made.where("counts is null").drop("counts")
    full = points.where("n > 0 and doc_id is not null")
    reps = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    # Copies are left out of all that follows; their ids are broadcast only if they are few.
    copies = written(full.select("doc_id", "d1", "d2").join(reps, ["d1", "d2"]).where("doc_id <> rep").select("doc_id").distinct(), "copies")
    few = copies.count() <= BROADCAST_ROWS
    single = known.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    shards = written(members(postings(single, counts)), "shards")
    release(spark)
    alone = written(full.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id"]), "points")
    vecs, fine = alone.select("doc_id", "n", "vec"), alone.select("doc_id", "fine")

    rows = shards.join(vecs, "doc_id").select("key", "chunk", "n", "doc_id", "vec", "at")
    found = mapped(rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "n", "doc_id"), first_round, CANDIDATES)
    found = written(found.groupBy("a", "b").agg(F.max("bound").alias("bound")), "candidates")
    release(spark)
    best = written(found.groupBy("b").agg(F.max_by("a", F.struct("bound", -F.col("a"))).alias("a")).select("a", "b"), "best")
    one = verified(known, best, fine)
    comps = components(one)

    named = shards.drop("at").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    named = written(named.join(vecs.select("doc_id", "n"), "doc_id"), "named")
    discard(shards)
    release(spark)
    # Small shards have shown all their candidates; the others are searched again for those between components.
    chunk = named.groupBy("key", "chunk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("rows")).where(f"rows > {SMALL} or chunk > 0")
    a, b = (chunk.toDF("key", *[f"{s}_{c}" for c in ("chunk", "low", "high", "least", "most", "rows")]) for s in "ab")
    open_ = a.join(b, "key").where("a_chunk <= b_chunk and (least(a_low, b_low) < greatest(a_high, b_high)) and 4 * a_most >= 3 * b_least and 4 * b_most >= 3 * a_least").selectExpr("key", "a_chunk ca", "b_chunk cb")
    one_side = lambda s, c: F.struct(F.lit(s).alias("side"), F.col(c).alias("chunk"))
    sides = open_.select("key", "ca", "cb", F.explode(F.when(F.col("ca") == F.col("cb"), F.array(one_side(0, "ca"))).otherwise(F.array(one_side(0, "ca"), one_side(1, "cb")))).alias("s")).select("key", "ca", "cb", "s.*")
    placed = written(sides.join(named, ["key", "chunk"]), "placed")
    discard(named)
    unit = ["key", "ca", "cb"]
    lows = placed.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LOWS).alias("lows"))
    rough = placed.join(alone.select("doc_id", "vec", "fine").join(lows, "doc_id"), "doc_id").select(*unit, "side", "n", "doc_id", "comp", "vec", "fine", "lows")
    rough = rough.repartition(*unit).sortWithinPartitions(*unit, "side", "n", "doc_id")
    # Sets go only to the units in which a document has a candidate left by its finer counts.
    left = written(mapped(rough, contenders, "key long, ca long, cb long, side int, doc_id long, comp long"), "left")
    discard(placed)
    release(spark)
    sets = maybe_sets(known, left.select("doc_id").distinct()).dropDuplicates(["doc_id"])
    more = left.join(vecs, "doc_id").join(sets, "doc_id").select(*unit, "side", "n", "doc_id", "comp", "vec", "shingles")
    across = mapped(more.repartition(*unit).sortWithinPartitions(*unit, "side", "n", "doc_id"), second_round, "a long, b long")
    across = written(across, "across")
    discard(left)
    release(spark)
    of = lambda c: comps.toDF(c, f"c{c}")
    apart = found.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    later = written(apart.select("a", "b").join(best, ["a", "b"], "left_anti"), "later")
    links = one.union(across).union(verified(known, later, fine))
    ends = components(links).withColumnRenamed("node", "rep")

    of_doc = points.join(reps, ["d1", "d2"], "left").join(ends, "rep", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return of_doc.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the component's id. Rows that only repeat it go too; null ids stay."""
    ids = docs.selectExpr("cast(doc_id as bigint) doc_id")
    gone = written(classes(docs).where("component_id <> doc_id").selectExpr("doc_id __gone").distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    if ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
