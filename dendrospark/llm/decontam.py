"""Benchmark decontamination with suffix arrays over training shards.

Each task turns its documents into shards of bounded bytes and builds a suffix
array over every shard's words. All suffixes of the benchmark items are then
binary-searched in it, word by word: the interval that stays after a window's
length holds all places where that window occurs, and going on until the
interval is empty gives the longest verbatim match.

The array is sparse in an exact way: only suffixes that start a run of
benchmark words at least as long as the shortest window can match one, so only
runs of that length are sorted (by prefix doubling).

Benchmark text goes to tasks in blocks of at most ``BLOCK_BYTES``; a larger
benchmark takes several scans over the same rows, one after another in the same
stage, so neither the driver nor a task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, slices, text_bytes, word_hashes, word_spans

WINDOW = 13
BLOCK_BYTES = 8 << 20
# A word byte: 0-9, A-Z, a-z, or any byte of a character from U+0080 on.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
]


def item_words(texts: list[str]) -> list[np.ndarray]:
    raw, starts = text_bytes(pa.array(texts, pa.string()))
    begin, end, rows = word_spans(raw, starts, IS_WORD)
    codes = word_hashes(raw, begin, end)
    return [codes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]


class Suffixes:
    """The suffixes of a block of benchmark items, coded by the block's own vocabulary (1 on; 0 is any other word)."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW):
        words = item_words(texts)
        keep = [i for i, w in enumerate(words) if len(w)]
        self.vocabulary = np.unique(np.concatenate([words[i] for i in keep])) if keep else np.zeros(0, np.uint64)
        self.codes = np.concatenate([np.r_[np.searchsorted(self.vocabulary, words[i]) + 1, 0] for i in keep] or [np.zeros(0, np.int64)]).astype(np.int64)
        starts, length, item = [], [], []
        at = 0
        for i in keep:
            n = len(words[i])
            need = min(window, n)
            starts += range(at, at + n - need + 1)
            length += [need] * (n - need + 1)
            item += [ids[i]] * (n - need + 1)
            at += n + 1
        self.starts, self.length = (np.array(x, np.int64) for x in (starts, length))
        self.item = np.array(item, object)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self.longest_item = max((len(words[i]) for i in keep), default=0)


def suffix_array(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the codes that follow, up to ``depth`` or until all differ; ``codes`` ends in a 0. Prefix doubling over the positions in runs."""
    rank = codes.astype(np.int64)
    step, different = 1, 0
    while step < depth and different < np.count_nonzero(rank):
        ahead = np.zeros_like(rank)
        ahead[:-step or None] = rank[step:]
        ahead[rank == 0] = 0
        pair = rank * (int(rank.max()) + 1) + ahead
        values, rank2 = np.unique(pair, return_inverse=True)
        rank = np.where(rank == 0, 0, rank2 + 1)
        different = len(values) - 1  # one of the values is that of the places between runs
        step *= 2
    return at[np.argsort(rank[at], kind="stable")]


def narrowed(codes: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """For many intervals of the suffix array at once, where ``want`` would go by the word at ``depth``."""
    lo, hi = lo.copy(), hi.copy()
    top = len(codes) - 1
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        seen = codes[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, top)]
        up = open_ & ((seen <= want) if right else (seen < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def search(codes: np.ndarray, order: np.ndarray, test: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences (word position, test suffix) of whole windows, and each occurrence's longest match."""
    n = len(test.starts)
    active = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    where, which, long = [], [], []
    last = len(test.codes) - 1
    depth = 0
    while len(active):
        whole = test.length[active] == depth
        if whole.any():
            for s, a, b in zip(active[whole], lo[whole], hi[whole], strict=True):
                where.append(order[a:b])
                which.append(np.full(b - a, s))
        want = test.codes[np.minimum(test.starts[active] + depth, last)]
        new_lo = narrowed(codes, order, lo, hi, depth, want, False)
        new_hi = narrowed(codes, order, new_lo, hi, depth, want, True)
        ended = (new_lo >= new_hi) | (want == 0)
        new_hi = np.where(ended, new_lo, new_hi)
        # The places that go no further match this far.
        for k in np.flatnonzero((depth >= test.length[active]) & (new_hi - new_lo < hi - lo)):
            places = order[lo[k] : hi[k]] if ended[k] else np.r_[order[lo[k] : new_lo[k]], order[new_hi[k] : hi[k]]]
            long.append((places, depth))
        active, lo, hi = active[~ended], new_lo[~ended], new_hi[~ended]
        depth += 1
    longest = np.zeros(len(codes), np.int64)
    for places, d in long:
        longest[places] = np.maximum(longest[places], d)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *where]), np.concatenate([empty, *which]), longest, empty


def shard(raw: np.ndarray, starts: np.ndarray, test: Suffixes) -> tuple[np.ndarray, list[tuple[list, list, int]]]:
    """Per row of a shard: its number of words, then merged hit spans (words), items and longest match."""
    begin, end, rows = word_spans(raw, starts, IS_WORD)
    n_words = np.diff(rows)
    none = ([], [], 0)
    out: list[tuple[list, list, int]] = [none] * len(n_words)
    if not test.shortest or len(begin) < 1:
        return n_words, out
    hashes = word_hashes(raw, begin, end)
    at = np.searchsorted(test.vocabulary, hashes)
    at[at == len(test.vocabulary)] = 0
    flat = np.where(test.vocabulary[at] == hashes, at + 1, 0)
    row = np.repeat(np.arange(len(n_words)), n_words)
    codes = np.zeros(len(flat) + len(n_words), np.int64)  # a 0 after each row
    codes[np.arange(len(flat)) + row] = flat
    stop = np.flatnonzero(codes == 0)
    run = stop[np.searchsorted(stop, np.arange(len(codes)))] - np.arange(len(codes))
    edge = np.r_[-1, stop]
    long_run = np.diff(edge) - 1 >= test.shortest
    if not long_run.any():
        return n_words, out
    spans = [(a + 1, b + 1) for a, b in zip(edge[:-1][long_run], edge[1:][long_run], strict=True)]
    kept = np.concatenate([np.arange(a, b) for a, b in spans])  # whole runs with the 0 behind each
    small, r = codes[kept], run[kept]
    order = suffix_array(small, np.flatnonzero(r >= test.shortest), test.longest_item)
    where, which, longest, _ = search(small, order, test)
    if not len(where):
        return n_words, out
    cover = np.zeros(len(small) + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + test.length[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    owner = np.searchsorted(np.cumsum(n_words + 1), kept, "right")
    first = np.r_[0, np.cumsum(n_words + 1)][owner]
    for o in np.unique(owner[where]):
        mine = owner[where] == o
        words = kept[hit & (owner == o)] - first[np.flatnonzero(owner == o)[0]]
        cut = np.flatnonzero(np.diff(words) > 1)
        spans_ = list(zip(words[np.r_[0, cut + 1]].tolist(), (words[np.r_[cut, len(words) - 1]] + 1).tolist(), strict=True))
        out[o] = (spans_, sorted(set(test.item[np.unique(which[mine])])), int(longest[owner == o].max()))
    return n_words, out


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(x, y) for x, y in out]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The items (id as a string, text), those without either left out, dealt by hash into blocks of about ``block_bytes``."""
    items = benchmark.selectExpr("cast(item_id as string) item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def locate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (merged word spans), items and longest (words of the longest verbatim match).

    All columns of ``docs`` come back, so no later join is needed; a column
    ``text`` must be there, and one named like a figure is replaced by it. Null
    or empty text has no words and no hits; an empty benchmark or a table without
    rows hits nothing; repeated rows each get their result. Words are compared by
    64-bit hash.
    """
    docs = docs.drop(*[f.name for f in FOUND])
    names = docs.columns
    at = names.index("text")
    out = T.StructType([*docs.schema.fields, *FOUND])
    df = docs
    first = True
    for ids, texts in blocks(benchmark, block_bytes):
        test = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], test=test, first=first) -> Iterator[pa.RecordBatch]:
            suffixes = Suffixes(*test.value, window)
            for batch in slices(batches, at):
                raw, starts = text_bytes(batch.column(at))
                n_words, found = shard(raw, starts, suffixes)
                if not first:
                    old = [c.to_pylist() for c in batch.columns[-3:]]
                    found = [
                        (merged([(x["start"], x["end"]) for x in h], f[0]), sorted({*i, *f[1]}), max(l_, f[2]))
                        for h, i, l_, f in zip(*old, found, strict=True)
                    ]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                new = [
                    pa.array(n_words, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in f[0]] for f in found], span),
                    pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([f[2] for f in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *new], names=out.names)

        df = mapped(df, run, out)
        first = False
    return df


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, contaminated (at least a twentieth of the words hit) and items_sha256 to what ``locate`` gives."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.sort_array("items"), ",")
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(ids, 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs`` the figures of ``judged`` without the texts."""
    found = judged(locate(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), benchmark))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; columns as they came (theirs may not be named like the figures)."""
    clash = {f.name for f in FOUND} & set(docs.columns)
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    kept = judged(locate(renamed, benchmark)).where(~F.col("contaminated")).select(*renamed.columns)
    return kept.withColumnsRenamed({f"__own_{c}": c for c in clash})
