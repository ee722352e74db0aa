"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes gives every position a value; a chunk
ends where that value is the largest within ``REACH`` bytes on either side. Ends
thus depend on nearby bytes only: after an insertion the chunks are the same
again within a few dozen bytes. Chunks are longer than ``REACH`` and about twice
that on average; where a text repeats itself so that no end comes up, one is set
every ``LONGEST`` bytes.

Chunks are compared by digest (96 bits) over all documents. A chunk is a repeat where a
document with a smaller id has it (with ``within``, also where an earlier chunk of
its own document is the same). A text's last chunk, or what a set end leaves, may be of ``REACH`` bytes or less;
it is then compared together with the chunk before it. Repeats go where they stand in
runs of ``LEAST_RUN`` bytes or more, so phrases that recur by chance stay, and
where a run is the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import _BYTE, discard, mapped, mixed, powers, slices, text_bytes, written

REACH = 20
LONGEST = 512
LEAST_RUN = 100
FREQUENT = 4096  # a chunk with more than this share of all occurrences is broadcast
PAD = 32
_GEAR = (mixed(_BYTE) >> np.uint64(16)).astype(np.uint32)
_CHECK = mixed(_BYTE + np.uint64(0x9E3779B97F4A7C15))  # other values for the bytes, for the digests' further bits


def widest(v: np.ndarray, n: int) -> np.ndarray:
    """At each place the largest of the ``n`` values before it."""
    out, have = np.zeros_like(v), 0  # out covers the `have` values before a place
    block, size = v.copy(), 1  # block covers `size` values that end at a place
    while have < n:
        if n - have >= size and (n & size):
            moved = np.zeros_like(v)
            moved[have + 1 :] = block[: -have - 1]
            np.maximum(out, moved, out=out)
            have += size
        if have < n:
            grown = block.copy()
            np.maximum(grown[size:], block[:-size], out=grown[size:])
            block, size = grown, 2 * size
    return out


def chunks(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of the chunks of many texts, and each text's first chunk plus the total."""
    lengths = np.diff(starts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(raw)) + PAD * (row + 1)  # texts lie apart, so no window reaches from one into another
    total = len(raw) + PAD * (len(lengths) + 1)
    h = np.zeros(total, np.uint32)
    h[place] = _GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        moved = np.zeros_like(h)
        moved[shift:] = h[:-shift] << np.uint32(shift)
        h = h + moved
    value = np.zeros(total, np.uint32)
    value[place] = (h[place] * np.uint32(0x9E3779B1)) | np.uint32(1)
    top = (value > widest(value, REACH)) & (value >= widest(value[::-1], REACH)[::-1])
    edge = np.flatnonzero(top[place]) + 1
    edge = edge[(edge - starts[row[edge - 1]] > REACH)]
    inside = edge < len(raw)
    for _ in range(3):  # to the start of a character
        cont = inside.copy()
        cont[inside] = (raw[edge[inside]] & 0xC0) == 0x80
        edge[cont] += 1
        inside = edge < len(raw)
    cuts = np.unique(np.r_[starts[:-1][lengths > 0], edge[edge < len(raw)]])
    ends = np.r_[cuts[1:], len(raw)] if len(cuts) else cuts
    long = ends - cuts > LONGEST
    if long.any():
        more = [np.arange(a + LONGEST, b, LONGEST) for a, b in zip(cuts[long], ends[long], strict=True)]
        more = np.concatenate(more)
        while True:
            cont = (raw[more] & 0xC0) == 0x80
            if not cont.any():
                break
            more[cont] -= 1
        cuts = np.unique(np.r_[cuts, more])
        ends = np.r_[cuts[1:], len(raw)]
    return cuts, ends, np.searchsorted(cuts, starts)


def digests(raw: np.ndarray, cuts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    if not len(cuts):
        return np.zeros(0, np.int64)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[cuts]) * down[cuts] + (ends - cuts).astype(np.uint64)).view(np.int64)


def chunk_digests(raw: np.ndarray, cuts: np.ndarray, ends: np.ndarray, first: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Digests of the chunks; one of at most ``REACH`` bytes has that of its bytes and the chunk before, if its text has one."""
    begin = cuts.copy()
    short = np.setdiff1d(np.flatnonzero(ends - cuts <= REACH), first)
    begin[short] = cuts[short - 1]
    return digests(raw, begin, ends, values)


def occurrences(docs: DataFrame) -> DataFrame:
    """(digest, check, doc_id): the chunks of each document, once; ``check`` is 32 more bits of the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            raw, starts = text_bytes(batch.column(1))
            cuts, ends, rows = chunks(raw, starts)
            d = chunk_digests(raw, cuts, ends, rows)
            check = (chunk_digests(raw, cuts, ends, rows, _CHECK) >> 32).astype(np.int32)
            out = [a + np.unique(d[a:b], return_index=True)[1] for a, b in zip(rows[:-1], rows[1:], strict=True)]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(o) for o in out])
            if len(ids):
                at = np.concatenate(out).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(check[at]), pa.array(ids)], names=["digest", "check", "doc_id"])

    return mapped(docs, run, "digest long, check int, doc_id long")


def runs(flag: np.ndarray, cuts: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte spans of runs of flagged chunks of at least ``least`` bytes, or of all of a document's chunks."""
    if flag.all() and len(flag):
        return [(int(cuts[0]), int(ends[-1]))]
    if not flag.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
    return [(int(cuts[a]), int(ends[b - 1])) for a, b in zip(edge[::2], edge[1::2], strict=True) if ends[b - 1] - cuts[a] >= least]


def values(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy() if cell.is_valid else np.zeros(0, np.int64)


def owned(seen: DataFrame, many: DataFrame, share: int = FREQUENT) -> DataFrame:
    """The occurrences of chunks in ``many`` (digest, check, owner, n), each with its owner.

    A chunk with more than one in ``share`` of all occurrences, of which there are fewer
    than ``share``, is looked up where it stands; the others meet by a shuffle.
    """
    keys, often = ["digest", "check"], seen.count() / share
    frequent = F.broadcast(many.where(F.col("n") > often).drop("n"))
    rest = seen.join(frequent, keys, "left_anti").join(many.where(F.col("n") <= often).drop("n"), keys)
    return seen.join(frequent, keys).unionByName(rest)


def deduplicate(docs: DataFrame, least_run: int = LEAST_RUN, within: bool = False) -> DataFrame:
    """``docs`` with ``text`` freed of repeats, and n_chunks, n_repeated, repeated, removed, removed_chars.

    ``repeated`` (spans start:end in code points of the old text, comma-joined)
    has the runs that also stand elsewhere, ``removed`` those of them that went;
    n_repeated counts the chunks in the former. A copied document keeps its
    row with an empty text. Null texts stay null and have no chunks. Rows that
    repeat an id are one document, so they don't repeat each other; rows with a
    null id are left as they are; a table without rows gives none. Further columns
    come back unchanged, but for those named like a new one, which it replaces.
    """
    docs = docs.drop("n_chunks", "n_repeated", "repeated", "removed", "removed_chars")
    names = docs.columns
    known = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null and text is not null")
    seen = written(occurrences(known), "chunks")
    many = written(seen.groupBy("digest", "check").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where("n > 1"), "repeated-chunks")
    hits = owned(seen, many).groupBy("doc_id").agg(F.collect_set(F.when(F.col("doc_id") > F.col("owner"), F.col("digest"))).alias("__again"), F.collect_set(F.when(F.col("doc_id") == F.col("owner"), F.col("digest"))).alias("__owned"))
    hits = written(hits, "repeats").withColumnRenamed("doc_id", "__doc")
    discard(seen, many)
    rows = docs.join(hits, F.col("doc_id") == F.col("__doc"), "left").select(*names, "__again", "__owned")
    extra = {"n_chunks": F.lit(0).cast("long"), "n_repeated": F.lit(0).cast("long"), "repeated": F.lit(""), "removed": F.lit(""), "removed_chars": F.lit(0).cast("long")}
    schema, added = docs.limit(0).withColumns(extra).schema, list(extra)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            raw, starts = text_bytes(batch.column(at))
            cuts, ends, first = chunks(raw, starts)
            d = chunk_digests(raw, cuts, ends, first)
            chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            texts, found = [], []
            for k, (old, again, owned) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)), batch.column(len(names) + 1), strict=True)):
                a, b = first[k], first[k + 1]
                if old is None or not (within or again.is_valid):
                    texts.append(old)
                    found.append((b - a, 0, "", "", 0))
                    continue
                mine, c, e = d[a:b], cuts[a:b], ends[a:b]
                later = np.isin(mine, values(again))
                shared = later | np.isin(mine, values(owned))
                if within:
                    repeat = np.ones(len(mine), bool)
                    repeat[np.unique(mine, return_index=True)[1]] = False
                    later |= repeat
                gone, all_ = runs(later, c, e, least_run), runs(shared, c, e, least_run)
                zero = chars[starts[k]]
                span = lambda s, z=zero: ",".join(f"{chars[x] - z}:{chars[y] - z}" for x, y in s)
                data, keep, pos = raw[starts[k] : starts[k + 1]].tobytes(), [], 0
                for x, y in gone:
                    keep.append(data[pos : x - starts[k]])
                    pos = y - starts[k]
                texts.append(b"".join([*keep, data[pos:]]).decode())
                found.append((b - a, int(sum(((c >= x) & (e <= y)).sum() for x, y in all_)), span(all_), span(gone), int(sum(chars[y] - chars[x] for x, y in gone))))
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            new = [pa.array([f[i] for f in found], pa.string() if i in (2, 3) else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*names, *added])

    return mapped(rows, run, schema)
