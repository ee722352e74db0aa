"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, and how often each pair does so in the corpus.

Tokens of A (byte-level BPE) and B (SentencePiece BPE) cut the same bytes. Places
where both cut form groups; an A and a B token are linked where their byte ranges
overlap. Links equal the pieces between neighbouring cuts of either, so they
are found by marking cuts in a slice of text, without comparing tokens.

``pair_counts`` is the first pass. Tasks align their documents and write the
distinct pairs they met with their numbers. The distinct pairs are split into
shards of some ``SHARD`` pairs; each gets a minimal perfect hash (levels of bits:
a key that is alone in its place of a level gets the place, the others go on to
the next level). Dense count vectors, indexed by the hash after the key kept
at that index has been verified, are made from bounded portions of what the tasks
wrote and summed in a tree of ``FAN`` vectors a step. ``aligned`` is the
second pass: it aligns the documents anew and looks every link up. The shards are
broadcast up to ``HELD`` pairs (some 70 MB); where there are more, the most
frequent ones are, hashed anew, and the others are joined by key.

Null and empty texts, and texts that one of the tokenizers doesn't give back byte
by byte, have no tokens: zeros and an empty ``groups_sha256``. Repeated rows and
null ids count and return like any other; very long texts are aligned whole, alone
in their slice; further columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, mapped, mixed, slices, text_bytes, written
from .sp_bpe import BYTE, Bpe, model_of, within

SHARD = 1 << 18  # pairs a shard of the perfect hash holds, about
ROWS = 1 << 20  # rows of counts that one task adds to a vector, about
FAN = 16
HELD = 1 << 22  # pairs whose counts are broadcast at most
FLUSH = 1 << 20  # distinct pairs a task of the first pass holds
LEVELS = 200
SHIFT = 16  # a pair is its A id shifted, plus its B id

RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelled:
    """Bytes of every token of a vocabulary, and the texts that stand for its ids in a digest."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.text = np.array([[f"{i}{inner}" for i in range(len(tokens))], [f"{i}{last}" for i in range(len(tokens))]], object)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.flat[np.repeat(self.at[ids], size) + within(size)]


@dataclass
class Alignment:
    """A slice of texts: of each row whether it has tokens, and for all rows' tokens together their ids and the bytes they end at."""

    has: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    row_end: np.ndarray

    def marks(self, *ends: np.ndarray) -> np.ndarray:
        out = np.zeros(int(self.row_end[-1]) + 1 if len(self.row_end) else 1, bool)
        for e in ends:
            out[e] = True
        return out

    @cached_property
    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of A, of B and of both, as marks on bytes."""
        a, b = self.marks(self.a_end), self.marks(self.b_end)
        return a, b, a & b

    def per_row(self, mark: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(mark)[self.row_end]])

    @cached_property
    def links(self) -> np.ndarray:
        """Keys of all links, row by row: every piece between neighbouring ends lies in one token of each."""
        a, b, _ = self.cuts
        u = np.flatnonzero(a | b)
        return (self.a[(np.cumsum(a) - a)[u]] << SHIFT) | self.b[(np.cumsum(b) - b)[u]]

    def digests(self, one: Spelled, two: Spelled, whole: bool) -> list[tuple[str, str]]:
        """SHA-256 of each row's groups, and the text of the groups if ``whole``."""
        a, b, both = self.cuts
        group = np.cumsum(both) - both
        ends = np.flatnonzero(both)
        a_to, b_from = np.cumsum(a)[ends], np.r_[0, np.cumsum(b)[ends]]
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + b_from[group[self.a_end]]] = one.text[both[self.a_end].astype(np.int8), self.a]
        out[np.arange(len(self.b)) + a_to[group[self.b_end]]] = two.text[both[self.b_end].astype(np.int8), self.b]
        at = (self.a_at + self.b_at).tolist()
        texts = ("".join(out[x:y].tolist())[:-1] for x, y in zip(at[:-1], at[1:], strict=True))
        return [(hashlib.sha256(t.encode()).hexdigest(), t if whole else "") for t in texts]


class Aligner:
    """Both tokenizers, from the bytes of their files."""

    def __init__(self, tokenizer: bytes, model: bytes):
        import tiktoken

        said = json.loads(tokenizer)
        special = {t["content"] for t in said.get("added_tokens", [])}
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        # The pre-tokenizer's pattern of byte-level BPE, a fixed value.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.one = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = tokenizer, None
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.a = Spelled(tokens, ",", "|")
        self.two: Bpe = model_of(model)
        pieces = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace("▁", " ").encode() for p, k in zip(self.two.piece, self.two.kind, strict=True)]
        self.b = Spelled(pieces, ",", ";")
        if len(pieces) > 1 << SHIFT:
            raise ValueError(f"a vocabulary of more than {1 << SHIFT} pieces")

    def first_ids(self, text: str) -> list[int]:
        """Ids of A. Its fast form gives up on white space of some hundred thousand characters; the tokenizer's own library takes such texts."""
        try:
            return self.one.encode_ordinary(text)
        except BaseException as error:
            if type(error).__name__ != "PanicException":
                raise
            from tokenizers import Tokenizer

            if self.slow is None:
                self.slow = Tokenizer.from_buffer(self.file)
                self.slow.encode_special_tokens = True
            return self.slow.encode(text, add_special_tokens=False).ids

    def align(self, texts: list[str | None], raw: np.ndarray, starts: np.ndarray) -> Alignment:
        full = np.diff(starts) > 0
        want = np.insert(raw, starts[:-1][full], 0x20)
        want_at = starts + np.r_[0, np.cumsum(full)]
        lists = [self.first_ids(" " + t) if t else [] for t in texts]
        a_at = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)]
        a = np.fromiter(chain.from_iterable(lists), np.int64, int(a_at[-1]))
        b, b_at = self.two.encode_rows(raw, starts)
        has = full.copy()
        for ids, at, said in ((a, a_at, self.a), (b, b_at, self.b)):
            has &= np.diff(np.r_[0, np.cumsum(said.size[ids])][at]) == np.diff(want_at)
        for ids, at, said in ((a, a_at, self.a), (b, b_at, self.b)):
            got = said.spell(ids[np.repeat(has, np.diff(at))])
            wrong = np.r_[0, np.cumsum(got != want[np.repeat(has, np.diff(want_at))])]
            ends = np.r_[0, np.cumsum(np.diff(want_at)[has])]
            has[np.flatnonzero(has)[np.diff(wrong[ends]) > 0]] = False
        out = []
        for ids, at, said in ((a, a_at, self.a), (b, b_at, self.b)):
            ids = ids[np.repeat(has, np.diff(at))]
            out.append((ids, np.r_[0, np.cumsum(np.diff(at)[has])], np.cumsum(said.size[ids])))
        (a, a_at, a_end), (b, b_at, b_end) = out
        return Alignment(has, a, b, a_at, b_at, a_end, b_end, np.cumsum(np.diff(want_at)[has]))

    def batches(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
        for batch in slices(batches, column):
            yield batch, self.align(batch.column(column).to_pylist(), *text_bytes(batch.column(column)))


_aligners: dict[bytes, Aligner] = {}


def aligner_of(files: tuple[bytes, bytes]) -> Aligner:
    key = hashlib.sha256(b"".join(files)).digest()
    if key not in _aligners:
        _aligners[key] = Aligner(*files)
    return _aligners[key]


class PerfectHash:
    """A minimal perfect hash of distinct keys: bits of all levels behind each other; a key's index is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.frombuffer(bits, np.uint8)
        ones = np.bitwise_count(self.bits)
        self.rank = np.cumsum(ones, dtype=np.int64) - ones

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = mixed(np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15))
        return (mixed(keys.astype(np.uint64) ^ seed) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys repeat")
            sizes.append(max(64, -(-2 * len(left) // 8) * 8))
            at = cls.place(left, len(sizes) - 1, sizes[-1])
            alone = np.bincount(at, minlength=sizes[-1]) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(sizes, b"".join(p.tobytes() for p in parts))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; any index or -1 for keys that weren't hashed."""
        out = np.full(len(keys), -1)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self.place(keys[left], level, size)
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = byte[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1))
            out[left[hit]] = self.rank[at[hit] >> 3] + np.bitwise_count(below)
            left, base = left[~hit], base + size
        return out

    def ordered(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), np.int64)
        out[self.index(keys)] = keys
        return out


def shard_number(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> SHIFT) * 40503 + (keys & ((1 << SHIFT) - 1))) % shards


def shard_column(shards: int) -> F.Column:
    return F.expr(f"cast(pmod(shiftright(key, {SHIFT}) * 40503L + (key & {(1 << SHIFT) - 1}L), {shards}L) as int)")


class Counts:
    """Counts of pairs, by hash, with the keys that prove a hit."""

    def __init__(self, rows: list[tuple], shards: int, best: np.ndarray):
        self.shards, self.best = shards, best
        self.table = {s: (PerfectHash(sizes, bits), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)) for s, sizes, bits, keys, counts in rows}

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts; -1 for pairs that the table doesn't hold."""
        out, shard = np.full(len(keys), -1), shard_number(keys, self.shards)
        for s in np.unique(shard).tolist():
            if s in self.table:
                mine = np.flatnonzero(shard == s)
                hashed, kept, counts = self.table[s]
                at = hashed.index(keys[mine])
                known = at >= 0
                known[known] = kept[at[known]] == keys[mine[known]]
                out[mine[known]] = counts[at[known]]
        return out


def met_pairs(docs: DataFrame, files) -> DataFrame:
    """Distinct pairs each task met, with their numbers: key, n, leaf (the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, leaf = aligner_of(files.value), TaskContext.get().partitionId()
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                k, n = keys[i : i + (1 << 16)], counts[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(np.full(len(k), leaf, np.int32))], names=["key", "n", "leaf"])

        for _, found in aligner.batches(batches, 0):
            k, n = np.unique(found.links, return_counts=True)
            keys, of = np.unique(np.r_[keys, k], return_inverse=True)
            counts = np.bincount(of, np.r_[counts, n], len(keys)).astype(np.int64)
            if len(keys) > FLUSH:
                yield from told()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from told()

    return mapped(docs.select("text"), run, "key bigint, n bigint, leaf int")


def hashed(keys: DataFrame, shards: int) -> DataFrame:
    """A perfect hash for each shard of distinct ``keys``: shard, sizes, bits, keys (in the order of the hash)."""

    def build(group: pa.Table) -> pa.Table:
        mine = group["key"].to_numpy()
        table = PerfectHash.of(mine)
        return pa.table({"shard": group["shard"][:1], "sizes": pa.array([table.sizes], pa.list_(pa.int32())), "bits": [table.bits.tobytes()], "keys": [table.ordered(mine).tobytes()]})

    return keys.withColumn("shard", shard_column(shards)).groupBy("shard").applyInArrow(build, "shard int, sizes array<int>, bits binary, keys binary")


def vectors(met: DataFrame, table: DataFrame, shards: int, rows: int) -> DataFrame:
    """Count vectors of all shards: shard, counts. Leaves add bounded portions of ``met``; a tree adds the leaves."""
    leaves = max(1, math.ceil(rows / (shards * ROWS)))

    def leaf_counts(part: pa.Table, hashes: pa.Table) -> pa.Table:
        keys, n = part["key"].to_numpy(), part["n"].to_numpy()
        kept = np.frombuffer(hashes["keys"][0].as_py(), np.int64)
        at = PerfectHash(hashes["sizes"][0].as_py(), hashes["bits"][0].as_py()).index(keys)
        if not (kept[at] == keys).all():
            raise ValueError("a pair isn't in the hash")
        out = np.zeros(len(kept), np.int64)
        np.add.at(out, at, n)
        return pa.table({"shard": hashes["shard"], "leaf": hashes["leaf"], "counts": [out.tobytes()]})

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c.as_py(), np.int64) for c in group["counts"]], axis=0)
        return pa.table({"shard": group["shard"][:1], "leaf": group["leaf"][:1], "counts": [total.tobytes()]})

    schema = "shard int, leaf int, counts binary"
    parts = met.select("key", "n", shard_column(shards).alias("shard"), F.expr(f"leaf % {leaves}").cast("int").alias("leaf"))
    hashes = table.withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))))
    out = parts.groupBy("shard", "leaf").cogroup(hashes.groupBy("shard", "leaf")).applyInArrow(leaf_counts, schema)
    while leaves > 1:
        out = out.withColumn("leaf", F.expr(f"cast(leaf div {FAN} as int)")).groupBy("shard", "leaf").applyInArrow(added, schema)
        leaves = math.ceil(leaves / FAN)
    return out.drop("leaf")


@dataclass
class PairTable:
    """What the first pass leaves: the shards with their counts (shard, sizes, bits, keys, counts), their number and the pairs'."""

    table: DataFrame
    shards: int
    pairs: int

    def rows(self) -> DataFrame:
        """key, n: one row a pair."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), np.int64)) for x in (keys, counts)], names=["key", "n"])

        return mapped(self.table.select("keys", "counts"), run, "key bigint, n bigint")

    def best(self) -> np.ndarray:
        """The largest count of each B id; as many numbers as B can have ids, whatever the corpus."""
        out = np.zeros(1 << SHIFT, np.int64)
        for r in self.rows().groupBy(F.expr(f"key & {(1 << SHIFT) - 1}L").alias("b")).agg(F.max("n").alias("n")).toLocalIterator():
            out[r.b] = r.n
        return out

    def held(self, limit: int) -> tuple[list[tuple], int, DataFrame | None]:
        """Shards of the most frequent pairs, ``limit`` at most; their number; and the other pairs, None if there are none."""
        if self.pairs <= limit:
            return [tuple(r) for r in self.table.toLocalIterator()], self.shards, None
        # Counts are split at a power of two: as many rows as a long has bits.
        sizes = {r.bits: r.pairs for r in self.rows().groupBy(F.expr("length(bin(n))").alias("bits")).agg(F.count("*").alias("pairs")).collect()}
        bits, total = 64, 0
        while total + sizes.get(bits - 1, 0) <= limit:
            bits -= 1
            total += sizes.get(bits, 0)
        frequent = F.expr(f"length(bin(n)) >= {bits}")
        shards = max(1, -(-total // SHARD)) | 1
        hot = self.rows().where(frequent)
        table = hashed(hot.select("key"), shards)
        found = table.join(vectors(hot.withColumn("leaf", F.lit(0)), table, shards, 0), "shard").select("shard", "sizes", "bits", "keys", "counts")
        return [tuple(r) for r in found.toLocalIterator()], shards, self.rows().where(~frequent)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pair_counts(docs: DataFrame, tokenizer_path: str, model_path: str) -> PairTable:
    """Counts of all pairs of an A and a B id over the texts of ``docs``; the table is written to the shared folder."""
    files = docs.sparkSession.sparkContext.broadcast((read(tokenizer_path), read(model_path)))
    met = written(met_pairs(docs, files), "pairs-met")
    distinct = written(met.select("key").distinct(), "pairs")
    pairs = distinct.count()
    shards = max(1, -(-pairs // SHARD)) | 1
    table = written(hashed(distinct, shards), "pair-hash")
    counts = vectors(met, table, shards, met.count())
    out = written(table.join(counts, "shard").select("shard", "sizes", "bits", "keys", "counts"), "pair-counts")
    discard(met, distinct, table)
    return PairTable(out, shards, pairs)


def aligned(docs: DataFrame, tokenizer_path: str, model_path: str, with_groups: bool = False, held: int = HELD) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the largest of their B id), count_sum, groups_sha256; ``groups`` if asked for."""
    spark = docs.sparkSession
    counted = pair_counts(docs, tokenizer_path, model_path)
    best = counted.best()
    rows, shards, rare = counted.held(held)
    files = spark.sparkContext.broadcast((read(tokenizer_path), read(model_path)))
    kept = spark.sparkContext.broadcast((rows, shards, best))
    schema = f"{RESULT}, groups string, rare array<struct<key: bigint, times: bigint>>"
    tables: list[Counts] = []  # of this worker, filled once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(files.value)
        if not tables:
            tables.append(Counts(*kept.value))
        table = tables[0]
        low = (1 << SHIFT) - 1
        for batch, found in aligner.batches(batches, 1):
            a, b, both = found.cuts
            keys, of = np.unique(found.links, return_inverse=True)
            n = table.get(keys)
            top = (n == table.best[keys & low]).astype(np.int64)
            links = found.per_row(a | b)
            ends = np.cumsum(links)

            def per_row(values: np.ndarray, ends=ends, of=of) -> np.ndarray:
                return np.diff(np.r_[0, np.r_[0, np.cumsum(values[of])][ends]])

            missing = [[] for _ in range(batch.num_rows)]
            for row in np.flatnonzero(per_row((n < 0).astype(np.int64))).tolist():
                k, times = np.unique(found.links[ends[row] - links[row] : ends[row]], return_counts=True)
                absent = n[np.searchsorted(keys, k)] < 0
                missing[int(np.flatnonzero(found.has)[row])] = [{"key": x, "times": y} for x, y in zip(k[absent].tolist(), times[absent].tolist(), strict=True)]
            columns = [np.diff(found.a_at), np.diff(found.b_at), found.per_row(both), links, per_row(top), per_row(np.maximum(n, 0))]
            said = iter(found.digests(aligner.a, aligner.b, with_groups))
            texts = [next(said) if h else ("", "") for h in found.has]
            arrays = [batch.column(0)]
            for c in columns:
                whole = np.zeros(batch.num_rows, np.int64)
                whole[found.has] = c
                arrays.append(pa.array(whole))
            arrays += [pa.array([t[i] for t in texts], pa.string()) for i in (0, 1)]
            arrays.append(pa.array(missing, pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups", "rare"])

    out = mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, schema)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    if rare is None:
        return out.select(*names)
    # Rare pairs have small counts, so none is a hot key of this join.
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "aligned")
    largest = spark.createDataFrame([(int(b), int(best[b])) for b in np.flatnonzero(best)], "b int, most bigint")
    rare = rare.withColumn("b", F.expr(f"cast(key & {(1 << SHIFT) - 1}L as int)")).join(F.broadcast(largest), "b").selectExpr("key", "n", "n = most as top")
    more = out.select("row", F.inline("rare")).join(rare, "key").groupBy("row").agg(F.sum(F.expr("if(top, times, 0L)")).alias("more_best"), F.sum(F.expr("n * times")).alias("more_sum"))
    out = out.join(more, "row", "left").withColumns({"n_best": F.expr("n_best + coalesce(more_best, 0L)"), "count_sum": F.expr("count_sum + coalesce(more_sum, 0L)")})
    return out.select(*names)
