"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets the signs of 64 random projections of its own,
concatenated. Vectors are ordered by them lexicographically (a range
partitioning, so any number of tasks share the order), and each is compared with
the ``WINDOW`` before it by cosine in double precision. The rows at the edges of
range partitions are compared again across them, so the links don't depend on
the number of partitions. Verified pairs of
all passes are united to components; a task passes on only a spanning forest of
what it has verified, so a dense group costs rows in proportion to its size.

A window is bounded, so a dense group has links that no window shows. They are
all found afterwards: within each component every pair is compared, in blocks of
``BLOCK`` vectors that spread over tasks, and only counted. Equal vectors are one
class from the start. Recall can thus only be lost between components.

Vectors usually share a direction, which makes all their signs alike, so the mean
of all is taken off before they are projected. That leaves less of the likeness of
a pair: at cosine 0.9 two vectors agree in a sign with probability 0.86, but 0.73
if the mean pair has a cosine of 0.7. The number of passes therefore follows from
the vectors (``passes_needed``): for each of a sample of at most ``SAMPLE`` it is
measured how many signs leave ``WINDOW`` vectors together, and computed how
likely a partner at the least cosine agrees in all of them; as many passes are made as find
such partners with probability ``RECALL`` on average. Where no link may be lost,
``exact`` compares all blocks of all vectors instead.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mapped, salted_fold, written

RECALL = 0.98  # of isolated pairs at the least cosine
PASSES = 16  # at least
MOST_PASSES = 4096  # a table that needs more is refused rather than searched in part
PASSES_A_JOB = 4  # passes whose sorted copies are on disk at a time
WINDOW = 256
SAMPLE = 8192
BLOCK = 256
COSINE = 0.9


@cache
def planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([number, dim, 77]).standard_normal((dim, 64))


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """The signs of a pass's projections as 64-bit numbers."""
    return np.packbits(x @ planes(number, x.shape[1]) > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def passes_needed(x: np.ndarray, centre: np.ndarray, n: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes over ``n`` vectors, of which the unit vectors ``x`` are a sample, that show a partner at ``cosine`` with probability ``recall``; ``PASSES`` at least."""
    if n <= window or not len(x):
        return PASSES
    # A partner as near the mean as its vector: its cosine once the mean is off.
    away = np.maximum(1e-9, 1 - 2 * x @ centre + centre @ centre)
    agree = 1 - np.arccos(np.clip((cosine - 1 + away) / away, -1, 1)) / math.pi
    most = max(1.0, window * len(x) / n)  # vectors of the sample that stand for a window
    further = max(0.0, math.log2(n / (window * len(x))))
    met = []
    for p in range(2):
        codes = signs(x - centre, p)
        depth = np.zeros(len(x), np.int64)
        for d in range(65):
            prefix = codes >> np.uint64(64 - d) if d else codes * np.uint64(0)
            _, of, size = np.unique(prefix, return_inverse=True, return_counts=True)
            together = size[of] > most
            depth[together] = d + 1
            if not together.any():
                break
        met.append(np.minimum(1.0, agree ** (depth + further)))
    met = np.concatenate(met)
    low, high = 0, PASSES
    while np.mean(1 - (1 - met) ** high) < recall:
        low, high = high, 2 * high
        if high > MOST_PASSES:
            raise ValueError(f"more than {MOST_PASSES} passes would be needed; exact=True compares all vectors")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if np.mean(1 - (1 - met) ** middle) < recall else (low, middle)
    return max(PASSES, high)


def centres(vecs: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors (in bytes) their number and the mean of the unit vectors: a row of fixed size a task, folded in two steps."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for size, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, t = total.get(size, (0, 0.0))
                total[size] = (m + n, t + np.frombuffer(raw, np.float64))
        yield from told(total)

    def told(total) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([t.tobytes() for _, t in total.values()], pa.binary())], names=["size", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            raw = batch.column(0).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                n, t = total.get(size, (0, 0.0))
                total[size] = (n + len(mine), t + units_of([raw[i] for i in mine]).sum(axis=0))
        yield from told(total)

    rows = salted_fold(mapped(vecs.select("vec"), run, "size int, n long, total binary"), fold)
    return {r["size"]: (r.n, np.frombuffer(r.total, np.float64) / r.n) for r in rows.toLocalIterator()}


def passes_over(vecs: DataFrame, means: dict[int, tuple[int, np.ndarray]], window: int, cosine: float) -> int:
    """The passes that the vectors of every length need, judged by a sample of ``SAMPLE`` vectors by hash."""
    n = sum(m for m, _ in means.values())
    some = vecs.select("vec").where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // SAMPLE)))) == 0)
    raw = [bytes(r.vec) for r in some.toLocalIterator()]
    by_size = {size: [r for r in raw if len(r) == size] for size in means}
    return max([PASSES, *(passes_needed(units_of(v), means[size][1], means[size][0], window, cosine) for size, v in by_size.items() if v)])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, d1, d2, vec) of the vectors that can link; vec is their components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ds, raw = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids.append(i)
                raw.append(x.tobytes())
                ds.append(np.frombuffer(hashlib.blake2b(raw[-1], digest_size=16).digest(), "<i8"))
            d = np.array(ds, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(raw, pa.binary())], names=["vec_id", "d1", "d2", "vec"])

    return mapped(embeddings, run, "vec_id long, d1 long, d2 long, vec binary")


def units_of(raw: list[bytes]) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares finite."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of pairs that keep the components of all pairs: rounds in which every component takes its first pair to another."""
    label = np.arange(n)
    keep = np.zeros(len(a), bool)
    while True:
        la, lb = label[a], label[b]
        out = np.flatnonzero(la != lb)
        if not len(out):
            return np.flatnonzero(keep)
        first = np.full(n, len(a))
        np.minimum.at(first, la[out], out)
        np.minimum.at(first, lb[out], out)
        chosen = np.unique(first[first < len(a)])
        keep[chosen] = True
        while True:  # spread the smaller label over the chosen pairs
            low = np.minimum(label[a[chosen]], label[b[chosen]])
            new = label.copy()
            np.minimum.at(new, label[a[chosen]], low)
            np.minimum.at(new, label[b[chosen]], low)
            new = new[new]
            new = new[label]
            if (new == label).all():
                break
            label = new


def windows(batches: Iterator[pa.RecordBatch], window: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of rows at most ``window`` apart. The last two columns are vec_id and vec; rows that are equal in the others are one sequence."""
    group, ids, x = None, np.zeros(0, np.int64), None  # the sequence, and its last rows
    for batch in batches:
        kinds = np.stack([c.to_numpy() for c in batch.columns[:-2]], 1)
        cuts = np.flatnonzero(np.any(kinds[1:] != kinds[:-1], axis=1)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(kinds)], strict=True):
            for at in range(a, b, 2048):
                part = batch.slice(at, min(b, at + 2048) - at)
                new_ids, new = part.column(part.num_columns - 2).to_numpy(), units_of(part.column(part.num_columns - 1).to_pylist())
                if group != tuple(kinds[a]):
                    group, ids, x = tuple(kinds[a]), np.zeros(0, np.int64), new[:0]
                before = len(ids)
                ids, x = np.r_[ids, new_ids], np.r_[x, new]
                left, right = [], []
                for i in range(before, len(ids), 256):
                    low, high = max(0, i - window), min(i + 256, len(ids))
                    r, c = np.nonzero(x[i:high] @ x[low:high].T >= cosine)
                    r, c = r + i, c + low
                    ok = (c < r) & (r - c <= window)
                    left.append(r[ok])
                    right.append(c[ok])
                l_, r_ = np.concatenate(left), np.concatenate(right)
                keep = forest(len(ids), l_, r_)
                yield ids[l_[keep]], ids[r_[keep]]
                ids, x = ids[-window:], x[-window:]


def sorted_pass(classes: DataFrame, numbers: list[int], window: int, cosine: float, means: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """Verified links (a, b) from the windows of some passes; ``means`` are what ``centres`` gives."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                x = units_of([raw[i] for i in mine]) - means[int(size)][1]
                for p in numbers:
                    sign = signs(x, p) ^ np.uint64(1 << 63)  # so that signed order is the order of the bits
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mine), p, np.int32)), pa.array(np.full(len(mine), size, np.int32)), pa.array(sign.view(np.int64)), batch.column(0).take(pa.array(mine)), pa.array([raw[i] for i in mine], pa.binary())],
                        names=["pass", "size", "sign", "vec_id", "vec"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a range partition, then its first and last ``window`` rows with their place ``at`` of ``n``."""
        n, head, tail = 0, None, None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal n, head, tail
            for batch in batches:
                if not batch.num_rows:
                    continue
                narrow = batch.select(["pass", "size", "vec_id", "vec"])
                more = pa.Table.from_batches([narrow])
                n += batch.num_rows
                head = more.slice(0, window) if head is None else head if len(head) >= window else pa.concat_tables([head, more]).slice(0, window)
                tail = more if tail is None else pa.concat_tables([tail, more])
                tail = tail.slice(max(0, len(tail) - window))
                yield narrow

        for a, b in windows(watched(), window, cosine):
            none = [pa.nulls(len(a), f.type) for f in edge]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=["a", "b", *edge.names])
        if not n:
            return
        new = max(0, len(head) + len(tail) - n)  # so many rows of the tail are in the head
        at = np.r_[np.arange(len(head)), np.arange(n - len(tail) + new, n)]
        rows = pa.concat_tables([head, tail.slice(new)]).combine_chunks()
        own = [pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array(at), pa.array(np.full(len(at), n))]
        none = [pa.nulls(len(at), pa.int64())] * 2
        for batch in pa.Table.from_arrays([*none, *own, *rows.columns], names=["a", "b", *edge.names]).to_batches():
            yield batch

    edge = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("pass", pa.int32()), ("size", pa.int32()), ("vec_id", pa.int64()), ("vec", pa.binary())])
    rows = mapped(classes.select("vec_id", "vec"), project, "pass int, size int, sign long, vec_id long, vec binary")
    order = ["pass", "size", "sign", "vec_id"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(mapped(ranges, compare, "a long, b long, part int, at long, n long, pass int, size int, vec_id long, vec binary"), "windows")
    return found.where("a is not null").select("a", "b").union(across(found.where("part is not null").drop("a", "b"), window, cosine))


def across(edges: DataFrame, window: int, cosine: float) -> DataFrame:
    """Verified links (a, b) between range partitions: the first rows of each are compared behind the ``window`` rows before it, of however many partitions.

    Only each partition's number of rows is collected.
    """
    sizes = sorted((r["part"], r["n"]) for r in edges.groupBy("part").agg(F.max("n").alias("n")).collect())
    reach = []  # (part, a later partition, rows between both)
    for k, (part, _) in enumerate(sizes):
        between = 0
        for later, n in sizes[k + 1 :]:
            reach.append((part, later, between))
            between += n
            if between >= window:
                break
    spark = edges.sparkSession
    reached = edges.join(F.broadcast(spark.createDataFrame(reach, "part int, into int, between long")), "part").where(F.col("n") - F.col("at") + F.col("between") <= window)
    names = ["into", "part", "at", "pass", "size", "vec_id", "vec"]
    rows = reached.select(*names).union(edges.where(F.col("at") < window).withColumn("into", F.col("part")).select(*names))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in windows((batch.select(["into", "pass", "size", "vec_id", "vec"]) for batch in batches if batch.num_rows), window, cosine):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return mapped(rows.repartition("into").sortWithinPartitions("into", "part", "at"), compare, "a long, b long")


def blockwise(classes: DataFrame, comps: DataFrame, cosine: float, links: bool) -> DataFrame:
    """Compares all classes of each component in pairs of blocks, which grow with a component of more than 64 of them.

    Gives (vec_id, near), the copies in other classes that a class links with as
    far as a block shows, or with ``links`` (a, b), links that join what a block's join.
    """
    many = comps.groupBy("component").count().withColumn("blocks", F.ceil(F.col("count") / (BLOCK * F.least(F.lit(8.0), F.greatest(F.lit(1.0), F.col("count") / (64 * BLOCK))))).cast("int")).drop("count")
    mine = comps.join(many, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "own").alias("ca"), F.greatest(k, "own").alias("cb")))
    spread = mine.select("component", F.col("node").alias("vec_id"), "own", F.explode(other).alias("e")).select("component", "e.*", "own", "vec_id")
    rows = spread.join(classes.select("vec_id", "copies", "vec"), "vec_id").select("component", "ca", "cb", "own", "vec_id", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            key = np.stack([rest.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            cut = np.flatnonzero(np.any(key != key[-1], axis=1)) if len(key) else []
            if len(cut):
                yield counted(rest.slice(0, cut[-1] + 1))
                rest = rest.slice(cut[-1] + 1)
        if rest is not None and rest.num_rows:
            yield counted(rest)

    def counted(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
        own, ids, copies, raw = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy(), t.column(6).to_pylist()
        first = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1)])
        out_ids, out, joins = [], [], []
        for a, b in zip(first, np.r_[first[1:], len(key)], strict=True):
            x = units_of(raw[a:b])
            if key[a, 1] == key[a, 2]:
                hit = x @ x.T >= cosine
                np.fill_diagonal(hit, False)
                near = hit @ copies[a:b]
                pair = np.nonzero(np.triu(hit))
            else:
                split = int((own[a:b] == key[a, 1]).sum())  # sorted by block
                hit = x[:split] @ x[split:].T >= cosine
                near = np.r_[hit @ copies[a + split : b], hit.T @ copies[a : a + split]]
                pair = np.nonzero(hit)
                pair = pair[0], pair[1] + split
            if links:
                keep = forest(b - a, *pair)
                joins.append(ids[a:b][np.stack(pair, 1)[keep]])
            out_ids.append(ids[a:b])
            out.append(near)
        if links:
            both = np.concatenate(joins)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out).astype(np.int64))], names=["vec_id", "near"])

    order = ["component", "ca", "cb", "own", "vec_id"]
    return mapped(rows.repartition("component", "ca", "cb").sortWithinPartitions(*order), run, "a long, b long" if links else "vec_id long, near long")


def link_counts(classes: DataFrame, comps: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, near): the copies in other classes of its component that a class links with."""
    return blockwise(classes, comps, cosine, False).groupBy("vec_id").agg(F.sum("near").alias("near"))


def all_links(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b): links that keep all components, by comparing every vector with every other of its length; the work grows with the square of their number."""
    together = classes.select(F.col("vec_id").alias("node"), F.length("vec").cast("long").alias("component"))
    return blockwise(classes, together, cosine, True)


def near_duplicates(embeddings: DataFrame, passes: int | None = None, window: int = WINDOW, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing; so do vectors of different lengths with each other. A repeated row
    counts once in links. A null id gives a row with no links and null component.
    Further columns are not read; an empty table gives an empty result. Without
    ``passes`` their number follows from the vectors (``passes_needed``); with
    ``exact`` there are none, and all vectors are compared.
    """
    narrow = embeddings.selectExpr("cast(vec_id as bigint) vec_id", "embedding")
    rows = written(usable(narrow), "vectors")
    ids = rows.select("vec_id", "d1", "d2").distinct()
    grouped = written(ids.groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    vecs = rows.join(grouped, (rows.d1 == grouped.d1) & (rows.d2 == grouped.d2) & (rows.vec_id == grouped.rep)).select("vec_id", "copies", "vec")
    vecs = written(vecs.dropDuplicates(["vec_id"]), "representatives")
    means = {} if exact else centres(vecs)
    passes = 0 if exact else passes or passes_over(vecs, means, window, cosine)
    links = written(all_links(vecs, cosine).distinct(), "links") if exact else None
    for at in range(0, passes, PASSES_A_JOB):
        part = written(sorted_pass(vecs, list(range(at, min(passes, at + PASSES_A_JOB))), window, cosine, means).distinct(), "links")
        links = part if links is None else links.union(part)
    comps = components(links)
    near = link_counts(vecs, comps, cosine)
    per_class = grouped.join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(near.withColumnRenamed("vec_id", "rep"), "rep", "left")
    per_class = per_class.select("d1", "d2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    per_vector = ids.join(per_class, ["d1", "d2"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = narrow.select("vec_id").join(per_vector, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
