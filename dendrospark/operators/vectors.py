"""Embeddings: normalising, similarity, pooling views to neurons, ranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder
from ..sources.files import located, opened

BROADCAST_ROWS = 20_000
QUERIES = 32_768  # queries that a task holds while it reads all items
QUERY_BLOCK = 4096
ITEM_BLOCK = 2048
Vectors = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: places, rows, rows in single precision
GROUP_BYTES, READ_BYTES = 4_000_000, 1_000_000  # of stored items: a row group, and what a task reads of it at a time


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


POOLS = ("mean", "max", "median", "l2_then_mean", "mean_then_l2", "concat_mean_std", "concat", "none")


def pool(views: DataFrame, how: str = "mean", group: str = "neuron_id", order: str = "view_id", vec: str = "vec") -> DataFrame:
    """(group, vec, n_poses): the views of a group merged element by element.

    Elements are exploded and pre-aggregated, so a group of any size is spread
    over tasks (``concat`` alone gathers a group, by its nature).
    """
    if how not in POOLS:
        raise ValueError(f"unknown pooling: {how}")
    if how == "none":
        return views
    if how == "concat":
        return views.groupBy(group).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, vec))), lambda r: r[vec])).alias("vec"), F.count("*").alias("n_poses"))
    rows = views.select(group, F.posexplode(normalised(F.col(vec)) if how == "l2_then_mean" else doubles(F.col(vec))).alias("i", "v"))
    agg = {"mean": [F.avg], "l2_then_mean": [F.avg], "mean_then_l2": [F.avg], "max": [F.max], "median": [F.median], "concat_mean_std": [F.avg, F.stddev_pop]}[how]
    each = rows.groupBy(group, "i").agg(*[f("v").alias(f"v{k}") for k, f in enumerate(agg)], F.count("*").alias("n"))
    list_ = lambda k: F.transform(F.sort_array(F.collect_list(F.struct("i", f"v{k}"))), lambda r: r[f"v{k}"])
    out = each.groupBy(group).agg((F.concat(list_(0), list_(1)) if how == "concat_mean_std" else list_(0)).alias("vec"), F.max("n").alias("n_poses"))
    return out.withColumn("vec", normalised(F.col("vec"))) if how == "mean_then_l2" else out


def first_of_group(views: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    return views.groupBy(group).agg(*[F.min_by(c, order).alias(c) for c in columns])


def pose_stats(pooled: DataFrame) -> DataFrame:
    n = F.col("n_poses")
    return pooled.agg(F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"))


def reduced(maps: Column, how: str = "mean") -> Column:
    """A stack of maps (array of arrays) as one value per map (mean, max) or flat."""
    if how == "flatten":
        return F.flatten(maps)
    if how == "max":
        return F.transform(maps, lambda m: F.array_max(m))
    return F.transform(maps, lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x) / F.size(m))


def similarities(queries: DataFrame, items: DataFrame, query_id: str, item_id: str) -> DataFrame:
    """(query, item, sim) of a stated query set against all items. The queries must be few (checked) and are broadcast."""
    n = queries.limit(BROADCAST_ROWS + 1).count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} queries; find their neighbours in blocks with nearest, their ranks with evaluate.ranks")
    q = queries.select(F.col(query_id), normalised(F.col("vec")).alias("qv"))
    i = items.select(F.col(item_id), normalised(F.col("vec")).alias("iv"))
    return i.crossJoin(F.broadcast(q)).select(query_id, item_id, dot(F.col("qv"), F.col("iv")).alias("sim"))


def top_k(sims: DataFrame, query_id: str, item_id: str, k: int) -> DataFrame:
    """The k most similar items per query with their rank; ties go to the smaller id. Spark keeps k rows per query before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(F.desc("sim"), item_id)
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths (-1 for null), starts and components (nan for null) of a column of vectors, without a Python object a vector."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    size = pc.list_value_length(a).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = np.maximum(size, 0)
    return size, np.cumsum(there) - there, a.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)


def plain(df: DataFrame, vec: str) -> Column:
    """The vectors as they are stored if they are of floats, else in double: ``units`` normalises them in columns, ``normalised`` takes half a millisecond a vector."""
    kind = df.schema[vec].dataType.elementType
    return F.col(vec) if isinstance(kind, T.FloatType) else F.col(vec).cast("array<double>")


def units(column: pa.ChunkedArray, codes: np.ndarray | None = None) -> Vectors:
    """The vectors of each length as ``normalised`` has them, in the order of their codes if there are; without vectors that are null or hold a null or nan, and without codes under 0."""
    size, at, x = flat(column)
    out: Vectors = {}
    for k in np.unique(size[size >= 0]).tolist():
        i = np.flatnonzero(size == k if codes is None else (size == k) & (codes >= 0))
        if codes is not None:
            i = i[np.argsort(codes[i], kind="stable")]
        rows = x[at[i][:, None] + np.arange(k)]
        with np.errstate(all="ignore"):
            rows = rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]
        there = ~np.isnan(rows).any(axis=1)
        if there.any():
            out[k] = i[there], rows[there], rows[there].astype(np.float32)
    return out


def products(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """All dot products of two columns of vectors; nan where one is null, holds a null or has another length."""
    out = np.full((len(a), len(b)), np.nan)
    (left, at, x), (right, to, y) = flat(a), flat(b)
    for size in np.intersect1d(left[left >= 0], right[right >= 0]):
        i, j = np.flatnonzero(left == size), np.flatnonzero(right == size)
        k = np.arange(size)
        out[np.ix_(i, j)] = x[at[i][:, None] + k] @ y[to[j][:, None] + k].T
    return out


def block_pairs(queries: DataFrame, items: DataFrame):
    """Blocks of about ``QUERY_BLOCK`` and ``ITEM_BLOCK`` rows, each of the ones with each of the others: a cogrouping, one pair of blocks a task at a time."""
    n_q, n_i = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-items.count() // ITEM_BLOCK))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    return dealt(queries, "qb", n_q, "ib", n_i).groupBy("qb", "ib").cogroup(dealt(items, "ib", n_i, "qb", n_q).groupBy("qb", "ib"))


def scanned(queries: DataFrame, items: DataFrame, run: Callable[[pa.Table, Callable[[], Iterator[pa.Table]]], Iterator[pa.Table]], schema: str) -> DataFrame:
    """The tables that ``run`` makes of each block of queries and a function that reads all items in chunks of at most ``ITEM_BLOCK`` rows, as often as it is called.

    Queries are dealt to tasks once; items are stored once in the shared folder,
    where every task reads them, so no pair of blocks is shuffled. They lie in small row groups and are
    read through a small buffer: a reader that takes a group's column whole would hold more of them the more there are.
    """
    spark = queries.sparkSession
    folder = f"{shared_folder(spark)}/items-{uuid.uuid4().hex}"
    items.write.option("parquet.block.size", GROUP_BYTES).parquet(folder)
    uri, rows, most = located(spark, folder), ITEM_BLOCK, QUERIES
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-queries.count() // (QUERIES * cores)))  # whole rounds, so that no core waits through the last one

    def chunks() -> Iterator[pa.Table]:
        system, base = opened(uri)
        for f in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
            if f.path.endswith(".parquet"):
                with system.open_input_file(f.path) as source:
                    for batch in pq.ParquetFile(source, buffer_size=READ_BYTES).iter_batches(rows, use_threads=False):
                        if batch.num_rows:
                            yield pa.Table.from_batches([batch])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) >= most):
                for made in run(pa.Table.from_batches(held).combine_chunks(), chunks):
                    yield from made.combine_chunks().to_batches()
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    return queries.repartition(tasks).mapInArrow(blocks, schema)


def nearest(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, k: int, places: int | None = None) -> DataFrame:
    """(query, item, sim, rank): the k most similar items of any number of queries, as ``top_k`` orders them.

    Queries and items are dealt into blocks (``block_pairs``). A task multiplies a block of queries with one of items
    and passes on k rows a query; these lists are merged by rank. Similarities are
    rounded to ``places`` before they are compared. Unknown ones come last.
    """
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("sim", T.DoubleType())])

    def run(q: pa.Table, it: pa.Table) -> pa.Table:
        it = it.sort_by("id")
        left, right, sims = [], [], []
        for at in range(0, len(q) if len(it) else 0, 512):
            s = products(q.column("v").slice(at, 512), it.column("v"))
            if places is not None:
                s = np.round(s, places)
            key = np.where(np.isnan(s), np.inf, -s)
            last = np.partition(key, k - 1, axis=1)[:, k - 1] if k < len(it) else np.full(len(key), np.inf)
            r, c = np.nonzero(key <= last[:, None])
            order = np.lexsort((c, key[r, c], r))
            r, c = r[order], c[order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, c = r[best], c[best]
            left.append(r + at)
            right.append(c)
            sims.append(s[r, c])
        r, c, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((left, np.int64), (right, np.int64), (sims, float)))
        return pa.table({query_id: q.column("id").take(pa.array(r)), item_id: it.column("id").take(pa.array(c)), "sim": pa.array(s, mask=np.isnan(s))})

    q, it = (df.select(F.col(i).alias("id"), normalised(F.col("vec")).alias("v")) for df, i in ((queries, query_id), (items, item_id)))
    return top_k(block_pairs(q, it).applyInArrow(run, schema), query_id, item_id, k)


def nearest_class(sims: DataFrame, item_id: str, class_id: str) -> DataFrame:
    """Per item the class of the best similarity, the smaller id on ties."""
    return sims.groupBy(item_id).agg(F.max_by(class_id, F.struct(F.col("sim"), -F.col(class_id))).alias("predicted"))


def group_cosines(items: DataFrame, id_column: str, label: str) -> DataFrame:
    """Mean cosine within and between labels, from label sums: no pair is formed.

    The pairs of a set have the summed cosine (|sum of unit vectors|^2 - n) / 2.
    """
    rows = items.select(F.col(label).alias("l"), F.posexplode(normalised(F.col("vec"))).alias("i", "v"))
    each = rows.groupBy("l", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    own = each.groupBy("l").agg(F.sum(F.col("s") ** 2).alias("q"), F.max("n").alias("n"))
    all_ = each.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") ** 2).alias("q"), F.max("n").alias("n"))
    inner = own.agg(F.sum((F.col("q") - F.col("n")) / 2).alias("intra_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("intra_n"))
    both = inner.crossJoin(all_)
    total, pairs = (F.col("q") - F.col("n")) / 2, F.col("n") * (F.col("n") - 1) / 2
    return both.select(F.try_divide("intra_sum", "intra_n").alias("intra"), F.try_divide(total - F.col("intra_sum"), pairs - F.col("intra_n")).alias("inter"))


def pca_scatter(items: DataFrame, id_column: str, k: int = 2) -> DataFrame:
    """(id, point): vectors, less their mean, on their first ``k`` principal components; each component's largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = items.where("vec is not null").select(id_column, doubles(F.col("vec")).alias("x"))
    model = PCA(k=k, inputCol="f", outputCol="p").fit(rows.select(array_to_vector("x").alias("f")))
    axes = model.pc.toArray()
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    mean = pool(rows.select(F.lit(0).alias("all"), F.col("x").alias("vec"), id_column), "mean", "all", id_column).select(F.col("vec").alias("mean"))
    both = rows.crossJoin(F.broadcast(mean))  # one row
    less = F.zip_with("x", "mean", lambda x, m: x - m)
    return both.select(id_column, F.array(*[dot(less, F.array(*map(F.lit, axis.tolist()))) for axis in axes.T]).alias("point"))
