"""Helpers that the operators of this subpackage share.

Text reaches Python only as Arrow batches. A batch is cut into slices of
bounded bytes, so a task's memory follows the slice size (or one document, if
that is longer), not the number of rows Spark puts in a batch. The batches
themselves are bounded by Spark's own setting (``mapped``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0xD1342543DE82EF95)
_MULT_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor reaches: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing will read again."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished stages now, not when the driver next happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``; where the session doesn't say how many bytes an Arrow batch may have, it is set to a few megabytes."""
    conf = df.sparkSession.conf
    if conf.get(BATCH[0], None) is None:
        conf.set(*BATCH)
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text ``column`` of each holds about ``limit`` bytes, or one row."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        ends = ends - ends[0]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and each row's start plus the end; null rows are empty."""
    if col.null_count:
        col = col.fill_null("")
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_spans(raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside a row, and each row's first word index plus the total."""
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(starts), np.int64)
    w = is_word[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 18))
        up, down = np.full(size, _MULT), np.full(size, _MULT_INV)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased: one polynomial prefix sum over all bytes."""
    if len(begin) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin])


def salted_fold(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Folds fixed-size summaries, one or more a task, in two steps; ``fold`` maps many rows to few.

    The first step leaves at most 32 partitions, the second one; every row is
    a summary of constant size, so no step gathers rows of the corpus.
    """
    once = mapped(df.repartition(32), fold, df.schema)
    return mapped(once.repartition(1), fold, df.schema)


def with_unique_names(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator needs, so that further columns never clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in keep])
