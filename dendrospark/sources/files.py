"""Files that tasks write and read themselves, by URI, where Spark has no format for them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def located(spark: SparkSession, path: str) -> str:
    """A path as the URI that tasks use: one without a scheme belongs to the default file system."""
    if "://" in path or path.startswith("file:"):
        return path.replace("s3a://", "s3://")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return default.rstrip("/") + "/" + path.lstrip("/")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``content`` (binary) of each row to the file ``name`` below ``folder``, in the tasks; returns (name, bytes) when it is read.

    A repeated task writes the same files again. Of rows that share a name one
    wins; null names are an error, null contents empty files.
    """
    uri = located(rows.sparkSession, folder).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(uri)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                where = f"{base}/{name}".rsplit("/", 1)[0]
                if where not in made:
                    system.create_dir(where)
                    made.add(where)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return rows.select("name", "content").mapInArrow(run, "name string, bytes bigint")
