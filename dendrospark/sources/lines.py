"""Lines of large text files with their numbers, and manifests whose errors name the line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, line_no, value): every line, blank ones too, numbered from 1 in its file, however the files are split.

    Lines are counted per byte range, the counts summed up along each file, and a
    second scan numbers the lines of its ranges from there on. No line is shuffled
    or written; only the counts are, one row a range. Should a cluster cut the
    files otherwise in the second scan, a range is missing from the counts and the
    job fails rather than number wrongly.
    """
    read = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    counts = lines.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.lit(True).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(3).to_numpy()
            new = np.r_[last != key[0], key[1:] != key[:-1]]
            begin = np.flatnonzero(new)
            offset = np.repeat(np.r_[[-seen] if not new[0] else [], begin], np.diff(np.r_[[0] if not new[0] else [], begin, n]).astype(np.int64))
            place = (np.arange(n) - offset).astype(np.int64) + 1
            last, seen = key[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(place)], names=["path", "start", "value", "place"])

    placed = lines.withColumn("range", F.xxhash64("path", "start")).mapInArrow(run, "path string, start bigint, value string, place bigint")
    rows = placed.join(first, ["path", "start"], "left")
    line_no = F.when(F.col("known"), F.col("before") + F.col("place")).otherwise(F.raise_error(F.lit("the files were split anew between two scans; set spark.sql.files.minPartitionNum")))
    return rows.select("path", line_no.alias("line_no"), "value")


def strict_manifest(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a manifest; blank lines are passed over. A line that is no JSON object, and a manifest without any entry, are errors; the first bad line's number is told.

    Lines are only numbered when there is a bad one.
    """
    text = spark.read.text(path)
    entry = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    state = text.where(F.trim("value") != "").agg(F.count("*").alias("n"), F.count_if(entry.isNull()).alias("bad")).first()
    if state.bad:
        worst = numbered_lines(spark, path).where((F.trim("value") != "") & entry.isNull()).agg(F.min(F.struct("path", "line_no")).alias("at")).first().at
        raise ValueError(f"no JSON object at line {worst.line_no} of {worst.path}")
    if not state.n:
        raise ValueError(f"an empty manifest: {path}")
    return spark.read.schema(schema).json(path)
