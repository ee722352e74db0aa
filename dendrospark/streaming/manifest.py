"""A manifest kept up to date from a stream of log files: every batch is a delta, the latest entry of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Manifest:
    """A table of entries by ``key`` below a folder: deltas (``delta/batch=<n>``) over a base (``base/upto=<n>``).

    A batch of a stream writes its own delta, anew if it is repeated, so a restart
    doubles nothing. Readers take the newest finished base and the deltas after it.
    ``order`` (a column) decides which entry of a key is the latest; ties go to the later
    batch. Entries without a key go.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType, key: str, order: str):
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def numbers(self, kind: str, name: str) -> list[int]:
        """The numbers of the finished folders of a kind."""
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        system = p.getFileSystem(context._jsc.hadoopConfiguration())
        if not system.exists(p):
            return []
        folders = [f.getPath() for f in system.listStatus(p) if f.getPath().getName().startswith(f"{name}=")]
        return sorted(int(f.getName().split("=")[1]) for f in folders if system.exists(context._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def latest(self, rows: DataFrame) -> DataFrame:
        """One entry a key; ``rows`` have ``__batch``."""
        rest = [c for c in self.schema.names if c != self.key]
        best = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rest, "__batch"), F.struct(F.col(self.order).isNotNull(), self.order, "__batch")).alias("v"))
        return best.select(self.key, "v.*").select(*self.schema.names, "__batch")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        rows = self.latest(batch.select(*self.schema.names).withColumn("__batch", F.lit(number).cast("long")))
        rows.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={number}")

    def parts(self) -> tuple[int, list[int], DataFrame]:
        """The newest base (-1: none), the deltas after it, and their entries."""
        schema = T.StructType([*self.schema.fields, T.StructField("__batch", T.LongType())])
        base = max(self.numbers("base", "upto"), default=-1)
        deltas = [n for n in self.numbers("delta", "batch") if n > base]
        paths = [f"{self.folder}/delta/batch={n}" for n in deltas] + ([f"{self.folder}/base/upto={base}"] if base >= 0 else [])
        return base, deltas, self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The latest entry of every key."""
        return self.latest(self.parts()[2]).drop("__batch")

    def compact(self) -> None:
        """Writes a new base of all finished deltas. Old ones stay until ``vacuum``, for readers that have begun."""
        base, deltas, rows = self.parts()
        if deltas:
            self.latest(rows).write.mode("overwrite").parquet(f"{self.folder}/base/upto={deltas[-1]}")

    def vacuum(self) -> None:
        """Deletes what the newest base holds."""
        context = self.spark.sparkContext
        base = max(self.numbers("base", "upto"), default=-1)
        old = [f"delta/batch={n}" for n in self.numbers("delta", "batch") if n <= base] + [f"base/upto={n}" for n in self.numbers("base", "upto") if n < base]
        for name in old:
            p = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)

    def follow(self, source: str, checkpoint: str, files_a_batch: int = 1000) -> None:
        """Takes all JSON-lines files of ``source`` that weren't taken before, then returns. Bad lines have null fields and go for want of a key."""
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_a_batch).json(source)
        query = rows.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
