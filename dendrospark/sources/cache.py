"""Results kept by the content they were computed from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


def content_key(*columns: str | Column, version: int = 1, **settings) -> Column:
    """A key of a row's content, the settings of the computation and its version. Nulls differ from empty texts."""
    said = [F.lit(f"v{version}"), *[F.lit(f"{k}={settings[k]!r}") for k in sorted(settings)]]
    return F.sha2(F.to_json(F.struct(*[c.alias(f"s{i}") for i, c in enumerate(said)], *columns), {"ignoreNullFields": "false"}), 256)


def group_keys(rows: DataFrame, group: str, columns: list[str], version: int = 1, **settings) -> DataFrame:
    """(group, key): a key of all rows of each group, in whatever order they come. A group's row digests meet in one task: groups must be small, as a neuron is."""
    one = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    whole = rows.groupBy(group).agg(F.sort_array(F.collect_list(one)).alias("__rows"))
    return whole.select(group, content_key("__rows", version=version, **settings).alias("key"))


class Cache:
    """A table of results by ``key`` in a folder. Results of any number of rows a key may have; a key without any is known too.

    Parts are appended, each with a ``part`` name of its own, and never changed.
    Where two runs computed the same key, the rows of one of them are read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def known(self) -> DataFrame:
        """(key, part): the part whose rows count for a key."""
        system, p = self.path("keys")
        if not system.exists(p):
            return self.spark.createDataFrame([], "key string, part string")
        return self.spark.read.schema("key string, part string").parquet(f"{self.folder}/keys").groupBy("key").agg(F.min("part").alias("part"))

    def through(self, rows: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results of all keys of ``rows`` (key, ...): ``compute`` is given those rows whose key isn't known, and returns results with their ``key``.

        Keys become known after their results are written, so a run that dies leaves
        unknown results at worst. Rows without a key go.
        """
        wanted = rows.where("key is not null")
        # Which keys are missing is settled among keys alone; whole rows are moved once, for those that are computed.
        keys = stored(wanted.select("key").distinct(), "cache_keys")
        missing = stored(keys.join(self.known(), "key", "left_anti"), "cache_missing")
        part = uuid.uuid4().hex
        if not missing.isEmpty():
            compute(wanted.join(missing, "key", "left_semi")).withColumn("part", F.lit(part)).write.mode("append").parquet(f"{self.folder}/results")
            missing.withColumn("part", F.lit(part)).write.mode("append").parquet(f"{self.folder}/keys")
        return self.results().join(keys, "key", "left_semi")

    def results(self) -> DataFrame:
        """All results."""
        system, p = self.path("results")
        if not system.exists(p):
            raise ValueError(f"nothing was ever computed into {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/results").join(self.known(), ["key", "part"], "left_semi").drop("part")

    def clear(self) -> int:
        """Forgets everything; the number of keys that were known."""
        n = self.known().count()
        for name in ("keys", "results"):
            system, p = self.path(name)
            system.delete(p, True)
        return n
