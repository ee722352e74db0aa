"""Keyed caches, and manifests kept from streams."""

import random

import pytest
from pyspark.sql import functions as F

from dendrospark.sources.cache import Cache, content_key, group_keys
from dendrospark.streaming.manifest import Manifest


def test_a_cache_computes_only_what_changed(spark, tmp_path):
    cache, given = Cache(spark, f"{tmp_path}/cache"), []
    with pytest.raises(ValueError, match="nothing was ever"):
        cache.results()

    def lengths(rows):
        given.append(rows.select("neuron_id").distinct().count())
        return rows.groupBy("key").agg(F.sum("x").alias("total")).where("total <> 0")

    def run(rows, **settings):
        nodes = spark.createDataFrame(rows, "neuron_id int, idx int, x double")
        keys = group_keys(nodes, "neuron_id", ["idx", "x"], **settings)
        found = cache.through(nodes.join(keys, "neuron_id"), lengths)
        return {r.neuron_id: r.total for r in keys.join(found, "key", "left").collect()}

    rows = [(n, i, float(n * i)) for n in range(5) for i in range(4)]
    want = {n: n * 6.0 if n else None for n in range(5)}
    assert run(rows) == want and given == [5]
    assert run(random.Random(1).sample(rows, 20)) == want and given == [5]
    changed = [(n, i, x + (n == 3)) for n, i, x in rows]
    assert run(changed) == want | {3: 22.0} and given == [5, 1]
    assert run(rows) == want and given == [5, 1]
    assert run(rows, scale=2) == want and given == [5, 1, 5]
    # The same key twice: one part counts.
    system, p = cache.path("keys")
    assert cache.results().count() == 4 + 1 + 4
    spark.read.parquet(f"{tmp_path}/cache/results").withColumn("part", F.lit("zz")).write.mode("append").parquet(f"{tmp_path}/cache/results")
    cache.known().withColumn("part", F.lit("zz")).write.mode("append").parquet(f"{tmp_path}/cache/keys")
    assert cache.results().count() == 9 and cache.clear() == 11 and not system.exists(p)
    assert run(rows) == want and given == [5, 1, 5, 5]


def test_content_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, ""), (None, None), ("a", "bc")], "a string, b string")
    keys = [r.key for r in rows.select(content_key("a", "b").alias("key")).collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[5]
    assert rows.select(content_key("a", version=2)).first() != rows.select(content_key("a")).first()


SCHEMA = "id int, status string, at long"


def test_a_restarted_stream_doubles_nothing(spark, tmp_path):
    rng, want = random.Random(2), {}

    def log(k):
        rows = [(rng.randrange(30), rng.choice(["ok", "failed", None]), 100 * k + i) for i in range(40)] + [(None, "ok", 1), (k, "late", None)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/log")
        for i, s, t in rows:
            if i is not None and (i not in want or t is not None and (want[i][1] is None or t > want[i][1])):
                want[i] = (s, t)

    manifest = Manifest(spark, f"{tmp_path}/table", SCHEMA, "id", "at")
    seen = lambda: {r.id: (r.status, r["at"]) for r in manifest.entries().collect()}
    assert seen() == {}

    class Dies(Manifest):
        """Dies in its second batch, after it wrote its delta and before the stream notes it."""

        def upsert(self, batch, number):
            super().upsert(batch, number)
            if number == 1:
                raise RuntimeError("killed")

    for k in range(3):
        log(k)
    with pytest.raises(Exception, match="killed"):
        Dies(spark, f"{tmp_path}/table", SCHEMA, "id", "at").follow(f"{tmp_path}/log", f"{tmp_path}/at", 1)
    manifest.follow(f"{tmp_path}/log", f"{tmp_path}/at", 1)
    assert seen() == want and len(manifest.numbers("delta", "batch")) == 3
    manifest.follow(f"{tmp_path}/log", f"{tmp_path}/at")
    manifest.compact()
    assert seen() == want and manifest.parts()[:2] == (2, [])
    manifest.vacuum()
    log(3)
    manifest.follow(f"{tmp_path}/log", f"{tmp_path}/at")
    manifest.compact()
    manifest.vacuum()
    assert seen() == want and manifest.numbers("base", "upto") == [3] and manifest.numbers("delta", "batch") == []
    assert manifest.entries().count() == len(want)


def test_rows_are_made_twice_at_most(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(k):
        made.add(1)
        return k

    rows = spark.range(10).select(F.udf(seen, "string").asNondeterministic()(F.col("id").cast("string")).alias("key"), "id")
    found = Cache(spark, str(tmp_path / "c")).through(rows, lambda r: r.groupBy("key").agg(F.sum("id").alias("s")))
    assert sorted((r.key, r.s) for r in found.collect()) == [(str(k), k) for k in range(10)]
    assert made.value <= 20  # once for the keys, once for the missing rows
