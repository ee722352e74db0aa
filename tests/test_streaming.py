"""The streaming forms on a stream of files, against the same rows as a table."""

from datetime import datetime, timedelta

from dendrospark.streaming import curation

SCHEMA = "id long, status string, ts timestamp"


def run(spark, folder, make, mode, name, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_counts_and_first_rows_of_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    batches = [[(k % 7 + 10 * b, "ok" if k % 3 else "failed", at + timedelta(minutes=40 * b + k)) for k in range(20)] for b in range(3)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    counts = run(spark, f"{tmp_path}/in", curation.status_counts, "complete", "counts", f"{tmp_path}/c1")
    assert sorted(map(tuple, counts)) == sorted(map(tuple, curation.status_counts(table).collect())) and sum(r.n for r in counts) == 60
    first = run(spark, f"{tmp_path}/in", lambda s: curation.once(s, "id", late="10 hours"), "append", "firsts", f"{tmp_path}/c2")
    assert sorted(r.id for r in first) == sorted(r.id for r in curation.once(table, "id").collect()) and len(first) == 21
