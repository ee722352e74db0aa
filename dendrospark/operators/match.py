"""Joins of manifests, metadata and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_candidates(left: DataFrame, key: str, candidates: Column, right: DataFrame, right_id: str, names: DataFrame | None = None) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` that the first of their candidate ids finds; rows without one go.

    One semi-join of the exploded candidates, then each row's earliest hit, by its place alone.
    ``names`` may give the ids of ``right`` where its rows are costly to make twice. Ids compress well, so
    a table's size on disk says little of its size in memory: the joins sort and spill, none holds a whole
    table (but that with costly rows, which adaptive execution chooses).
    """
    own = F.xxhash64(candidates).alias("__of")  # rows of one key have each their own candidates
    tries = left.select(F.col(key), own, F.posexplode(candidates).alias("__pos", "__id"))
    known = (right if names is None else names).select(F.col(right_id).alias("__id"))
    hits = tries.join(known.hint("merge"), "__id", "left_semi").groupBy(key, "__of").agg(F.min("__pos").alias("__pos"))
    found = left.withColumn("__of", own).join(hits.hint("merge"), [key, "__of"]).withColumn("__id", F.get(candidates, F.col("__pos"))).drop("__pos", "__of")
    rows = right.withColumnRenamed(right_id, "__rid")
    return found.join(rows.hint("merge") if names is None else rows, F.col("__id") == F.col("__rid")).drop("__id").withColumnRenamed("__rid", right_id)


def with_metadata(rows: DataFrame, metadata: DataFrame, id_column: str) -> DataFrame:
    """Left join; adaptive execution broadcasts the metadata where it is small."""
    return rows.join(metadata, id_column, "left")


def annotated(rows: DataFrame, key: Column, by_key: DataFrame, key_column: str, file: Column, by_file: DataFrame, file_column: str, fields: list[str]) -> DataFrame:
    """Each field from the row itself, else from the table by key, else from that by file name, else empty."""
    a = by_key.select(F.col(key_column).alias("__k"), *[F.col(f).alias(f"__a_{f}") for f in fields if f in by_key.columns])
    b = by_file.select(F.col(file_column).alias("__f"), *[F.col(f).alias(f"__b_{f}") for f in fields if f in by_file.columns])
    out = rows.withColumns({"__key": key, "__file": file}).join(a, F.col("__key") == F.col("__k"), "left").join(b, F.col("__file") == F.col("__f"), "left")
    have = set(out.columns)
    pick = lambda f: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in (f, f"__a_{f}", f"__b_{f}") if c in have], F.lit(""))
    return out.withColumns({f: pick(f) for f in fields}).drop(*[c for c in have if c.startswith("__")])


def first_entry(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


def pose(rows: DataFrame, manifest: DataFrame, swc: str, idx: str, value: str, seed: int = 0) -> DataFrame:
    """``value`` of the manifest's row with the same swc and idx, else of one of that swc's rows by hash, else empty."""
    exact = manifest.groupBy(swc, idx).agg(F.min(value).alias("__exact"))
    any_ = manifest.groupBy(swc).agg(F.min_by(value, F.struct(F.xxhash64(swc, idx, F.lit(seed)), idx)).alias("__any"))
    return rows.join(exact, [swc, idx], "left").join(any_, swc, "left").withColumn(value, F.coalesce("__exact", "__any", F.lit(""))).drop("__exact", "__any")


def existing(rows: DataFrame, path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is in the listing (column path), and those whose is not."""
    known = files.select(F.col("path").alias(path)).distinct()
    return rows.join(known, path, "left_semi"), rows.join(known, path, "left_anti")
