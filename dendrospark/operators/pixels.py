"""Pixel tables (view_id, r, c, val): pooling, depth, occupancy, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALID = 0.999


def majority_pool(pixels: DataFrame, f: int) -> DataFrame:
    """Class of each f x f block: the commonest foreground class, the lowest id on ties; 0 if there is none."""
    block = [F.floor(F.col(c) / f).cast("int").alias(c) for c in "rc"]
    n = pixels.select("view_id", *block, "val").groupBy("view_id", "r", "c", "val").agg(F.count("*").alias("n"))
    front = n.withColumn("w", F.when(F.col("val") > 0, F.col("n")).otherwise(0))
    return front.groupBy("view_id", "r", "c").agg(F.max_by("val", F.struct("w", -F.col("val"))).alias("v"), F.max("w").alias("w")).select("view_id", "r", "c", F.when(F.col("w") > 0, F.col("v")).otherwise(0).alias("val"))


def depth_pool(pixels: DataFrame, f: int) -> DataFrame:
    """Mean valid depth of each block; blocks of background only give their mean."""
    block = [F.floor(F.col(c) / f).cast("int").alias(c) for c in "rc"]
    return pixels.select("view_id", *block, "val").groupBy("view_id", "r", "c").agg(F.coalesce(F.avg(F.when(F.col("val") < VALID, F.col("val"))), F.avg("val")).alias("val"))


def depth_bytes(pixels: DataFrame) -> DataFrame:
    """Depth of valid pixels stretched to 0..255 per view, 0 for the others; a constant depth gives 128."""
    v = F.when(F.col("val") < VALID, F.col("val"))
    span = pixels.groupBy("view_id").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    x = F.when(v.isNull(), 0).when(F.col("hi") > F.col("lo"), F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(128)
    return pixels.join(span, "view_id").select("view_id", "r", "c", x.cast("int").alias("val"))


def grey(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Pixels with val between 0 and 1: the mean of their channels (bytes) by 255."""
    return pixels.withColumn("val", sum(F.col(c).cast("double") for c in channels) / (255.0 * len(channels)))


def occupancy(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("view_id").agg((F.count_if(F.col("val") > 0) / F.count("*")).alias("occupancy"))


def class_fractions(pixels: DataFrame) -> DataFrame:
    n = pixels.groupBy("view_id", "val").agg(F.count("*").alias("n"))
    return n.select("view_id", "val", (F.col("n") / F.sum("n").over(Window.partitionBy("view_id"))).alias("fraction"))


def colourise(pixels: DataFrame, palette: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Pixels with red, green and blue by class; a palette is a few literals."""
    pick = F.create_map(*[x for k, v in palette.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rgb = F.coalesce(F.element_at(pick, F.col("val")), F.array(F.lit(0), F.lit(0), F.lit(0)))
    return pixels.select("*", *[rgb[i].alias(c) for i, c in enumerate(("red", "green", "blue"))])
