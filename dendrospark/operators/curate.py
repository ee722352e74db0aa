"""Curation: filters with reasons, splits, percentile bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lot

# Bin names, their measure, labels and percentiles.
BINS = {
    "size": ("length", ["small", "medium", "large", "very large", "extremely large"], [20, 40, 60, 80]),
    "branching": ("n_bifs", ["sparsely branched", "moderately branched", "densely branched", "highly branched"], [25, 50, 75]),
    "extent": ("_max_extent", ["compact", "extended", "sprawling"], [33, 67]),
    "straightness": ("contraction", ["tortuous", "moderately straight", "straight"], [33, 67]),
    "stems": ("n_stems", ["few primary processes", "several primary processes", "many primary processes"], [33, 67]),
    "complexity": ("fractal_Dim", ["sparse", "moderately space-filling", "space-filling"], [33, 67]),
    "aspect": ("_aspect_ratio", ["tall and narrow", "roughly symmetric", "wide and flat"], [33, 67]),
}
UNSAID = ("", "unknown", "not reported")


def max_extent(w: Column, h: Column, d: Column) -> Column:
    return F.array_max(F.filter(F.array(w, h, d), lambda v: v > 0))


def aspect_ratio(w: Column, h: Column) -> Column:
    """Width by height; none for a width of 0 or a height that isn't above 0."""
    return F.when((w != 0) & (h > 0), F.try_divide(w, h))


def degenerate(n_bifs: Column, n_branch: Column, width: Column, depth: Column, length: Column) -> Column:
    """Why a morphology is degenerate, or null. A missing measure passes."""
    return F.when(n_bifs == 0, "zero_bifurcations").when(n_branch < 4, "too_few_branches").when(width == 0, "zero_width").when(depth == 0, "zero_depth").when(length < 200, "too_short")


def uninformative(cell_types: Column, regions: Column) -> Column:
    said = lambda a: F.coalesce(F.exists(a, lambda c: ~F.lower(F.trim(c)).isin(*UNSAID)), F.lit(False))
    return F.when(~said(cell_types) & ~said(regions), "no_cell_type_or_region")


def faulty(integrity: Column, failed: Column) -> Column:
    return F.when(F.upper(integrity).contains("ERROR"), "integrity_error").when(F.coalesce(failed, F.lit(False)), "download_failed")


def failed_ids(log: DataFrame, id_column: str, statuses: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Ids whose log has one of the statuses. The logs' writers differ in the word, so it is a parameter."""
    return log.where(F.col("status").isin(*statuses)).select(id_column).distinct()


def rare_species(df: DataFrame, least: int, species: str = "species") -> DataFrame:
    """``df`` with ``rare``: rare_species_<name> where the species has fewer than ``least`` rows, counted before any filter."""
    counts = df.groupBy(species).agg(F.count("*").alias("__n"))
    name = F.coalesce(F.col(species), F.lit("unknown"))
    return df.join(counts.withColumnRenamed(species, "__s"), F.col(species).eqNullSafe(F.col("__s"))).withColumn("rare", F.when(F.col("__n") < least, F.concat(F.lit("rare_species_"), name))).drop("__n", "__s")


def cascade(df: DataFrame, *reasons: Column) -> DataFrame:
    """``df`` with ``reason``: the first filter that rejects a row, null if none does."""
    return df.withColumn("reason", F.coalesce(*reasons))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def commonest(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, n) of the ``n`` commonest values, the smaller one first on ties."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def split(df: DataFrame, key: str, strata: str | None, val: float, test: float, seed: int = 42) -> DataFrame:
    """(key, strata, split): per stratum the first int(n test) keys in hash order go to test, the next int(n val) to val, the rest to train.

    Keys of one value stay together. The order is a hash of key and seed, so a
    split does not depend on partitioning. Ranks are counted per range partition,
    so no task sees all keys of a stratum.
    """
    from ..sources.tables import numbered

    if not 0 <= val < 1 or not 0 <= test < 1 or val + test >= 1:
        raise ValueError("ratios must be in [0, 1) and leave room for train")
    h = lot(F.col(key), F.lit(seed))
    if strata:
        keys = numbered(df.groupBy(key).agg(F.min(strata).alias(strata)).withColumn("__h", h), [strata, "__h", key])
        each = keys.groupBy(F.col(strata).alias("__s")).agg(F.min("row_no").alias("__0"), F.count("*").alias("__n"))
        keys = keys.join(each, F.col(strata).eqNullSafe(F.col("__s"))).withColumn("__r", F.col("row_no") - F.col("__0")).drop("__s", "__0", "row_no")
    else:
        keys = df.select(key).distinct().withColumn("__h", h)
        keys = numbered(keys, ["__h", key]).withColumnRenamed("row_no", "__r").crossJoin(F.broadcast(keys.agg(F.count("*").alias("__n"))))
    n_test, n_val = F.floor(F.col("__n") * test), F.floor(F.col("__n") * val)
    return keys.withColumn("split", F.when(F.col("__r") < n_test, "test").when(F.col("__r") < n_test + n_val, "val").otherwise("train")).drop("__h", "__r", "__n")


def assign_split(rows: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Rows of passing keys with their split; a key in several splits takes the first of train, val, test."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return rows.join(splits.groupBy(key).agg(F.min_by("split", order).alias("split")), key)


def bins(train: DataFrame, least: int = 100) -> DataFrame:
    """(name, key, labels, thresholds, percentiles, n_samples, min, max, median) of the measures with at least ``least`` positive values.

    Percentiles are exact: all values are numbered in order once, per range
    partition, and only those at the wanted places are looked at.
    """
    from ..sources.tables import numbered

    keys = sorted({k for k, _, _ in BINS.values()} & set(train.columns))
    pairs = ", ".join(f"'{k}', try_cast(`{k}` as double)" for k in keys)
    rows = numbered(train.selectExpr(f"stack({len(keys)}, {pairs}) as (key, v)").where("v > 0"), ["key", "v"])
    each = rows.groupBy("key").agg(F.min("row_no").alias("start"), F.count("*").alias("n_samples"), F.min("v").alias("min"), F.max("v").alias("max"))
    spark = train.sparkSession
    wanted = spark.createDataFrame([(name, key, k, float(p)) for name, (key, _, percents) in BINS.items() if key in keys for k, p in enumerate([*percents, 50])], "name string, key string, k int, percent double")
    at = wanted.join(each, "key").withColumn("at", (F.col("n_samples") - 1) * F.col("percent") / 100)
    ends = at.select("name", "k", "key", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place"), "at", "start")
    near = ends.join(rows, (ends.key == rows.key) & (ends.place + ends.start == rows.row_no)).select("name", "k", "at", "place", "v")
    value = near.groupBy("name", "k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("at") - F.floor("at")).alias("part")).withColumn("q", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    values = value.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))
    fixed = spark.createDataFrame([(name, key, labels, percents) for name, (key, labels, percents) in BINS.items() if key in keys], "name string, key string, labels array<string>, percentiles array<int>")
    out = fixed.join(each.where(F.col("n_samples") >= least), "key").join(values, "name")
    return out.select("name", "key", "labels", F.slice("q", 1, F.size("q") - 1).alias("thresholds"), "percentiles", "n_samples", "min", "max", F.element_at("q", -1).alias("median"))


def bin_label(value: Column, thresholds: Column, labels: Column) -> Column:
    """The label of the first threshold that a value does not exceed, else the last label; null for null."""
    at = F.size(F.filter(thresholds, lambda t: t < value))
    return F.when(value.isNotNull(), F.get(labels, at))


def report(df: DataFrame, splits: DataFrame, species: str = "species") -> DataFrame:
    """(section, name, n): totals, reasons, the thirty commonest species and how many more there are, split sizes."""
    line = lambda s, n, c: F.struct(F.lit(s).alias("section"), n.alias("name"), c.alias("n"))
    total = df.agg(F.count("*").alias("all"), F.count_if(F.col("reason").isNull()).alias("kept")).select(F.explode(F.array(line("total", F.lit("rows"), F.col("all")), line("total", F.lit("passing"), F.col("kept")))).alias("r")).select("r.*")
    reasons = reason_counts(df).select(F.lit("reason").alias("section"), F.col("reason").alias("name"), "n")
    kinds = df.where("reason is null").groupBy(species).agg(F.count("*").alias("n"))
    top = kinds.orderBy(F.desc("n"), species).limit(30).select(F.lit("species").alias("section"), F.col(species).alias("name"), "n")
    rest = kinds.agg(F.greatest(F.lit(0), F.count("*") - 30).alias("n")).select(F.lit("species").alias("section"), F.lit("more").alias("name"), "n")
    sizes = splits.groupBy("split").agg(F.count("*").alias("n")).select(F.lit("split").alias("section"), F.col("split").alias("name"), "n")
    return total.union(reasons).union(top).union(rest).union(sizes)
