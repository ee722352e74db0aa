"""JSONL, JSON, CSV and TSV: metadata, manifests, projector files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines of a given schema; blank lines are passed over. ``strict`` stops at the first bad line, otherwise it is kept in ``_corrupt``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T.StructType.fromDDL(schema).fields if isinstance(schema, str) else schema.fields
    return spark.read.schema(T.StructType([*fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line, v) of JSON lines whose fields change type; bad lines have a null ``v``."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), F.try_parse_json("value").alias("v"))


def as_strings(v: Column, field: str) -> Column:
    """A field that is a string or a list of strings, as a list; null or absent gives an empty one."""
    many = F.try_variant_get(v, f"$.{field}", "array<string>")
    one = F.try_variant_get(v, f"$.{field}", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def read_metadata(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """Rows by suffix, all fields as text, one per id, the last in the file wins.

    ``.jsonl`` and ``.csv``: rows without an id go. ``.json``: a list of objects, of
    which those without an id go, or one object whose keys are the ids.
    """
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
        at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    elif path.endswith(".jsonl"):
        rows = spark.read.option("primitivesAsString", True).json(path)
        at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    elif path.endswith(".json"):
        return json_records(spark, path, id_column)
    else:
        raise ValueError(f"unknown kind of metadata: {path}")
    names = rows.columns
    return last_of_each(rows.select("*", at.alias("__at")), id_column, names)


def metadata_fields(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """``read_metadata`` with one schema for all kinds of files: (id, fields), a map of the texts that a row has."""
    rows = read_metadata(spark, path, id_column)
    if path.endswith(".json"):
        return rows
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in rows.columns if c != id_column])
    return rows.select(id_column, F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("fields"))


def last_of_each(rows: DataFrame, id_column: str, names: list[str]) -> DataFrame:
    """Per id, where there is one, the row with the greatest ``__at``."""
    rest = [c for c in names if c != id_column]
    some = rows.where(F.coalesce(F.col(id_column), F.lit("")) != "")
    return some.groupBy(id_column).agg(F.max_by(F.struct(*rest), "__at").alias("v")).select(id_column, "v.*") if rest else some.select(id_column).distinct()


def json_records(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """The objects of a JSON file that is a list of them, or one object that maps ids to them; (id, fields as a map of texts)."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<map<string,string>>")
    keyed = F.from_json("value", "map<string,map<string,string>>")
    is_list = F.ltrim("value").startswith("[")
    rows = raw.where(is_list).select(F.posexplode(listed).alias("__at", "fields")).withColumn(id_column, F.element_at("fields", F.lit(id_column)))
    whole = raw.where(~is_list).select(F.posexplode(F.map_entries(keyed)).alias("__at", "e")).select("__at", F.col("e.value").alias("fields"), F.col("e.key").alias(id_column))
    return last_of_each(rows.unionByName(whole), id_column, ["fields", id_column])


def specimen_id(swc_name: Column) -> Column:
    """What stands before the first "_" of a file name; null for none."""
    return F.when(swc_name != "", F.substring_index(swc_name, "_", 1))


def with_specimen_metadata(views: DataFrame, by_specimen: DataFrame, by_file: DataFrame, swc: str = "swc") -> DataFrame:
    """Views with ``specimen`` and ``file_fields``: the rows of metadata indexed by cell_specimen_id and by filename that a view's SWC name leads to."""
    a = by_specimen.select(F.col("cell_specimen_id").alias("__s"), F.struct(*by_specimen.columns).alias("specimen"))
    b = by_file.select(F.col("filename").alias("__f"), F.struct(*by_file.columns).alias("file_fields"))
    return views.join(a, specimen_id(F.col(swc)) == F.col("__s"), "left").join(b, F.col(swc) == F.col("__f"), "left").drop("__s", "__f")


def write_jsonl(rows: DataFrame, folder: str, append: bool = True) -> None:
    """Rows as JSON lines; fields that are null are kept."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(folder)


def merged_manifests(spark: SparkSession, folder: str, schema: str | T.StructType, parts: list[int] | None = None) -> DataFrame:
    """The entries of the manifests that tasks left (manifest_<i>.jsonl), in one table with ``task``; missing parts are passed over."""
    rows = spark.read.schema(schema).json(folder, pathGlobFilter="manifest_*.jsonl").select("*", F.regexp_extract(F.col("_metadata.file_name"), r"manifest_(\d+)\.jsonl$", 1).alias("task"))
    rows = rows.where("task <> ''").withColumn("task", F.col("task").cast("int"))
    return rows if parts is None else rows.where(F.col("task").isin(parts))


def with_morphometry(neurons: DataFrame, measures: DataFrame, id_column: str = "neuron_id") -> DataFrame:
    """Neurons with the struct ``morphometry`` of their measures, null where there are none."""
    m = measures.select(id_column, F.struct(*[c for c in measures.columns if c != id_column]).alias("morphometry"))
    return neurons.join(m, id_column, "left")


def paired(entries: DataFrame) -> DataFrame:
    """Entries that come with their metadata (image_path, metadata, maybe neuron_id); a missing id is empty."""
    own = F.coalesce(F.col("neuron_id").cast("string"), F.lit("")) if "neuron_id" in entries.columns else F.lit("")
    return entries.withColumn("neuron_id", own)


# The named collections of the archive.
COLLECTIONS = (
    ("mouse_motor_cortex", "Mouse Motor Cortex Patch-seq", "https://download.brainimagelibrary.org/biccn/zeng/tolias/pseq/morph/"),
    ("mouse_visual_cortex", "Mouse Visual Cortex Patch-seq", "https://download.brainimagelibrary.org/biccn/zeng/pseq/morph/200526/"),
)


def collections(spark: SparkSession) -> DataFrame:
    """(key, name, url) of the collections that can be asked for by name."""
    return spark.createDataFrame(COLLECTIONS, "key string, name string, url string")


def standard_swc_url(base: str, archive: Column, name: Column) -> Column:
    """Where an archive keeps the standardised file of a neuron."""
    return F.concat(F.lit(f"{base}/dableFiles/"), F.lower(F.trim(archive)), F.lit("/CNG%20version/"), name, F.lit(".CNG.swc"))


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def by_swc(entries: DataFrame, swc: str = "swc", order: str = "line_no", strict: bool = False) -> DataFrame:
    """(swc, first, lines): manifest lines by file name, in the order in which they stand. Blank names go; with ``strict`` a missing one is an error."""
    if strict and not entries.where(F.col(swc).isNull()).isEmpty():
        raise ValueError(f"an entry without {swc}")
    rows = entries.where(F.coalesce(F.col(swc), F.lit("")) != "") if not strict else entries
    return rows.groupBy(swc).agg(F.min(order).alias("first"), F.sort_array(F.collect_list(order)).alias("lines"))


def find_manifests(spark: SparkSession, folder: str, split: str) -> str | None:
    """The first manifest of a split in the usual names; an undivided manifest counts as train."""
    jvm = spark.sparkContext._jvm
    names = [f"manifest_{split}.jsonl", f"{split}.jsonl", f"manifest_{split}.json", *(["manifest.jsonl"] if split == "train" else [])]
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return f"{folder}/{name}"
    return None


def evaluator_manifest(spark: SparkSession, folder: str) -> str:
    """The manifest that an evaluation reads: validation's, else the test's, else the undivided one; none is an error."""
    jvm = spark.sparkContext._jvm
    for name in ("manifest_val.jsonl", "manifest_test.jsonl", "manifest.jsonl"):
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return f"{folder}/{name}"
    raise ValueError(f"no manifest in {folder}")


def links(pages: DataFrame, html: str = "html", pattern: str = r'href="([^"]+)"') -> DataFrame:
    """One row per link of a page, in order (pos, link)."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "link"))


def labelled_link(html: Column, label: str, base: str = "", folder: str = "dableFiles", suffix: str = ".swc") -> Column:
    """The first link into ``folder`` of an anchor that holds ``label``, else the first one that ends in ``suffix``; relative ones below ``base``."""
    named = F.filter(F.split(html, "</a>"), lambda a: F.contains(a, F.lit(label)))
    link = rf'(?i)href\s*=\s*("?)({folder}[^"\s>]+{{}})\1'
    found = F.get(F.filter(F.transform(named, lambda a: F.regexp_extract(a, link.format(""), 2)), lambda x: x != ""), F.lit(0))
    rel = F.coalesce(found, F.nullif(F.regexp_extract(html, link.format(re.escape(suffix)), 2), F.lit("")))
    return F.when(rel.rlike("^https?://"), rel).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(rel, "^/+", "")))


def saved_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a paginated service's saved pages (page-*.json): the list below ``_embedded``, or below content, items, data or results."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="page-*.json").select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    lists = [F.try_variant_get("v", p, "array<variant>") for p in ("$._embedded.neuronResources", "$.content", "$.items", "$.data", "$.results")]
    return raw.select("path", F.posexplode(F.coalesce(*lists)).alias("pos", "item"))


def task_range(df: DataFrame, order: list[str], task: int, tasks: int) -> DataFrame:
    """The rows of one task of many: consecutive numbers of ``ceil(n / tasks)``, counted per range partition rather than in one window."""
    if not 0 <= task < tasks:
        raise ValueError("task out of range")
    n = df.count()
    size = -(-n // tasks)
    return numbered(df, order).where(F.col("row_no").between(task * size, (task + 1) * size - 1)).drop("row_no")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with row_no from 0 in the given order, which should be total: range partitions are numbered apart and offset by counts."""
    from pyspark.sql import Window

    from ..session import stored

    parts = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    at, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    start = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    rows = parts.join(F.broadcast(start), "__part").withColumn("row_no", F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__start"))
    return rows.drop("__part", "__start")


def in_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with ``batch``, the number of the run of ``size`` rows in the given order that they are in."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("row_no") / size)).drop("row_no")


def place_in_group(df: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """Rows with their place from 0 among those of their group (a neuron's views: a small group)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def write_projector(vectors: DataFrame, metadata: DataFrame, id_column: str, folder: str, fields: list[str]) -> None:
    """Tensor and metadata TSV files in one order, and the config as JSON. Metadata comes from annotation columns first, then from ``metadata``, then is empty."""
    rows = vectors.join(metadata.select(id_column, *[F.col(f).alias(f"__{f}") for f in fields]), id_column, "left")
    own = set(vectors.columns)
    cols = [F.coalesce(*([F.col(f)] if f in own else []), F.col(f"__{f}"), F.lit("")).alias(f) for f in fields]
    # Both files are sorted in jobs of their own: the order must tell rows of one id apart.
    rows = rows.withColumns({f: c for f, c in zip(fields, cols, strict=True)}).withColumn("__all", F.to_json(F.struct("vec", *fields)))
    rows = rows.orderBy(id_column, "__all")
    rows.select(F.concat_ws("\t", F.transform("vec", lambda x: x.cast("string")))).write.mode("overwrite").text(f"{folder}/tensors")
    rows.select(id_column, *fields).write.mode("overwrite").csv(f"{folder}/metadata", sep="\t", header=True)
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    shape.select(F.to_json(F.struct(F.array(F.struct(F.lit("embeddings").alias("tensorName"), F.array("n", F.col("d").cast("long")).alias("tensorShape"), F.lit("tensors").alias("tensorPath"), F.lit("metadata").alias("metadataPath"))).alias("embeddings")))).write.mode("overwrite").text(f"{folder}/config")


def sprite_cells(items: DataFrame, order: list[str]) -> DataFrame:
    """Row and column of each item in a sprite sheet of ceil(sqrt n) columns."""
    n = items.agg(F.count("*").alias("n")).withColumn("cols", F.ceil(F.sqrt("n")).cast("long"))
    return numbered(items, order).crossJoin(F.broadcast(n)).select("*", F.floor(F.col("row_no") / F.col("cols")).alias("cell_row"), (F.col("row_no") % F.col("cols")).alias("cell_col")).drop("n", "cols")
