"""SWC files: scan, headers, validation, and writing back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPACES = " \t\n\x0b\f\r"
SPECIAL = {"nan": ("nan", "+nan", "-nan"), "inf": ("inf", "+inf", "infinity", "+infinity"), "-inf": ("-inf", "-infinity")}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, neuron_id, line_no, line) of all SWC files below the paths, in either case of the extension."""
    paths = [path] if isinstance(path, str) else path
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][wW][cC]").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text_lines(files)


def text_lines(files: DataFrame) -> DataFrame:
    """Lines of (path, value) whole files; the neuron's id is the file's stem."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[sS][wW][cC])?$", 1)
    # A file's stem is taken once, not on each of its lines; these are trimmed before they become rows: a filter of the lines would else be pushed below the trimming, and do it over again in each of its parts.
    lines = F.transform(F.split("value", r"\r?\n"), lambda line: F.btrim(line, F.lit(SPACES)))
    return files.select("path", stem.alias("neuron_id"), "value").select("path", "neuron_id", F.posexplode(lines).alias("line_no", "line"))


def number(token: Column) -> Column:
    """A decimal number as Python's float reads it (without underscores); null otherwise."""
    out = F.when(token.rlike(NUMBER), token.try_cast("double"))
    for value, names in SPECIAL.items():
        out = out.when(F.lower(token).isin(*names), F.lit(float(value)))
    return out


def parse_nodes(lines: DataFrame) -> DataFrame:
    """The node table: lines of exactly seven tokens that cast; others are passed over."""
    whole = lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))
    said = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("t", F.split("line", r"\s+"))
    read = said.select("neuron_id", "line_no", "t", F.transform(F.array(*[F.get("t", F.lit(i)) for i in (0, 1, 6)]), whole).alias("w"), F.transform(F.slice("t", 3, 4), number).alias("v"))
    # The fields come out of a generator, below which no filter is pushed: each token is read once.
    fields = [*[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(("idx", "type_id"))], *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "z", "radius"))], F.get("w", F.lit(2)).alias("parent")]
    out = read.select("neuron_id", "line_no", F.inline(F.array(F.when(F.size("t") == 7, F.struct(*fields)))))
    out = out.select("neuron_id", "idx", "type_id", "x", "y", "z", "radius", "parent", "line_no")
    return out.where(" and ".join(f"{c} is not null" for c in ("idx", "type_id", "x", "y", "z", "radius", "parent")))


def parse_headers(lines: DataFrame) -> DataFrame:
    """(neuron_id, header map): ``key = value`` lines, others as comment_<n> by the header line's ordinal; the last of a key wins."""
    h = lines.where(F.col("line").startswith("#"))
    h = h.withColumn("ordinal", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).withColumn("body", F.trim(F.substring("line", 2, 1 << 30)))
    at = F.instr("body", "=")
    key = F.when(at > 0, F.trim(F.expr("substring(body, 1, instr(body, '=') - 1)"))).otherwise(F.concat(F.lit("comment_"), F.col("ordinal").cast("string")))
    value = F.when(at > 0, F.trim(F.expr("substring(body, instr(body, '=') + 1)"))).otherwise(F.col("body"))
    pairs = h.select("neuron_id", key.alias("k"), value.alias("v"), "line_no", (at > 0).alias("pair")).where("pair or v <> ''")
    last = pairs.groupBy("neuron_id", "k").agg(F.max_by("v", "line_no").alias("v"))
    return last.groupBy("neuron_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("header"))


def swc_text(nodes: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(neuron_id, value): each neuron as an SWC file's text, nodes by index, six decimals."""
    line = F.format_string("%d %d %.6f %.6f %.6f %.6f %d", *[F.col(c) for c in ("idx", "type_id", "x", "y", "z", "radius", "parent")])
    body = nodes.groupBy("neuron_id").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("line")))).alias("rows"))
    out = body.select("neuron_id", F.array_join("rows.line", "\n").alias("value"))
    if headers is None:
        return out
    entry = F.transform(F.array_sort(F.map_entries("header")), lambda e: F.when(e["key"].startswith("comment_"), F.concat(F.lit("# "), e["value"])).otherwise(F.concat(F.lit("# "), e["key"], F.lit(" = "), e["value"])))
    return out.join(headers, "neuron_id", "left").select("neuron_id", F.concat_ws("\n", F.array_join(F.coalesce(entry, F.array()), "\n"), "value").alias("value"))


def write_swc(nodes: DataFrame, path: str, headers: DataFrame | None = None) -> None:
    """One folder per neuron with its text below ``path``."""
    swc_text(nodes, headers).write.partitionBy("neuron_id").mode("overwrite").text(path)


def swc_errors(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(neuron_id, level, problem, detail): no root, several roots, orphans, self-loops, cycles, empty files."""
    from ..operators.topology import placed

    rooted = nodes.groupBy("neuron_id").agg(F.count_if(F.col("parent") == -1).alias("n"), F.sort_array(F.collect_list(F.when(F.col("parent") == -1, F.col("idx")))).alias("ids"))
    none = rooted.where("n = 0").select("neuron_id", F.lit("error").alias("level"), F.lit("no_root").alias("problem"), F.lit("").alias("detail"))
    many = rooted.where("n > 1").select("neuron_id", F.lit("warning"), F.lit("several_roots"), F.array_join("ids", ","))
    known = nodes.select("neuron_id", F.col("idx").alias("parent")).distinct()
    orphan = nodes.where("parent <> -1").join(known, ["neuron_id", "parent"], "left_anti").select("neuron_id", F.lit("warning"), F.lit("orphan"), F.col("idx").cast("string"))
    loop = nodes.where("parent = idx").select("neuron_id", F.lit("warning"), F.lit("self_loop"), F.col("idx").cast("string"))
    lost = placed(nodes).where("depth is null").groupBy("neuron_id").agg(F.count("*").alias("n")).select("neuron_id", F.lit("error"), F.lit("cycle"), F.col("n").cast("string"))
    out = none.union(many).union(orphan).union(loop).union(lost)
    if files is not None:
        out = out.union(files.select("neuron_id").distinct().join(nodes.select("neuron_id"), "neuron_id", "left_anti").select("neuron_id", F.lit("error"), F.lit("empty"), F.lit("")))
    return out


def load_swc(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (unique), headers and errors of many files. A bad file is reported and the others go on. Nodes are stored, as the search for errors reads them too."""
    from ..operators.topology import unique_nodes

    lines = read_lines(spark, path)
    nodes = stored(unique_nodes(parse_nodes(lines)), "swc_nodes")
    return nodes, parse_headers(lines), swc_errors(nodes, lines)
