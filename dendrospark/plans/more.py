"""Queries that look at whole results of operators which other queries see in part, and at those that had none; each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate, evaluate, match, topology, vectors, views
from ..sources import files, lines, swc, tables
from . import fixtures as fx
from .catalog import _EIGEN, _V, _ZERO, NODES, SQL, new_folder, query, r, ranked, zero_shot
from .fixtures import rounded


def part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


# Curation

_FIVE = {"bifs": "p_size % 5", "branch": "p_partkey % 9", "width": "p_size % 4", "depth": "p_partkey % 6", "length": "p_retailprice - 800"}


@query(
    "P7_degenerate",
    "SELECT p_partkey, CASE WHEN {bifs} = 0 THEN 'zero_bifurcations' WHEN {branch} < 4 THEN 'too_few_branches' WHEN {width} = 0 THEN 'zero_width' WHEN {depth} = 0 THEN 'zero_depth' WHEN {length} < 200 THEN 'too_short' END AS reason FROM part".format(**{k: f"CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE {v} END" for k, v in _FIVE.items()}),
)
def _(spark, d):
    five = [F.when(F.expr("p_partkey % 7 <> 0"), F.expr(v)) for v in _FIVE.values()]
    return part(spark, d).select("p_partkey", curate.degenerate(*five).alias("reason"))


_SAID = "len([c FOR c IN coalesce({}, []) IF lower(trim(c)) NOT IN ('', 'unknown', 'not reported')]) = 0"


@query("P8_uninformative", f"WITH t AS ({fx.TAGS}) SELECT p_partkey, CASE WHEN {_SAID.format('cell_types')} AND {_SAID.format('regions')} THEN 'no_cell_type_or_region' END AS reason FROM t")
def _(spark, d):
    return fx.tags(spark, d).select("p_partkey", curate.uninformative(F.col("cell_types"), F.col("regions")).alias("reason"))


_MEASURES = {key: f"length * {k + 1} + neuron_id % {k + 5} - 300" for k, (key, _, _) in enumerate(curate.BINS.values())}


@query(
    "A19_all_bins",
    f"WITH m AS ({fx.META}), v AS (SELECT {', '.join(f'{e} AS {k}' for k, e in _MEASURES.items())} FROM m), b AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS name, quantile_cont({key}, [{', '.join(str(p / 100) for p in percents)}]) AS q, count(*) AS n_samples, min({key}) AS lo, max({key}) AS hi, median({key}) AS mid FROM v WHERE {key} > 0" for name, (key, _, percents) in curate.BINS.items())
    + f") SELECT name, CAST(unnest(range(len(q))) AS INT) AS pos, {r('unnest(q)', 'threshold', 4)}, n_samples, {r('lo', 'low')}, {r('hi', 'high')}, {r('mid', 'middle', 4)} FROM b WHERE n_samples >= 100",
)
def _(spark, d):
    b = curate.bins(fx.meta(spark, d).select(*[F.expr(e).alias(k) for k, e in _MEASURES.items()]))
    out = b.select("name", F.posexplode("thresholds").alias("pos", "threshold"), "n_samples", F.col("min").alias("low"), F.col("max").alias("high"), F.col("median").alias("middle"))
    return rounded(rounded(out, "low", "high"), "threshold", "middle", places=4)


@query("W2_split_order", f"WITH m AS ({fx.META}), n AS (SELECT archive, count(*) AS n FROM m GROUP BY 1) SELECT archive, n, true AS ordered, CAST(floor(n * 0.1) AS BIGINT) AS tests FROM n")
def _(spark, d):
    m = fx.meta(spark, d)
    s = curate.split(m, "neuron_id", "archive", 0.1, 0.1).withColumn("h", tx.lot(F.col("neuron_id"), F.lit(42)))
    at = lambda f, name: f(F.when(F.col("split") == name, F.col("h")))
    lower = lambda a, b: F.coalesce(at(F.max, a) < at(F.min, b), F.lit(True))
    return s.groupBy("archive").agg(F.count("*").alias("n"), (lower("test", "val") & lower("val", "train") & lower("test", "train")).alias("ordered"), F.count_if(F.col("split") == "test").alias("tests"))


# Joins


@query(
    "J6_annotated",
    "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END, ''), CASE WHEN p_partkey % 2 = 0 THEN nullif(concat('key-', p_size), '') END, '') AS p_type, coalesce(CASE WHEN p_partkey % 2 = 0 AND p_size % 2 = 0 THEN 'k' END, CASE WHEN p_partkey % 5 = 0 THEN concat('file-', p_size) END, '') AS note FROM part",
)
def _(spark, d):
    p = part(spark, d)
    by_key = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.concat(F.lit("key-"), F.col("p_size").cast("string")).alias("p_type"), F.when(F.col("p_size") % 2 == 0, "k").otherwise("").alias("note"))
    by_file = p.where("p_partkey % 5 = 0").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".swc")).alias("f"), F.concat(F.lit("file-"), F.col("p_size").cast("string")).alias("note"))
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise("").alias("p_type"))
    return match.annotated(rows, F.col("p_partkey"), by_key, "k", F.concat(F.col("p_partkey").cast("string"), F.lit(".swc")), by_file, "f", ["p_type", "note"]).select("p_partkey", "p_type", "note")


@query("J8_pose", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN concat('own-', p_partkey) ELSE concat('other-', p_partkey) END AS value FROM part")
def _(spark, d):
    p = part(spark, d).select("p_partkey", F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("swc"), F.lit(3).alias("idx"))
    own = p.where("p_partkey % 4 = 1").select("swc", "idx", F.concat(F.lit("own-"), F.col("p_partkey").cast("string")).alias("value"))
    other = p.where("p_partkey % 4 > 0").select("swc", F.lit(9).alias("idx"), F.concat(F.lit("other-"), F.col("p_partkey").cast("string")).alias("value"))
    return match.pose(p, own.union(other), "swc", "idx", "value").select("p_partkey", "value")


@query("P12_of_classes", f"{_ZERO} SELECT view_id, gt, pred FROM z WHERE gt IN (1, 3, 5)")
def _(spark, d):
    return evaluate.of_classes(zero_shot(spark, d), [1, 3, 5]).select("view_id", "gt", "pred")


# Vectors

_LISTED = f"WITH {_V}, l AS (SELECT view_id, neuron_id, unnest(vec) AS v, CAST(unnest(range(len(vec))) AS INT) AS i, sqrt(list_dot_product(vec, vec)) AS n FROM v)"


def pooled(how: str):
    def run(spark, d):
        return rounded(vectors.pool(fx.views(spark, d), how).select("neuron_id", F.posexplode("vec").alias("i", "v")), "v")

    return run


query("A20_concat_whole", f"{_LISTED} SELECT neuron_id, CAST(row_number() OVER (PARTITION BY neuron_id ORDER BY view_id, i) - 1 AS INT) AS i, {r('v')} FROM l")(pooled("concat"))
query("A21_l2_then_mean", f"{_LISTED} SELECT neuron_id, i, {r('avg(v / n)', 'v')} FROM l GROUP BY 1, 2")(pooled("l2_then_mean"))
query("A21_mean_then_l2", f"{_LISTED}, m AS (SELECT neuron_id, i, avg(v) AS a FROM l GROUP BY 1, 2) SELECT neuron_id, i, {r('a / sqrt(sum(a * a) OVER (PARTITION BY neuron_id))', 'v')} FROM m")(pooled("mean_then_l2"))
query("A21_mean_and_std", f"{_LISTED}, m AS (SELECT neuron_id, i, avg(v) AS a, stddev_pop(v) AS s FROM l GROUP BY 1, 2), k AS (SELECT neuron_id, count(*) AS k FROM m GROUP BY 1) SELECT neuron_id, i, {r('a', 'v')} FROM m UNION ALL SELECT neuron_id, CAST(i + k AS INT), {r('s', 'v')} FROM m JOIN k USING (neuron_id)")(pooled("concat_mean_std"))


@query("A22_reduced", f"WITH {_V}, m AS (SELECT view_id, CAST(k AS INT) AS i, vec[8 * k + 1:8 * k + 8] AS m FROM v, (SELECT unnest(range(8)) AS k)) SELECT view_id, i, {r('list_sum(m) / 8', 'mean')}, {r('list_max(m)', 'most')} FROM m")
def _(spark, d):
    maps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: vectors.doubles(F.slice("vec", k * 8 + 1, F.lit(8))))
    v = fx.views(spark, d).select("view_id", vectors.reduced(maps, "mean").alias("mean"), vectors.reduced(maps, "max").alias("most"))
    return rounded(v.select("view_id", F.posexplode(F.arrays_zip("mean", "most")).alias("i", "z")).select("view_id", "i", "z.*"), "mean", "most")


@query(
    "A34_losses",
    f"WITH {_V}, s AS (SELECT view_id, label, vec, vec[1] * 10 AS d, [-0.5 * (1 + vec[i + 32] - vec[i] * vec[i] - exp(vec[i + 32])) FOR i IN range(1, 33)] AS k, list_max(vec[1:10]) AS top FROM v) SELECT view_id, {r('list_sum(k) / 32', 'kl')}, {r('list_sum([greatest(0.1, x) FOR x IN k]) / 32', 'kl_free')}, "
    f"{r('ln(list_sum([exp(x - top) FOR x IN vec[1:10]])) + top - vec[label + 1]', 'ce')}, {r('(2 * list_dot_product(vec[1:32], vec[33:64]) + 1) / (list_sum(vec[1:32]) + list_sum(vec[33:64]) + 1)', 'dice', 3)}, {r('CASE WHEN abs(d) <= 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END', 'huber')} FROM s WHERE abs(list_sum(vec) + 1) > 0.01",
)
def _(spark, d):
    half = lambda at: vectors.doubles(F.slice("vec", at, 32))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    v = fx.views(spark, d).withColumn("vec", vectors.doubles(F.col("vec"))).where(F.abs(total + 1) > 0.01)
    out = v.select("view_id", evaluate.kl_term(half(1), half(33)).alias("kl"), evaluate.kl_term(half(1), half(33), 0.1).alias("kl_free"), evaluate.cross_entropy(F.slice("vec", 1, 10), F.col("label")).alias("ce"), evaluate.dice(half(1), half(33)).alias("dice"), evaluate.huber(F.col("vec")[0] * 10).alias("huber"))
    return rounded(rounded(out, "kl", "kl_free", "ce", "huber"), "dice", places=3)


@query("F18_embedded", "SELECT p_partkey, CAST(length(p_name) AS DOUBLE) AS size, CAST(ascii(substr(p_name, 1, 1)) AS DOUBLE) AS first, CAST(length(p_type) AS DOUBLE) AS other FROM part")
def _(spark, d):
    class Encoder:
        def __call__(self, name, values):
            return [(len(v), ord(v[0])) for v in values]

    rows = part(spark, d).select("p_partkey", "p_name", "p_type")
    out = evaluate.embedded(rows, {"a": "p_name", "b": "p_type"}, Encoder, "p_partkey long, p_name string, p_type string, a array<double>, b array<double>")
    return out.select("p_partkey", F.col("a")[0].alias("size"), F.col("a")[1].alias("first"), F.col("b")[0].alias("other"))


@query("K7_all_metrics", f"WITH k AS ({SQL['W1_retrieval']}) SELECT 'retrieval' AS section, name, value FROM (UNPIVOT k ON COLUMNS(*) INTO NAME name VALUE value)")
def _(spark, d):
    return rounded(evaluate.metrics(("retrieval", evaluate.retrieval(ranked(spark, d)))), "value")


# Views

_FLAT = f"WITH {NODES.replace(fx.NODES, fx.ODD)}, {_EIGEN}, f AS (SELECT neuron_id, n < 10 OR (w3 > 0 AND w1 / greatest(w3, 1e-12) < 1.1) AS flat FROM w)"


@query("G7_even_directions", f"{_FLAT}, k AS (SELECT CAST(unnest(range(24)) AS INT) AS i), e AS (SELECT neuron_id, i, 1 - (2 * i + 1) / 24.0 AS z, i * pi() * (3 - sqrt(5)) AS a FROM f, k WHERE flat) SELECT neuron_id, i, {r('sqrt(1 - z * z) * cos(a)', 'dx')}, {r('sqrt(1 - z * z) * sin(a)', 'dy')}, {r('z', 'dz')} FROM e UNION ALL SELECT neuron_id, -1, 0, 0, 0 FROM f WHERE NOT flat")
def _(spark, d):
    g = views.guided_directions(fx.odd(spark, d))
    even = g.where("tier = 'fibonacci'").select("neuron_id", "i", *[F.col("direction")[k].alias(c) for k, c in enumerate(("dx", "dy", "dz"))])
    rest = g.where("tier <> 'fibonacci'").select("neuron_id", F.lit(-1).alias("i"), *[F.lit(0.0).alias(c) for c in ("dx", "dy", "dz")]).distinct()
    return rounded(even, "dx", "dy", "dz").union(rest)


# Of the biased directions each is one of the pool's, by number; canonical ones come in opposite pairs.
@query("G7_guided_tiers", f"{_FLAT} SELECT neuron_id, tier, n, true AS units, CASE tier WHEN 'canonical' THEN 1 END AS opposite, CASE tier WHEN 'biased' THEN 12 END AS of_pool FROM f, (VALUES ('canonical', 6), ('biased', 12), ('random', 6)) t(tier, n) WHERE NOT flat")
def _(spark, d):
    g = views.guided_directions(fx.odd(spark, d)).where("tier <> 'fibonacci'")
    x, y, z = (F.col("direction")[k] for k in range(3))
    near = lambda a, b: F.abs(a - b) < 1e-9
    k = F.round((48 * (1 - z) - 1) / 2)
    angle = k * views.GOLDEN
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    pool = near(z, 1 - (2 * k + 1) / 48) & near(x, flat * F.cos(angle)) & near(y, flat * F.sin(angle))
    sums = [F.abs(F.sum(v)) < 1e-9 for v in (x, y, z)]
    out = g.groupBy("neuron_id", "tier").agg(F.count("*").cast("int").alias("n"), F.every(near(x * x + y * y + z * z, F.lit(1.0))).alias("units"), (sums[0] & sums[1] & sums[2]).alias("sum0"), F.countDistinct(F.when(pool, k)).cast("int").alias("pooled"))
    return out.select("neuron_id", "tier", "n", "units", F.when(F.col("tier") == "canonical", F.col("sum0").cast("int")).alias("opposite"), F.when(F.col("tier") == "biased", F.col("pooled")).alias("of_pool"))


@query("W4_pose_counts", f"WITH v AS ({fx.VIEWS}) SELECT neuron_id, least(2, count(*)) AS n, true AS own FROM v GROUP BY 1")
def _(spark, d):
    v = fx.views(spark, d)
    picked = views.sample_poses(v, 2).select("neuron_id", "view_id").join(v.select("view_id", F.col("neuron_id").alias("of")), "view_id")
    return picked.groupBy("neuron_id").agg(F.countDistinct("view_id").alias("n"), F.every(F.col("of") == F.col("neuron_id")).alias("own"))


# Files


@query("K9_merged_manifests", "SELECT p_partkey, p_name, CAST(p_partkey % 4 AS INT) AS task FROM part WHERE p_partkey % 4 <> 2")
def _(spark, d):
    folder = new_folder(spark, "manifests")
    # Lines of a task in files by ranges of keys would be usual; one file a task is the format.
    lines = part(spark, d).groupBy((F.col("p_partkey") % 4).alias("task")).agg(F.array_join(F.collect_list(F.to_json(F.struct("p_partkey", "p_name"))), "\n").alias("text"))
    made = lines.select(F.concat(F.lit("manifest_"), F.col("task").cast("string"), F.lit(".jsonl")).alias("name"), F.encode("text", "utf-8").alias("content"))
    files.write_files(made, folder).write.format("noop").mode("overwrite").save()
    return tables.merged_manifests(spark, folder, "p_partkey long, p_name string", [0, 1, 3])


@query("S2_headers", f"WITH {NODES}, n AS (SELECT DISTINCT neuron_id FROM nodes) SELECT CAST(neuron_id AS VARCHAR) AS neuron_id, 'SOURCE' AS key, concat('n', neuron_id % 7) AS value FROM n UNION ALL SELECT CAST(neuron_id AS VARCHAR), 'comment_2', 'free words' FROM n")
def _(spark, d):
    nodes = fx.nodes(spark, d)
    ids = nodes.select("neuron_id").distinct()
    headers = ids.select("neuron_id", F.create_map(F.lit("SOURCE"), F.concat(F.lit("n"), (F.col("neuron_id") % 7).cast("string")), F.lit("comment_2"), F.lit("free words")).alias("header"))
    texts = swc.swc_text(nodes, headers).select(F.concat(F.col("neuron_id").cast("string"), F.lit(".swc")).alias("path"), "value")
    return swc.parse_headers(swc.text_lines(texts)).select("neuron_id", F.explode("header").alias("key", "value"))


@query("S3_load_swc", f"WITH n AS ({fx.ODD}) SELECT concat('cell', neuron_id) AS neuron_id, idx, type_id, {r('x')}, {r('radius')}, parent FROM n")
def _(spark, d):
    folder = new_folder(spark, "swc")
    texts = swc.swc_text(fx.odd(spark, d)).select(F.concat(F.lit("deep/cell"), F.col("neuron_id").cast("string"), F.when(F.col("neuron_id") % 2 == 0, ".swc").otherwise(".SWC")).alias("name"), F.encode("value", "utf-8").alias("content"))
    files.write_files(texts, folder).write.format("noop").mode("overwrite").save()
    nodes, _, _ = swc.load_swc(spark, folder)
    return rounded(nodes.select("neuron_id", "idx", "type_id", "x", "radius", "parent"), "x", "radius")


@query("S8_metadata", "SELECT kind, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN kind = 'jsonl' THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 1 AS VARCHAR) END AS size FROM part, (VALUES ('csv'), ('jsonl')) k(kind)")
def _(spark, d):
    folder, p = new_folder(spark, "metadata"), part(spark, d)
    p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") + 1).alias("size")).write.csv(f"{folder}/m.csv", header=True)
    p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.json(f"{folder}/m.jsonl")
    both = [tables.metadata_fields(spark, f"{folder}/m.{kind}", "id").select(F.lit(kind).alias("kind"), "id", *[F.col("fields")[c].alias(c) for c in ("name", "size")]) for kind in ("csv", "jsonl")]
    return both[0].union(both[1])


@query("S9_specimens", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size FROM part")
def _(spark, d):
    p = part(spark, d)
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("_cell_"), F.col("p_size").cast("string"), F.lit(".swc"))
    by_specimen = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("cell_specimen_id"), "p_brand")
    by_file = p.where("p_partkey % 2 = 0").select(name.alias("filename"), "p_size")
    return tables.with_specimen_metadata(p.select("p_partkey", name.alias("swc")), by_specimen, by_file).select("p_partkey", F.col("specimen.p_brand").alias("brand"), F.col("file_fields.p_size").alias("size"))


def whole_lines(spark, folder, skip=0):
    """Lines of a folder's files, in the order of the files, numbered through; the first ``skip`` lines of each are left out."""
    rows = lines.numbered_lines(spark, folder, "part-*").where(F.col("line_no") > skip)
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return rows.join(sizes.select("path", before.alias("before")), "path").select((F.col("before") + F.col("line_no") - skip).alias("line"), "value")


@query("K4_projector", f"WITH v AS ({fx.VIEWS}) SELECT view_id, CASE WHEN view_id % 3 = 0 THEN '' ELSE concat('n', label) END AS name, {r('vec[1]', 'x', 4)}, (SELECT count(*) FROM v) AS n, 64 AS d FROM v")
def _(spark, d):
    folder, v = new_folder(spark, "projector"), fx.views(spark, d)
    names = v.where("view_id % 3 <> 0").select("view_id", F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"))
    tables.write_projector(v.select("view_id", "vec"), names, "view_id", folder, ["name"])
    shape = F.from_json("value", "embeddings array<struct<tensorShape: array<bigint>>>")["embeddings"][0]["tensorShape"]
    config = spark.read.text(f"{folder}/config").select(shape[0].alias("n"), shape[1].cast("int").alias("d"))
    # Every file of metadata begins with a header line, which tensors have not.
    meta = whole_lines(spark, f"{folder}/metadata", 1).select("line", F.split("value", "\t").alias("m"))
    tensors = whole_lines(spark, f"{folder}/tensors").select("line", F.split("value", "\t")[0].cast("double").alias("x"))
    rows = meta.join(tensors, "line").crossJoin(F.broadcast(config))
    return rounded(rows.select(F.col("m")[0].cast("long").alias("view_id"), F.replace(F.col("m")[1], F.lit('""'), F.lit("")).alias("name"), "x", "n", "d"), "x", places=4)


@query("P3_node_lists", f"""WITH {NODES.replace(fx.NODES, fx.ODD)}, k AS (SELECT neuron_id, parent AS idx, count(*) AS n FROM nodes WHERE parent <> -1 GROUP BY 1, 2), j AS (SELECT nodes.*, coalesce(n, 0) AS n FROM nodes LEFT JOIN k USING (neuron_id, idx))
 SELECT neuron_id, idx, 'root' AS kind FROM j WHERE parent = -1 UNION ALL SELECT neuron_id, idx, 'soma' FROM j WHERE type_id = 1 UNION ALL SELECT neuron_id, idx, 'axon' FROM j WHERE type_id = 2 UNION ALL SELECT neuron_id, idx, 'dendrite' FROM j WHERE type_id IN (3, 4)
 UNION ALL SELECT neuron_id, idx, 'branch_point' FROM j WHERE n > 1 UNION ALL SELECT neuron_id, idx, 'terminal' FROM j WHERE n = 0""")
def _(spark, d):
    return topology.of_kind(fx.odd(spark, d)).select("neuron_id", "idx", "kind")


# Found manifests, named collections, the projector's config, the report


@query(
    "S10_manifests",
    "SELECT 'divided' AS layout, CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, p_partkey FROM part UNION ALL SELECT 'whole', s, p_partkey FROM part, (VALUES ('train'), ('evaluation')) t(s) UNION ALL SELECT 'both', 'evaluation', p_partkey FROM part WHERE p_partkey % 3 = 2",
)
def _(spark, d):
    p, folder = part(spark, d).select("p_partkey"), new_folder(spark, "manifests")
    for name, rows in (("divided/manifest_train.jsonl", "p_partkey % 3 = 0"), ("divided/val.jsonl", "p_partkey % 3 = 1"), ("divided/manifest_test.json", "p_partkey % 3 = 2"), ("whole/manifest.jsonl", "true"), ("both/manifest_test.jsonl", "p_partkey % 3 = 2"), ("both/manifest.jsonl", "true")):
        p.where(rows).write.json(f"{folder}/{name}")
    found = [(layout, split, tables.find_manifests(spark, f"{folder}/{layout}", split)) for layout in ("divided", "whole") for split in ("train", "val", "test")]
    found += [(layout, "evaluation", tables.evaluator_manifest(spark, f"{folder}/{layout}")) for layout in ("whole", "both")]
    out = None
    for layout, split, path in found:
        if path:
            rows = spark.read.schema(p.schema).json(path).select(F.lit(layout).alias("layout"), F.lit(split).alias("split"), "p_partkey")
            out = out.union(rows) if out else rows
    return out


@query(
    "S19_collections",
    f"SELECT p_partkey, CASE p_size % 3 {' '.join(f'WHEN {k} THEN {chr(39)}{url}{chr(39)}' for k, (_, _, url) in enumerate(tables.COLLECTIONS))} END AS url FROM part",
)
def _(spark, d):
    keys = F.array(*[F.lit(key) for key, _, _ in tables.COLLECTIONS], F.lit("of no such name"))
    asked = part(spark, d).select("p_partkey", F.get(keys, F.col("p_size") % 3).alias("key"))
    return asked.join(F.broadcast(tables.collections(spark)), "key", "left").select("p_partkey", "url")


@query("K5_projector_config", "SELECT 'embeddings' AS name, count(*) AS n, max(len(embedding)) AS d, 'tensors' AS tensors, 'metadata' AS metadata FROM embeddings")
def _(spark, d):
    folder, v = new_folder(spark, "config"), fx.views(spark, d)
    tables.write_projector(v.select("view_id", "vec"), v.select("view_id", "label"), "view_id", folder, ["label"])
    one = "embeddings array<struct<tensorName: string, tensorShape: array<bigint>, tensorPath: string, metadataPath: string>>"
    e = spark.read.text(f"{folder}/config").select(F.explode(F.from_json("value", one)["embeddings"]).alias("e"))
    return e.select(F.col("e.tensorName").alias("name"), F.col("e.tensorShape")[0].alias("n"), F.col("e.tensorShape")[1].alias("d"), F.col("e.tensorPath").alias("tensors"), F.col("e.metadataPath").alias("metadata"))


_FIGURES = [("retrieval", c, f"(SELECT {c} FROM k)") for c in ("r_at_1", "r_at_5", "r_at_10", "mrr", "median_rank")] + [("lengths", "longest", "(SELECT max(length) FROM m)"), ("lengths", "mean", "(SELECT avg(length) FROM m)"), ("lengths", "unknown", "NULL")]
_LINES = ["'" + "=" * 70 + "'", "'Evaluation report'", "'" + "=" * 70 + "'"]
for _section in ("retrieval", "lengths"):
    _LINES += ["''", f"'[{_section}]'", "'" + "-" * 40 + "'", *[f"'  {name}: ' || coalesce(format('{{:.1f}}', CAST({value} AS DOUBLE)), 'n/a')" for section, name, value in _FIGURES if section == _section]]
_LINES += ["''", "'" + "=" * 70 + "'"]


@query("K10_report", f"WITH m AS ({fx.META}), k AS ({SQL['W1_retrieval']}) SELECT CAST(i - 1 AS INT) AS line, lines[i] AS value FROM (SELECT [{', '.join(_LINES)}] AS lines), range(1, {len(_LINES) + 1}) t(i)")
def _(spark, d):
    lengths = fx.meta(spark, d).agg(F.max("length").alias("longest"), F.avg("length").alias("mean"), F.lit(None).cast("double").alias("unknown"))
    said = evaluate.metrics_text(evaluate.metrics(("retrieval", evaluate.retrieval(ranked(spark, d))), ("lengths", lengths)))
    return spark.createDataFrame(list(enumerate(said.split("\n"))), "line int, value string")


@query("G16_scatter", "SELECT count(embedding) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS leading FROM embeddings")
def _(spark, d):
    v = fx.views(spark, d)
    x, y = F.col("point")[0], F.col("point")[1]
    widest = v.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.max("v").alias("widest"))
    s = vectors.pca_scatter(v, "view_id", 2).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("xy"))
    least = F.col("vx") * 1e-6
    return s.crossJoin(widest).select("n", (F.abs("mx") + F.abs("my") < least).alias("centred"), (F.abs("xy") < least).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("ordered"), (F.col("vx") >= F.col("widest")).alias("leading"))
