"""All registered queries of the library's own operators, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate, evaluate, features, match, pixels, topology, vectors, views
from ..session import shared_folder
from ..sources import swc, tables
from . import fixtures as fx
from .fixtures import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(expr: str, name: str | None = None, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {fx.nudge(places)!r}, {places}) AS {name or expr}"


NODES = f"nodes AS ({fx.NODES})"
EDGES = "edges AS (SELECT c.*, p.x px, p.y py, p.z pz, p.radius pr, sqrt((c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y)+(c.z-p.z)*(c.z-p.z)) seg FROM nodes c JOIN nodes p ON c.neuron_id = p.neuron_id AND c.parent = p.idx)"
DEPTH = "d AS (SELECT neuron_id, idx, 0 AS depth, CAST(0 AS DOUBLE) AS path FROM nodes WHERE parent = -1 UNION ALL SELECT e.neuron_id, e.idx, d.depth + 1, d.path + e.seg FROM edges e JOIN d ON e.neuron_id = d.neuron_id AND e.parent = d.idx)"
ANC = "anc AS (SELECT neuron_id, idx, idx AS a FROM nodes UNION ALL SELECT n.neuron_id, n.idx, p.a FROM anc p JOIN nodes n ON n.neuron_id = p.neuron_id AND n.parent = p.idx)"
SIZE = "sz AS (SELECT neuron_id, a AS idx, count(*) AS size FROM anc GROUP BY 1, 2)"
KIDS = "kids AS (SELECT neuron_id, parent AS idx, count(*) AS k FROM nodes WHERE parent <> -1 GROUP BY 1, 2)"
FULL = f"full_ AS (SELECT n.*, d.depth, d.path, sz.size, coalesce(kids.k, 0) AS k, e.seg, e.pr, count(*) OVER (PARTITION BY n.neuron_id) AS total FROM nodes n JOIN d USING (neuron_id, idx) JOIN sz USING (neuron_id, idx) LEFT JOIN kids USING (neuron_id, idx) LEFT JOIN edges e USING (neuron_id, idx))"
TREE = f"WITH RECURSIVE {NODES}, {EDGES}, {DEPTH}, {ANC}, {SIZE}, {KIDS}, {FULL}"


def feature_query(name: str, columns: list[str], sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = features.neuron_features(fx.nodes(spark, sf_dir)).select("neuron_id", *columns)
        return rounded(f, *columns)


# Nodes, links, predicates


@query("P1_node_columns", f"WITH {NODES} SELECT neuron_id, idx, type_id = 1 AS is_soma, type_id = 2 AS is_axon, type_id IN (3, 4) AS is_dendrite, CASE type_id WHEN 1 THEN 'SOMA' WHEN 2 THEN 'AXON' WHEN 3 THEN 'BASAL_DENDRITE' WHEN 4 THEN 'APICAL_DENDRITE' ELSE 'OTHER' END AS class FROM nodes")
def _(spark, d):
    t = F.col("type_id")
    return fx.nodes(spark, d).select("neuron_id", "idx", topology.is_soma(t).alias("is_soma"), topology.is_axon(t).alias("is_axon"), topology.is_dendrite(t).alias("is_dendrite"), topology.node_class(t).alias("class"))


@query("P4_soma_index", f"WITH {NODES} SELECT neuron_id, coalesce(min(CASE WHEN type_id = 1 THEN idx END), min(CASE WHEN parent = -1 THEN idx END)) AS soma_idx FROM nodes GROUP BY 1")
def _(spark, d):
    return topology.soma_index(fx.nodes(spark, d))


@query("J1_edges", f"WITH {NODES}, {EDGES} SELECT neuron_id, idx, parent, {r('seg', 'seg_len')} FROM edges")
def _(spark, d):
    return rounded(topology.edges(fx.nodes(spark, d)).select("neuron_id", "idx", "parent", "seg_len"), "seg_len")


@query("A1_lengths", f"WITH {NODES}, {EDGES} SELECT neuron_id, {r('sum(seg)', 'length')}, {r('coalesce(sum(CASE WHEN type_id = 2 THEN seg END), 0)', 'axon')}, {r('coalesce(sum(CASE WHEN type_id IN (3, 4) THEN seg END), 0)', 'dendrite')} FROM edges GROUP BY 1")
def neurite_lengths(spark, d):
    e = topology.edges(fx.nodes(spark, d))
    t, s = F.col("type_id"), F.col("seg_len")
    by = lambda ok: F.coalesce(F.sum(F.when(ok, s)), F.lit(0.0))
    return rounded(e.groupBy("neuron_id").agg(F.sum(s).alias("length"), by(topology.is_axon(t)).alias("axon"), by(topology.is_dendrite(t)).alias("dendrite")), "length", "axon", "dendrite")


@query("A2_bounding_box", f"WITH {NODES} SELECT neuron_id, {', '.join(r(f'{f}({a})', f'{f}_{a}') for a in 'xyz' for f in ('min', 'max', 'avg'))} FROM nodes GROUP BY 1")
def _(spark, d):
    fs = {"min": F.min, "max": F.max, "avg": F.avg}
    cols = {f"{f}_{a}": g(a) for a in "xyz" for f, g in fs.items()}
    return rounded(fx.nodes(spark, d).groupBy("neuron_id").agg(*[v.alias(k) for k, v in cols.items()]), *cols)


@query("T1_depth_joins", f"WITH RECURSIVE {NODES}, {EDGES}, {DEPTH} SELECT neuron_id, idx, depth, {r('path', 'path_len')}, 1 AS root FROM d")
def _(spark, d):
    return rounded(topology.closure(fx.nodes(spark, d)), "path_len")


@query("T2_subtree_size", f"{TREE} SELECT neuron_id, idx, size AS subtree_size, depth FROM full_")
def _(spark, d):
    return topology.topology(fx.nodes(spark, d)).select("neuron_id", "idx", "subtree_size", "depth")


@query("T3_path_distance", f"WITH RECURSIVE {NODES}, {EDGES}, {DEPTH}, {ANC}, pairs AS (SELECT neuron_id, max(idx) AS a, max(idx) - 1 AS b FROM nodes GROUP BY 1 HAVING max(idx) >= 3), meet AS (SELECT p.neuron_id, p.a, p.b, max(d.path) AS m FROM pairs p JOIN anc x ON x.neuron_id = p.neuron_id AND x.idx = p.a JOIN anc y ON y.neuron_id = p.neuron_id AND y.idx = p.b AND y.a = x.a JOIN d ON d.neuron_id = p.neuron_id AND d.idx = x.a GROUP BY 1, 2, 3) SELECT m.neuron_id, m.a, m.b, {r('da.path + db.path - 2 * m.m', 'distance')} FROM meet m JOIN d da ON da.neuron_id = m.neuron_id AND da.idx = m.a JOIN d db ON db.neuron_id = m.neuron_id AND db.idx = m.b")
def _(spark, d):
    n = fx.nodes(spark, d)
    pairs = n.groupBy("neuron_id").agg(F.max("idx").alias("a")).where("a >= 3").withColumn("b", F.col("a") - 1)
    return rounded(topology.path_distance(n, pairs), "distance")


_RUNS = "runs AS (SELECT e.neuron_id, e.idx AS first, e.parent AS start, e.idx AS cur, e.seg AS len, concat(e.parent, '-', e.idx) AS nodes FROM edges e LEFT JOIN kids k ON k.neuron_id = e.neuron_id AND k.idx = e.parent JOIN nodes p ON p.neuron_id = e.neuron_id AND p.idx = e.parent WHERE p.parent = -1 OR k.k > 1 UNION ALL SELECT r.neuron_id, r.first, r.start, e.idx, r.len + e.seg, concat(r.nodes, '-', e.idx) FROM runs r JOIN kids k ON k.neuron_id = r.neuron_id AND k.idx = r.cur AND k.k = 1 JOIN edges e ON e.neuron_id = r.neuron_id AND e.parent = r.cur)"


@query("T8_branches", f"WITH RECURSIVE {NODES}, {EDGES}, {KIDS}, {_RUNS} SELECT neuron_id, first, start, {r('max(len)', 'length')}, arg_max(nodes, length(nodes)) AS nodes, CASE WHEN start = 1 THEN 'soma' WHEN any_value(t.type_id) = 2 THEN 'axon' WHEN any_value(t.type_id) IN (3, 4) THEN 'dendrite' ELSE 'other' END AS class FROM runs JOIN (SELECT neuron_id AS n_, idx AS i_, type_id FROM nodes) t ON t.n_ = neuron_id AND t.i_ = start GROUP BY 1, 2, 3")
def _(spark, d):
    b = topology.typed_branches(fx.nodes(spark, d))
    return rounded(b.select("neuron_id", "first", "start", "length", F.array_join(F.col("nodes").cast("array<string>"), "-").alias("nodes"), "class"), "length")


@query("T9_junctions", f"WITH {NODES}, {KIDS} SELECT n.neuron_id, n.idx FROM nodes n LEFT JOIN kids USING (neuron_id, idx) WHERE n.parent = -1 OR coalesce(k, 0) <> 1")
def _(spark, d):
    return topology.junctions(fx.nodes(spark, d)).select("neuron_id", "idx")


ODD = f"nodes AS ({fx.ODD})"
TOPS = "tops AS (SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.neuron_id = n.neuron_id AND e.idx = n.idx))"
ODD_DEPTH = "d AS (SELECT neuron_id, idx, 0 AS depth, CAST(0 AS DOUBLE) AS path, idx AS root FROM tops UNION ALL SELECT e.neuron_id, e.idx, d.depth + 1, d.path + e.seg, d.root FROM edges e JOIN d ON e.neuron_id = d.neuron_id AND e.parent = d.idx)"
ODD_ANC = "anc AS (SELECT neuron_id, idx, idx AS a, 0 AS hops FROM d UNION ALL SELECT p.neuron_id, p.idx, e.parent, p.hops + 1 FROM anc p JOIN edges e ON e.neuron_id = p.neuron_id AND e.idx = p.a)"
ODD_TREE = f"WITH RECURSIVE {ODD}, {EDGES}, {TOPS}, {ODD_DEPTH}"


@query("V_problems", f"{ODD_TREE}, rooted AS (SELECT neuron_id, count(*) FILTER (WHERE parent = -1) AS n, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE parent = -1) AS ids FROM nodes GROUP BY 1) SELECT neuron_id, 'error' AS level, 'no_root' AS problem, '' AS detail FROM rooted WHERE n = 0 UNION ALL SELECT neuron_id, 'warning', 'several_roots', ids FROM rooted WHERE n > 1 UNION ALL SELECT neuron_id, 'warning', 'orphan', CAST(idx AS VARCHAR) FROM tops WHERE parent <> -1 UNION ALL SELECT neuron_id, 'warning', 'self_loop', CAST(idx AS VARCHAR) FROM nodes WHERE idx = parent UNION ALL SELECT neuron_id, 'error', 'cycle', CAST(count(*) AS VARCHAR) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.neuron_id = n.neuron_id AND d.idx = n.idx) GROUP BY 1")
def _(spark, d):
    return swc.swc_errors(fx.odd(spark, d))


@query("P1_position", f"WITH {NODES} SELECT neuron_id, idx, {r('x', 'p0')}, {r('y', 'p1')}, {r('z', 'p2')} FROM nodes")
def _(spark, d):
    p = topology.position(fx.nodes(spark, d))
    return rounded(p.select("neuron_id", "idx", *[F.col("position")[k].alias(f"p{k}") for k in range(3)]), "p0", "p1", "p2")


@query("P4_soma_fallback", f"WITH {ODD} SELECT neuron_id, coalesce(min(CASE WHEN type_id = 1 THEN idx END), min(CASE WHEN parent = -1 THEN idx END)) AS soma_idx FROM nodes GROUP BY 1")
def _(spark, d):
    return topology.soma_index(fx.odd(spark, d))


@query("T1_deep", f"{ODD_TREE} SELECT n.neuron_id, n.idx, depth, {r('path', 'path_len')}, root FROM nodes n LEFT JOIN d ON d.neuron_id = n.neuron_id AND d.idx = n.idx")
def _(spark, d):
    return rounded(topology.placed(fx.odd(spark, d)).drop("parent"), "path_len")


@query("T1_deep_joins", f"{ODD_TREE} SELECT neuron_id, idx, depth, {r('path', 'path_len')}, root FROM d")
def _(spark, d):
    return rounded(topology.closure(fx.odd(spark, d)), "path_len")


@query("J11_ancestors", f"{ODD_TREE}, {ODD_ANC} SELECT a.neuron_id, a.idx, a.a AS anc, hops FROM anc a WHERE a.idx % 9 = 0 UNION SELECT neuron_id, idx, idx, 0 FROM nodes WHERE idx % 9 = 0")
def _(spark, d):
    n = fx.odd(spark, d)
    return topology.ancestors(n, n.where("idx % 9 = 0"))


@query("T2_subtree", f"{ODD_TREE}, {ODD_ANC} SELECT neuron_id, a AS start, idx FROM anc WHERE a % 10 = 3 UNION SELECT neuron_id, idx, idx FROM nodes WHERE idx % 10 = 3")
def _(spark, d):
    n = fx.odd(spark, d)
    return topology.subtree(n, n.where("idx % 10 = 3").select("neuron_id", "idx"))


_ODD_PAIRS = f"{ODD_TREE}, {ODD_ANC}, pairs AS (SELECT neuron_id, idx AS a, CAST(1 + (idx * 7) % 50 AS INT) AS b FROM nodes WHERE idx % 5 = 0), meet AS (SELECT p.neuron_id, p.a, p.b, min(x.hops) AS ha, arg_min(x.a, x.hops) AS m FROM pairs p JOIN anc x ON x.neuron_id = p.neuron_id AND x.idx = p.a JOIN anc y ON y.neuron_id = p.neuron_id AND y.idx = p.b AND y.a = x.a GROUP BY 1, 2, 3)"


@query("T3_deep_distance", f"{_ODD_PAIRS} SELECT p.neuron_id, p.a, p.b, {r('coalesce(da.path + db.path - 2 * dm.path, -1)', 'distance')} FROM pairs p LEFT JOIN meet m USING (neuron_id, a, b) LEFT JOIN d da ON da.neuron_id = p.neuron_id AND da.idx = p.a LEFT JOIN d db ON db.neuron_id = p.neuron_id AND db.idx = p.b LEFT JOIN d dm ON dm.neuron_id = p.neuron_id AND dm.idx = m.m")
def _(spark, d):
    out = topology.path_distance(fx.odd(spark, d), odd_pairs(spark, d))
    return rounded(out.withColumn("distance", F.when(F.col("distance") < float("inf"), F.col("distance")).otherwise(-1.0)), "distance")


def odd_pairs(spark, d):
    return fx.odd(spark, d).where("idx % 5 = 0").select("neuron_id", F.col("idx").alias("a"), (1 + (F.col("idx") * 7) % 50).alias("b"))


@query("T3_reference_distance", f"{_ODD_PAIRS}, far AS (SELECT m.neuron_id, m.a, m.b, m.m, least(m.ha, db.depth) AS sb FROM meet m JOIN d db ON db.neuron_id = m.neuron_id AND db.idx = m.b) SELECT p.neuron_id, p.a, p.b, {r('coalesce(da.path - dm.path + db.path - df.path, -1)', 'distance')} FROM pairs p LEFT JOIN far f USING (neuron_id, a, b) LEFT JOIN anc y ON y.neuron_id = p.neuron_id AND y.idx = p.b AND y.hops = f.sb LEFT JOIN d da ON da.neuron_id = p.neuron_id AND da.idx = p.a LEFT JOIN d db ON db.neuron_id = p.neuron_id AND db.idx = p.b LEFT JOIN d dm ON dm.neuron_id = p.neuron_id AND dm.idx = f.m LEFT JOIN d df ON df.neuron_id = p.neuron_id AND df.idx = y.a")
def _(spark, d):
    out = topology.path_distance_ref(fx.odd(spark, d), odd_pairs(spark, d))
    return rounded(out.withColumn("distance", F.when(F.col("distance") < float("inf"), F.col("distance")).otherwise(-1.0)), "distance")


# Features

feature_query(
    "A4_segments",
    ["total_dendritic_length", "total_axonal_length", "total_neurite_length", "mean_segment_length", "median_segment_length", "std_segment_length", "max_segment_length", "min_segment_length"],
    f"{TREE} SELECT neuron_id, {r('coalesce(sum(CASE WHEN type_id IN (3,4) THEN seg END),0)', 'total_dendritic_length')}, {r('coalesce(sum(CASE WHEN type_id = 2 THEN seg END),0)', 'total_axonal_length')}, {r('coalesce(sum(seg),0)', 'total_neurite_length')}, {r('coalesce(avg(seg),0)', 'mean_segment_length')}, {r('coalesce(median(seg),0)', 'median_segment_length')}, {r('coalesce(stddev_pop(seg),0)', 'std_segment_length')}, {r('coalesce(max(seg),0)', 'max_segment_length')}, {r('coalesce(min(seg),0)', 'min_segment_length')} FROM full_ GROUP BY 1",
)
feature_query(
    "A5_counts",
    ["n_branch_points", "n_terminals", "n_dendritic_branches", "n_axonal_branches", "max_branch_order", "mean_branch_order", "max_path_distance", "mean_path_distance", "median_path_distance", "n_primary_neurites", "axon_dendrite_terminal_ratio", "axon_dendrite_node_ratio"],
    f"{TREE} SELECT neuron_id, {r('count(*) FILTER (WHERE k > 1)', 'n_branch_points')}, {r('count(*) FILTER (WHERE k = 0)', 'n_terminals')}, {r('count(*) FILTER (WHERE k > 1 AND type_id IN (3,4))', 'n_dendritic_branches')}, {r('count(*) FILTER (WHERE k > 1 AND type_id = 2)', 'n_axonal_branches')}, {r('max(depth)', 'max_branch_order')}, {r('avg(depth)', 'mean_branch_order')}, {r('max(path) FILTER (WHERE k = 0)', 'max_path_distance')}, {r('avg(path) FILTER (WHERE k = 0)', 'mean_path_distance')}, {r('median(path) FILTER (WHERE k = 0)', 'median_path_distance')}, {r('count(*) FILTER (WHERE parent = 1)', 'n_primary_neurites')}, {r('coalesce(CAST(count(*) FILTER (WHERE k = 0 AND type_id = 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE k = 0 AND type_id IN (3,4)), 0), 0)', 'axon_dendrite_terminal_ratio')}, {r('coalesce(CAST(count(*) FILTER (WHERE type_id = 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE type_id IN (3,4)), 0), 0)', 'axon_dendrite_node_ratio')} FROM full_ GROUP BY 1",
)
_VOL = "coalesce(sum(pi() * seg / 3 * (pr*pr + pr*radius + radius*radius)), 0)"
_AREA = "coalesce(sum(pi() * (pr + radius) * sqrt((pr-radius)*(pr-radius) + seg*seg)), 0)"
_BOX = "((max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)))"
feature_query(
    "A8_volume",
    ["total_volume", "total_surface_area", "surface_to_volume_ratio", "bbox_volume", "mean_radius", "std_radius", "max_radius", "min_radius", "mean_soma_radius", "n_soma_nodes"],
    f"{TREE} SELECT neuron_id, {r(_VOL, 'total_volume')}, {r(_AREA, 'total_surface_area')}, {r(f'CASE WHEN {_VOL} > 0 THEN {_AREA} / {_VOL} ELSE 0 END', 'surface_to_volume_ratio')}, {r(_BOX, 'bbox_volume')}, {r('avg(radius)', 'mean_radius')}, {r('stddev_pop(radius)', 'std_radius')}, {r('max(radius)', 'max_radius')}, {r('min(radius)', 'min_radius')}, {r('coalesce(avg(radius) FILTER (WHERE type_id = 1), 0)', 'mean_soma_radius')}, {r('count(*) FILTER (WHERE type_id = 1)', 'n_soma_nodes')} FROM full_ GROUP BY 1",
)
feature_query(
    "A12_graph",
    ["n_nodes", "n_edges", "n_components", "mean_degree", "max_degree", "is_tree", "tree_depth", "mean_betweenness", "max_betweenness", "mean_closeness", "max_closeness"],
    f"{TREE}, g AS (SELECT *, k + (CASE WHEN parent = -1 THEN 0 ELSE 1 END) AS deg, CASE WHEN total > 2 THEN depth * (size - 1) / CAST((total - 1) * (total - 2) AS DOUBLE) ELSE 0 END AS bt, CASE WHEN total > 1 AND depth > 0 THEN 2.0 / (depth + 1) * depth / (total - 1) ELSE 0 END AS cl FROM full_) SELECT neuron_id, {r('count(*)', 'n_nodes')}, {r('count(seg)', 'n_edges')}, {r('1', 'n_components')}, {r('avg(deg)', 'mean_degree')}, {r('max(deg)', 'max_degree')}, {r('1', 'is_tree')}, {r('max(depth)', 'tree_depth')}, {r('avg(bt)', 'mean_betweenness')}, {r('max(bt)', 'max_betweenness')}, {r('avg(cl)', 'mean_closeness')}, {r('max(cl)', 'max_closeness')} FROM g GROUP BY 1",
)


def _moments(v: str, name: str) -> str:
    m = f"avg({v})"
    return f"{r(f's_{name}', f'{name}_skewness')}, {r(f'k_{name}', f'{name}_kurtosis')}" if m else ""


def _moment_cte(v: str, name: str) -> str:
    c = f"(v_{name} - m_{name})"
    sd = f"stddev_pop(v_{name})"
    return f"CASE WHEN count(v_{name}) >= 3 AND {sd} > 1e-9 THEN avg({c}*{c}*{c}) / ({sd}*{sd}*{sd}) ELSE 0 END AS s_{name}, CASE WHEN count(v_{name}) >= 4 AND {sd} > 1e-9 THEN avg({c}*{c}*{c}*{c}) / ({sd}*{sd}*{sd}*{sd}) - 3 ELSE 0 END AS k_{name}"


_MV = {"segment_length": "seg", "radius": "radius", "branch_order": "CAST(depth AS DOUBLE)"}
feature_query(
    "A14_moments",
    [f"{n}_{m}" for n in _MV for m in ("skewness", "kurtosis")],
    f"{TREE}, v AS (SELECT neuron_id, {', '.join(f'{e} AS v_{n}, avg({e}) OVER (PARTITION BY neuron_id) AS m_{n}' for n, e in _MV.items())} FROM full_), w AS (SELECT neuron_id, {', '.join(_moment_cte(e, n) for n, e in _MV.items())} FROM v GROUP BY 1) SELECT neuron_id, {', '.join(_moments(e, n) for n, e in _MV.items())} FROM w",
)
feature_query(
    "A15_orientation",
    ["spatial_extent_x", "spatial_extent_y", "spatial_extent_z", "xy_aspect_ratio", "xz_aspect_ratio", "yz_aspect_ratio", "center_offset", "sphericity"],
    f"WITH {NODES}, b AS (SELECT neuron_id, count(*) AS n, max(x)-min(x) AS dx, max(y)-min(y) AS dy, max(z)-min(z) AS dz, sqrt(power(avg(x)-(min(x)+max(x))/2,2)+power(avg(y)-(min(y)+max(y))/2,2)+power(avg(z)-(min(z)+max(z))/2,2)) AS off FROM nodes GROUP BY 1) SELECT neuron_id, {r('CASE WHEN n > 1 THEN dx ELSE 0 END', 'spatial_extent_x')}, {r('CASE WHEN n > 1 THEN dy ELSE 0 END', 'spatial_extent_y')}, {r('CASE WHEN n > 1 THEN dz ELSE 0 END', 'spatial_extent_z')}, {r('CASE WHEN n > 1 AND dz > 0 AND dy > 0 THEN dx / dy ELSE 1 END', 'xy_aspect_ratio')}, {r('CASE WHEN n > 1 AND dz > 0 THEN dx / dz ELSE 1 END', 'xz_aspect_ratio')}, {r('CASE WHEN n > 1 AND dz > 0 THEN dy / dz ELSE 1 END', 'yz_aspect_ratio')}, {r('CASE WHEN n > 1 THEN off ELSE 0 END', 'center_offset')}, {r('CASE WHEN n > 1 AND dx > 0 AND dy > 0 AND dz > 0 THEN power(36 * pi() * power(dx*dy*dz, 2), 1.0/3) / (dx*dx+dy*dy+dz*dz) ELSE 0 END', 'sphericity')} FROM b",
)
feature_query(
    "A16_sholl",
    ["sholl_max_intersections", "sholl_mean_intersections", "sholl_regression_coeff"],
    f"WITH {NODES}, s AS (SELECT neuron_id, x, y, z FROM nodes WHERE idx = 1), q AS (SELECT n.neuron_id, sqrt(power(n.x-s.x,2)+power(n.y-s.y,2)+power(n.z-s.z,2)) AS dist FROM nodes n JOIN s USING (neuron_id)), far AS (SELECT neuron_id, max(dist) AS far FROM q GROUP BY 1), sh AS (SELECT neuron_id, far, k, far * k / 19.0 AS rad FROM far, range(20) t(k)), c AS (SELECT sh.neuron_id, sh.far, sh.rad, count(q.dist) AS n FROM sh LEFT JOIN q ON q.neuron_id = sh.neuron_id AND abs(q.dist - sh.rad) < sh.far / 20 GROUP BY 1, 2, 3, sh.k) SELECT neuron_id, {r('max(n)', 'sholl_max_intersections')}, {r('avg(n)', 'sholl_mean_intersections')}, {r('CASE WHEN max(far) > 0 THEN regr_slope(n, rad) ELSE 0 END', 'sholl_regression_coeff')} FROM c GROUP BY 1",
)
_SCALES = ", ".join(f"({k}, {s!r}, {math.ceil(1 / s - 1e-9)})" for k, s in enumerate(features.SCALES))
feature_query(
    "A17_fractal",
    ["fractal_dimension_2d"],
    f"WITH {NODES}, b AS (SELECT neuron_id, min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys FROM nodes GROUP BY 1), c AS (SELECT neuron_id, s, count(DISTINCT greatest(0, least(m - 1, CAST(floor((x - x0) / (xs * s)) AS INT))) * 1000 + greatest(0, least(m - 1, CAST(floor((y - y0) / (ys * s)) AS INT)))) AS n FROM nodes JOIN b USING (neuron_id), (VALUES {_SCALES}) t(k, s, m) WHERE xs > 0 AND ys > 0 GROUP BY 1, 2), f AS (SELECT neuron_id, -regr_slope(ln(n), ln(s)) AS f FROM c GROUP BY 1) SELECT b.neuron_id, {r('coalesce(f, 0)', 'fractal_dimension_2d')} FROM b LEFT JOIN f USING (neuron_id)",
)


_REST = f"{TREE} SELECT neuron_id, {r('max(x) - min(x)', 'bbox_x')}, {r('max(y) - min(y)', 'bbox_y')}, {r('max(z) - min(z)', 'bbox_z')}, {r(f'CASE WHEN {_BOX} > 0 THEN {_VOL} / {_BOX} ELSE 0 END', 'space_filling_ratio')}, {r('CASE WHEN coalesce(sum(CASE WHEN type_id IN (3,4) THEN seg END),0) > 0 THEN coalesce(sum(CASE WHEN type_id = 2 THEN seg END),0) / sum(CASE WHEN type_id IN (3,4) THEN seg END) ELSE 0 END', 'axon_dendrite_length_ratio')}, {r('coalesce(max(radius) FILTER (WHERE type_id = 1), 0)', 'max_soma_radius')}, max(sqrt(power(x - sx, 2) + power(y - sy, 2) + power(z - sz, 2))) = 0 AS degenerate FROM full_ JOIN (SELECT neuron_id, x AS sx, y AS sy, z AS sz FROM nodes WHERE idx = 1) s USING (neuron_id) GROUP BY 1"
_PARTS = ["A4_segments", "A5_counts", "A8_volume", "A12_graph", "A14_moments", "A15_orientation", "A16_sholl", "A17_fractal"]


@query("features_all", f"SELECT * FROM ({_REST}) rest " + " ".join(f"JOIN ({SQL[p]}) q_{p} USING (neuron_id)" for p in _PARTS))
def _(spark, d):
    return rounded(features.neuron_features(fx.nodes(spark, d)), *features.NAMES)


# Sources and sinks


@query("S14_links", "SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def _(spark, d):
    return tables.links(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select("page_id", "pos", "link")


@query("S15_labelled_link", "SELECT page_id, 'http://x/' || regexp_replace(link, '^/+', '') AS link FROM (SELECT page_id, coalesce(([x FOR x IN [regexp_extract(p, 'href=\"(/[^\"\\s>]+)\"', 1) FOR p IN string_split(html, '</a>') IF contains(p, '>the')] IF x <> ''])[1], nullif(regexp_extract(html, 'href=\"(/[^\"\\s>]+ch)\"', 1), '')) AS link FROM pages)")
def _(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", tables.labelled_link(F.col("html"), ">the", "http://x/", "/", "ch").alias("link"))


@query("P15_swc_url", "SELECT p_partkey, concat('http://x/dableFiles/', lower(trim(p_type)), '/CNG%20version/', p_name, '.CNG.swc') AS url FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tables.standard_swc_url("http://x", F.concat(F.lit(" "), "p_type", F.lit(" ")), F.col("p_name")).alias("url"))


@query("K2_jsonl", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS p_type FROM part")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"))
    folder = new_folder(spark, "jsonl")
    for half in (0, 1):
        tables.write_jsonl(rows.where(F.col("p_partkey") % 2 == half), folder)
    return tables.read_jsonl(spark, folder, "p_partkey long, p_name string, p_type string").drop("_corrupt")


@query("S12_morphometry", f"WITH m AS ({fx.META}) SELECT p_partkey, m.length, m.quality FROM part LEFT JOIN m ON p_partkey = m.neuron_id")
def _(spark, d):
    n = tables.with_morphometry(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("neuron_id")), fx.meta(spark, d).select("neuron_id", "length", "quality"))
    return n.select(F.col("neuron_id").alias("p_partkey"), "morphometry.length", "morphometry.quality")


@query("S20_paired", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS neuron_id FROM part")
def _(spark, d):
    return tables.paired(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("neuron_id")))


@query("P13_first_rows", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def _(spark, d):
    return tables.first_rows(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice"), 25, ["o_totalprice", "o_orderkey"]).select("o_orderkey")


@query("A36_by_swc", "SELECT p_type AS swc, min(p_partkey) AS first, count(*) AS n, sum(p_partkey) AS s FROM part WHERE p_type <> 'PROMO' GROUP BY 1")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise("").alias("swc"), F.col("p_partkey").alias("line_no"))
    return tables.by_swc(p).select("swc", "first", F.size("lines").cast("long").alias("n"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))


@query("A35_commonest", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(spark, d):
    return curate.commonest(spark.read.parquet(f"{d}/part.parquet"), "p_name")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("S18_task_range", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders) WHERE n >= 2 * ceil(c / 7.0) AND n < 3 * ceil(c / 7.0)")
def _(spark, d):
    return tables.task_range(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 2, 7)


@query("K1_swc_round_trip", f"WITH {NODES} SELECT neuron_id, idx, type_id, {r('round(x, 6)', 'x')}, {r('round(radius, 6)', 'radius')}, parent FROM nodes")
def _(spark, d):
    text = swc.swc_text(fx.nodes(spark, d)).select(F.col("neuron_id").cast("string").alias("path"), "value")
    n = topology.unique_nodes(swc.parse_nodes(swc.text_lines(text)))
    return rounded(n.select(F.col("neuron_id").cast("long").alias("neuron_id"), "idx", "type_id", "x", "radius", "parent"), "x", "radius")


@query("W5_ordinals", f"WITH v AS ({fx.VIEWS}) SELECT view_id, CAST(floor((row_number() OVER (ORDER BY view_id) - 1) / 64) AS BIGINT) AS batch, CAST(row_number() OVER (PARTITION BY neuron_id ORDER BY view_id) - 1 AS INT) AS place FROM v")
def _(spark, d):
    v = tables.in_batches(fx.views(spark, d).select("view_id", "neuron_id"), ["view_id"], 64)
    return tables.place_in_group(v, "neuron_id", "view_id").select("view_id", "batch", "place")


@query("G13_tube_faces", f"WITH RECURSIVE {NODES}, {EDGES}, {KIDS}, {_RUNS}, b AS (SELECT neuron_id, first, max(len(string_split(nodes, '-'))) AS n FROM runs GROUP BY 1, 2) SELECT neuron_id, first, 2 * 8 * (n - 1) AS n_faces, 8 * n - 1 AS last_vertex FROM b")
def _(spark, d):
    f = views.tube_faces(fx.nodes(spark, d), 8)
    return f.groupBy("neuron_id", "first").agg(F.count("*").alias("n_faces"), F.max(F.greatest("a", "b", "c")).cast("long").alias("last_vertex"))


@query("K6_sprite_cells", "WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, ceil(sqrt(count(*) OVER ())) AS cols FROM part) SELECT p_partkey, CAST(floor(i / cols) AS BIGINT) AS cell_row, CAST(i % cols AS BIGINT) AS cell_col FROM n")
def _(spark, d):
    return tables.sprite_cells(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), ["p_partkey"]).select("p_partkey", "cell_row", "cell_col")


# Curation

_META = f"m AS ({fx.META})"
_REASON = "CASE WHEN length < 200 THEN 'too_short' END"


@query("P11_cascade", f"WITH {_META}, c AS (SELECT *, count(*) OVER (PARTITION BY archive) AS n FROM m), f AS (SELECT DISTINCT neuron_id FROM ({fx.LOG}) WHERE status = 'failed') SELECT c.neuron_id, coalesce({_REASON}, CASE WHEN toxic = 1 THEN 'integrity_error' WHEN f.neuron_id IS NOT NULL THEN 'download_failed' END, CASE WHEN n < 2 THEN concat('rare_species_', archive) END) AS reason FROM c LEFT JOIN f USING (neuron_id)")
def curated(spark, d):
    none = F.lit(None).cast("double")
    failed = curate.failed_ids(fx.log(spark, d), "neuron_id").withColumn("failed", F.lit(True))
    m = curate.rare_species(fx.meta(spark, d), 2, "archive").join(failed, "neuron_id", "left")
    return curate.cascade(m, curate.degenerate(none, none, none, none, F.col("length")), curate.faulty(F.when(F.col("toxic") == 1, "Error"), F.col("failed")), F.col("rare")).select("neuron_id", "reason")


@query("A18_reason_counts", f"WITH q AS ({SQL['P11_cascade']}) SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, d):
    return curate.reason_counts(curated(spark, d))


@query("A18_species_counts", f"WITH {_META} SELECT species, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    return fx.meta(spark, d).groupBy("species").agg(F.count("*").alias("n"))


@query("J4_not_failed", f"WITH {_META} SELECT neuron_id FROM m WHERE neuron_id NOT IN (SELECT neuron_id FROM ({fx.LOG}) WHERE status IN ('failed', 'fail'))")
def _(spark, d):
    return fx.meta(spark, d).select("neuron_id").join(curate.failed_ids(fx.log(spark, d), "neuron_id", ("failed", "fail")), "neuron_id", "left_anti")


@query("W2_split_sizes", f"WITH {_META}, n AS (SELECT archive, count(*) AS n FROM m GROUP BY 1) SELECT archive, split, CASE split WHEN 'test' THEN CAST(floor(n * 0.1) AS BIGINT) WHEN 'val' THEN CAST(floor(n * 0.1) AS BIGINT) ELSE n - 2 * CAST(floor(n * 0.1) AS BIGINT) END AS n FROM n, (VALUES ('train'), ('val'), ('test')) s(split)")
def _(spark, d):
    return curate.split(fx.meta(spark, d), "neuron_id", "archive", 0.1, 0.1).groupBy("archive", "split").agg(F.count("*").alias("n"))


@query("W2_split", f"WITH {_META}, n AS (SELECT neuron_id, archive, row_number() OVER (PARTITION BY archive ORDER BY md5(concat_ws('|', neuron_id, 42)), neuron_id) - 1 AS r, CAST(floor(count(*) OVER (PARTITION BY archive) * 0.1) AS BIGINT) AS tenth FROM m) SELECT neuron_id, archive, CASE WHEN r < tenth THEN 'test' WHEN r < 2 * tenth THEN 'val' ELSE 'train' END AS split FROM n")
def _(spark, d):
    return curate.split(fx.meta(spark, d), "neuron_id", "archive", 0.1, 0.1)


@query("W3_group_split_sizes", f"WITH v AS ({fx.VIEWS}), n AS (SELECT count(DISTINCT neuron_id) AS n FROM v) SELECT split, CASE split WHEN 'train' THEN n - CAST(floor(n * 0.2) AS BIGINT) - CAST(floor(n * 0.1) AS BIGINT) WHEN 'test' THEN CAST(floor(n * 0.1) AS BIGINT) ELSE CAST(floor(n * 0.2) AS BIGINT) END AS n FROM n, (VALUES ('train'), ('val'), ('test')) s(split)")
def _(spark, d):
    return curate.split(fx.views(spark, d), "neuron_id", None, 0.2, 0.1).groupBy("split").agg(F.count("*").alias("n"))


@query("J3_assigned_split", f"WITH {_META} SELECT neuron_id, CASE WHEN neuron_id % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM m WHERE neuron_id % 3 <> 0")
def _(spark, d):
    m = fx.meta(spark, d).select("neuron_id")
    s = m.where("neuron_id % 3 <> 0").select("neuron_id", F.when(F.col("neuron_id") % 2 == 0, "train").otherwise("val").alias("split"))
    return curate.assign_split(m, s.union(s.where("split = 'train'").withColumn("split", F.lit("test"))), "neuron_id")


@query("A19_bins", f"WITH {_META} SELECT name, {r('unnest(q)', 'threshold')}, CAST(unnest(range(len(q))) AS INT) AS pos, n_samples, {r('median_')} FROM (SELECT 'size' AS name, quantile_cont(length, [0.2, 0.4, 0.6, 0.8]) AS q, count(*) AS n_samples, median(length) AS median_ FROM m WHERE length > 0)".replace("median_ FROM (", "median_ FROM ("))
def _(spark, d):
    b = curate.bins(fx.meta(spark, d).select("length"))
    return rounded(b.select("name", F.posexplode("thresholds").alias("pos", "threshold"), "n_samples", F.col("median").alias("median_")), "threshold", "median_")


@query("G4_bin_label", f"WITH {_META} SELECT neuron_id, CASE WHEN length <= 500 THEN 'small' WHEN length <= 2000 THEN 'medium' ELSE 'large' END AS label FROM m")
def _(spark, d):
    return fx.meta(spark, d).select("neuron_id", curate.bin_label(F.col("length"), F.array(F.lit(500.0), F.lit(2000.0)), F.array(*map(F.lit, ("small", "medium", "large")))).alias("label"))


@query("G5_measures", "SELECT p_partkey, CASE WHEN greatest(p_size - 10, p_size % 7, 0) > 0 THEN CAST(greatest(p_size - 10, p_size % 7, 0) AS DOUBLE) END AS extent, round(CASE WHEN p_size <> 10 AND p_size % 7 > 0 THEN CAST(p_size - 10 AS DOUBLE) / (p_size % 7) END + 3.3e-8, 6) AS aspect FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    a, b, c = (F.expr(e).cast("double") for e in ("p_size - 10", "p_size % 7", "0"))
    return rounded(p.select("p_partkey", curate.max_extent(a, b, c).alias("extent"), curate.aspect_ratio(a, b).alias("aspect")), "aspect")


_PASS = f"p AS ({SQL['P11_cascade']}), q AS (SELECT p.reason, m.species FROM p JOIN m USING (neuron_id))"


@query("report", f"WITH m AS ({fx.META}), {_PASS}, s AS ({SQL['W2_split_sizes']}) SELECT 'total' AS section, 'rows' AS name, count(*) AS n FROM q UNION ALL SELECT 'total', 'passing', count(*) FILTER (WHERE reason IS NULL) FROM q UNION ALL SELECT 'reason', reason, count(*) FROM q WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'species', species, count(*) FROM q WHERE reason IS NULL GROUP BY 2 UNION ALL SELECT 'species', 'more', 0 UNION ALL SELECT 'split', split, CAST(sum(n) AS BIGINT) FROM s GROUP BY 2")
def _(spark, d):
    m = fx.meta(spark, d)
    return curate.report(m.join(curated(spark, d), "neuron_id"), curate.split(m, "neuron_id", "archive", 0.1, 0.1))


# Joins


@query("J2_candidates", f"WITH i AS ({fx.IDS}) SELECT p_partkey, manifest_id, meta_id FROM i WHERE p_partkey % 4 <> 3")
def _(spark, d):
    i = fx.ids(spark, d)
    return match.by_candidates(i.select("p_partkey", "manifest_id"), "p_partkey", tx.candidate_ids(F.col("manifest_id")), i.select("meta_id"), "meta_id")


@query("J5_with_metadata", f"WITH {_META}, v AS ({fx.VIEWS}) SELECT view_id, m.archive, m.species FROM v LEFT JOIN m USING (neuron_id)")
def _(spark, d):
    return match.with_metadata(fx.views(spark, d).select("view_id", "neuron_id"), fx.meta(spark, d).select("neuron_id", "archive", "species"), "neuron_id").select("view_id", "archive", "species")


@query("J7_first_entry", "SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def _(spark, d):
    return match.first_entry(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn").select("conv_id", "role", "text")


@query("V6_existing", f"WITH {_META} SELECT neuron_id FROM m WHERE neuron_id IN (SELECT page_id FROM pages)")
def _(spark, d):
    return match.existing(fx.meta(spark, d).select("neuron_id"), "neuron_id", spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("path")))[0]


# Text


@query("F7_article", "SELECT doc_id, concat(CASE WHEN regexp_matches(lower(substr(text, 1, 1)), '[aeiou]') THEN 'an ' ELSE 'a ' END, text) AS t FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.article(F.col("text")).alias("t"))


_TAGS = f"t AS ({fx.TAGS})"


def _label(patterns: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(s, '{p}') THEN '{p}'" for p in patterns) + " ELSE 'other' END"


@query("F10_labels", f"WITH {_TAGS}, l AS (SELECT *, lower(concat(array_to_string(cell_types, ' '), ' in ', array_to_string(regions, ' '))) AS s FROM t) SELECT p_partkey, {_label(tx.TEXT_CELL_TYPES)} AS cell_type, {_label(tx.TEXT_REGIONS)} AS region, CASE WHEN coalesce(lower(species), '') IN ('', 'unknown', 'not reported') THEN 'other' ELSE species END AS species FROM l")
def _(spark, d):
    t = fx.tags(spark, d).withColumn("s", F.concat(F.array_join("cell_types", " "), F.lit(" in "), F.array_join("regions", " ")))
    return t.select("p_partkey", tx.label_from_text(F.col("s"), tx.TEXT_CELL_TYPES).alias("cell_type"), tx.label_from_text(F.col("s"), tx.TEXT_REGIONS).alias("region"), tx.species_label(F.col("species")).alias("species"))


_FIRST_TYPE = "coalesce(" + ", ".join(f"([c FOR c IN cell_types IF contains(lower(c), '{p}')])[1]" for p in tx.CELL_TYPE_PRIORITY) + ", ([c FOR c IN cell_types IF lower(c) NOT IN ('principal cell', 'neuron')])[1], cell_types[1])"
_FIRST_REGION = "coalesce(" + ", ".join(f"([x FOR x IN regions IF contains(lower(x), '{p}') OR contains('{p}', lower(x))])[1]" for p in tx.PRIMARY_REGIONS) + ", regions[1])"
_LAYER = "([y FOR y IN [regexp_extract(lower(x), 'layer\\s*(\\d+(?:[/-]\\d+)?)', 1) FOR x IN regions] IF y <> ''])[1]"


@query("F1_cell_type", f"WITH {_TAGS} SELECT p_partkey, {_FIRST_TYPE} AS cell_type FROM t")
def _(spark, d):
    return fx.tags(spark, d).select("p_partkey", tx.primary_cell_type(F.col("cell_types")).alias("cell_type"))


@query("F2_region", f"WITH {_TAGS} SELECT p_partkey, {_FIRST_REGION} AS region, 'layer ' || {_LAYER} AS layer FROM t")
def _(spark, d):
    return fx.tags(spark, d).select("p_partkey", tx.primary_region(F.col("regions")).alias("region"), tx.layer(F.col("regions")).alias("layer"))


_PARTS_SQL = f"q AS (SELECT p_partkey, CASE WHEN lower(species) NOT IN ('unknown', 'not reported', '') THEN species END AS species, nullif(lower({_FIRST_TYPE}), '') AS c, nullif(lower({_FIRST_REGION}), '') AS region, 'layer ' || {_LAYER} AS layer FROM t), p AS (SELECT *, CASE WHEN contains(c, 'cell') OR contains(c, 'neuron') THEN c ELSE c || ' neuron' END AS kind FROM q)"


@query("F4_parts", f"WITH {_TAGS}, {_PARTS_SQL} SELECT p_partkey, species, kind AS cell_type, region, layer FROM p")
def _(spark, d):
    p = tx.archive_parts(F.col("species"), F.col("cell_types"), F.col("regions"))
    return fx.tags(spark, d).select("p_partkey", p.species.alias("species"), p.cell_type.alias("cell_type"), p.region.alias("region"), p.layer.alias("layer"))


@query("F4_text", f"WITH {_TAGS}, {_PARTS_SQL}, s AS (SELECT p_partkey, coalesce(kind, 'neuron') || coalesce(' from ' || region || coalesce(' ' || layer, ''), '') AS s FROM p) SELECT p_partkey, CASE WHEN left(s, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || s AS description FROM s")
def _(spark, d):
    p = tx.archive_parts(F.col("species"), F.col("cell_types"), F.col("regions"))
    return fx.tags(spark, d).select("p_partkey", tx.legacy_text(p).alias("description"))


@query("F6_fields", f"WITH {_TAGS} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE concat('n', p_partkey) END AS neuron_id, CASE WHEN len(cell_types) > 0 THEN array_to_string(cell_types, ' ') ELSE 'unknown' END AS cell_type, CASE WHEN len(regions) > 0 THEN array_to_string(regions, ' ') ELSE 'unknown' END AS brain_region, coalesce(species, 'unknown') AS species FROM t")
def _(spark, d):
    key = F.col("p_partkey").cast("string")
    f = tx.archive_fields(F.when(F.col("p_partkey") % 2 == 0, key), F.concat(F.lit("n"), key), F.col("cell_types"), F.col("regions"), F.col("species"))
    return fx.tags(spark, d).select("p_partkey", *[v.alias(k) for k, v in f.items()])


@query("F6_specimen", "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS t, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS m, CASE WHEN p_partkey % 5 = 0 THEN 'Spiny' ELSE '' END AS d, CASE WHEN p_partkey % 7 > 0 THEN 'VISp' END AS st FROM part) SELECT p_partkey, coalesce(nullif(t, ''), nullif(m, ''), nullif(d, ''), 'unknown') AS cell_type, coalesce(st, 'cortex') AS brain_region, coalesce(nullif(concat_ws(' ', nullif(d, ''), st, nullif(t, '')), ''), 'neuron') AS description, coalesce(CASE WHEN d <> '' THEN 'spiny neuron' END, nullif(lower(t), '')) AS kind, lower(st) AS region FROM s")
def _(spark, d):
    k = F.col("p_partkey")
    if_ = lambda ok, v: F.when(ok, v).otherwise("")
    t, m, de, st = if_(k % 2 == 0, F.col("p_name")), if_(k % 3 == 0, F.col("p_type")), if_(k % 5 == 0, F.lit("Spiny")), F.when(k % 7 > 0, "VISp")
    f = tx.specimen_fields(k.cast("string"), t, m, de, st, F.lit(None).cast("string"))
    p = tx.specimen_parts(t, de, st, F.lit(None).cast("string"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", f["cell_type"].alias("cell_type"), f["brain_region"].alias("brain_region"), tx.specimen_text(de, st, t).alias("description"), p.cell_type.alias("kind"), p.region.alias("region"))


@query("F11_id_from_path", f"WITH i AS ({fx.IDS}) SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id FROM i")
def _(spark, d):
    return fx.ids(spark, d).select("p_partkey", tx.id_from_path(F.concat(F.lit("/data/"), "manifest_id", F.lit(".swc"))).alias("id"))


@query("F13_ngrams", "WITH w AS (SELECT p_partkey, [x FOR x IN regexp_split_to_array(lower(p_name), '\\s+') IF x <> ''] AS w FROM part), g AS (SELECT p_partkey, unnest(w) AS gram FROM w UNION ALL SELECT p_partkey, unnest([concat(w[i], ' ', w[i+1]) FOR i IN range(1, len(w))]) FROM w UNION ALL SELECT p_partkey, unnest([concat(w[i], ' ', w[i+1], ' ', w[i+2]) FOR i IN range(1, len(w) - 1)]) FROM w) SELECT p_partkey, gram, count(*) AS n FROM g GROUP BY 1, 2")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(tx.ngrams(F.col("p_name"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


@query("F14_hash_slots", "SELECT p_partkey, CAST(CAST(concat('0x', md5(p_name)) AS UHUGEINT) % 384 AS INT) AS at, CASE WHEN CAST(concat('0x', right(sha1(p_name), 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tx.md5_mod(F.col("p_name"), 384).alias("at"), tx.sha1_sign(F.col("p_name")).alias("sign"))


@query("F15_hash_vectors", "WITH w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF x <> ''] AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS gram FROM w UNION ALL SELECT doc_id, unnest([concat(w[i], ' ', w[i+1]) FOR i IN range(1, len(w))]) FROM w UNION ALL SELECT doc_id, unnest([concat(w[i], ' ', w[i+1], ' ', w[i+2]) FOR i IN range(1, len(w) - 1)]) FROM w UNION ALL SELECT doc_id, text FROM w WHERE len(w) = 0), c AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY 1, 2), h AS (SELECT doc_id, CAST(CAST(concat('0x', md5(gram)) AS UHUGEINT) % 384 AS INT) AS slot, sum(CASE WHEN CAST(concat('0x', right(sha1(gram), 1)) AS INT) % 2 = 0 THEN n ELSE -n END) AS v FROM c GROUP BY 1, 2), z AS (SELECT * FROM h WHERE v <> 0) SELECT doc_id, CAST(count(*) AS INT) AS n, min(slot) AS first_slot, " + r("arg_min(v, slot) / sqrt(sum(v * v))", "first_value") + ", " + r("sum(slot * v) / sqrt(sum(v * v))", "weighted") + " FROM z GROUP BY 1")
def _(spark, d):
    v = tx.hash_vectors(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    first = F.col("slots")[0]
    return rounded(v.select("doc_id", F.size("slots").alias("n"), first["at"].alias("first_slot"), first["v"].alias("first_value"), F.aggregate("slots", F.lit(0.0), lambda s, x: s + x["at"] * x["v"]).alias("weighted")), "first_value", "weighted")


@query("P14_safe_filename", "SELECT page_id, left(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), 240) AS name FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.safe_filename(F.col("url")).alias("name"))


@query("F17_clipped", "SELECT doc_id, CASE WHEN length(text) > 50 THEN concat(left(text, 50), '...') ELSE text END AS t FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.clipped(F.col("text")).alias("t"))


@query("F5_descriptions", f"WITH {_META} SELECT neuron_id, concat('a ', species, ' neuron') AS broad, concat('a ', species, ' ', archive, ' neuron from neocortex layer 2/3') AS standard FROM m WHERE species NOT IN ('en', 'es') UNION ALL SELECT neuron_id, concat('an ', species, ' neuron'), concat('an ', species, ' ', archive, ' neuron from neocortex layer 2/3') FROM m WHERE species IN ('en', 'es')")
def _(spark, d):
    p = tx.archive_parts(F.col("species"), F.array("archive"), F.array(F.lit("Neocortex"), F.lit("Layer 2/3")))
    return fx.meta(spark, d).select("neuron_id", tx.broad(p).alias("broad"), tx.standard(p).alias("standard"))


def _chance(parts):
    """SQL of a number in [0, 1) drawn by a hash of the parts."""
    return f"CAST('0x' || left(md5(concat_ws('|', {parts})), 8) AS BIGINT) / 4294967296.0"


@query("F8_augmented", f"SELECT p_partkey, [p_name, lower(p_name), 'a ' || p_name, 'morphology of ' || p_name][CAST(floor(4 * {_chance('p_partkey, 3')}) AS INT) + 1] AS phrase FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tx.augmented(F.col("p_name"), F.col("p_partkey"), 3).alias("phrase"))


@query(
    "F9_multilevel_texts",
    f"""WITH {_META}, f AS (SELECT *, concat(species, ' ', archive, ' neuron from hippocampus') AS s, concat(CASE WHEN left(archive, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END, archive, ' neuron from hippocampus') AS old,
 concat_ws(' ', CASE WHEN length <= 500 THEN 'small' WHEN length <= 2000 THEN 'medium' WHEN length > 2000 THEN 'large' END, s) AS sized, {_chance("neuron_id, 'level0'")} AS u, CAST(floor(2 * {_chance("neuron_id, 'facts'")}) AS INT) + 2 AS wanted,
 [x FOR x IN [CAST(round_even(length, 0) AS BIGINT) || ' um total length', CAST(quality AS BIGINT) || ' bifurcations', CAST(toxic AS BIGINT) || ' stems', CAST(round_even(length / 3, 0) AS BIGINT) || ' x ' || CAST(round_even(length / 7, 0) AS BIGINT) || ' um span'] IF x IS NOT NULL] AS facts FROM m),
 o AS (SELECT *, list_sort([md5(concat_ws('|', neuron_id, x)) || x FOR x IN facts])[:wanted] AS drawn FROM f),
 a AS (SELECT *, CASE WHEN lower(left(s, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || s AS standard, CASE WHEN lower(left(sized, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || sized AS detailed FROM o)
 SELECT neuron_id, CASE WHEN u < 0.1 THEN 'broad' WHEN u < 0.4 THEN 'standard' WHEN u < 0.8 THEN 'detailed' ELSE 'morphometric' END AS level, detailed, array_to_string(list_concat([standard], [x[33:] FOR x IN drawn]), ', ') AS morphometric, [old, lower(old), 'a ' || old, 'morphology of ' || old][CAST(floor(4 * {_chance('neuron_id, 0')}) AS INT) + 1] AS legacy FROM a""",
)
def _(spark, d):
    key = F.col("neuron_id")
    p = tx.archive_parts(F.col("species"), F.array("archive"), F.array(F.lit("Hippocampus")))
    size = curate.bin_label(F.col("length"), F.array(F.lit(500.0), F.lit(2000.0)), F.array(*map(F.lit, ("small", "medium", "large"))))
    fact = tx.facts(F.col("length"), F.col("quality").cast("double"), F.col("toxic").cast("double"), F.col("length") / 3, F.col("length") / 7)
    return fx.meta(spark, d).select("neuron_id", tx.level(key).alias("level"), tx.detailed(p, F.array_compact(F.array(size)), key).alias("detailed"), tx.morphometric(p, fact, key).alias("morphometric"), tx.augmented(tx.legacy_text(p), key).alias("legacy"))


# Vectors and evaluation

_V = f"v AS (SELECT view_id, neuron_id, label, [CAST(x AS DOUBLE) FOR x IN vec] AS vec FROM ({fx.VIEWS}))"
_LONG = "l AS (SELECT view_id, neuron_id, label, unnest(vec) AS v, CAST(unnest(range(len(vec))) AS INT) AS i FROM v)"


def pooled_query(how: str, sql: str) -> None:
    @query(f"A20_pool_{how}", f"WITH {_V}, {_LONG} SELECT neuron_id, i, {r(sql, 'v')} FROM l GROUP BY 1, 2")
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = vectors.pool(fx.views(spark, d), how)
        return rounded(p.select("neuron_id", F.posexplode("vec").alias("i", "v")), "v")


pooled_query("mean", "avg(v)")
pooled_query("max", "max(v)")
pooled_query("median", "median(v)")


@query("A20_concat", f"WITH {_V} SELECT neuron_id, sum(len(vec)) AS n, {r('sum(vec[1])', 's')} FROM v GROUP BY 1")
def _(spark, d):
    p = vectors.pool(fx.views(spark, d), "concat")
    firsts = F.filter(F.transform("vec", lambda x, i: F.when(i % 64 == 0, x.cast("double"))), lambda x: x.isNotNull())
    return rounded(p.select("neuron_id", F.size("vec").cast("long").alias("n"), F.aggregate(firsts, F.lit(0.0), lambda s, x: s + x).alias("s")), "s")


@query("A23_pose_stats", f"WITH n AS (SELECT neuron_id, count(*) AS n FROM ({fx.VIEWS}) GROUP BY 1) SELECT {r('avg(n)', 'mean')}, {r('median(n)', 'median')}, min(n) AS min, max(n) AS max FROM n")
def _(spark, d):
    return rounded(vectors.pose_stats(vectors.pool(fx.views(spark, d), "mean")), "mean", "median")


@query("G2_normalised", f"WITH {_V} SELECT view_id, {r('list_dot_product(vec, vec) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(vec, vec)))', 'one')}, {r('vec[1] / sqrt(list_dot_product(vec, vec))', 'x0')} FROM v")
def _(spark, d):
    n = fx.views(spark, d).select("view_id", vectors.normalised(F.col("vec")).alias("u"))
    return rounded(n.select("view_id", vectors.dot(F.col("u"), F.col("u")).alias("one"), F.col("u")[0].alias("x0")), "one", "x0")


_SIM = f"WITH {_V}, q AS (SELECT view_id AS query_id, label AS query_label, vec AS qv FROM v WHERE view_id % 20 = 0), s AS (SELECT query_id, query_label, view_id, label, list_cosine_similarity(qv, vec) AS sim FROM q, v)"


@query("O2_top_k", f"{_SIM} SELECT query_id, view_id, CAST(k AS INT) AS rank, {r('sim')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, view_id) AS k FROM s) WHERE k <= 5")
def _(spark, d):
    v = fx.views(spark, d)
    return rounded(vectors.nearest(v.where("view_id % 20 = 0").select(F.col("view_id").alias("query_id"), "vec"), v.select("view_id", "vec"), "query_id", "view_id", 5, places=9), "sim")


@query("W1_ranks", f"{_SIM}, b AS (SELECT query_id, max(sim) FILTER (WHERE label = query_label) AS best FROM s GROUP BY 1) SELECT query_id, 1 + count(*) FILTER (WHERE s.sim > b.best + 1e-9) AS rank FROM s JOIN b USING (query_id) GROUP BY 1")
def ranked(spark, d):
    v = fx.views(spark, d)
    return evaluate.ranks(v.where("view_id % 20 = 0").select(F.col("view_id").alias("query_id"), "label", "vec"), v, "query_id")


@query("W1_retrieval", f"WITH k AS ({SQL['W1_ranks']}) SELECT {', '.join(r(f'100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)', f'r_at_{k}') for k in (1, 5, 10))}, {r('100 * avg(1.0 / rank)', 'mrr')}, {r('median(rank)', 'median_rank')} FROM k")
def _(spark, d):
    e = evaluate.retrieval(ranked(spark, d))
    return rounded(e, *e.columns)


@query("W1_both_ways", f"WITH {_V}, s AS (SELECT a.view_id AS i, b.view_id AS j, a.label = b.label AS ok, list_cosine_similarity(a.vec, list_reverse(b.vec)) AS sim FROM v a, v b), x AS (SELECT i, 1 + count(*) FILTER (WHERE sim > best + 1e-9) AS rank FROM (SELECT *, max(sim) FILTER (WHERE ok) OVER (PARTITION BY i) AS best FROM s) GROUP BY 1), y AS (SELECT j, 1 + count(*) FILTER (WHERE sim > best + 1e-9) AS rank FROM (SELECT *, max(sim) FILTER (WHERE ok) OVER (PARTITION BY j) AS best FROM s) GROUP BY 1) SELECT * FROM (SELECT " + ", ".join([r(f"100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)", f"i2t_r_at_{k}") for k in (1, 5, 10)] + [r("100 * avg(1.0 / rank)", "i2t_mrr"), r("median(rank)", "i2t_median_rank")]) + " FROM x), (SELECT " + ", ".join([r(f"100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END)", f"t2i_r_at_{k}") for k in (1, 5, 10)] + [r("100 * avg(1.0 / rank)", "t2i_mrr"), r("median(rank)", "t2i_median_rank")]) + " FROM y)")
def both_ways(spark, d):
    v = fx.views(spark, d).select("view_id", F.col("label").alias("text"), F.col("vec").alias("image"), F.reverse("vec").alias("embedded"))
    e = evaluate.retrieval_both_ways(v, "view_id")
    return rounded(e, *e.columns)


@query("K7_metrics", f"SELECT 'retrieval' AS section, name, value FROM (UNPIVOT ({SQL['W1_both_ways']}) ON COLUMNS(*) INTO NAME name VALUE value) WHERE name LIKE '%r_at%'")
def _(spark, d):
    return rounded(evaluate.metrics(("retrieval", both_ways(spark, d))).where("name like '%r_at%'"), "value")


_ZERO = f"WITH {_V}, {_LONG}, p AS (SELECT label AS class, i, avg(v) AS m FROM l GROUP BY 1, 2), pn AS (SELECT class, sqrt(sum(m * m)) AS n FROM p GROUP BY 1), ln AS (SELECT view_id, sqrt(sum(v * v)) AS n FROM l GROUP BY 1), s AS (SELECT l.view_id, l.label, p.class, sum(l.v * p.m) / (ln.n * pn.n) AS sim FROM l JOIN p USING (i) JOIN pn USING (class) JOIN ln USING (view_id) GROUP BY 1, 2, 3, ln.n, pn.n), z AS (SELECT view_id, label AS gt, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY sim DESC, class) AS k FROM s) WHERE k = 1)"


def zero_shot(spark, d):
    v = fx.views(spark, d)
    p = vectors.pool(v, "mean", "label").select(F.col("label").alias("class"), "vec")
    best = vectors.nearest(v.select("view_id", "vec"), p, "view_id", "class", 1)
    return best.join(v.select("view_id", F.col("label").alias("gt")), "view_id").select("view_id", "gt", F.col("class").alias("pred"))


@query("O3_zero_shot", f"{_ZERO} SELECT view_id, gt, pred FROM z")
def _(spark, d):
    return zero_shot(spark, d)


_REPORT = "t AS (SELECT gt AS label, count(*) AS support, count(*) FILTER (WHERE gt = pred) AS tp FROM z GROUP BY 1), y AS (SELECT pred AS label, count(*) AS predicted FROM z GROUP BY 1), r AS (SELECT label, coalesce(CAST(tp AS DOUBLE) / predicted, 0) AS p, CAST(tp AS DOUBLE) / support AS rc, support FROM t LEFT JOIN y USING (label)), f AS (SELECT label, p AS precision, rc AS recall, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1, support FROM r)"


@query("A25_class_report", f"{_ZERO}, {_REPORT} SELECT label, {r('precision')}, {r('recall')}, {r('f1')}, support FROM f")
def _(spark, d):
    return rounded(evaluate.class_report(zero_shot(spark, d)), "precision", "recall", "f1")


@query("A25_averages", f"{_ZERO}, {_REPORT} SELECT {', '.join(r(f'avg({m})', f'macro_{m}') + ', ' + r(f'sum({m} * support) / sum(support)', f'weighted_{m}') for m in ('precision', 'recall', 'f1'))}, {r('sum(recall * support) / sum(support)', 'accuracy')}, CAST(sum(support) AS BIGINT) AS n FROM f")
def _(spark, d):
    a = evaluate.averages(evaluate.class_report(zero_shot(spark, d)))
    return rounded(a, *[c for c in a.columns if c != "n"])


@query("A26_confusion", f"{_ZERO} SELECT g.gt, {', '.join(f'count(z.view_id) FILTER (WHERE pred = {k}) AS c{k}' for k in range(10))} FROM (SELECT CAST(unnest(range(10)) AS INT) AS gt) g LEFT JOIN z USING (gt) GROUP BY 1")
def _(spark, d):
    c = evaluate.confusion(zero_shot(spark, d), list(range(10)))
    return c.withColumnsRenamed({str(k): f"c{k}" for k in range(10)})


@query("A32_group_cosines", f"WITH {_V}, s AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.view_id < b.view_id) SELECT {r('avg(c) FILTER (WHERE same)', 'intra')}, {r('avg(c) FILTER (WHERE NOT same)', 'inter')} FROM s")
def _(spark, d):
    return rounded(vectors.group_cosines(fx.views(spark, d), "view_id", "label"), "intra", "inter")


@query("A24_effect", f"WITH {_V}, q AS (SELECT vec AS qv FROM v WHERE view_id = 0), s AS (SELECT view_id, CAST(label AS DOUBLE) AS value, round(list_cosine_similarity(qv, vec), 9) AS sim FROM q, v), t AS (SELECT avg(value) AS m FROM (SELECT * FROM s ORDER BY sim DESC, view_id LIMIT 50)) SELECT {r('t.m', 'top_mean')}, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('(t.m - avg(value)) / stddev_pop(value)', 'effect_size')}, t.m > avg(value) AS correct_direction FROM s, t GROUP BY t.m")
def _(spark, d):
    v = fx.views(spark, d)
    s = vectors.similarities(v.where("view_id = 0").select(F.col("view_id").alias("q"), "vec"), v, "q", "view_id").join(v.select("view_id", F.col("label").cast("double").alias("value")), "view_id").withColumn("sim", F.round("sim", 9))
    e = evaluate.effect(s, "value", "view_id", 50)
    return rounded(e, "top_mean", "mean", "std", "effect_size")


_NCE = f"WITH {_V}, b AS (SELECT row_number() OVER (ORDER BY view_id) - 1 AS k, vec FROM v), s AS (SELECT CAST(floor(x.k / 64) AS BIGINT) AS batch, x.k AS i, y.k AS j, list_cosine_similarity(x.vec, list_reverse(y.vec)) / 0.07 AS s FROM b x JOIN b y ON floor(x.k / 64) = floor(y.k / 64)), m AS (SELECT *, max(s) OVER (PARTITION BY i) AS mi, max(s) OVER (PARTITION BY j) AS mj, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS rj FROM s), e AS (SELECT *, sum(exp(s - mi)) OVER (PARTITION BY i) AS ei, sum(exp(s - mj)) OVER (PARTITION BY j) AS ej FROM m)"


@query("A33_info_nce", f"{_NCE} SELECT batch, count(*) AS n, {r('(avg(ln(ei) + mi - s) + avg(ln(ej) + mj - s)) / 2', 'loss')}, {r('avg(CASE WHEN ri = 1 THEN 1.0 ELSE 0 END)', 'i2t_acc')}, {r('avg(CASE WHEN rj = 1 THEN 1.0 ELSE 0 END)', 't2i_acc')} FROM e WHERE i = j GROUP BY 1")
def _(spark, d):
    v = tables.numbered(fx.views(spark, d), ["view_id"]).select("view_id", F.floor(F.col("row_no") / 64).alias("batch"), F.col("vec").alias("image"), F.reverse("vec").alias("text"))
    return rounded(evaluate.info_nce(v, "view_id", "batch"), "loss", "i2t_acc", "t2i_acc")


# Pixels

_PX = f"p AS ({fx.PIXELS})"


@query("A27_majority_pool", f"WITH {_PX}, n AS (SELECT view_id, CAST(floor(r / 2) AS INT) AS r, CAST(floor(c / 2) AS INT) AS c, val, count(*) AS n FROM p GROUP BY 1, 2, 3, 4) SELECT view_id, r, c, val FROM (SELECT *, row_number() OVER (PARTITION BY view_id, r, c ORDER BY CASE WHEN val > 0 THEN n ELSE 0 END DESC, CASE WHEN val = 0 THEN 99 ELSE val END) AS k FROM n) WHERE k = 1")
def _(spark, d):
    return pixels.majority_pool(fx.pixels(spark, d), 2)


_DP = f"p AS ({fx.DEPTHS})"


@query("A28_depth_pool", f"WITH {_DP} SELECT view_id, CAST(floor(r / 2) AS INT) AS r, CAST(floor(c / 2) AS INT) AS c, {r('coalesce(avg(val) FILTER (WHERE val < 0.999), avg(val))', 'val')} FROM p GROUP BY view_id, 2, 3")
def _(spark, d):
    return rounded(pixels.depth_pool(fx.depths(spark, d), 2), "val")


@query("A29_depth_bytes", f"WITH {_DP}, s AS (SELECT view_id, min(val) FILTER (WHERE val < 0.999) AS lo, max(val) FILTER (WHERE val < 0.999) AS hi FROM p GROUP BY 1) SELECT p.view_id, r, c, CAST(CASE WHEN val >= 0.999 THEN 0 WHEN hi > lo THEN floor((val - lo) / (hi - lo) * 255) ELSE 128 END AS INT) AS val FROM p JOIN s USING (view_id)")
def _(spark, d):
    return pixels.depth_bytes(fx.depths(spark, d))


@query("A30_occupancy", f"WITH {_PX} SELECT view_id, {r('CAST(count(*) FILTER (WHERE val > 0) AS DOUBLE) / count(*)', 'occupancy')} FROM p GROUP BY 1")
def _(spark, d):
    return rounded(pixels.occupancy(fx.pixels(spark, d)), "occupancy")


@query("A30_class_fractions", f"WITH {_PX}, n AS (SELECT view_id, val, count(*) AS n FROM p GROUP BY 1, 2) SELECT view_id, val, {r('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY view_id)', 'fraction')} FROM n")
def _(spark, d):
    return rounded(pixels.class_fractions(fx.pixels(spark, d)), "fraction")


@query("G15_colourise", f"WITH {_PX} SELECT view_id, r, c, CASE val WHEN 1 THEN 255 ELSE 0 END AS red, CASE val WHEN 2 THEN 255 ELSE 0 END AS green, 0 AS blue FROM p")
def _(spark, d):
    return pixels.colourise(fx.pixels(spark, d), {1: (255, 0, 0), 2: (0, 255, 0)}).select("view_id", "r", "c", "red", "green", "blue")


# Views

_COV = ", ".join(r(f"covar_samp({a}, {b})", f"c{a}{b}") for k, a in enumerate("xyz") for b in "xyz"[k:])


@query("A31_covariance", f"WITH {NODES} SELECT neuron_id, {_COV}, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    c = views.covariance(fx.nodes(spark, d)).where("n > 1")
    return rounded(c, *[x for x in c.columns if x.startswith("c")])


# Eigenvalues of a symmetric 3 x 3 matrix in closed form.
_EIGEN = f"c AS (SELECT neuron_id, count(*) AS n, coalesce(covar_samp(x, x), 0) a, coalesce(covar_samp(y, y), 0) b, coalesce(covar_samp(z, z), 0) c, coalesce(covar_samp(x, y), 0) d, coalesce(covar_samp(x, z), 0) e, coalesce(covar_samp(y, z), 0) f FROM nodes GROUP BY 1), p AS (SELECT *, (a + b + c) / 3 AS q FROM c), s AS (SELECT *, sqrt(((a-q)*(a-q) + (b-q)*(b-q) + (c-q)*(c-q) + 2*(d*d + e*e + f*f)) / 6) AS p FROM p), t AS (SELECT *, CASE WHEN p < 1e-12 THEN 0 ELSE greatest(-1, least(1, ((a-q)*((b-q)*(c-q) - f*f) - d*(d*(c-q) - f*e) + e*(d*f - (b-q)*e)) / (2*p*p*p))) END AS r FROM s), w AS (SELECT neuron_id, n, q + 2*p*cos(acos(r)/3) AS w1, q + 2*p*cos(acos(r)/3 + 2*pi()/3) AS w3, 3*q AS tr FROM t)"


@query("A31_principal_axes", f"WITH {NODES}, {_EIGEN} SELECT neuron_id, round(w1 + 3.3e-6, 3) AS w1, round(tr - w1 - w3 + 3.3e-6, 3) AS w2, round(w3 + 3.3e-6, 3) AS w3 FROM w")
def _(spark, d):
    p = views.principal_axes(fx.nodes(spark, d))
    return p.select("neuron_id", *[F.round(F.col("values")[k] + 3.3e-6, 3).alias(f"w{k + 1}") for k in range(3)])


@query("G6_fibonacci", f"SELECT i, {r('sqrt(1 - z * z) * cos(i * a)', 'dx')}, {r('sqrt(1 - z * z) * sin(i * a)', 'dy')}, {r('z', 'dz')} FROM (SELECT i, (1 - 1/100.0) - i * (2 - 2/100.0) / 99 AS z, pi() * (3 - sqrt(5)) AS a FROM range(100) t(i))")
def _(spark, d):
    return rounded(views.fibonacci_sphere(spark, 100), "dx", "dy", "dz")


_ALONG = [(0, 0.0, 0.0, 1.0), (1, 0.0, -1.0, 0.0), (2, 0.6, 0.0, 0.8), (3, 0.48, 0.6, 0.64), (4, 0.18, 0.96, 0.24), (5, -2.0, 1.0, 2.0)]


@query("G8_extents", f"WITH {NODES}, g AS (SELECT * FROM (VALUES " + ", ".join(map(str, _ALONG)) + f") t(i, gx, gy, gz)), h AS (SELECT i, gx / l AS dx, gy / l AS dy, gz / l AS dz FROM (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS l FROM g)), k AS (SELECT *, CASE WHEN abs(dy) > 0.95 THEN dy ELSE -dz END AS ux, CASE WHEN abs(dy) > 0.95 THEN -dx ELSE 0 END AS uy, CASE WHEN abs(dy) > 0.95 THEN 0 ELSE dx END AS uz FROM h), u AS (SELECT i, dx, dy, dz, ux / l AS ux, uy / l AS uy, uz / l AS uz FROM (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS l FROM k)), o AS (SELECT neuron_id, i, x*ux + y*uy + z*uz AS pu, x*(uy*dz - uz*dy) + y*(uz*dx - ux*dz) + z*(ux*dy - uy*dx) AS pv FROM nodes, u) SELECT neuron_id, CAST(i AS INT) AS i, {r('max(pu) - min(pu)', 'width', 4)}, {r('max(pv) - min(pv)', 'height', 4)}, {r('sqrt(power(max(pu) - min(pu), 2) + power(max(pv) - min(pv), 2))', 'diagonal', 4)} FROM o GROUP BY 1, 2")
def _(spark, d):
    along = spark.createDataFrame(_ALONG, "i int, dx double, dy double, dz double")
    return rounded(views.projected_extents(fx.nodes(spark, d), along), "width", "height", "diagonal", places=4)


@query("G9_framing", f"WITH {NODES}, b AS (SELECT neuron_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(1e-6, 0.5 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2))) AS rad FROM nodes GROUP BY 1) SELECT neuron_id, {r('cx')}, {r('cy')}, {r('cz')}, {r('0.85 * rad', 'ortho_scale')}, {r('3 * rad + 1', 'ortho_distance')}, {r('0.85 * rad / tan(radians(22.5))', 'distance')} FROM b")
def _(spark, d):
    f = views.framing(fx.nodes(spark, d))
    return rounded(f.select("neuron_id", *[F.col("target")[k].alias(c) for k, c in enumerate(("cx", "cy", "cz"))], "ortho_scale", "ortho_distance", "distance"), "cx", "cy", "cz", "ortho_scale", "ortho_distance", "distance")


_CAMERA = views.perspective(30.0, 1.0, 0.1, 90.0) @ views.look_at(np.array([60.0, 20.0, 50.0]), np.array([25.0, 5.0, 4.0]), np.array([0.0, 1.0, 0.0]))
_CLIP = ", ".join(f"{row[0]!r}*px + {row[1]!r}*py + {row[2]!r}*pz + {row[3]!r} AS {c}" for row, c in zip(_CAMERA.tolist(), "uvts", strict=True))
_BOX16 = ", ".join(map(str, [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)] + [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1), (0, 0, 0), (0, 0, 0)]))


@query("G10_qc_fraction", f"WITH {NODES}, b AS (SELECT neuron_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM nodes GROUP BY 1), p AS (SELECT neuron_id, (x0 + x1) / 2 + sx * (x1 - x0) / 2 AS px, (y0 + y1) / 2 + sy * (y1 - y0) / 2 AS py, (z0 + z1) / 2 + sz * (z1 - z0) / 2 AS pz FROM b, (VALUES {_BOX16}) k(sx, sy, sz)), q AS (SELECT neuron_id, {_CLIP} FROM p) SELECT neuron_id, avg(CASE WHEN greatest(abs(u), abs(v), abs(t)) / greatest(1e-6, s) <= 1 THEN 1.0 ELSE 0 END) AS fraction FROM q GROUP BY 1")
def _(spark, d):
    return views.qc_fractions(fx.nodes(spark, d), _CAMERA)


@query("G7_guided_directions", f"WITH {NODES.replace(fx.NODES, fx.ODD)}, {_EIGEN}, f AS (SELECT neuron_id, n < 10 OR (w3 > 0 AND w1 / greatest(w3, 1e-12) < 1.1) AS flat FROM w) SELECT neuron_id, tier, CAST(n AS BIGINT) AS n FROM f, (VALUES ('canonical', 6, false), ('biased', 12, false), ('random', 6, false), ('fibonacci', 24, true)) t(tier, n, on_flat) WHERE flat = on_flat")
def _(spark, d):
    return views.guided_directions(fx.odd(spark, d)).groupBy("neuron_id", "tier").agg(F.count("*").alias("n"))


@query("G12_scaled_radii", f"WITH RECURSIVE {NODES}, {EDGES}, {KIDS}, rr AS (SELECT neuron_id, radius AS r FROM edges UNION ALL SELECT e.neuron_id, e.pr FROM edges e JOIN kids k ON k.neuron_id = e.neuron_id AND k.idx = e.parent WHERE e.parent = 1 OR k.k > 1), m AS (SELECT neuron_id, quantile_cont(r, 0.25) AS ref FROM rr GROUP BY 1), w AS (SELECT n.*, least(10.0, power(ref / (radius + 1e-12), 2)) AS w FROM nodes n LEFT JOIN m USING (neuron_id)) SELECT neuron_id, idx, {r('CASE WHEN idx = 1 THEN radius ELSE radius * (1 + 2 * w / (1 + w)) END', 'scaled_radius')} FROM w")
def _(spark, d):
    return rounded(views.scaled_radii(fx.nodes(spark, d), 3.0, 2.0, 25.0).select("neuron_id", "idx", "scaled_radius"), "scaled_radius")


@query("W4_first_pose", f"SELECT neuron_id, min(view_id) AS view_id FROM ({fx.VIEWS}) GROUP BY 1")
def _(spark, d):
    return views.sample_poses(fx.views(spark, d), 1, how="first").select("neuron_id", "view_id")


@query("W4_pose_sample", f"WITH v AS ({fx.VIEWS}), n AS (SELECT neuron_id, view_id, row_number() OVER (PARTITION BY neuron_id ORDER BY md5(concat_ws('|', neuron_id, view_id, 0)), view_id) AS r FROM v) SELECT neuron_id, view_id FROM n WHERE r <= 2")
def _(spark, d):
    return views.sample_poses(fx.views(spark, d), 2).select("neuron_id", "view_id")


@query("stream_status_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    from ..streaming.curation import status_counts

    return status_counts(spark.read.parquet(f"{d}/events.parquet").withColumn("status", F.col("event_type")))


from . import files, geometry, more  # noqa: E402, F401  registers further queries
