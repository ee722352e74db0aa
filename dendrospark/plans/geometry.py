"""Queries of meshes and cameras, of kept results and of kept streams, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cameras, mesh
from ..sources.cache import Cache, group_keys
from ..streaming.manifest import Manifest
from . import fixtures as fx
from .catalog import EDGES, KIDS, NODES, new_folder, query, r
from .fixtures import rounded

AXES = range(3)


def each(text: str) -> str:
    """A list of SQL expressions, one for each axis; "#" is its number."""
    return ", ".join(text.replace("#", str(k)) for k in AXES)


def dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{k} * {b}{k}" for k in AXES) + ")"


def cross(a: str, b: str, name: str) -> str:
    return ", ".join(f"{a}{(k + 1) % 3} * {b}{(k + 2) % 3} - {a}{(k + 2) % 3} * {b}{(k + 1) % 3} AS {name}{k}" for k in AXES)


# Meshes: rings of three points along the branches. The soma is node 1 of every tree.
M = 3
RINGS = f"""walk AS (SELECT e.neuron_id, e.idx AS first, e.parent AS start, e.idx AS cur, 1 AS ring FROM edges e LEFT JOIN kids k ON k.neuron_id = e.neuron_id AND k.idx = e.parent WHERE e.parent = 1 OR k.k > 1
  UNION ALL SELECT w.neuron_id, w.first, w.start, e.idx, w.ring + 1 FROM walk w JOIN kids k ON k.neuron_id = w.neuron_id AND k.idx = w.cur AND k.k = 1 JOIN edges e ON e.neuron_id = w.neuron_id AND e.parent = w.cur),
 place AS (SELECT neuron_id, first, ring, cur AS idx FROM walk UNION ALL SELECT neuron_id, first, 0, start FROM walk WHERE ring = 1),
 spot AS (SELECT p.neuron_id, p.first, p.ring, n.x - s.x AS p0, n.y - s.y AS p1, n.z - s.z AS p2, n.radius, n.type_id FROM place p JOIN nodes n USING (neuron_id, idx) JOIN nodes s ON s.neuron_id = p.neuron_id AND s.idx = 1),
 step AS (SELECT *, {each("lead(p#) OVER w - p# AS d#")}, count(*) OVER (PARTITION BY neuron_id, first) AS rings FROM spot WINDOW w AS (PARTITION BY neuron_id, first ORDER BY ring)),
 way AS (SELECT *, {each(f"CASE WHEN sqrt({dot('d', 'd')}) > 1e-13 THEN d# / sqrt({dot('d', 'd')}) ELSE d# END AS w#")} FROM step),
 mean AS (SELECT *, {each("coalesce(w#, 0) + coalesce(lag(w#) OVER w, 0) AS m#")} FROM way WINDOW w AS (PARTITION BY neuron_id, first ORDER BY ring)),
 normal AS (SELECT *, {each(f"CASE WHEN sqrt({dot('m', 'm')}) > 1e-13 THEN m# / sqrt({dot('m', 'm')}) ELSE m# END AS n#")} FROM mean),
 turned AS (SELECT *, CASE WHEN sqrt({dot('n', 'n')}) > 1e-13 THEN atan2(n1, n0) ELSE 0 END AS t, CASE WHEN sqrt({dot('n', 'n')}) > 1e-13 THEN acos(greatest(-1, least(1, n2))) ELSE 0 END AS f FROM normal),
 ends AS (SELECT neuron_id, first, any_value(rings) AS rings, CASE WHEN sqrt({" + ".join(f"power(max(p{k}) FILTER (ring = 0) - max(p{k}) FILTER (ring = rings - 1), 2)" for k in AXES)}) >= 1e-8 THEN 1 ELSE 0 END AS open,
  CASE arg_min(type_id, ring) WHEN 1 THEN max(type_id) FILTER (ring = 1) ELSE arg_min(type_id, ring) END AS kind FROM step GROUP BY 1, 2),
 part AS (SELECT *, CASE kind WHEN 2 THEN 'AXON' WHEN 3 THEN 'BASAL_DENDRITE' WHEN 4 THEN 'APICAL_DENDRITE' ELSE 'OTHER' END AS class, sum(rings * {M} + 2 * open) OVER (PARTITION BY neuron_id ORDER BY first) - rings * {M} - 2 * open AS low FROM ends)"""
MESH = f"WITH RECURSIVE {NODES}, {EDGES}, {KIDS}, {RINGS}"
_ANGLE = f"k * 2 * pi() / {M}"


@query(
    "G13_rings",
    f"""{MESH}, spots AS (SELECT neuron_id, first, ring, CAST(k AS BIGINT) AS k, low + ring * {M} + k AS vertex, class, p0 + radius * (cos({_ANGLE}) * sin(t) + sin({_ANGLE}) * cos(f) * cos(t)) AS x,
  p1 + radius * (-cos({_ANGLE}) * cos(t) + sin({_ANGLE}) * cos(f) * sin(t)) AS y, p2 - radius * sin({_ANGLE}) * sin(f) AS z FROM turned JOIN part USING (neuron_id, first), (SELECT unnest(range({M})) AS k)
  UNION ALL SELECT neuron_id, first, ring, -1, low + part.rings * {M} + CASE WHEN ring = 0 THEN 0 ELSE 1 END, class, p0, p1, p2 FROM spot JOIN part USING (neuron_id, first) WHERE open = 1 AND ring IN (0, part.rings - 1))
 SELECT neuron_id, CAST(vertex AS BIGINT) AS vertex, CAST(first AS BIGINT) AS branch, class, CAST(ring AS BIGINT) AS "at", k, {", ".join(r(c, places=4) for c in "xyz")} FROM spots""",
)
def _(spark, d):
    return fx.rounded_plainly(mesh.mesh_vertices(fx.nodes(spark, d), M, True, sphere=False), "x", "y", "z", places=4)


_FACES = f"""gap AS (SELECT neuron_id, class, CAST(low + ring * {M} AS BIGINT) AS l, k, (k + 1) % {M} AS j FROM part, (SELECT unnest(range({M})) AS k), (SELECT unnest(range(1000000)) AS ring) WHERE ring < rings - 1),
 cap AS (SELECT neuron_id, class, CAST(low AS BIGINT) AS l, CAST(low + (rings - 1) * {M} AS BIGINT) AS h, CAST(low + rings * {M} AS BIGINT) AS c, k, (k + 1) % {M} AS j FROM part, (SELECT unnest(range({M})) AS k) WHERE open = 1),
 face AS (SELECT neuron_id, class, l + k AS a, l + j AS b, l + k + {M} AS c FROM gap UNION ALL SELECT neuron_id, class, l + j + {M}, l + k + {M}, l + j FROM gap
  UNION ALL SELECT neuron_id, class, c, l + j, l + k FROM cap UNION ALL SELECT neuron_id, class, h + k, h + j, c + 1 FROM cap)""".replace("range(1000000)", "range((SELECT max(rings) FROM part))")


@query("G13_mesh_faces", f"{MESH}, {_FACES} SELECT * FROM face")
def _(spark, d):
    return mesh.mesh_faces(fx.nodes(spark, d), M, True, sphere=False)


@query(
    "K8_mesh_texts",
    f"{MESH}, {_FACES}, v AS (SELECT neuron_id, sum(rings * {M} + 2 * open) AS v FROM part GROUP BY 1), f AS (SELECT neuron_id, count(*) AS f FROM face GROUP BY 1) SELECT n.neuron_id, CAST(coalesce(v, 0) + 162 AS INT) AS vertices, CAST(coalesce(f, 0) + 320 AS INT) AS faces, CAST(coalesce(v, 0) + 162 AS BIGINT) AS last FROM (SELECT DISTINCT neuron_id FROM nodes WHERE idx = 1 AND radius > 0) n LEFT JOIN v USING (neuron_id) LEFT JOIN f USING (neuron_id)",
)
def _(spark, d):
    return mesh.read_obj(mesh.mesh_texts(fx.nodes(spark, d), "obj", M, True))


# Cameras: one a neuron, looking at its box from the way its root lies.
BOX = "box AS (SELECT neuron_id, (min(x) + max(x)) / 2 AS c0, (min(y) + max(y)) / 2 AS c1, (min(z) + max(z)) / 2 AS c2, (max(x) - min(x)) / 2 AS h0, (max(y) - min(y)) / 2 AS h1, (max(z) - min(z)) / 2 AS h2 FROM nodes GROUP BY 1)"
FIT = f"fit AS (SELECT *, 2 * sqrt({dot('h', 'h')}) AS diag, 3 * greatest(1e-6, sqrt({dot('h', 'h')})) + 1 AS far, 0.85 * greatest(1e-6, sqrt({dot('h', 'h')})) AS scale FROM box)"


def looking(source: str) -> str:
    """Cameras at the distance ``far`` from c along the unit direction d."""
    return f"SELECT *, {each('c# - d# * far AS e#')}, 0.0 AS u0, CASE WHEN abs(d1) > 0.95 THEN 0.0 ELSE 1.0 END AS u1, CASE WHEN abs(d1) > 0.95 THEN 1.0 ELSE 0.0 END AS u2 FROM {source}"


def framed(source: str) -> str:
    """Cameras with the axes s, v (up) and f."""
    return f"""fwd AS (SELECT *, {each(f"(c# - e#) / (sqrt({' + '.join(f'(c{k} - e{k}) * (c{k} - e{k})' for k in AXES)}) + 1e-12) AS f#")} FROM {source}), side AS (SELECT *, {cross("f", "u", "q")} FROM fwd),
 right_ AS (SELECT *, {each(f"q# / (sqrt({dot('q', 'q')}) + 1e-12) AS s#")} FROM side), framed AS (SELECT *, {cross("s", "f", "v")}, greatest(1.02, sqrt({" + ".join(f"(c{k} - e{k}) * (c{k} - e{k})" for k in AXES)}) + 3 * diag) AS back FROM right_)"""


def direction(nodes):
    return F.array(F.col("x") - 25.3, F.col("y") - 5.1, F.col("z") - 4.2)


_WAY = "x - 25.3 AS g0, y - 5.1 AS g1, z - 4.2 AS g2"
_UNIT = each(f"g# / (sqrt({dot('g', 'g')}) + 1e-12) AS d#")
_BALL = "(2 * {x} - 400) / 400 AS {n}0, (300 - 2 * {y}) / 300 AS {n}1"
_DRAG = {"a": ("(100.0 + neuron_id % 50)", "80.0"), "b": ("150.0", "(100.0 + neuron_id % 30)")}
_TURN = lambda v, n: ", ".join(f"{v}{k} * cos(angle) + ({f'k{(k + 1) % 3} * {v}{(k + 2) % 3} - k{(k + 2) % 3} * {v}{(k + 1) % 3}'}) * sin(angle) + k{k} * {dot('k', v)} * (1 - cos(angle)) AS {n}{k}" for k in AXES)


@query(
    "G9_cameras",
    f"""WITH {NODES}, {BOX}, {FIT}, aim AS (SELECT fit.*, {_WAY} FROM fit JOIN nodes USING (neuron_id) WHERE idx = 1), unit_ AS (SELECT *, {_UNIT} FROM aim), placed AS ({looking("unit_")}),
 ball AS (SELECT *, {", ".join(_BALL.format(x=x, y=y, n=n) for n, (x, y) in _DRAG.items())} FROM placed), on_ AS (SELECT *, sqrt(1 - a0 * a0 - a1 * a1) AS a2, sqrt(1 - b0 * b0 - b1 * b1) AS b2 FROM ball),
 axis AS (SELECT *, {cross("a", "b", "x")}, acos({dot("a", "b")}) AS angle FROM on_), spin AS (SELECT *, {each(f"x# / sqrt({dot('x', 'x')}) AS k#")}, {each("e# - c# AS r#")} FROM axis),
 spun AS (SELECT *, {_TURN("r", "t")}, {_TURN("u", "o")} FROM spin),
 moved AS (SELECT neuron_id, diag, scale, {each("c#")}, {each("h#")}, {each("c# + t# AS e#")}, {each(f"o# / (sqrt({dot('o', 'o')}) + 1e-12) AS u#")} FROM spun), {framed("moved")},
 corner AS (SELECT *, CAST(n AS INT) AS corner, {", ".join(f"c{k} + CASE WHEN (n // {4 >> k}) % 2 = 1 THEN h{k} ELSE -h{k} END - e{k} AS p{k}" for k in AXES)} FROM framed, (SELECT unnest(range(8)) AS n)),
 seen AS (SELECT *, {dot("s", "p")} AS a, {dot("v", "p")} AS b, -{dot("f", "p")} AS z, 1 / tan(radians(45.0) / 2) AS t, neuron_id % 2 = 1 AS persp FROM corner)
 SELECT neuron_id, corner, {r("CASE WHEN persp THEN t / 1.5 * a ELSE a / (scale * 1.5) END", "cx", 4)}, {r("CASE WHEN persp THEN t * b ELSE b / scale END", "cy", 4)},
 {r("CASE WHEN persp THEN (back + 0.02) / (0.02 - back) * z + 2 * back * 0.02 / (0.02 - back) ELSE -2 / (back - 0.02) * z - (back + 0.02) / (back - 0.02) END", "cz", 4)}, {r("CASE WHEN persp THEN -z ELSE 1 END", "cw", 4)} FROM seen""",
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    rows = cameras.fitted(nodes).withColumn("perspective", F.col("neuron_id") % 2 == 1).join(nodes.where("idx = 1").select("neuron_id", direction(nodes).alias("d")), "neuron_id")
    drag = {"x0": 100.0 + F.col("neuron_id") % 50, "y0": F.lit(80.0), "x1": F.lit(150.0), "y1": 100.0 + F.col("neuron_id") % 30, "w": F.lit(400), "h": F.lit(300)}
    rows = cameras.orbited(cameras.placed(rows, "d").withColumns(drag), *drag)
    seen = cameras.clipped(cameras.matrices(rows.join(cameras.box_points(nodes, corners_only=True), "neuron_id"), 1.5))
    clip = seen.select("neuron_id", F.posexplode_outer("clip").alias("corner", "p"))  # not plain: its filter on "clip" would be pushed down and written out through all steps
    return rounded(clip.select("neuron_id", "corner", *[F.col("p")[k].alias(c) for k, c in enumerate(("cx", "cy", "cz", "cw"))]), "cx", "cy", "cz", "cw", places=4)


_BOX16 = ", ".join(map(str, cameras.BOX_POINTS))


@query(
    "G11_tries",
    f"""WITH {NODES}, {BOX}, {FIT}, aim AS (SELECT fit.*, CAST(idx - 1 AS INT) AS i, CAST(w AS INT) AS widened, {_WAY} FROM fit JOIN nodes USING (neuron_id), (VALUES (0), (1)) k(w) WHERE idx <= 4), unit_ AS (SELECT * REPLACE (scale * power(1.05, i + widened) AS scale), {_UNIT} FROM aim),
 placed AS ({looking("unit_")}), {framed("placed")}, point AS (SELECT *, {", ".join(f"c{k} + q{k}_ * h{k} - e{k} AS p{k}" for k in AXES)} FROM framed, (VALUES {_BOX16}) k(q0_, q1_, q2_)),
 share AS (SELECT neuron_id, i, widened, any_value(scale) AS scale, avg(CASE WHEN abs({dot("s", "p")}) <= scale AND abs({dot("v", "p")}) <= scale AND abs(2 / (back - 0.02) * {dot("f", "p")} - (back + 0.02) / (back - 0.02)) <= 1 THEN 1.0 ELSE 0 END) AS share FROM point GROUP BY 1, 2, 3),
 rank_ AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY share < 0.9, CASE WHEN share < 0.9 THEN -i ELSE i END, CASE WHEN share < 0.9 THEN -widened ELSE widened END) AS rn FROM share)
 SELECT neuron_id, i, widened, {r("share", "fraction")}, {r("scale", "ortho_scale", 4)}, share >= 0.9 AS enough FROM rank_ WHERE rn = 1""",
)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    ways = nodes.select("neuron_id", (F.col("idx") - 1).alias("i"), direction(nodes).alias("direction"))
    got = cameras.first_in_frame(cameras.fitted(nodes), ways, cameras.box_points(nodes), 0.9, 4, 1.05)
    return rounded(rounded(got.select("neuron_id", "i", "widened", "fraction", "ortho_scale", "enough"), "fraction"), "ortho_scale", places=4)


# Kept results and streams.


@query("K11_cache", f"WITH {NODES} SELECT neuron_id, CASE WHEN neuron_id % 2 = 0 AND neuron_id % 3 > 0 THEN 1 ELSE 2 END AS run, {r('sum(x) + CASE WHEN neuron_id % 3 = 0 THEN count(*) ELSE 0 END', 'total')} FROM nodes GROUP BY 1")
def _(spark, d):
    nodes, cache = fx.nodes(spark, d).select("neuron_id", "idx", "x"), Cache(spark, new_folder(spark, "cache"))
    # First the even neurons; then all of them, every third one changed.
    for run in (1, 2):
        now = nodes.where("neuron_id % 2 = 0") if run == 1 else nodes.withColumn("x", F.when(F.col("neuron_id") % 3 == 0, F.col("x") + 1).otherwise(F.col("x")))
        keys = group_keys(now, "neuron_id", ["neuron_id", "idx", "x"])
        found = cache.through(now.join(keys, "neuron_id"), lambda rows, run=run: rows.groupBy("key").agg(F.sum("x").alias("total")).withColumn("run", F.lit(run)))
    return rounded(keys.join(found, "key").select("neuron_id", "run", "total"), "total")


@query("stream_manifest", f"SELECT neuron_id, arg_max(status, event_id) AS status, max(event_id) AS event_id FROM ({fx.LOG}) GROUP BY 1")
def _(spark, d):
    folder = new_folder(spark, "stream")
    fx.log(spark, d).repartitionByRange(6, "event_id").write.json(f"{folder}/log")
    manifest = Manifest(spark, f"{folder}/table", "neuron_id long, status string, event_id long", "neuron_id", "event_id")
    manifest.follow(f"{folder}/log", f"{folder}/at", files_a_batch=2)
    manifest.compact()
    return manifest.entries()
