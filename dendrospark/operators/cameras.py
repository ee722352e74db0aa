"""Cameras as rows: placing, orbiting, panning, zooming, their matrices, and what of a box they see.

A camera has ``eye``, ``target``, ``up`` (three numbers each), ``perspective``
(boolean), ``fovy`` (degrees), ``ortho_scale`` (half of the height it takes in) and
``diag`` (of what it looks at, for the far plane). Matrices are arrays of sixteen
numbers, row by row. Every operation works on a whole table of cameras.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import flat
from .views import BOX_POINTS, boxes, cross

TINY = 1e-12
NEAR = 0.02
SIDE = 0.95  # a direction whose Y is larger gets Z as its way up

Vector = list[Column]


def item(column: str | Column, k: int) -> Column:
    """Number ``k`` of an array. Not ``get``: the optimizer sees through that and writes a vector's expression out at each of its uses, which grows with every step."""
    return F.try_element_at(F.col(column) if isinstance(column, str) else column, F.lit(k + 1))


def parts(column: str | Column) -> Vector:
    return [item(column, k) for k in range(3)]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b, strict=True)))


def size(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def added(a: Vector, b: Vector, times: Column | float = 1.0) -> Vector:
    return [x + y * times for x, y in zip(a, b, strict=True)]


def scaled(v: Vector, by: Column) -> Vector:
    return [x / by for x in v]


def array(v: Vector) -> Column:
    return F.array(*[x.cast("double") for x in v])


def fitted(nodes: DataFrame, margin: float = 0.85, fovy: float = 45.0, perspective: bool = False) -> DataFrame:
    """(neuron_id, eye, target, up, perspective, fovy, ortho_scale, diag): a camera along Z that takes in each neuron's box."""
    rows = boxes(nodes).withColumn("diag", 2 * F.sqrt(sum(F.col(f"h{k}") ** 2 for k in range(3))))
    radius = F.greatest(F.lit(1e-6), F.col("diag") / 2)
    away = margin * radius / math.tan(math.radians(fovy) / 2) if perspective else 3 * radius + 1
    rows = rows.select("neuron_id", F.array("c0", "c1", "c2").alias("target"), "diag", away.alias("away"), (margin * radius).alias("ortho_scale"))
    eye = array(added(parts("target"), [F.lit(0.0), F.lit(0.0), F.lit(1.0)], F.col("away")))
    return rows.select("neuron_id", eye.alias("eye"), "target", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("up"), F.lit(perspective).alias("perspective"), F.lit(float(fovy)).alias("fovy"), "ortho_scale", "diag")


def placed(cameras: DataFrame, direction: str, distance: str | None = None) -> DataFrame:
    """Cameras moved so that they look along ``direction`` at their target, from as far as before or from ``distance``; Y is up, or Z along Y."""
    d = parts(direction)
    rows = cameras.withColumn("__d", array(scaled(d, size(d) + TINY)))
    far = F.col(distance) if distance else size(added(parts("eye"), parts("target"), -1.0))
    steep = F.abs(parts("__d")[1]) > SIDE
    up = array([F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)])
    return rows.withColumns({"eye": array(added(parts("target"), parts("__d"), -far)), "up": up}).drop("__d")


def turn(v: Vector, axis: Vector, angle: Column) -> Vector:
    """``v`` turned about a unit axis: the product with the axis-angle matrix."""
    c, s, along = F.cos(angle), F.sin(angle), dot(axis, v)
    return [x * c + k * s + a * along * (1 - c) for x, k, a in zip(v, cross(axis, v), axis, strict=True)]


def on_ball(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The point of the unit ball under a place of the window; outside the ball, that at its rim."""
    nx, ny = (2 * x - width) / F.greatest(F.lit(1.0), width), (height - 2 * y) / F.greatest(F.lit(1.0), height)
    d = nx * nx + ny * ny
    on = F.when(d <= 1, array([nx, ny, F.sqrt(F.greatest(F.lit(0.0), 1 - d))])).otherwise(array([nx / F.sqrt(d), ny / F.sqrt(d), F.lit(0.0)]))
    return F.when((width <= 0) | (height <= 0), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(on)


def orbited(cameras: DataFrame, x0: str, y0: str, x1: str, y1: str, width: str, height: str) -> DataFrame:
    """Cameras turned about their targets by a drag from (x0, y0) to (x1, y1) in a window, all of them columns. A drag that turns by nothing leaves a camera as it is."""
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    rows = cameras.withColumns({"__a": on_ball(F.col(x0), F.col(y0), w, h), "__b": on_ball(F.col(x1), F.col(y1), w, h)})
    rows = rows.withColumns({"__axis": array(cross(parts("__a"), parts("__b"))), "__angle": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(parts("__a"), parts("__b")))))})
    still = (size(parts("__axis")) < 1e-6) | (F.col("__angle") == 0)
    rows = rows.withColumns({"__still": still, "__axis": array(scaled(parts("__axis"), F.greatest(F.lit(TINY), size(parts("__axis")))))})
    away = added(parts("eye"), parts("target"), -1.0)
    rows = rows.withColumns({"__eye": array(added(parts("target"), turn(away, parts("__axis"), F.col("__angle")))), "__up": array(turn(parts("up"), parts("__axis"), F.col("__angle")))})
    new = {"eye": F.when(F.col("__still"), F.col("eye")).otherwise(F.col("__eye")), "up": F.when(F.col("__still"), F.col("up")).otherwise(array(scaled(parts("__up"), size(parts("__up")) + TINY)))}
    return rows.withColumns(new).drop("__a", "__b", "__axis", "__angle", "__still", "__eye", "__up")


def look_at(eye: Vector, target: Vector, up: Vector) -> Column:
    """The axes of a camera: right, up and forward, nine numbers."""
    f = added(target, eye, -1.0)
    f = scaled(f, size(f) + TINY)
    s = cross(f, up)
    s = scaled(s, size(s) + TINY)
    return array([*s, *cross(s, f), *f])


def with_axes(cameras: DataFrame) -> DataFrame:
    return cameras.withColumn("__axes", look_at(parts("eye"), parts("target"), parts("up")))


def axes() -> tuple[Vector, Vector, Vector]:
    a = [item("__axes", k) for k in range(9)]
    return a[:3], a[3:6], a[6:]


def panned(cameras: DataFrame, dx: str, dy: str, aspect: float = 1.0) -> DataFrame:
    """Cameras and targets shifted by parts of the window. The shift is along the first two columns of the view matrix, not its rows: kept for equal results."""
    s, u, f = axes()
    right, up = [s[0], u[0], -f[0]], [s[1], u[1], -f[1]]
    far = size(added(parts("eye"), parts("target"), -1.0))
    scale = F.when(F.col("perspective"), 2 * far * F.tan(F.radians("fovy") / 2)).otherwise(2 * F.col("ortho_scale"))
    shift = added([x * (-F.col(dx) * scale * aspect) for x in right], up, F.col(dy) * scale)
    rows = with_axes(cameras).withColumn("__shift", array(shift))
    return rows.withColumns({c: array(added(parts(c), parts("__shift"))) for c in ("eye", "target")}).drop("__axes", "__shift")


def dollied(cameras: DataFrame, factor: str) -> DataFrame:
    """Cameras moved nearer by a factor (0.05 to 500 away), or without perspective their scale times it (0.02 to 20 times ``diag``)."""
    way = added(parts("target"), parts("eye"), -1.0)
    far = size(way)
    to = F.greatest(F.lit(0.05), F.least(F.lit(500.0), far / F.col(factor)))
    eye = array(added(parts("target"), scaled(way, far + 1e-9), -to))
    scale = F.greatest(F.col("diag") * 0.02, F.least(F.col("diag") * 20.0, F.col("ortho_scale") * F.col(factor)))
    return cameras.withColumns({"eye": F.when(F.col("perspective"), eye).otherwise(F.col("eye")), "ortho_scale": F.when(F.col("perspective"), F.col("ortho_scale")).otherwise(scale)})


def product(a: str, b: str) -> Column:
    """The product of two columns of 4 x 4 matrices."""
    at = lambda m, i, j: item(m, 4 * i + j)
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(1, 4)), at(a, i, 0) * at(b, 0, j)) for i in range(4) for j in range(4)])


def matrices(cameras: DataFrame, aspect: float = 1.0) -> DataFrame:
    """Cameras with ``view``, ``projection`` and their product ``view_projection``. The far plane lies three times ``diag`` behind the target."""
    s, u, f = axes()
    eye, zero, one = parts("eye"), F.lit(0.0), F.lit(1.0)
    view = [*s, -dot(s, eye), *u, -dot(u, eye), *[-x for x in f], dot(f, eye), zero, zero, zero, one]
    far = F.greatest(F.lit(NEAR + 1), size(added(eye, parts("target"), -1.0)) + 3 * F.col("diag"))
    t, h, z = 1 / F.tan(F.radians("fovy") / 2), F.col("ortho_scale"), F.col("__far")
    seen = [t / max(1e-6, aspect), zero, zero, zero, zero, t, zero, zero, zero, zero, (z + NEAR) / (NEAR - z), 2 * z * NEAR / (NEAR - z), zero, zero, F.lit(-1.0), zero]
    flat = [1 / (h * aspect), zero, zero, zero, zero, 1 / h, zero, zero, zero, zero, -2 / (z - NEAR), -(z + NEAR) / (z - NEAR), zero, zero, zero, one]
    rows = with_axes(cameras).withColumns({"view": F.array(*view), "__far": far}).withColumn("projection", F.when(F.col("perspective"), F.array(*seen)).otherwise(F.array(*flat)))
    return rows.withColumn("view_projection", product("projection", "view")).drop("__axes", "__far")


def clipped(cameras: DataFrame, points: str = "points", matrix: str = "view_projection") -> DataFrame:
    """Cameras with ``clip``: of each of their points (an array of arrays of three) the four clip coordinates."""
    at = lambda i, j: item(matrix, 4 * i + j)
    rows = lambda p: F.array(*[at(i, 0) * F.get(p, F.lit(0)) + at(i, 1) * F.get(p, F.lit(1)) + at(i, 2) * F.get(p, F.lit(2)) + at(i, 3) for i in range(4)])
    return cameras.withColumn("clip", F.transform(points, rows))


def box_points(nodes: DataFrame, corners_only: bool = False) -> DataFrame:
    """(neuron_id, points): the corners of each neuron's box, by default also the middles of its faces and, twice, its centre."""
    place = [F.array(*[F.col(f"c{k}") + s * F.col(f"h{k}") for k, s in enumerate(p)]) for p in BOX_POINTS[: 8 if corners_only else None]]
    return boxes(nodes).select("neuron_id", F.array(*place).alias("points"))


def share_inside(clip: str = "clip") -> Column:
    """The share of clip coordinates that lie in the view."""
    inside = lambda p: F.greatest(*[F.abs(F.get(p, F.lit(k)) / F.greatest(F.lit(1e-6), F.get(p, F.lit(3)))) for k in range(3)]) <= 1
    return F.size(F.filter(clip, inside)) / F.size(clip)


def first_in_frame(cameras: DataFrame, directions: DataFrame, points: DataFrame, least: float, retries: int, zoom: float | None = None, key: str = "neuron_id", aspect: float = 1.0) -> DataFrame:
    """Per camera (``key``) the direction tried first, in the order of ``i`` from 0 on, from which at least the share ``least`` of its points is in view; with ``zoom`` a camera without perspective may take in more.

    Rule of the tries: look along direction i; if too little is seen, widen the
    scale by ``zoom`` and look again; the wider scale stays for the tries after. The
    last of ``retries`` tries is taken however little it shows. All tries of many cameras are computed at once: the
    scale of try i is known beforehand, ``zoom`` to the power of i, or of i + 1 when widened. A camera's
    points and directions are moved once, not with each of its tries.
    Returns the camera's columns as chosen, with ``i``, ``widened`` and ``fraction``.
    ``directions`` (key, i, direction); cameras without any have no row.
    """
    rest = [c for c in cameras.columns if c != key]
    ways = directions.where(F.col("i") < retries).groupBy(key).agg(F.collect_list(F.struct(F.col("i"), F.col("direction"))).alias("__ways"))
    rows = cameras.join(ways, key).join(points.select(key, F.col("points").alias("__points")), key).select(key, *rest, "__ways", "__points")
    kind = lambda c: {"eye": "array<double>", "up": "array<double>", "ortho_scale": "double"}.get(c, cameras.schema[c].dataType.simpleString())
    schema = ", ".join(f"`{c}` {kind(c)}" for c in [key, *rest]) + f", i {directions.schema['i'].dataType.simpleString()}, widened int, fraction double, enough boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CAMERAS):
                yield from chosen(pa.Table.from_batches([batch.slice(at, CAMERAS)]), least, zoom, aspect)

    return rows.mapInArrow(run, schema)


CAMERAS = 1024  # cameras whose tries are computed together


def triples(column: pa.ChunkedArray) -> Vector:
    """The first three numbers of each array, as columns; nan where one is missing."""
    length, start, values = flat(column)
    out, known = np.full((3, len(length)), np.nan), np.flatnonzero(length >= 3)
    out[:, known] = values[start[known] + np.arange(3)[:, None]]
    return list(out)


def chosen(t: pa.Table, least: float, zoom: float | None, aspect: float) -> Iterator[pa.RecordBatch]:
    """The cameras with the try that is chosen of each, by the rule of ``first_in_frame``; steps as in ``placed``, ``matrices``, ``clipped`` and ``share_inside``."""
    number = lambda c: pc.cast(t.column(c), pa.float64()).to_numpy()
    length = lambda v: np.sqrt(dot(v, v))
    many = pc.list_value_length(t.column("__ways")).to_numpy()
    of, (i, direction) = np.repeat(np.arange(len(t)), many), t.column("__ways").combine_chunks().flatten().flatten()
    if not len(of):
        return
    deep = pc.fill_null(t.column("perspective"), False).to_numpy(zero_copy_only=False).astype(bool)
    # Each camera's tries in order: its directions, each once more with a wider scale where that may be.
    wide = (pc.fill_null(pc.invert(t.column("perspective")), False).to_numpy(zero_copy_only=False).astype(bool) if zoom else np.zeros(len(t), bool))[of]
    take, widened = np.r_[np.arange(len(of)), np.flatnonzero(wide)], np.r_[np.zeros(len(of), int), np.ones(wide.sum(), int)]
    turn_ = i.to_numpy()
    order = np.lexsort((widened, turn_[take], of[take]))
    take, widened = take[order], widened[order]
    own = of[take]
    target, way = ([v[n] for v in triples(c)] for c, n in ((t.column("target"), own), (pa.chunked_array([direction]), take)))
    away = added([v[own] for v in triples(t.column("eye"))], target, -1.0)
    way = scaled(way, length(way) + TINY)
    eye = added(target, way, -length(away))
    steep = np.abs(way[1]) > SIDE
    up = [np.zeros(len(own)), np.where(steep, 0.0, 1.0), np.where(steep, 1.0, 0.0)]
    f = added(target, eye, -1.0)
    f = scaled(f, length(f) + TINY)
    s = cross(f, up)
    s = scaled(s, length(s) + TINY)
    u = cross(s, f)
    h = number("ortho_scale")[own]
    h = np.where(wide[take], h * np.power(float(zoom or 1), turn_[take] + widened), h)
    z = np.fmax(NEAR + 1, length(added(eye, target, -1.0)) + 3 * number("diag")[own])
    tan, p = 1 / np.tan(np.radians(number("fovy")[own]) / 2), deep[own]
    with np.errstate(all="ignore"):
        near = [np.where(p, tan / max(1e-6, aspect), 1 / (h * aspect)), np.where(p, tan, 1 / h), np.where(p, (z + NEAR) / (NEAR - z), -2 / (z - NEAR))]
        shift = np.where(p, 2 * z * NEAR / (NEAR - z), -(z + NEAR) / (z - NEAR))
        view = [[*s, -dot(s, eye)], [*u, -dot(u, eye)], [*[-x for x in f], dot(f, eye)]]
        seen = [[m * x for x in row] for m, row in zip(near, view, strict=True)]
        seen[2][3] = seen[2][3] + shift
        last = [np.where(p, -x, one) for x, one in zip(view[2], (0.0, 0.0, 0.0, 1.0), strict=True)]
        # A try's points one after the other; all points of all tries at once.
        n = pc.fill_null(pc.list_value_length(t.column("__points")), 0).to_numpy()
        first = np.cumsum(n) - n
        each = np.repeat(np.arange(len(own)), n[own])
        at = np.arange(len(each)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + first[own][each]
        point = [v[at] for v in triples(pa.chunked_array([t.column("__points").combine_chunks().flatten()]))]
        clip = [row[0][each] * point[0] + row[1][each] * point[1] + row[2][each] * point[2] + row[3][each] for row in (*seen, last)]
        bottom = np.fmax(1e-6, clip[3])
        inside = np.logical_and.reduce([np.abs(c / bottom) <= 1 for c in clip[:3]])
        share = np.bincount(each, inside, len(own)) / n[own]
    good = share >= least
    ends = np.flatnonzero(np.r_[own[1:] != own[:-1], True])
    rank = np.where(good, np.arange(len(own)), len(own))
    best = np.minimum.reduceat(rank, np.r_[0, ends[:-1] + 1])
    enough = best < len(own)
    best = np.where(enough, best, ends)
    row, of_try = pa.array(own[best]), take[best]
    listed = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(best) + 1, 3, np.int32)), pa.array(np.stack([x[best] for x in v], 1).ravel()))
    new = {"eye": listed(eye), "up": listed(up), "ortho_scale": pa.array(h[best])}
    out = {c: new.get(c, t.column(c).take(row)) for c in t.column_names if c not in ("__ways", "__points")}
    out |= {"i": i.take(pa.array(of_try)), "widened": pa.array(widened[best].astype(np.int32)), "fraction": pa.array(share[best], mask=np.isnan(share[best])), "enough": pa.array(enough)}
    yield from pa.table(out).combine_chunks().to_batches()
