"""Cameras against plain numpy, one at a time."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from dendrospark.operators import cameras
from dendrospark.operators.views import BOX_POINTS

CAMERA = "neuron_id long, eye array<double>, target array<double>, up array<double>, perspective boolean, fovy double, ortho_scale double, diag double"


def look(eye, target, up):
    f = (target - eye) / (np.linalg.norm(target - eye) + 1e-12)
    s = np.cross(f, up)
    s /= np.linalg.norm(s) + 1e-12
    m = np.eye(4)
    m[:3, :3] = [s, np.cross(s, f), -f]
    m[:3, 3] = -m[:3, :3] @ eye
    return m


def project(c, aspect):
    near, far = 0.02, max(1.02, np.linalg.norm(c["eye"] - c["target"]) + 3 * c["diag"])
    if c["perspective"]:
        t = 1 / math.tan(math.radians(c["fovy"]) / 2)
        return np.array([[t / aspect, 0, 0, 0], [0, t, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]])
    h = c["ortho_scale"]
    return np.array([[1 / (h * aspect), 0, 0, 0], [0, 1 / h, 0, 0], [0, 0, -2 / (far - near), -(far + near) / (far - near)], [0, 0, 0, 1]])


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    return [{"neuron_id": i, "eye": rng.normal(size=3) * 4, "target": rng.normal(size=3), "up": np.array([0, 1.0, 0]), "perspective": bool(i % 2), "fovy": 30.0 + i, "ortho_scale": 1.0 + rng.random(), "diag": 2.0 + rng.random()} for i in range(n)]


def table(spark, rows, extra="", **columns):
    data = [(*[v.tolist() if isinstance(v, np.ndarray) else v for v in c.values()], *[col[i] for col in columns.values()]) for i, c in enumerate(rows)]
    return spark.createDataFrame(data, CAMERA + extra)


def same(got, want, names=("eye", "target", "up", "ortho_scale")):
    got = {r.neuron_id: r for r in got.collect()}
    assert set(got) == {c["neuron_id"] for c in want}
    for c in want:
        for n in names:
            assert np.allclose(got[c["neuron_id"]][n], c[n], atol=1e-9), n


def test_matrices_and_clip_coordinates(spark):
    rows = made(9)
    points = [[[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [-4.0, 1.0, 0.5]]] * 9
    got = {r.neuron_id: r for r in cameras.clipped(cameras.matrices(table(spark, rows, ", points array<array<double>>", points=points), 1.5)).collect()}
    for c in rows:
        r, v, p = got[c["neuron_id"]], look(c["eye"], c["target"], c["up"]), project(c, 1.5)
        for name, m in (("view", v), ("projection", p), ("view_projection", p @ v)):
            assert np.allclose(np.reshape(r[name], (4, 4)), m, atol=1e-9)
        assert np.allclose(r.clip, [p @ v @ np.r_[q, 1] for q in points[0]], atol=1e-9)


def test_placing_orbiting_panning_and_dollying(spark):
    rows = made(12, 1)
    rng = np.random.default_rng(2)
    ways = [*rng.normal(size=(10, 3)).tolist(), [0.0, 5.0, 0.1], [0.0, -1.0, 0.0]]
    want = []
    for c, d in zip(rows, ways, strict=True):
        d = np.array(d) / np.linalg.norm(d)
        want.append(c | {"eye": c["target"] - d * np.linalg.norm(c["eye"] - c["target"]), "up": np.array([0, 0, 1.0] if abs(d[1]) > 0.95 else [0, 1.0, 0])})
    same(cameras.placed(table(spark, rows, ", d array<double>", d=ways), "d"), want)
    same(cameras.placed(table(spark, rows, ", d array<double>, r double", d=ways, r=[7.0] * 12), "d", "r"), [w | {"eye": w["target"] - np.array(d) / np.linalg.norm(d) * 7} for w, d in zip(want, ways, strict=True)])

    drags = [(rng.uniform(-50, 450), rng.uniform(-50, 350), rng.uniform(-50, 450), rng.uniform(-50, 350), 400, 300) for _ in range(10)] + [(5.0, 5.0, 5.0, 5.0, 400, 300), (1.0, 2.0, 3.0, 4.0, 0, 300)]

    def ball(x, y, w, h):
        if w <= 0 or h <= 0:
            return np.array([0, 0, 1.0])
        v = np.array([(2 * x - w) / w, (h - 2 * y) / h, 0])
        d = v @ v
        return np.r_[v[:2], math.sqrt(1 - d)] if d <= 1 else v / math.sqrt(d)

    want = []
    for c, (x0, y0, x1, y1, w, h) in zip(rows, drags, strict=True):
        a, b = ball(x0, y0, w, h), ball(x1, y1, w, h)
        k, angle = np.cross(a, b), math.acos(max(-1, min(1, a @ b)))
        if np.linalg.norm(k) >= 1e-6 and angle:
            k /= np.linalg.norm(k)
            s = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
            m = np.eye(3) + math.sin(angle) * s + (1 - math.cos(angle)) * s @ s
            c = c | {"eye": c["target"] + m @ (c["eye"] - c["target"]), "up": m @ c["up"]}
        want.append(c)
    columns = dict(zip(("x0", "y0", "x1", "y1", "w", "h"), map(list, zip(*drags, strict=True)), strict=True))
    same(cameras.orbited(table(spark, rows, ", x0 double, y0 double, x1 double, y1 double, w int, h int", **columns), *columns), want)

    want = []
    for c in rows:
        v, far = look(c["eye"], c["target"], c["up"]), np.linalg.norm(c["eye"] - c["target"])
        scale = 2 * far * math.tan(math.radians(c["fovy"]) / 2) if c["perspective"] else 2 * c["ortho_scale"]
        shift = -v[:3, 0] * 0.25 * scale * 2 + v[:3, 1] * -0.5 * scale
        want.append(c | {"eye": c["eye"] + shift, "target": c["target"] + shift})
    same(cameras.panned(table(spark, rows, ", dx double, dy double", dx=[0.25] * 12, dy=[-0.5] * 12), "dx", "dy", 2.0), want)

    factors, want = [0.001, 0.5, 2.0, 3.0, 1e6, 1e6, 0.001, 1.0, 1.0, 1.0, 0.1, 0.1], []
    for c, k in zip(rows, factors, strict=True):
        way = c["target"] - c["eye"]
        far = np.linalg.norm(way)
        moved = {"eye": c["target"] - way / (far + 1e-9) * max(0.05, min(500, far / k))} if c["perspective"] else {"ortho_scale": max(c["diag"] * 0.02, min(c["diag"] * 20, c["ortho_scale"] * k))}
        want.append(c | moved)
    same(cameras.dollied(table(spark, rows, ", k double", k=factors), "k"), want)


def test_fitted_cameras(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 4.0, 4.0), (2, 1.0, 1.0, 1.0)], "neuron_id long, x double, y double, z double")
    flat, seen = ({r.neuron_id: r for r in cameras.fitted(nodes, perspective=p).collect()} for p in (False, True))
    assert flat[1].target == [1, 2, 2] and flat[1].diag == 6 and np.allclose(flat[1].eye, [1, 2, 12]) and math.isclose(flat[1].ortho_scale, 2.55)
    assert np.allclose(seen[1].eye, [1, 2, 2 + 2.55 / math.tan(math.radians(22.5))]) and math.isclose(flat[2].ortho_scale, 0.85e-6)


def stepwise(c, ways, points, least, retries, zoom):
    """The rule of the tries, try by try."""
    c = dict(c)

    def share():
        m = project(c, 1.0) @ look(c["eye"], c["target"], c["up"])
        clip = [m @ np.r_[p, 1] for p in points]
        return sum(max(abs(q[:3] / max(1e-6, q[3]))) <= 1 for q in clip) / len(clip)

    for i, d in enumerate(ways):
        d = np.array(d) / np.linalg.norm(d)
        c["eye"], c["up"] = c["target"] - d * np.linalg.norm(c["eye"] - c["target"]), np.array([0, 0, 1.0] if abs(d[1]) > 0.95 else [0, 1.0, 0])
        now, widened = share(), 0
        if now < least and zoom and not c["perspective"]:
            c["ortho_scale"] *= zoom
            now, widened = share(), 1
        if now >= least or i + 1 >= retries:
            return i, widened, now, c["ortho_scale"]
    return i, widened, now, c["ortho_scale"]


def test_tries_by_the_stepwise_rule(spark):
    rng = random.Random(5)
    rows = made(24, 3)
    ways = {c["neuron_id"]: [[rng.gauss(0, 1) for _ in range(3)] for _ in range(8)] for c in rows}
    points = {c["neuron_id"]: [(c["target"] + np.array([rng.uniform(0.4, 1.6), rng.uniform(0.4, 1.6), rng.uniform(0.4, 1.6)]) * p).tolist() for p in BOX_POINTS] for c in rows}
    directions = spark.createDataFrame([(k, i, d) for k, w in ways.items() for i, d in enumerate(w)], "neuron_id long, i int, direction array<double>")
    clouds = spark.createDataFrame(list(points.items()), "neuron_id long, points array<array<double>>")
    for least, retries, zoom in ((0.95, 8, 1.05), (0.95, 3, 1.2), (0.9, 20, None), (2.0, 4, 1.05), (0.0, 5, 1.05)):
        got = {r.neuron_id: r for r in cameras.first_in_frame(table(spark, rows), directions, clouds, least, retries, zoom).collect()}
        for c in rows:
            i, widened, share, scale = stepwise(c, ways[c["neuron_id"]], points[c["neuron_id"]], least, retries, zoom)
            r = got[c["neuron_id"]]
            assert (r.i, r.widened, r.enough) == (i, widened, share >= least) and math.isclose(r.fraction, share) and math.isclose(r.ortho_scale, scale)
    assert cameras.first_in_frame(table(spark, rows), directions.where("false"), clouds, 1.0, 3).count() == 0
    assert cameras.box_points(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 2.0, 2.0, 2.0)], "neuron_id long, x double, y double, z double")).select(F.size("points")).first()[0] == 16


def test_tries_are_computed_many_cameras_at_once(spark):
    rows = made(5, 8)
    clouds = {c["neuron_id"]: [(c["target"] + 0.1 * k * np.array(p)).tolist() for p in BOX_POINTS[: 3 + 2 * k]] for k, c in enumerate(rows)}
    ways = [(c["neuron_id"], i, [1.0 + i, 0.5, -i / 2]) for k, c in enumerate(rows) for i in range(k + 1)]
    points = spark.createDataFrame([(k, p if k != rows[0]["neuron_id"] else [*p, [1.0]]) for k, p in clouds.items()], "neuron_id long, points array<array<double>>")
    df = cameras.first_in_frame(table(spark, rows), spark.createDataFrame(ways, "neuron_id long, i int, direction array<double>"), points, 0.9, 3, 1.1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortAggregate" not in plan
    got = {r.neuron_id: r for r in df.collect()}
    assert len(got) == 5
    for c in rows[1:]:
        k = c["neuron_id"]
        i, widened, share, scale = stepwise(c, [w[2] for w in ways if w[0] == k][:3], clouds[k], 0.9, 3, 1.1)
        assert (got[k].i, got[k].widened) == (i, widened) and math.isclose(got[k].fraction, share) and math.isclose(got[k].ortho_scale, scale)
    assert got[rows[0]["neuron_id"]].fraction <= 3 / 4  # a point that lacks numbers is not in view
