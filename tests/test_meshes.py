"""Meshes: rings against a plain sweep of one branch at a time, frames without twist, closed surfaces, texts read back."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dendrospark.operators import mesh
from dendrospark.plans import catalog, fixtures
from dendrospark.sources import files

NODES = "neuron_id long, idx int, type_id int, x double, y double, z double, radius double, parent int"


def grown(seed, n, neuron):
    rng = random.Random(seed)
    rows = [(neuron, 1, 1, 1.0, 2.0, 3.0, 2.0, -1)]
    for i in range(2, n + 1):
        p = rows[max(0, i - 2 - (rng.randrange(6) if rng.random() < 0.3 else 0))]
        rows.append((neuron, i, rng.choice([2, 3, 4, 5]), p[3] + rng.uniform(-2, 2), p[4] + rng.uniform(-2, 2), p[5] + rng.uniform(0.1, 2), rng.uniform(0.2, 1), p[1]))
    return rows


def plain_branches(rows):
    """Paths of node rows from the soma on, by walking."""
    by = {r[1]: r for r in rows}
    kids = {}
    for r in rows:
        kids.setdefault(r[7], []).append(r[1])
    soma = next(r for r in rows if r[2] == 1)[1]
    out, todo = [], [soma]
    while todo:
        start = todo.pop()
        for c in kids.get(start, []):
            path = [start, c]
            while len(kids.get(path[-1], [])) == 1:
                path.append(kids[path[-1]][0])
            out.append([by[i] for i in path])
            if len(kids.get(path[-1], [])) > 1:
                todo.append(path[-1])
    return out


def plain_rings(path, m):
    p = np.array([r[3:6] for r in path])
    way = [(b - a) / np.linalg.norm(b - a) for a, b in zip(p, p[1:], strict=False)]
    normal = [way[0], *[(a + b) / np.linalg.norm(a + b) for a, b in zip(way, way[1:], strict=False)], way[-1]]
    out = []
    for q, n, r in zip(p, normal, path, strict=True):
        t, f = math.atan2(n[1], n[0]), math.acos(n[2])
        x, y = np.array([math.sin(t), -math.cos(t), 0]), np.array([math.cos(f) * math.cos(t), math.cos(f) * math.sin(t), -math.sin(f)])
        out.append([q + r[6] * (math.cos(2 * math.pi * k / m) * x + math.sin(2 * math.pi * k / m) * y) for k in range(m)])
    return out


@pytest.mark.parametrize("cap", [False, True])
def test_rings_and_faces_by_brute_force(spark, cap):
    trees = {k: grown(k, n, k) for k, n in enumerate((1, 2, 9, 60, 200))}
    rows = [r for t in trees.values() for r in t]
    random.Random(0).shuffle(rows)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    vertices, faces = mesh.mesh_vertices(nodes, 5, cap, centred=False).collect(), mesh.mesh_faces(nodes, 5, cap).collect()
    for k, tree in trees.items():
        mine = {(r.branch, r.at, r.k): r for r in vertices if r.neuron_id == k}
        branches = plain_branches(tree)
        for path in branches:
            for at, ring in enumerate(plain_rings(path, 5)):
                for j, p in enumerate(ring):
                    r = mine.pop((path[1][1], at, j))
                    assert np.allclose((r.x, r.y, r.z), p)
            if cap:
                ends = [mine.pop((path[1][1], at, -1)) for at in (0, len(path) - 1)]
                assert [(e.x, e.y, e.z) for e in ends] == [path[0][3:6], path[-1][3:6]]
        assert len(mine) == 162 and all(abs(math.dist((r.x, r.y, r.z), (1, 2, 3)) - 2) < 1e-9 for r in mine.values())
        numbers = sorted(r.vertex for r in vertices if r.neuron_id == k)
        assert numbers == list(range(len(numbers)))
        corners = [(r.a, r.b, r.c) for r in faces if r.neuron_id == k]
        assert {v for f in corners for v in f} == set(numbers)
        assert len(corners) == 320 + sum(10 * (len(p) - 1) + 10 * cap for p in branches)
        if cap:  # every edge has two faces, one each way
            edges = [e for a, b, c in corners for e in ((a, b), (b, c), (c, a))]
            assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)


def test_classes_scaling_and_odd_trees(spark):
    rows = [(1, 1, 1, 0.0, 0.0, 0.0, 0.0, -1), (1, 2, 2, 0.0, 0.0, 1.0, 1.0, 1), (1, 3, 3, 0.0, 0.0, 2.0, 1.0, 2), (1, 4, 4, 0.0, 1.0, 2.0, 1.0, 2), (1, 5, 9, 0.0, 0.0, 0.0, 1.0, 1), (1, 6, 3, 1.0, 0.0, 0.0, 1.0, 77)]
    rows += [(2, 1, 3, 0.0, 0.0, 0.0, 1.0, 2), (2, 2, 3, 1.0, 0.0, 0.0, 1.0, 1)]  # a cycle, no soma
    nodes = spark.createDataFrame(rows, NODES)
    v, f = mesh.neuron_mesh(nodes, 4, True, radius_scale=3.0)
    got = {(r.neuron_id, r.branch): r["class"] for r in v.collect()}
    assert got == {(1, 2): "AXON", (1, 3): "AXON", (1, 4): "AXON", (1, 5): "OTHER"}
    ring = [r for r in v.collect() if r.branch == 2 and r.k >= 0]
    assert {round(math.dist((r.x, r.y, r.z), (0, 0, r.at)), 6) for r in ring if r.at == 1} == {3.0}
    # The branch to node 5 has no length: its ends meet, so it has no caps, and its rings lie across Z.
    flat = [r for r in v.collect() if r.branch == 5]
    assert {r.k for r in flat} == {0, 1, 2, 3} and {round(r.z, 9) for r in flat} == {0.0}
    assert mesh.triangles(v, f).count() == f.count() and {len(r.corners) for r in mesh.triangles(v, f).collect()} == {9}
    assert mesh.mesh_vertices(nodes.where("false")).count() == 0
    with pytest.raises(ValueError, match="three points"):
        mesh.mesh_vertices(nodes, 2)
    with pytest.raises(ValueError, match="unknown frames"):
        mesh.mesh_vertices(nodes, frames="x")


def test_transported_frames_do_not_twist(spark):
    n = 300
    helix = [(7, 1, 1, 1.0, 0.0, 0.0, 0.5, -1)] + [(7, i, 2, math.cos(i / 9), math.sin(i / 9), (i % 40) / 30 - i / 50, 0.5, i - 1) for i in range(2, n + 1)]
    nodes = spark.createDataFrame(helix, NODES)

    def twists(frames):
        rings = {}
        for r in mesh.mesh_vertices(nodes, 8, frames=frames, centred=False).where("branch >= 0").collect():
            rings.setdefault(r.at, {})[r.k] = np.array([r.x, r.y, r.z])
        out = []
        for at in range(n - 1):
            mid = [sum(rings[k].values()) / 8 for k in (at, at + 1)]
            a, b = ((rings[at + i][0] - mid[i]) / 0.5 for i in (0, 1))
            normal = [np.cross(rings[at + i][0] - mid[i], rings[at + i][2] - mid[i]) * 4 for i in (0, 1)]
            assert abs(np.linalg.norm(normal[0]) - 1) < 1e-6
            axis, cos = np.cross(*normal), float(np.dot(*normal))
            turned = a + np.cross(axis, a) + np.cross(axis, np.cross(axis, a)) / (1 + cos)
            out.append(math.degrees(math.acos(min(1, float(np.dot(turned, b))))))
        return out

    assert max(twists("transported")) < 1e-3 and max(twists("spherical")) > 5


def test_transported_frames_turn_back_and_stand_still():
    normal = np.array([[0, 0, 1.0], [0, 0, -1.0], [0, 0, 0], [1.0, 0, 0], [0, 1.0, 0]])
    x, y = mesh.transported_axes(normal, np.array([0, 1, 2, 3, 0]))
    want = np.array([[0, 0, 1.0], [0, 0, -1.0], [0, 0, -1.0], [1.0, 0, 0], [0, 1.0, 0]])
    assert np.allclose(np.cross(x, y), want) or np.allclose(np.cross(x, y), -want)
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose((x * y).sum(axis=1), 0)


@pytest.mark.parametrize("kind", ["ply", "obj"])
def test_texts_read_back(spark, tmp_path, kind):
    nodes = spark.createDataFrame([r for k in range(3) for r in grown(k, 30, k)], NODES)
    sizes = {r.name: r.bytes for r in files.write_files(mesh.mesh_texts(nodes, kind, 6, True), str(tmp_path)).collect()}
    vertices, faces = mesh.mesh_vertices(nodes, 6, True).collect(), mesh.mesh_faces(nodes, 6, True).collect()
    for k in range(3):
        lines = (tmp_path / f"{k}.{kind}").read_text().splitlines()
        assert sizes[f"{k}.{kind}"] == (tmp_path / f"{k}.{kind}").stat().st_size
        if kind == "ply":
            n, m = (int(x.split()[2]) for x in lines if x.startswith("element"))
            body = lines[lines.index("end_header") + 1 :]
            points, corners = [x.split() for x in body[:n]], [tuple(map(int, x.split()[1:])) for x in body[n:]]
            assert len(body) == n + m
        else:
            points, corners = [x.split()[1:] for x in lines if x[0] == "v"], [tuple(int(i) - 1 for i in x.split()[1:]) for x in lines if x[0] == "f"]
        want = sorted((r.vertex, r.x, r.y, r.z) for r in vertices if r.neuron_id == k)
        assert np.allclose(np.array(points, float), [w[1:] for w in want], atol=1e-7)
        assert sorted(corners) == sorted((r.a, r.b, r.c) for r in faces if r.neuron_id == k)


def test_decimals_are_those_of_the_format():
    rng = np.random.default_rng(5)
    x = np.r_[0.0, -0.0, -1e-12, 1e-8, 0.5e-8, 1.5e-8, -2.5e-8, 0.999999995, 9999.999999995, 12345.125, 39_999_999.5, rng.normal(0, 50, 5000), rng.normal(0, 1e6, 5000), rng.integers(0, 10**9, 5000) / 1e8 + 0.5e-8]
    for values in (x, np.r_[x, 1e12, np.inf, np.nan, -1e300]):
        assert mesh.text_of(mesh.text_rows(b"v", [mesh.decimals(values)])).decode().split("\n")[:-1] == [f"v {v:.8f}" for v in values.tolist()]
    n = np.array([0, 7, 9999, 10_000, 12_030, 100_000_000, 10**15 + 5])
    for some in (n[:2], n[:4], n):
        assert mesh.text_of(mesh.text_rows(b"f", [mesh.digits(some)])).decode().split() == [t for i in some.tolist() for t in ("f", str(i))]


def test_texts_come_many_a_batch(spark):
    nodes = spark.createDataFrame([r for k in range(300) for r in grown(k, 4, k)], NODES)
    rows = mesh.mesh_texts(nodes, "obj", 3, True)
    batches = rows.select("content").coalesce(1).mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()
    assert sum(b.n for b in batches) == 300
    assert mesh.mesh_vertices(nodes, 3, sphere=False).exceptAll(mesh.mesh_vertices(nodes, 3).where("branch >= 0")).count() == 0
    assert mesh.mesh_faces(nodes, 3, sphere=False).count() == mesh.mesh_faces(nodes, 3).where("class <> 'SOMA'").count()
    got = mesh.read_obj(rows).orderBy("neuron_id").collect()
    text = [bytes(r.content).decode().splitlines() for r in rows.orderBy("neuron_id").collect()]
    assert [(r.vertices, r.faces, r.last) for r in got] == [(sum(x[0] == "v" for x in t), sum(x[0] == "f" for x in t), max(int(i) for x in t if x[0] == "f" for i in x[2:].split())) for t in text]


def test_rings_round_plainly_and_make_no_sphere(spark, monkeypatch):
    values = [*np.random.default_rng(2).normal(scale=50, size=3000).tolist(), 0.0, -0.0, -1e-7, 2.5, -0.07, 1e9 / 3, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    same = fixtures.rounded(df.withColumn("w", F.col("v")), "v", places=4).select("v").collect(), fixtures.rounded_plainly(df, "v", places=4).collect()
    assert [str(r.v) for r in same[0]] == [str(r.v) for r in same[1]]
    rows = [(1, i, 1 if i == 1 else 3, float(i), 0.0, float(i % 2), 1.0, i - 1 if i > 1 else -1) for i in range(1, 6)]
    t = pa.Table.from_pylist([dict(zip(mesh.NODE, r, strict=True)) for r in rows])
    monkeypatch.setattr(mesh, "icosphere", None)
    sweep = mesh.Sweep(t, {c: i for i, c in enumerate(mesh.NODE)}, "radius", 3, True, "spherical", True)
    assert sum(len(p["vertex"]) for p in sweep.vertices(False)) == 5 * 3 + 2 and sum(len(p["a"]) for p in sweep.faces(False)) == 4 * 6 + 6
    plan = catalog.QUERIES["G13_rings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rint" in plan.lower() and "round(" not in plan
