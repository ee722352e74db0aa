"""Directions, extents, radii, pixels and figures against plain numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from dendrospark.operators import evaluate, pixels, vectors, views


def node_table(spark, trees):
    rows = [(k, i + 1, 1 if i == 0 else 3, *map(float, p), 1.0 + i % 3, i if i else -1) for k, ps in trees.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "neuron_id long, idx int, type_id int, x double, y double, z double, radius double, parent int")


def even(n):
    z = np.linspace(1 - 1 / n, -1 + 1 / n, n)
    a = np.arange(n) * math.pi * (3 - math.sqrt(5))
    return np.stack([np.sqrt(1 - z * z) * np.cos(a), np.sqrt(1 - z * z) * np.sin(a), z], 1)


def test_guided_directions(spark):
    rng = np.random.default_rng(4)
    trees = {k: rng.standard_normal((30, 3)) * (9, 3, 1) for k in range(4)} | {10: rng.standard_normal((5, 3)), 11: np.zeros((20, 3))}
    out = views.guided_directions(node_table(spark, trees)).orderBy("neuron_id", "i").collect()
    for k, p in trees.items():
        got = [(r.tier, np.array(r.direction)) for r in out if r.neuron_id == k]
        assert [i for i, r in enumerate(x for x in out if x.neuron_id == k) if r.i != i] == []
        if len(p) < 10:
            assert all(t == "fibonacci" for t, _ in got) and np.allclose([d for _, d in got], even(24))
            continue
        assert [t for t, _ in got] == ["canonical"] * 6 + ["biased"] * 12 + ["random"] * 6
        if k == 11:  # nodes that all coincide have axes too
            continue
        w, v = np.linalg.eigh(np.cov(p.T))
        axes = v[:, np.argsort(w)[::-1]].T
        assert np.allclose(np.abs([d for _, d in got[:6:2]]), np.abs(axes)) and np.allclose(got[0][1], -got[1][1])
        pool = even(48)
        want = [c for c in pool[np.argsort(np.abs(pool @ axes[2]), kind="stable")] if (np.abs(axes @ c) <= math.cos(math.radians(15))).all()][:12]
        assert np.allclose([d for _, d in got[6:18]], want)
        assert np.allclose(np.linalg.norm([d for _, d in got[18:]], axis=1), 1)
    assert [r.direction for r in out if r.neuron_id == 0][18:] != [r.direction for r in out if r.neuron_id == 1][18:]


def test_too_few_sidelong_directions_are_filled_up(spark):
    p = np.random.default_rng(1).standard_normal((20, 3)) * (9, 3, 1)
    out = views.guided_directions(node_table(spark, {0: p}), n_biased=48).collect()
    assert sum(r.tier == "biased" for r in out) == 48


def test_projected_box(spark):
    rng = np.random.default_rng(2)
    p = rng.standard_normal((15, 3)) * (5, 2, 1)
    along = {0: (0, 0, 1), 1: (0.1, 0.99, -0.1), 2: (0.1, -0.99, 0.3), 3: (1, 2, 3)}
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in along.items()], "i int, dx double, dy double, dz double")
    for r in views.projected_extents(node_table(spark, {0: p}), d).collect():
        n = np.array(along[r.i], float) / np.linalg.norm(along[r.i])
        u = np.cross(n, (0, 0, 1) if abs(n[1]) > 0.95 else (0, 1, 0))
        u /= np.linalg.norm(u)
        box = [np.ptp(p @ u), np.ptp(p @ np.cross(u, n))]
        assert np.allclose([r.width, r.height, r.diagonal], [*box, np.hypot(*box)])


def test_radii_are_scaled_more_where_they_are_thin(spark):
    n = node_table(spark, {0: np.arange(12).reshape(4, 3)})  # a chain with radii 1, 2, 3, 1; all branch radii: 1, 2, 3, 1
    got = {r.idx: r.scaled_radius for r in views.scaled_radii(n, 2.0, 1.0).collect()}
    w = {r: min(10, 1.5 / r) for r in (1.0, 2.0, 3.0)}
    want = {i: r * (1 + w[r] / (1 + w[r])) for i, r in ((2, 2.0), (3, 3.0), (4, 1.0))} | {1: 1.0}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert {r.scaled_radius for r in views.scaled_radii(n).collect()} == {1.0, 2.0, 3.0}


def test_depth_bytes_and_grey(spark):
    px = spark.createDataFrame([(0, 0, 0, 0.2), (0, 0, 1, 0.6), (0, 1, 0, 1.0), (1, 0, 0, 0.5), (1, 0, 1, 1.0)], "view_id int, r int, c int, val double")
    assert {(r.view_id, r.r, r.c): r.val for r in pixels.depth_bytes(px).collect()} == {(0, 0, 0): 0, (0, 0, 1): 255, (0, 1, 0): 0, (1, 0, 0): 128, (1, 0, 1): 0}
    rgb = spark.createDataFrame([(255, 0, 51)], "a int, b int, c int")
    assert math.isclose(pixels.grey(rgb, ["a", "b", "c"]).first().val, 0.4)


def test_jittered_sphere_stays_on_the_sphere(spark):
    d = np.array([[r.dx, r.dy, r.dz] for r in views.fibonacci_sphere(spark, 50, jitter=0.2, seed=3).orderBy("i").collect()])
    assert np.allclose(np.linalg.norm(d, axis=1), 1) and not np.allclose(d, even(50)) and np.abs(d[:, 2] - even(50)[:, 2]).max() <= 0.2 / 50 + 1e-12


def test_cross_entropy(spark):
    rows = spark.createDataFrame([([1.0, 2.0, -1.0], 1), ([0.5, 0.5, 900.0], 0), ([1.0, 1.0, 1.0], -100)], "logits array<double>, label int")
    got = [r[0] for r in rows.select(evaluate.cross_entropy(F.col("logits"), F.col("label"))).collect()]
    assert math.isclose(got[0], -math.log(math.e**2 / (math.e + math.e**2 + math.e**-1))) and math.isclose(got[1], 899.5) and got[2] is None


def test_losses(spark):
    row = spark.createDataFrame([([0.5, -1.0], [0.0, 0.2], [0.9, 0.1], [1.0, 0.0], 3.0, 0.5)], "mu array<double>, lv array<double>, p array<double>, t array<double>, d1 double, d2 double")
    c = F.col
    kl, free, dice, h1, h2 = row.select(evaluate.kl_term(c("mu"), c("lv")), evaluate.kl_term(c("mu"), c("lv"), 0.3), evaluate.dice(c("p"), c("t")), evaluate.huber(c("d1")), evaluate.huber(c("d2"))).first()
    each = [-0.5 * (1 + v - m * m - math.exp(v)) for m, v in ((0.5, 0.0), (-1.0, 0.2))]
    assert math.isclose(kl, sum(each) / 2) and math.isclose(free, sum(max(0.3, e) for e in each) / 2)
    assert math.isclose(dice, (2 * 0.9 + 1) / (2.0 + 1)) and (h1, h2) == (2.5, 0.125)


def test_pca_scatter(spark):
    x = np.random.default_rng(3).standard_normal((40, 4)) * (5, 2, 1, 0.5)
    got = {r.i: r.point for r in vectors.pca_scatter(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, vec array<double>"), "i").collect()}
    u = np.linalg.svd(x - x.mean(axis=0))[2][:2]
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(axis=1)[:, None], axis=1) < 0, -1, 1)
    assert np.allclose([got[i] for i in range(40)], (x - x.mean(axis=0)) @ u.T)


def test_embedding_map_and_report(spark):
    class Lengths:
        def __call__(self, name, values):
            return [[len(v), len(name)] for v in values]

    rows = spark.createDataFrame([(1, "ab"), (2, "abc")], "i int, text string")
    for encode in (Lengths, Lengths()):
        got = {r.i: r.image for r in evaluate.embedded(rows, {"image": "text"}, encode, "i int, text string, image array<double>").collect()}
        assert got == {1: [2.0, 5.0], 2: [3.0, 5.0]}
    m = evaluate.metrics(("one", spark.createDataFrame([(1.25, None)], "a double, b double")), ("two", spark.createDataFrame([(3,)], "c int")))
    assert [(r.section, r["name"], r.value) for r in m.collect()] == [("one", "a", 1.25), ("one", "b", None), ("two", "c", 3.0)]
    text = evaluate.metrics_text(m)
    assert text.index("[one]") < text.index("a: 1.2") < text.index("b: n/a") < text.index("[two]")
    assert evaluate.of_classes(spark.createDataFrame([(1, 2), (3, 1)], "gt int, pred int"), [1, 2]).count() == 1


def test_other_pools(spark):
    v = spark.createDataFrame([(1, 0, [[1.0, 3.0], [2.0, 2.0]])], "neuron_id int, view_id int, maps array<array<double>>")
    assert v.select(vectors.reduced(F.col("maps")), vectors.reduced(F.col("maps"), "max"), vectors.reduced(F.col("maps"), "flatten")).first()[:] == ([2.0, 2.0], [3.0, 2.0], [1.0, 3.0, 2.0, 2.0])
    rows = spark.createDataFrame([(1, 0, [3.0, 4.0]), (1, 1, [0.0, 2.0])], "neuron_id int, view_id int, vec array<double>")
    pooled = {how: vectors.pool(rows, how).first().vec for how in ("l2_then_mean", "mean_then_l2", "concat_mean_std")}
    assert np.allclose(pooled["l2_then_mean"], [0.3, 0.9]) and np.allclose(pooled["mean_then_l2"], np.array([1.5, 3]) / np.hypot(1.5, 3)) and np.allclose(pooled["concat_mean_std"], [1.5, 3, 1.5, 1])


def test_tubes_have_their_radius_and_close(spark):
    rng = np.random.default_rng(8)
    p = np.cumsum(rng.standard_normal((6, 3)), axis=0)
    n = node_table(spark, {0: p})
    rings = np.zeros((6, 5, 3))
    for r in views.tubes(n, 5).collect():
        assert r.vertex == r.at * 5 + r.k
        rings[r.at, r.k] = r.x, r.y, r.z
    way = np.r_[p[1:], p[-1:]] - np.r_[p[:1], p[:-1]]
    away = rings - p[:, None]
    assert np.allclose(np.linalg.norm(away, axis=2), (1.0 + np.arange(6) % 3)[:, None]) and np.allclose((away * way[:, None]).sum(axis=2), 0)
    assert np.allclose(rings.mean(axis=1), p)
    faces = [(r.a, r.b, r.c) for r in views.tube_faces(n, 5).collect()]
    edges = [e for a, b, c in faces for e in ((a, b), (b, c), (c, a))]
    assert len(faces) == 50 and len(set(edges)) == 150 and sum((b, a) not in set(edges) for a, b in edges) == 10  # open at both ends only


def test_first_passing_candidate(spark):
    c = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.9), ("a", 2, 0.95), ("b", 0, 0.1), ("b", 1, 0.3)], "key string, at int, score double")
    assert {r.key: r.at for r in views.first_passing(c, "key", "at", "score", 0.8).collect()} == {"a": 1, "b": 1}


def test_extents_shuffle_nodes_not_their_projections(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0), (2, 1.0, 1.0, 1.0)], "neuron_id long, x double, y double, z double")
    along = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0)], "i int, dx double, dy double, dz double")
    box = views.projected_extents(nodes, along)
    plan = box._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(neuron_id" in plan and "hashpartitioning(neuron_id#" in plan and ", i#" not in plan.split("Exchange hashpartitioning")[1].split(")")[0]
    assert {(r.neuron_id, r.i): round(r.diagonal, 9) for r in box.collect()} == {(1, 0): 5.0, (1, 1): 3.0, (2, 0): 0.0, (2, 1): 0.0}
