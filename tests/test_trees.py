import math
import random

import numpy as np
import pytest

from dendrospark.operators import features, topology
from dendrospark.sources import swc

NODE = "neuron_id string, idx int, type_id int, x double, y double, z double, radius double, parent int, line_no int"
Y_TREE = """# ORIGINAL_SOURCE = demo
# free comment

1 1 0 0 0 2 -1
2 3 3 4 0 1 1
3 3 6 8 0 1 2
4 3 6 8 5 0.5 3
5 2 3 4 12 0.5 2
6 2 0 0 -10 1 1
not a node line
"""
EXPECTED = {
    "total_dendritic_length": 15, "total_axonal_length": 22, "total_neurite_length": 37, "std_segment_length": 3.006659276, "max_path_distance": 17, "total_volume": 156.8178333, "total_surface_area": 254.468095,
    "bbox_volume": 1056, "n_branch_points": 2, "n_terminals": 3, "is_tree": 1, "tree_depth": 3, "mean_betweenness": 0.04166666667, "mean_closeness": 0.2055555556, "sholl_regression_coeff": 0.06593406593,
    "fractal_dimension_2d": 0.1507290029, "n_primary_neurites": 2, "segment_length_skewness": 0.5403933775, "segment_length_kurtosis": -1.548790038, "radius_skewness": 1, "branch_order_kurtosis": -0.9421487603, "center_offset": 0.1666666667, "sphericity": 0.8587113888,
}


def lines_of(spark, files):
    return swc.text_lines(spark.createDataFrame(list(files.items()), "path string, value string"))


@pytest.fixture(scope="module")
def y_nodes(spark):
    return swc.parse_nodes(lines_of(spark, {"/a/y_tree.swc": Y_TREE}))


def test_scan_and_header(spark, y_nodes):
    assert [r.idx for r in y_nodes.orderBy("idx").collect()] == [1, 2, 3, 4, 5, 6]
    header = swc.parse_headers(lines_of(spark, {"/a/y_tree.swc": Y_TREE})).first()
    assert header.header == {"ORIGINAL_SOURCE": "demo", "comment_2": "free comment"}


def test_bad_tokens_are_passed_over(spark):
    text = "1.0 1 0 0 0 1 -1\n2 1 1f 0 0 1 -1\n3\t1\t0 0 0 nan -1\r\n4 1 0 0 0 -1\n5 1 1e3 .5 -2. 1 -1"
    got = {r.idx: r for r in swc.parse_nodes(lines_of(spark, {"/b.SWC": text})).collect()}
    assert sorted(got) == [3, 5] and math.isnan(got[3].radius) and got[5].x == 1000 and got[5].neuron_id == "b"


def test_lines_are_split_and_read_once(spark):
    tokens = ["1.5", "+.5", "-5.", "1e3", "NaN", "-nan", "+Inf", "-INFINITY", "1_0", "1d", "0x1p3", "e5", "."]
    text = "\r\n".join([f"\t {i} 3 {t} 0 0 1 -1 \f" for i, t in enumerate(tokens)] + ["# 1 2 3 4 5 6 7", "90 3 0 0 0 1", "91 3 0 0 0 1 -1 0", "92 3.0 0 0 0 1 -1", "93 99999999999 0 0 0 1 -1"])
    nodes = swc.parse_nodes(lines_of(spark, {"/c/odd.swc": text}))
    assert [(r.idx, str(r.x)) for r in nodes.orderBy("idx").collect()] == list(enumerate(["1.5", "0.5", "-5.0", "1000.0", "nan", "nan", "inf", "-inf"]))
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # a file into lines, a line into tokens
    assert plan.count("RLIKE(") == 2
    assert plan.index("regexp_extract(") > plan.index("Generate posexplode(")  # below it: a stem a file, not one a line


def test_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.swc").write_text(Y_TREE)
    nodes, _, errors = swc.load_swc(spark, str(tmp_path))
    assert nodes.count() > 0 and "Generate" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert errors.columns == ["neuron_id", "level", "problem", "detail"]


def test_directory_scan_takes_either_case(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.swc").write_text(Y_TREE)
    (tmp_path / "sub" / "upper.SWC").write_text(Y_TREE)
    (tmp_path / "empty.swc").write_text("# nothing\n")
    nodes, headers, errors = swc.load_swc(spark, str(tmp_path))
    assert nodes.count() == 12 and headers.count() == 3
    assert [(r.neuron_id, r.problem) for r in errors.collect()] == [("empty", "empty")]


def test_features_of_the_hand_made_tree(y_nodes):
    f = features.neuron_features(y_nodes).first()
    assert len(features.NAMES) == 65
    for k, v in EXPECTED.items():
        assert f[k] == pytest.approx(v, rel=1e-8), k


def test_path_distances_true_and_as_the_reference_walks(spark, y_nodes):
    pairs = spark.createDataFrame([("y_tree", 4, 5), ("y_tree", 5, 4)], "neuron_id string, a int, b int")
    assert {(r.a, r.b): r.distance for r in topology.path_distance(y_nodes, pairs).collect()} == {(4, 5): 22.0, (5, 4): 22.0}
    assert {(r.a, r.b): r.distance for r in topology.path_distance_ref(y_nodes, pairs).collect()} == {(4, 5): 27.0, (5, 4): 17.0}


def test_branches_cover_each_edge_once(y_nodes):
    got = {tuple(r.nodes): r.length for r in topology.branches(y_nodes).collect()}
    assert got == {(1, 2): 5.0, (2, 3, 4): 10.0, (2, 5): 12.0, (1, 6): 10.0}


def test_validation(spark):
    rows = [("two", 1, 1, -1), ("two", 2, 1, -1), ("orphan", 1, 1, -1), ("orphan", 2, 3, 99), ("loop", 1, 1, -1), ("loop", 2, 3, 2), ("cycle", 1, 1, -1), ("cycle", 2, 3, 3), ("cycle", 3, 3, 2), ("none", 1, 1, 2), ("none", 2, 1, 1)]
    n = spark.createDataFrame([(t, i, k, 0.0, 0.0, 0.0, 1.0, p, i) for t, i, k, p in rows], NODE)
    got = {(r.neuron_id, r.problem) for r in swc.swc_errors(n).collect()}
    assert got == {("two", "several_roots"), ("orphan", "orphan"), ("loop", "self_loop"), ("cycle", "cycle"), ("none", "no_root"), ("none", "cycle")} | ({("loop", "cycle")} & got)


def test_degenerate_and_duplicates(spark):
    n = spark.createDataFrame([("one", 1, 1, 0.0, 0.0, 0.0, 5.0, -1, 0), ("dup", 1, 1, 0.0, 0.0, 0.0, 1.0, -1, 0), ("dup", 2, 3, 1.0, 0.0, 0.0, 1.0, 1, 1), ("dup", 2, 3, 9.0, 0.0, 0.0, 1.0, 1, 2)], NODE)
    u = topology.unique_nodes(n)
    f = {r.neuron_id: r for r in features.neuron_features(u).collect()}
    assert f["one"].degenerate and f["one"].sholl_regression_coeff == 0 and f["one"].xy_aspect_ratio == 1
    assert f["dup"].total_neurite_length == 9.0


def test_strategies_agree_on_random_trees_and_a_deep_chain(spark):
    rng = random.Random(3)
    rows = []
    for t in range(20):
        size = rng.randint(1, 60)
        for i in range(1, size + 1):
            rows.append((f"t{t}", i, rng.choice([2, 3, 4]) if i > 1 else 1, rng.random(), rng.random(), rng.random(), 1.0, -1 if i == 1 else rng.randint(1, i - 1), i))
    rows += [("chain", i, 3, float(i), 0.0, 0.0, 1.0, i - 1 if i > 1 else -1, i) for i in range(1, 401)]
    n = spark.createDataFrame(rows, NODE)
    a = {(r.neuron_id, r.idx): r for r in topology.topology(n).collect()}
    b = {(r.neuron_id, r.idx): r for r in topology.closure(n).collect()}
    assert set(a) == set(b)
    for k in a:
        assert a[k].depth == b[k].depth and a[k].root == b[k].root and a[k].path_len == pytest.approx(b[k].path_len)
    sizes = np.array([r.subtree_size for r in a.values()])
    assert sizes.sum() == sum(r.depth + 1 for r in a.values())


def test_save_and_parse_again(spark, y_nodes):
    text = swc.swc_text(y_nodes).select("neuron_id", "value").first()
    again = swc.parse_nodes(lines_of(spark, {"/y_tree.swc": text.value}))
    assert again.drop("line_no").exceptAll(y_nodes.drop("line_no")).isEmpty()


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_blocks_of_a_tree_give_what_the_whole_tree_gives(spark, block):
    rng = random.Random(block)
    rows = []
    for k in range(6):
        for i in range(1, 61):
            parent = -1 if i == 1 or rng.random() < 0.05 else rng.choice([i - 1, i - 2, rng.randrange(1, 61), 500 if rng.random() < 0.1 else i - 1])
            rows.append((f"n{k}", i, 2, float(rng.randrange(9)), float(rng.randrange(9)), 0.0, 1.0, parent if parent else -1, i))
    nodes = spark.createDataFrame(rows, NODE)
    said = lambda df: sorted((r.neuron_id, r.idx, r.depth, r.root, None if r.path_len is None else round(r.path_len, 9)) for r in df.select("neuron_id", "idx", "depth", "root", "path_len").collect())
    got = said(topology.placed(nodes, block))
    # What lies on or below a cycle differs in nothing: topology gives nulls there too.
    assert got == said(topology.topology(nodes)) and any(g[2] is None for g in got)


def test_pairs_of_large_trees_go_root_by_root(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"n{k}", i, 2, float(rng.randrange(9)), float(rng.randrange(9)), 0.0, 1.0, -1 if i in (1, 20) else rng.choice([i - 1, max(1, i - 3)]) if i != 30 else 31, i) for k in range(3) for i in range(1, 41 - 30 * (k == 2))]
    nodes = spark.createDataFrame(rows, NODE)
    pairs = spark.createDataFrame([(f"n{k}", rng.randrange(1, 44), rng.randrange(1, 44)) for k in range(3) for _ in range(80)], "neuron_id string, a int, b int")
    said = lambda: sorted(map(str, ((r.neuron_id, r.a, r.b, r.distance, r.distance_ref) for r in topology.pair_distances(nodes, pairs).collect())))
    whole = said()
    monkeypatch.setattr(topology, "BLOCK", 15)
    assert "part" in topology.pair_distances(nodes, pairs)._jdf.queryExecution().toString() and said() == whole and any("inf" in w for w in whole) and any("None" in w for w in whole)


def test_features_take_one_pass_and_plain_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, 1 if i == 1 else 2 + i % 3, *map(float, rng.integers(0, 9, 3)), 1.0, -1 if i == 1 else int(rng.integers(1, i))) for k in range(12) for i in range(1, 2 + 5 * k)]
    df = features.neuron_features(spark.createDataFrame(rows, "neuron_id long, idx int, type_id int, x double, y double, z double, radius double, parent int").repartition(3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ObjectHashAggregate" not in plan
    for f in df.collect():
        own = {r[1]: r for r in rows if r[0] == f.neuron_id}
        place = {i: np.array(r[3:6]) for i, r in own.items()}
        seg = {i: float(np.linalg.norm(place[i] - place[r[7]])) for i, r in own.items() if r[7] != -1}
        path = {1: 0.0}
        for i in sorted(seg):
            path[i] = path[own[i][7]] + seg[i]
        ends = [path[i] for i in own if i not in {r[7] for r in own.values()}]
        assert abs(f.median_segment_length - (np.median(list(seg.values())) if seg else 0)) < 1e-9
        assert abs(f.median_path_distance - np.median(ends)) < 1e-9
        xy = np.array(list(place.values()))[:, :2]
        low, size = xy.min(axis=0), np.ptp(xy, axis=0)
        want = 0.0
        if len(xy) > 1 and (size > 0).all():
            most = [math.ceil(1 / s - 1e-9) for s in features.SCALES]
            n = [len({tuple(c) for c in np.clip(np.floor((xy - low) / (size * s)), 0, m - 1)}) for s, m in zip(features.SCALES, most, strict=True)]
            want = -np.polyfit(np.log(features.SCALES), np.log(n), 1)[0]
        assert abs(f.fractal_dimension_2d - want) < 1e-9
