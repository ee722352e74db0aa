"""Metadata files, manifests, saved pages, projector files, joins."""

import json
import time

import pytest
from pyspark.sql import functions as F

from dendrospark.operators import match, topology
from dendrospark.sources import swc, tables


def test_metadata_by_suffix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "v": "old"}\n\n{"id": "1", "v": "new"}\n{"id": "", "v": "x"}\n{"v": "y"}\n')
    (tmp_path / "a.csv").write_text("id,v\n1,old\n2,b\n1,new\n,x\n")
    (tmp_path / "list.json").write_text(json.dumps([{"id": "1", "v": "old"}, {"id": "2", "v": 3}, {"id": "1", "v": "new"}, {"id": ""}, {"v": 1}]))
    (tmp_path / "keyed.json").write_text(json.dumps({"1": {"v": "new"}, "2": {"v": 3}}))
    read = lambda name: {r.id: (r.fields["v"] if "fields" in r else r.v) for r in tables.read_metadata(spark, str(tmp_path / name), "id").collect()}
    assert read("a.jsonl") == {"1": "new"} and read("a.csv") == {"1": "new", "2": "b"}
    assert read("list.json") == read("keyed.json") == {"1": "new", "2": "3"}
    with pytest.raises(ValueError):
        tables.read_metadata(spark, "x.txt", "id")


def test_specimen_and_file_metadata(spark):
    views = spark.createDataFrame([(1, "77_a.swc"), (2, "b.swc"), (3, None)], "v int, swc string")
    a = spark.createDataFrame([("77", "basket")], "cell_specimen_id string, kind string")
    b = spark.createDataFrame([("b.swc", "cortex")], "filename string, region string")
    got = {r.v: (r.specimen and r.specimen.kind, r.file_fields and r.file_fields.region) for r in tables.with_specimen_metadata(views, a, b).collect()}
    assert got == {1: ("basket", None), 2: (None, "cortex"), 3: (None, None)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    rows = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").cache()
    assert sorted((r.a, r._corrupt) for r in rows.where("a is not null").collect()) == [(1, None), (2, None)] and rows.where("_corrupt is not null").count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()
    df = spark.createDataFrame([(1, None)], "a int, b string")
    for _ in range(2):
        tables.write_jsonl(df, str(tmp_path / "out"))
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect()] == [{"a": 1, "b": None}] * 2
    tables.write_jsonl(df, str(tmp_path / "out"), append=False)
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_manifests_of_tasks(spark, tmp_path):
    for k in (0, 2):
        (tmp_path / f"manifest_{k}.jsonl").write_text(f'{{"swc": "s{k}"}}\n\n{{"swc": "t{k}"}}\n')
    (tmp_path / "manifest_train.jsonl").write_text('{"swc": "no"}\n')
    m = tables.merged_manifests(spark, str(tmp_path), "swc string")
    assert sorted((r.task, r.swc) for r in m.collect()) == [(0, "s0"), (0, "t0"), (2, "s2"), (2, "t2")]
    assert tables.merged_manifests(spark, str(tmp_path), "swc string", [2]).count() == 2
    assert tables.find_manifests(spark, str(tmp_path), "train").endswith("manifest_train.jsonl") and tables.find_manifests(spark, str(tmp_path), "val") is None


def test_saved_pages_and_variants(spark, tmp_path):
    (tmp_path / "page-0.json").write_text(json.dumps({"_embedded": {"neuronResources": [{"n": 1}, {"n": 2}]}}))
    (tmp_path / "page-1.json").write_text(json.dumps({"results": [{"n": 3}]}))
    got = tables.saved_pages(spark, str(tmp_path)).select(F.try_variant_get("item", "$.n", "int").alias("n"), "pos").collect()
    assert sorted((r.n, r.pos) for r in got) == [(1, 0), (2, 1), (3, 0)]
    (tmp_path / "v.jsonl").write_text('{"c": "one"}\n{"c": ["a", "b"]}\n{}\n')
    assert sorted(map(tuple, (r[0] for r in tables.read_variants(spark, str(tmp_path / "v.jsonl")).select(tables.as_strings(F.col("v"), "c")).collect()))) == [(), ("a", "b"), ("one",)]


def test_links_by_label_or_ending(spark):
    html = ['<a href="dableFiles/x/a.CNG.swc">Morphology File (Standardized)</a>', '<a HREF = dableFiles/y/b.swc>other</a><a href="z.swc">no</a>', "none", '<a href="dableFiles/1.txt">Morphology File (Standardized)</a><a href="dableFiles/2.swc">x</a>']
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, html string")
    got = {r.i: r.l for r in df.select("i", tables.labelled_link(F.col("html"), "Morphology File (Standardized)", "http://h").alias("l")).collect()}
    assert got == {0: "http://h/dableFiles/x/a.CNG.swc", 1: "http://h/dableFiles/y/b.swc", 2: None, 3: "http://h/dableFiles/1.txt"}


def test_projector_files(spark, tmp_path):
    v = spark.createDataFrame([(2, [0.5, 1.0], "own"), (1, [2.0, 3.0], None)], "id int, vec array<double>, kind string")
    m = spark.createDataFrame([(1, "meta", "r"), (2, "meta", None)], "id int, kind string, region string")
    tables.write_projector(v, m, "id", str(tmp_path / "p"), ["kind", "region"])
    assert [r.value for r in spark.read.text(str(tmp_path / "p/tensors")).collect()] == ["2.0\t3.0", "0.5\t1.0"]
    rows = spark.read.csv(str(tmp_path / "p/metadata"), sep="\t", header=True).collect()
    assert {r.id: (r.kind, r.region) for r in rows} == {"1": ("meta", "r"), "2": ("own", None)}
    config = json.loads(spark.read.text(str(tmp_path / "p/config")).first().value)
    assert config["embeddings"][0]["tensorShape"] == [2, 2]


def test_annotations_fall_back(spark):
    rows = spark.createDataFrame([(1, "k1", "f1", "own"), (2, "k1", "f2", ""), (3, "zz", "f2", None), (4, "zz", "zz", None)], "i int, k string, f string, kind string")
    a, b = spark.createDataFrame([("k1", "by key")], "key string, kind string"), spark.createDataFrame([("f2", "by file")], "file string, kind string")
    got = match.annotated(rows, F.col("k"), a, "key", F.col("f"), b, "file", ["kind"]).collect()
    assert {r.i: r.kind for r in got} == {1: "own", 2: "by key", 3: "by file", 4: ""}


def test_pose_of_a_view(spark):
    m = spark.createDataFrame([("a", 0, "a0"), ("a", 1, "a1"), ("b", 5, "b5")], "swc string, idx int, file string")
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 9), (3, "c", 0)], "i int, swc string, idx int")
    assert {r.i: r.file for r in match.pose(rows, m, "swc", "idx", "file").collect()} == {1: "a1", 2: "b5", 3: ""}


def test_by_swc(spark):
    e = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("", 3), (None, 4)], "swc string, line_no int")
    assert {r.swc: r.lines for r in tables.by_swc(e).collect()} == {"b": [0, 2], "a": [1]}
    with pytest.raises(ValueError):
        tables.by_swc(e, strict=True)


def test_named_collections(spark):
    assert {r.key for r in tables.collections(spark).collect()} == {"mouse_motor_cortex", "mouse_visual_cortex"}


def test_distances_end_on_cycles_and_long_chains(spark):
    rows = [(0, i, i - 1 if i > 1 else -1) for i in range(1, 5001)] + [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, -1), (3, 2, 1)]
    n = spark.createDataFrame([(k, i, 2, float(i), 0.0, 0.0, 1.0, p) for k, i, p in rows], "neuron_id long, idx int, type_id int, x double, y double, z double, radius double, parent int")
    pairs = spark.createDataFrame([(0, 5000, 17), (1, 1, 2), (2, 3, 1), (3, 1, 2), (3, 1, 9)], "neuron_id long, a int, b int")
    begun = time.time()
    got = {(r.neuron_id, r.a, r.b): r.distance for r in topology.path_distance(n, pairs).collect()}
    assert got == {(0, 5000, 17): 4983.0, (1, 1, 2): float("inf"), (2, 3, 1): float("inf"), (3, 1, 2): 1.0, (3, 1, 9): None} and time.time() - begun < 60
    up = topology.ancestors(n, spark.createDataFrame([(0, 5000), (2, 3)], "neuron_id long, idx int")).groupBy("neuron_id").count().collect()
    assert {r.neuron_id: r["count"] for r in up} == {0: 5000, 2: 1}
    assert topology.closure(n).groupBy("neuron_id").count().count() == 2


def test_repeated_and_short_lines(spark):
    text = "# a = 1\n# note\n1 1 0 0 0 1 -1\n2 3 1 0 0 1 1\n2 3 2 0 0 1 1\nbad line\n3 3 1 1 1 x 1\n"
    lines = swc.text_lines(spark.createDataFrame([("/x/n1.swc", text)], "path string, value string"))
    n = topology.unique_nodes(swc.parse_nodes(lines))
    assert sorted((r.idx, r.x) for r in n.collect()) == [(1, 0.0), (2, 2.0)]
    assert swc.parse_headers(lines).first().header == {"a": "1", "comment_2": "note"}


def test_metadata_of_every_kind_has_one_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "x": "p"}, {"x": "q"}, {"id": "2"}]')
    (tmp_path / "b.json").write_text('{"1": {"x": "p"}, "2": {}}')
    (tmp_path / "c.csv").write_text("id,x\n1,o\n1,p\n,q\n2,\n")
    (tmp_path / "d.jsonl").write_text('{"id": 1, "x": "p"}\n{"id": "2"}\n{"x": 3}\n')
    for name in ("a.json", "b.json", "c.csv", "d.jsonl"):
        got = {r["id"]: r.fields for r in tables.metadata_fields(spark, f"{tmp_path}/{name}", "id").collect()}
        assert {k: v.get("x") for k, v in got.items()} == {"1": "p", "2": None}, name


def test_an_evaluation_takes_the_first_manifest_of_its_order(spark, tmp_path):
    with pytest.raises(ValueError, match="no manifest"):
        tables.evaluator_manifest(spark, str(tmp_path))
    for name in ("manifest.jsonl", "manifest_test.jsonl", "manifest_val.jsonl"):
        (tmp_path / name).write_text("{}")
        assert tables.evaluator_manifest(spark, str(tmp_path)).endswith(f"/{name}")


def test_projector_files_tell_rows_of_one_id_apart(spark, tmp_path):
    rows = [(k % 3, [float(k), 1.0], f"n{k}") for k in range(30)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, name string").repartition(7)
    tables.write_projector(v, spark.createDataFrame([(0, "z")], "id long, name string"), "id", f"{tmp_path}/p", ["name"])
    lines = lambda part: [x for f in sorted((tmp_path / "p" / part).glob("part-*")) for x in f.read_text().splitlines()]
    tensors, names = [float(x.split("\t")[0]) for x in lines("tensors")], [x.split("\t") for x in lines("metadata") if not x.startswith("id\t")]
    assert [f"n{int(t)}" for t in tensors] == [n for _, n in names] and [i for i, _ in names] == sorted(i for i, _ in names)


@pytest.mark.parametrize(("val", "test"), [(-0.1, 0.1), (0.5, 0.5), (0.1, 1.0), (1.2, 0.0)])
def test_ratios_must_leave_room(spark, val, test):
    from dendrospark.operators import curate

    with pytest.raises(ValueError, match="leave room"):
        curate.split(spark.range(3), "id", None, val, test)
