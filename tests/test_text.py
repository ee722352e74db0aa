import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from dendrospark.functions import digests
from dendrospark.functions import text as tx
from dendrospark.operators import curate, evaluate, match, vectors


def one(spark, column, **fields):
    return spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for k, v in fields.items())).select(column.alias("v")).first().v


def test_descriptions(spark):
    p = tx.archive_parts(F.col("s"), F.col("c"), F.col("r"))
    assert one(spark, tx.legacy_text(p), s="mouse", c=["pyramidal", "principal cell"], r=["neocortex", "layer 2/3"]) == "a pyramidal neuron from neocortex layer 2/3"
    assert one(spark, tx.standard(p), s="mouse", c=["principal cell"], r=[]) == "a mouse principal cell"
    assert one(spark, tx.legacy_text(p), s="mouse", c=["Basket cell"], r=["Frontal Lobe"]) == "a basket cell from frontal lobe"
    assert one(spark, tx.legacy_text(p), s="mouse", c=["Unknown"], r=[""]) == "an unknown neuron"
    assert one(spark, tx.specimen_text(F.col("s"), F.col("s"), F.col("s")), s="") == "neuron"
    assert one(spark, tx.broad(p), s="African elephant", c=["x"], r=[]) == "an African elephant neuron"


def test_priorities(spark):
    assert one(spark, tx.primary_cell_type(F.col("c")), c=["Pyramidal", "Basket cell"]) == "Basket cell"
    assert one(spark, tx.primary_cell_type(F.col("c")), c=["VIP", "odd"]) == "VIP"
    assert one(spark, tx.primary_region(F.col("c")), c=["left olfactory bulb"]) == "left olfactory bulb"
    assert one(spark, tx.primary_region(F.col("c")), c=["qq", ""]) == "" and one(spark, tx.primary_region(F.col("c")), c=["odd place"]) == "odd place"
    assert one(spark, tx.primary_cell_type(F.col("c")), c=["neuron", "foo"]) == "foo"
    assert one(spark, tx.layer(F.col("c")), c=["x", "Layer 5/6"]) == "layer 5/6"


def test_hash_slots_match_hashlib(spark):
    for word in ("a", "granule cell", "ärger"):
        assert one(spark, tx.md5_mod(F.col("w"), 384), w=word) == int(hashlib.md5(word.encode()).hexdigest(), 16) % 384
        assert one(spark, tx.sha1_sign(F.col("w")), w=word) == (1 if int(hashlib.sha1(word.encode()).hexdigest(), 16) % 2 == 0 else -1)
    assert one(spark, tx.ngrams(F.col("w")), w="A b  c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, tx.ngrams(F.col("w")), w="") == [""]


def test_ids(spark):
    assert one(spark, tx.id_from_path(F.col("w")), w="/x/2020-01_cell9.swc") == "2020"
    assert one(spark, tx.candidate_ids(F.col("w")), w="12_ab-1.CNG") == ["12_ab-1.CNG", "12_ab-1", "ab-1", "12"]


def test_numbers_round_to_even(spark):
    assert one(spark, tx.whole(F.col("w")), w=2.5) == "2" and one(spark, tx.whole(F.col("w")), w=3.5) == "4"


def test_first_reason_wins_and_missing_passes(spark):
    c = curate.degenerate(*[F.col(x) for x in "abcde"])
    assert one(spark, c, a=0.0, b=1.0, c=0.0, d=0.0, e=1.0) == "zero_bifurcations"
    rows = spark.createDataFrame([(None, 9.0, 1.0, 1.0, 300.0)], "a double, b double, c double, d double, e double")
    assert rows.select(c.alias("v")).first().v is None


def test_bins_are_closed_on_the_right(spark):
    label = curate.bin_label(F.col("v"), F.array(F.lit(1.0), F.lit(2.0)), F.array(*map(F.lit, "abc")))
    rows = spark.createDataFrame([(1.0,), (1.1,), (2.0,), (9.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(label).collect()] == ["a", "b", "b", "c", None]


def test_candidates_take_the_first_hit(spark):
    left = spark.createDataFrame([(1, "7_a.CNG"), (2, "8_b.CNG"), (3, "zzz")], "k int, name string")
    right = spark.createDataFrame([("a", "by name"), ("7", "by number"), ("8", "by number")], "id string, v string")
    got = {r.k: r.v for r in match.by_candidates(left, "k", tx.candidate_ids(F.col("name")), right, "id").collect()}
    assert got == {1: "by name", 2: "by number"}


def test_ranks_and_effects(spark):
    items = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.9, 0.1]), (2, "a", [0.0, 1.0])], "id int, label string, vec array<double>")
    q = spark.createDataFrame([(7, "b", [1.0, 0.0]), (8, "zz", [1.0, 0.0])], "q int, label string, vec array<double>")
    assert {r.q: r["rank"] for r in evaluate.ranks(q, items, "q").collect()} == {7: 2, 8: None}
    c = vectors.group_cosines(items, "id", "label").first()
    assert math.isclose(c.intra, 0.0, abs_tol=1e-12)


def test_digests_of_many_pieces_are_hashlibs():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start, length = rng.integers(0, 2900, 500), np.r_[np.arange(90), rng.integers(0, 60, 410)]
    for dim in (384, 7):
        for i, place, sign in zip(range(500), *digests.signed_places(data, start, length, dim), strict=True):
            raw = data[start[i] : start[i] + length[i]].tobytes()
            assert place == int.from_bytes(hashlib.md5(raw).digest()) % dim and sign == 1 - 2 * (hashlib.sha1(raw).digest()[-1] % 2)


def test_hashed_vectors_of_odd_texts_move_twice(spark, monkeypatch):
    monkeypatch.setattr(tx, "GRAM_ROWS", 3, raising=False)
    texts = ["A b  c\tA b\n", "", "   ", None, "one", "\x0bTwo x 中文 Été\r\f", "w" * 70 + " " + "v" * 30 + " u", " a", "b ", "c A b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "b c b"), (None, "x y"), (None, "z")]
    got = tx.hash_vectors(spark.createDataFrame(rows, "id long, text string").repartition(2), "id")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
    want = {}
    for i, t in rows:
        if t is not None:
            w = [x for x in re.split("[ \t\n\x0b\f\r]+", t.lower()) if x]
            for g in [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)] or [t]:
                raw, v = g.encode(), want.setdefault(i, {})
                at = int.from_bytes(hashlib.md5(raw).digest()) % 384
                v[at] = v.get(at, 0) + 1 - 2 * (hashlib.sha1(raw).digest()[-1] % 2)
    found = {r.id: {x.at: x.v for x in r.slots} for r in got.collect()}
    assert found.keys() == want.keys()
    for i, v in want.items():
        size = sum(c * c for c in v.values()) ** 0.5
        assert found[i] == {at: c / size for at, c in v.items() if c}


def test_candidates_are_compared_by_place_and_sorted(spark):
    left = spark.createDataFrame([(1, "a", "b"), (2, "x", "c"), (3, None, "b"), (4, "x", "y"), (5, "c", "a"), (5, "x", "a"), (None, "a", "b")], "k long, p string, q string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), (None, 5)], "id string, v int")
    names = F.array("p", "q", "p")
    df = match.by_candidates(left, "k", names, right, "id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Broadcast" not in plan and "distinct" not in plan
    want = [(1, "a", 1), (2, "c", 4), (3, "b", 2), (3, "b", 3), (5, "a", 1), (5, "c", 4)]
    assert sorted((r.k, r.id, r.v) for r in df.collect()) == want
    costly = match.by_candidates(left, "k", names, right, "id", right.select("id"))
    assert sorted((r.k, r.id, r.v) for r in costly.collect()) == want
