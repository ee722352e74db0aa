"""Every query of the catalogue with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from dendrospark.operators import evaluate, vectors
from dendrospark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v != v else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype(float).fillna(-1e99)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = plain(catalog.QUERIES[name](spark, DATA).toPandas()), plain(duck.execute(catalog.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_info_nce_takes_every_view(spark, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    got = {r.batch: r for r in catalog.QUERIES["A33_info_nce"](spark, DATA).collect()}
    assert len(got) == -(-len(rows) // 64) and sum(r.n for r in got.values()) == len(rows)
    for k, r in got.items():
        x = np.array([e for _, e in rows[64 * k : 64 * k + 64]], float)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u[:, ::-1].T / 0.07
        loss = [np.mean(np.log(np.exp(m).sum(axis=1)) - np.diag(m)) for m in (s, s.T)]
        assert abs(r.loss - sum(loss) / 2) < 1e-5
        assert abs(r.i2t_acc - np.mean(s.argmax(axis=1) == np.arange(len(s)))) < 1e-5


def test_top_k_of_many_queries_in_blocks(spark, duck, monkeypatch):
    for name, rows in (("BROADCAST_ROWS", 5), ("QUERY_BLOCK", 7), ("ITEM_BLOCK", 100)):
        monkeypatch.setattr(vectors, name, rows, raising=False)
    got, want = plain(catalog.QUERIES["O2_top_k"](spark, DATA).toPandas()), plain(duck.execute(catalog.SQL["O2_top_k"]).df())
    assert got.equals(want)


def test_nearest_keeps_ties_and_unknown_ones_in_order(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for k in (1, 2, 6, 9):
        got = vectors.nearest(df.selectExpr("id q", "vec"), df.selectExpr("id i", "vec"), "q", "i", k).collect()
        want = vectors.top_k(vectors.similarities(df.selectExpr("id q", "vec"), df.selectExpr("id i", "vec"), "q", "i"), "q", "i", k).collect()
        assert sorted((r.q, r.rank, r.i, r.sim) for r in got if r.sim is not None) == sorted((r.q, r.rank, r.i, r.sim) for r in want if r.sim is not None)
        assert sorted((r.q, r.rank, r.i) for r in got) == sorted((r.q, r.rank, r.i) for r in want)


def test_moments_of_values_that_differ_by_rounding_alone(spark, duck, tmp_path):
    # Four lines of one order, three segments of 7 but for the rounding of 0.07 * 100.
    places = "(VALUES (1, 10, 0.0), (2, 10, 0.07), (3, 17, 0.0), (4, 17, 0.07)) t(n, q, d)"
    duck.execute(f"COPY (SELECT l.* REPLACE (1 AS l_orderkey, n AS l_linenumber, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS DOUBLE) AS l_discount, 0.0::DOUBLE AS l_tax) FROM (SELECT * FROM lineitem LIMIT 1) l, {places}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got, want = plain(catalog.QUERIES["A14_moments"](spark, str(tmp_path)).toPandas()), plain(own.execute(catalog.SQL["A14_moments"]).df())
    assert want["segment_length_skewness"].tolist() == [0.0] and got.equals(want)


def test_ranks_move_queries_once_and_read_items_in_chunks(spark, monkeypatch):
    for name, rows in (("QUERIES", 7), ("ITEM_BLOCK", 5)):
        monkeypatch.setattr(vectors, name, rows, raising=False)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    labels = [None if i % 9 == 0 else f"l{i % 5}" for i in range(39)] + ["alone"]
    v = spark.createDataFrame([(i, labels[i], x[i].tolist()) for i in range(40)], "view_id long, label string, vec array<double>")
    ranks = evaluate.ranks(v, v.where("view_id < 39"), "view_id")
    assert "CoGroup" not in ranks._jdf.queryExecution().toString()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[:39].T, 12)
    for r in ranks.collect():
        right = [s[r.view_id, j] for j in range(39) if labels[j] == labels[r.view_id]]
        assert r.rank == (1 + (s[r.view_id] > max(right)).sum() if right else None)


def test_stored_items_lie_in_small_row_groups(spark, monkeypatch):
    from pyarrow import parquet

    monkeypatch.setattr(vectors, "GROUP_BYTES", 50_000)
    folder = vectors.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    x = np.random.default_rng(5).normal(size=(3000, 16))
    v = spark.createDataFrame([(i, f"l{i % 3}", x[i].tolist()) for i in range(3000)], "view_id long, label string, vec array<double>").coalesce(1)
    got = {r.view_id: r.rank for r in evaluate.ranks(v.where("view_id < 20"), v.where("view_id >= 20"), "view_id").collect()}
    (new,) = [f for f in set(os.listdir(folder)) - before if f.startswith("items-")]
    files = [f"{folder}/{new}/{f}" for f in os.listdir(f"{folder}/{new}") if f.endswith(".parquet")]
    assert sum(parquet.ParquetFile(f).num_row_groups for f in files) > 2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u[:20] @ u[20:].T, 12)
    assert got == {i: 1 + (s[i] > s[i][np.arange(20, 3000) % 3 == i % 3].max()).sum() for i in range(20)}


@pytest.mark.parametrize("name", ["W1_both_ways", "W1_ranks", "K7_metrics"])
def test_ranks_of_near_and_exact_ties_are_those_of_the_sql(spark, tmp_path, name):
    # The own label's best and other labels' vectors differ by nothing, by 3e-11 (as good) or by 1e-7 (too near for single precision).
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(90, 6)), 8, axis=0)
    x += rng.choice([0, 3e-11, 1e-7], size=(len(x), 1)) * rng.normal(size=x.shape)
    labels = np.where(np.arange(len(x)) % 8 == 0, np.arange(len(x)) // 8 % 7, rng.integers(0, 7, len(x)))
    own = duckdb.connect()
    own.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    own.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, v.tolist(), int(labels[i])) for i, v in enumerate(x)])
    own.execute(f"COPY embeddings TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    got, want = plain(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()), plain(own.execute(catalog.SQL[name]).df())
    assert got.equals(want)


def test_ranks_of_vectors_of_several_lengths(spark, monkeypatch):
    for name, rows in (("QUERIES", 400), ("ITEM_BLOCK", 150)):
        monkeypatch.setattr(vectors, name, rows)
    rng = np.random.default_rng(12)
    odd = {3: None, 10: [1.0, None, 2.0], 17: [], 24: [0.0, 0.0, 0.0], 31: [float("nan"), 1.0, 1.0], 38: [float("inf"), 1.0, 1.0]}
    x = [odd.get(i, rng.normal(size=3 + i % 2).tolist()) for i in range(1300)]
    labels = [None if i % 11 == 0 else f"l{i % 11}" if i % 3 else f"own{i}" for i in range(1300)]
    v = spark.createDataFrame([(i, labels[i], x[i]) for i in range(1300)], "view_id long, label string, vec array<double>")
    ranks = evaluate.ranks(v, v, "view_id")
    assert "aggregate(" not in ranks._jdf.queryExecution().analyzed().toString()  # vectors are normalised in columns
    known = [None if v is None or None in v or not np.isfinite(v).all() else np.array(v) / max(np.linalg.norm(v), 1e-12) for v in x]
    got = {r.view_id: r["rank"] for r in ranks.collect()}
    for i, u in enumerate(known):
        s = {j: u @ w for j, w in enumerate(known) if u is not None and w is not None and len(u) == len(w)}
        right = [s[j] for j in s if labels[j] == labels[i]]
        assert got[i] == (1 + sum(t > max(right) + 1e-9 for t in s.values()) if right else None)


def test_both_ways_come_from_one_product(spark, monkeypatch):
    for name, rows in (("QUERIES", 400), ("ITEM_BLOCK", 150)):
        monkeypatch.setattr(vectors, name, rows)
    rng = np.random.default_rng(13)
    image, text = ([rng.normal(size=4 + (i % 100 == 0)).tolist() if i % 97 or not i else None for i in range(1300)] for _ in range(2))
    labels = [None if i % 13 == 0 else f"l{i % 13}" if i % 3 else f"own{i}" for i in range(1300)]
    pairs = spark.createDataFrame([(i // 2, labels[i], image[i], text[i]) for i in range(1300)], "i long, text string, image array<float>, embedded array<double>")
    row = evaluate.retrieval_both_ways(pairs, "i")
    assert row._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    figures = row.first().asDict()
    unit = lambda vs, kind: [None if v is None else (u := np.array(v, kind).astype(float)) / np.linalg.norm(u) for v in vs]
    sides = {"i2t": (unit(image, np.float32), unit(text, float)), "t2i": (unit(text, float), unit(image, np.float32))}
    for way, (own, other) in sides.items():
        ranks = []
        for i, u in enumerate(own):
            s = {j: u @ w for j, w in enumerate(other) if u is not None and w is not None and len(u) == len(w)}
            right = [s[j] for j in s if labels[j] == labels[i]]
            ranks.append(1 + sum(t > max(right) + 1e-9 for t in s.values()) if right else None)
        known = [k for k in ranks if k is not None]
        assert None in ranks and figures[f"{way}_median_rank"] == np.median(known)
        want = [100 * sum(k <= most for k in known) / 1300 for most in (1, 5, 10)] + [100 * sum(1 / k for k in known) / 1300]
        assert np.allclose([figures[f"{way}_{c}"] for c in ("r_at_1", "r_at_5", "r_at_10", "mrr")], want)
