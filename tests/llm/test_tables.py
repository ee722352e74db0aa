"""Archives, embeddings, components and the pipeline."""

import base64
import gzip
import hashlib
import os

import numpy as np
import pytest

from dendrospark.llm import components, embed_dups, shingle_join, warc


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (10, 3), *[(k, k + 1) for k in range(100, 160)], *[(500, k) for k in range(501, 560)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[10] == got[3] == 1 and got[5] == 4 and 9 not in got and got[160] == 100 and got[559] == 500
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = os.urandom(40_000).hex()
    pages = [(1, "http://a/\r\nx", "one"), (2, None, "two"), (3, "u", "one"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n\x1f"), (-8, "u", "one")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, size string")
    want, first = {}, {}
    for i, _, h in sorted(pages):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(spark, df).collect()}
    assert got == want
    files = warc.write_archives(df, f"file://{tmp_path}/w")
    for step in (7, 100, 1 << 20):
        rows = warc.read_archives(files, range_bytes=step).collect()
        assert sorted(r.page_id for r in rows) == sorted(want)
        assert {r.page_id: r.payload for r in rows}[6] == big.encode()
    path = files.first().path
    assert gzip.open(path).read().count(b"WARC-Type") == len(gzip.open(path).read().split(b"WARC/1.1\r\nWARC-Type")) - 1
    assert warc.round_trip(spark, df.where("false")).count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 32))
    near = x[:40] + 0.15 * rng.standard_normal((40, 32))
    dense = x[0] + 0.12 * rng.standard_normal((200, 32))
    v = np.r_[x, near, dense, x[:10], 3 * x[:3]]
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(v)]
    odd = [(9001, None), (9002, [0.0] * 32), (9003, [1.0, None]), (9004, [float("nan")] * 32), (9005, []), (None, rows[0][1])]
    got = {r.vec_id: r for r in embed_dups.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, copies int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    n = hit.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= n).all() and found.sum() >= 0.95 * n.sum() and len(got) == len(rows) + len(odd)
    for k in (9001, 9002, 9003, 9004, 9005):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[None].component_id is None


def test_windows_reach_over_the_edges_of_partitions(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 16))
    v = np.r_[x, x + 0.2 * rng.standard_normal((200, 16))]
    vecs = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(v)], "vec_id long, vec binary")
    u = embed_dups.units_of([r.tobytes() for r in v])
    want = set()
    for p in (0, 1):
        bits = ((u - u.mean(axis=0)) @ embed_dups.planes(p, 16) > 0).astype(int).tolist()
        order = sorted(range(len(v)), key=lambda i: (bits[i], i))
        want |= {frozenset((a, b)) for k, a in enumerate(order) for b in order[max(0, k - 12) : k] if u[a] @ u[b] >= 0.9}
    assert want
    means = embed_dups.centres(vecs)
    assert list(means) == [128] and means[128][0] == 400 and np.allclose(means[128][1], u.mean(axis=0))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for parts in ("1", "9", "80"):
            for k, x in (conf | {"spark.sql.shuffle.partitions": parts}).items():
                spark.conf.set(k, x)
            links = embed_dups.sorted_pass(vecs, [0, 1], 12, 0.9, {128: (400, u.mean(axis=0))}).collect()
            got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
            assert {frozenset((r.a, r.b)) for r in links} <= want
            assert all(got[a] == got[b] for a, b in map(tuple, want))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_shards_are_dealt_out_by_their_excess_at_any_scale():
    rng = np.random.default_rng(3)
    for mean in (10, 10**3, 10**6, 10**9):
        counts = rng.poisson(mean, shingle_join.BUCKETS)
        assert (shingle_join.tasks_of(counts) == 1).all()
        counts[7] = 40 * max(mean, shingle_join.HOT)
        tasks = shingle_join.tasks_of(counts)
        assert 9 <= tasks[7] <= 40 and (np.delete(tasks, 7) == 1).all()


def partners(n, dim, background, seed=1):
    """Unit vectors that share a direction: the second half are partners of the first at cosine 0.9001, all other pairs have the background's cosine."""
    rng = np.random.default_rng(seed)

    def across(*to):
        r = rng.standard_normal((n // 2, dim))
        r[:, 0] = 0
        for t in to:
            r -= (r * t).sum(axis=1, keepdims=True) * t
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    a = across()
    c = (0.9001 - background) / (1 - background)
    shared = np.sqrt(background) * np.eye(dim)[:1]
    return np.r_[shared + np.sqrt(1 - background) * a, shared + np.sqrt(1 - background) * (c * a + np.sqrt(1 - c * c) * across(a))]


@pytest.mark.parametrize(("n", "dim", "background"), [(10_000, 64, 0.0), (10_000, 64, 0.7), (50_000, 64, 0.5), (50_000, 64, 0.7)])
def test_passes_find_partners_of_vectors_that_share_a_direction(n, dim, background):
    x = partners(n, dim, background)
    centre, some = x.mean(axis=0), x[np.random.default_rng(0).permutation(n)[: embed_dups.SAMPLE]]
    met = np.zeros(n // 2, bool)
    for p in range(embed_dups.passes_needed(some, centre, n)):
        place = np.empty(n, int)
        place[np.argsort(embed_dups.signs(x - centre, p), kind="stable")] = np.arange(n)
        met |= np.abs(place[: n // 2] - place[n // 2 :]) <= embed_dups.WINDOW
    assert met.mean() >= 0.95


def test_passes_follow_the_vectors():
    even, shared = partners(4000, 32, 0.0), partners(4000, 32, 0.7)
    need = lambda x, n: embed_dups.passes_needed(x, x.mean(axis=0), n)
    assert need(even, 200) == embed_dups.PASSES and need(even, 10**6) > need(even, 10**5) >= embed_dups.PASSES
    assert need(shared, 10**5) > need(even, 10**5)
    with pytest.raises(ValueError, match="exact=True"):
        need(partners(4000, 32, 0.89), 10**9)


def test_recall_against_brute_force_on_vectors_that_share_a_direction(spark):
    x = partners(3000, 32, 0.7)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dups.near_duplicates(rows, window=32).collect()}
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    found = np.array([got[i].n_links for i in range(3000)])
    assert (found <= hit.sum(axis=1)).all() and found.sum() >= 0.95 * hit.sum()


def test_pipeline_on_small_tables(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        left = out.count()
        assert 0 < left <= n
        docs, n = out, left
