"""Small brute-force checks of the text operators, with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import json
import re
import zlib

import numpy as np
import pytest

from dendrospark.llm import cdc, chat_hmm, decontam, pii, secrets, shingle_join, sp_bpe, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = [f"w{k}x" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    texts = {}
    for k in range(60):
        texts[k] = prose(rng, int(rng.integers(5, 200)))
    base = prose(rng, 120).split()
    for k in range(60, 90):  # near copies
        w = list(base)
        for _ in range(int(rng.integers(0, 8))):
            w[int(rng.integers(len(w)))] = "new%d" % rng.integers(1000)
        texts[k] = " ".join(w)
    for k in range(90, 100):
        texts[k] = texts[5]
    texts |= {100: None, 101: "", 102: "  \t\n", 103: "One Two", 104: "one  two", 105: prose(rng, 20_000), 106: "a" * 100_000}
    rows = [(k, t, "x", 1) for k, t in texts.items()] + [(None, "lost id text", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, rep int")


def text_map(docs):
    return {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}


def test_jaccard_classes(docs):
    texts, sets = text_map(docs), {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = shingle_join.classes(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_jaccard_keeps_one_of_each(docs):
    kept = shingle_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {5, 103}.issubset(ids) and not ids & set(range(90, 100)) and 104 not in ids


def test_jaccard_of_no_rows(spark, docs):
    assert shingle_join.classes(docs.where("false")).count() == 0


def test_fine_bound_never_loses_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: max(1, int(len(a) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])
        if shingle_join.sets_ok(shingle_join.packed(a), shingle_join.packed(b)):
            assert shingle_join.fine_bound_ok(shingle_join.fine_vector(a), shingle_join.fine_vector(b))
            assert set(shingle_join.keys(a, np.zeros(shingle_join.BUCKETS, np.int64), 9).tolist()) & set(shingle_join.keys(b, np.zeros(shingle_join.BUCKETS, np.int64), 9).tolist())


def test_fine_bounds_and_overlaps_of_many_pairs_agree_with_single_ones():
    rng = np.random.default_rng(11)
    base = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.sort(rng.permutation(base)[: int(rng.integers(1, 900))]) for _ in range(40)] + [base[:0], base]
    fine = [shingle_join.fine_vector(s) for s in sets]
    x, y = np.triu_indices(len(sets), 1)
    got = shingle_join.fine_ok(fine, x, y)
    assert got.tolist() == [shingle_join.fine_bound_ok(fine[i], fine[j]) for i, j in zip(x, y, strict=True)]
    for block in (1 << 21, 97):
        m = shingle_join.overlaps(sets, block)
        assert [int(v) for v in m[x, y]] == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(x, y, strict=True)]


def test_jaccard_of_chained_near_copies_in_large_shards(spark):
    """Every text differs from the next by a few words, so large shards hold many components after the first round."""
    rng = np.random.default_rng(17)
    rows, passage = [], " ".join(f"share{i}" for i in range(40))
    for group in range(3):
        w = [f"g{group}w{i}" for i in range(120)]
        for k in range(60):
            if k % 7:
                w[int(rng.integers(len(w)))] = f"new{group}x{k}"
            else:
                w[k : k + 4] = [f"cut{group}x{k}x{i}" for i in range(4)]
            rows.append((len(rows), passage + " " + " ".join(w)))
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = [[b for b, other in enumerate(sets) if 4 * len(mine & other) >= 3 * len(mine | other)] for mine in sets]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[b] for b in near) for near in links]
    got = {r.doc_id: r.component_id for r in shingle_join.classes(docs).collect()}
    assert got == dict(enumerate(least))


def test_tree_finds_all_points_within_the_bound():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 6, (300, shingle_join.GROUPS)).astype(np.int16)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = shingle_join.Tree(points, sizes)
    for q in range(0, 300, 17):
        rows, _ = tree.search(points[q], int(sizes[q]))
        want = np.flatnonzero((np.minimum(points, points[q]).sum(axis=1) >= shingle_join.need(sizes + sizes[q])) & (4 * sizes >= 3 * sizes[q]) & (3 * sizes <= 4 * sizes[q]))
        assert sorted(rows.tolist()) == want.tolist()


def test_decontamination(spark, docs):
    texts = text_map(docs)
    items = [(1, " ".join(texts[60].split()[10:40])), (2, "One TWO"), (3, None), (4, ""), (5, texts[7]), (10, "w1x w2x"), (None, "w3x w4x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    for blocks in (1 << 23, 60):
        found = decontam.judged(decontam.locate(docs.select("doc_id", "text"), bench, block_bytes=blocks)).collect()
        assert len(found) == docs.count()
        for r in found:
            w, hit, seen = word.findall((r.text or "").translate(LOWER)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        seen |= x
            assert (r.n_words, r.n_hit, r.n_items, r.items) == (len(w), len(hit), len(seen), sorted(map(str, seen)))
            assert r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns
    assert decontam.drop_contaminated(docs, bench.where("false")).count() == docs.count()


def base_spans(text):
    hits = re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A)
    return ",".join(f"assign:{m.start()}:{m.end()}" for m in hits if len(m[2]) >= 6)


def test_secrets(spark):
    body = "A" * 30
    crc, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, k = divmod(crc, 62)
        tail = secrets.BASE62[k] + tail
    jwt = base64.urlsafe_b64encode(json.dumps({"alg": "none"}).encode()).decode().rstrip("=") + ".YQ.YQ"
    texts = ["PassWord = 'abcdef' token=secret=abcdefg", "AKIA" + "B" * 16 + " akia" + "B" * 16, "é" + "0a" * 12, f"ghp_{body}{tail} ghp_{body}xxxxxx {jwt}", None, "", "toKen=abcdef", "x" * 200_000]
    got = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.spans for r in got] == [base_spans(texts[0]), "access:0:20", "hex:1:25", f"github:0:40,jwt:82:{82 + len(jwt)}", "", "", "", ""]
    assert got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = secrets.redact(spark.createDataFrame([(1, "my password=abcdef12 end", 24, "k")], "doc_id long, text string, n_chars long, found string")).first()
    assert (red.text, red.n_chars, red.found) == ("my [SECRET] end", 15, "k")


def test_pii(spark):
    texts = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112, 12 4111 1111 1111 1111", "+1 (383) 555-6083. +12", "😀 joe (at) mail (dot) com", None, "", "@" * 3000 + "1." * 3000, "12 34 " + "5" * 5000]
    got = pii.find(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, card int")).orderBy("doc_id").collect()
    assert got[0].spans == "email:0:5,email:5:11,ip:12:19,ip:20:27" and got[1].spans == "card:0:19" and got[2].n_phone == 1
    assert (got[4].spans, got[4].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert len(got) == len(texts) and got[7].n_card == 0


def test_reliabilities_follow_the_votes():
    rows = [{"kind": "iban", "form": f, "gazetteer": g, "context": 0, "edge": e, "size": 2, "share": 1, "count": n} for f, g, e, n in ((1, 1, 1, 80), (-1, -1, 1, 70), (1, 1, -1, 5), (-1, -1, -1, 5))]
    m = pii.Model(rows)
    ratio = lambda t: t[1][0] / t[1][1]
    assert ratio(m.reliability["form"]) > 3 > ratio(m.reliability["edge"])


def test_sentencepiece(spark):
    tok = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tok.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(0)
    alpha = list("abcdeinrst öéñ▁​😀\n\t\x00_-09ﬁ你好")
    texts = [None, "", " ", "▁", "  two  spaces", "<s> hi </s>", "ab" * 500, "zq" * 2000] + ["".join(rng.choice(alpha, 40)) for _ in range(300)]
    got = sp_bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    bpe = sp_bpe.model_of(open(path, "rb").read())
    for _ in range(300):
        ids = rng.integers(1, 400, 8).tolist()
        assert bpe.decode(ids) == lib.decode(ids)


def test_substring_dedup(spark, docs):
    rng = np.random.default_rng(9)
    passage = prose(rng, 60)
    rows = [(k, f"{prose(rng, 40)} é {passage} {prose(rng, 30)}") for k in range(5)] + [(k, prose(rng, 80)) for k in range(5, 10)] + [(10, None), (11, ""), (None, passage), (12, "z" * 5000)]
    got = {r.doc_id: r for r in cdc.deduplicate(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, digest int")).collect()}
    assert len(got) == len(rows) and got[10].text is None and got[None].text == passage
    assert passage in got[0].text and got[0].removed == "" and got[0].n_repeated > 0
    for k in range(1, 5):
        a, b = map(int, got[k].removed.split(":"))
        text = dict(rows)[k]
        assert text[a:b] in passage and len(text) - len(got[k].text) == b - a == got[k].removed_chars
    for k in range(5, 10):
        assert got[k].text == dict(rows)[k] and got[k].n_repeated == 0


def test_exact_copies_are_left_empty(spark):
    rng = np.random.default_rng(21)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 120, 40)] + ["ok", "é" * 9, "w1x w2x"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)] + [(300, "w1x w3x, another short text")]
    got = {r.doc_id: r for r in cdc.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k].text == t
        assert (got[100 + k].text, got[100 + k].removed, got[100 + k].removed_chars) == ("", f"0:{len(t)}", len(t))
    assert got[300].text == "w1x w3x, another short text"


def test_a_short_end_goes_only_with_what_stands_before_it():
    rng = np.random.default_rng(22)
    a = prose(rng, 60).encode()
    cuts, ends, rows = cdc.chunks(np.frombuffer(a, np.uint8), np.array([0, len(a)]))
    text = a[: cuts[-1] + 3]
    other = prose(rng, 30).encode() + text[-3:]
    both = np.frombuffer(text + other, np.uint8)
    starts = np.array([0, len(text), len(both)])
    cuts, ends, rows = cdc.chunks(both, starts)
    d = cdc.chunk_digests(both, cuts, ends, rows)
    assert ends[rows[1] - 1] - cuts[rows[1] - 1] == 3 and not set(d[: rows[1]]) & set(d[rows[1] :])


def test_passages_of_51_words_are_removed(spark):
    rng = np.random.default_rng(23)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51) for _ in range(200)]
    rows = [(2 * k + i, f"{text(60)} {p} {text(60)}") for k, p in enumerate(passages) for i in (0, 1)]
    got = {r.doc_id: r for r in cdc.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1].removed_chars > 0 for k in range(len(passages))) >= 198


def test_chunks_survive_an_insertion():
    rng = np.random.default_rng(4)
    text = prose(rng, 400).encode()
    cut = lambda t: {t[a:b] for a, b in zip(*cdc.chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[:2], strict=True)}
    a, b = cut(text), cut(text[:500] + b"INSERTED " + text[500:])
    assert len(a - b) <= 4
    # a text's chunks don't depend on its neighbours in a batch
    both = np.frombuffer(b"other words before " + text, np.uint8)
    cuts, ends, rows = cdc.chunks(both, np.array([0, 19, len(both)]))
    assert {both[x:y].tobytes() for x, y in zip(cuts[rows[1] :], ends[rows[1] :], strict=True)} == a


def test_toxicity_learns_and_spares(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        w = prose(rng, 30).split()
        if bad:
            w[3] = str(rng.choice(["vermine", "vermin", "Scumbag"]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad), 0))
    rows += [(1000, "vermіn v3rmin"), (1001, None), (1002, ""), (1003, prose(rng, 20_000))]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, weight double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.predictions(docs, lab).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held)
    right = sum(got[k].predicted == int(k % 3 == 0) for k in held)
    assert right / len(held) > 0.95 and got[1000].predicted == 1 and got[1001].score == got[1002].score < 0.3 and 0 <= got[1003].score <= 1
    assert set(toxicity.drop_toxic(docs, lab).columns) == set(docs.columns)
    flat = toxicity.learn(docs, lab.where("false"))
    assert flat.weights == {}


def test_exception_phrases():
    lex = toxicity.Lexicon({toxicity.fold(" trash "): 5.0}, exceptions=("trash can",))
    assert lex.hits("the trash can") == (0, 0, 3) and lex.hits("you tr4sh")[1] == 1


def test_frequent_chunks_find_their_owners(spark):
    rows = [(k % 7 if k % 3 else 99, k % 5 if k % 3 else 1, k) for k in range(400)]
    seen = spark.createDataFrame(rows, "digest long, check int, doc_id long")
    least = {}
    for d, c, k in rows:
        least.setdefault((d, c), []).append(k)
    want = sorted((d, c, k, min(least[d, c])) for d, c, k in rows if len(least[d, c]) > 1)
    many = spark.createDataFrame([(d, c, min(v), len(v)) for (d, c), v in least.items() if len(v) > 1], "digest long, check int, owner long, n long")
    for share in (1, 4, 100, 4096):
        got = cdc.owned(seen, many, share).select("digest", "check", "doc_id", "owner").collect()
        assert sorted(map(tuple, got)) == want


def test_chat_roles(spark):
    rows = []
    for c in range(80):
        for t in range(4):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"what is {t} of {c}?" if t % 2 == 0 else f"It is a long answer, number {t} of {c}, and it goes on for a while.\nWith a second line."))
    rows += [(200, 0, "user", None), (200, 0, "user", None)]
    conv = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = chat_hmm.recovered(conv).collect()
    assert len(got) == 81 and sum(r.same_roles for r in got) >= 60
    m = chat_hmm.Hmm({}, {}, {})
    assert chat_hmm.turns("User: hi\nthere\nAssistant: hello", m) == [("user", "hi\nthere"), ("assistant", "hello")]
