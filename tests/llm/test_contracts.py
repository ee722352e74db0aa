"""The numbered operators against plain brute force, and on odd tables: repeats, nulls, no rows, clashing columns, very long texts."""

import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest

from dendrospark.llm import cdc, chat_hmm, decontam, embed_dups, pii, secrets, shingle_join, sp_bpe, toxicity, warc

LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, texts, extra="k string", value="x"):
    return spark.createDataFrame([(i, t, value) for i, t in texts], f"doc_id long, text string, {extra}")


def babble(seed, alphabet, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def odd(texts):
    """Numbered texts with nulls, an empty one, repeats and a null id."""
    rows = list(enumerate(texts))
    return [*rows, (900, None), (901, ""), (902, texts[0]), (902, texts[0]), (None, texts[1])]


# Toxicity


def plain_score(lex, text):
    words = re.findall(r"[^\W_]+", toxicity.fold(text))
    phrases = [toxicity.fold(p).split() for p in lex.exceptions]
    spared = {i + k for p in phrases for i in range(len(words)) if words[i : i + len(p)] == p for k in range(len(p))}
    total = 0.0
    for i, w in enumerate(words):
        if i not in spared:
            total += max([0.0, lex.weights.get(f" {w} ", 0.0), *(v for t, v in lex.weights.items() if not t.endswith(" ") and w.startswith(t[1:]))])
    b = lex.curve
    return 1 / (1 + math.exp(-max(-40, min(40, b[0] + b[1] * math.log1p(total) + b[2] * total / math.sqrt(len(words) + 1)))))


def test_toxicity_scores_by_brute_force(spark):
    lex = toxicity.Lexicon({" trash ": 3.0, " idio": 2.0, " moron ": 4.0, " ass ": 2.5, " clow": 1.0}, (-3.0, 1.0, 2.0), ("trash can", "not an idiot", "clown fish"))
    texts = [*babble(3, ["trash", "can", "idiot", "idiotic", "not", "an", "ass", "assess", "clown", "fish", "m0r0n", "Мoron", " ", " ", ". "], 200, 30), "trash can trash can " * 3000 + "trash"]
    got = toxicity.score(spark.createDataFrame([(i, t, 1.0) for i, t in odd(texts)], "doc_id long, text string, toxicity double"), lex).collect()
    assert len(got) == len(odd(texts)) and got[0].__fields__ == ["doc_id", "text", "toxicity", "toxic_terms"]
    for r in got:
        assert math.isclose(r.toxicity, plain_score(lex, r.text or ""), rel_tol=1e-9)


def test_toxicity_keeps_columns_that_are_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, "some words", 7.0, "z") for i in range(8)], "doc_id long, text string, toxicity double, toxic_terms string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and {(r.toxicity, r.toxic_terms) for r in kept.collect()} == {(7.0, "z")} and kept.count() == 8
    assert toxicity.predictions(docs.where("false"), labels).count() == 0


def test_short_words_may_be_terms():
    assert " ass " in toxicity.terms_of("ass") and toxicity.terms_of("ass") == [" ass "]


# Shingle join


def test_jaccard_with_repeated_ids_and_hot_shards(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(90):  # one group of near copies, larger than a chunk
        w = list(base)
        w[rng.randrange(60)] = f"n{k % 30}"
        texts.append(" ".join(w))
    texts += [" ".join(f"q{rng.randrange(40)}" for _ in range(12)) for _ in range(60)]
    rows = odd(texts)
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    least = {i: i for i in sets}
    links = {i: [j for j in sets if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])] for i in sets}
    for _ in sets:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in sets}
    for chunk, hot in ((512, 1 << 16), (16, 1 << 16), (16, 5)):
        monkeypatch.setattr(shingle_join, "CHUNK", chunk)
        monkeypatch.setattr(shingle_join, "HOT", hot)
        got = shingle_join.classes(frame(spark, rows, "n string")).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else least[r.doc_id]) and (r.doc_id is None or r.n_shingles == len(sets[r.doc_id]))


# Personal data


def luhn(d):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(m.start(), k, kind, m.end()) for k, (kind, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m[0])]


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))


def test_base_personal_data_by_brute_force(spark):
    texts = babble(5, ["4111 1111 1111 1111", "4111111111111112", "378282246310005", " ", " ", "-", ".", "1", "22", "333", "255", "@", "a.b", "+1 (383) 555-6083", "+", "(", "é", "😀", "x", "10.0.0.1"], 400, 14)
    rows = odd(texts)
    got = pii.find(frame(spark, rows, "base string")).collect()
    assert len(got) == len(rows)
    want = {i: plain_base(t or "") for i, t in rows}
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == sha(joined(spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in pii.BASE]
        assert set(filter(None, joined(spans).split(","))) <= set(r.spans.split(","))
        found = [(a, b) for a, b in (map(int, x.split(":")[1:]) for x in r.spans.split(",") if x and x.split(":")[0] not in pii.BASE)]
        assert all(not (a < e and s < b) for a, b in found for s, _, _, e in spans)
    assert pii.find(frame(spark, []).where("false")).count() == 0


def test_the_classifier_follows_the_reliabilities():
    def row(kind, form, context, n):
        return {"kind": kind, "form": form, "gazetteer": form, "context": context, "edge": 1, "size": 1, "share": 2, "count": n}

    def odds(counts, r):
        m = pii.Model(counts)
        return math.log(m.prior[r["kind"]] / (1 - m.prior[r["kind"]])) + sum(math.log(m.features[f][r[f]][0] / m.features[f][r[f]][1]) for f in m.features)

    asked = row("account", 0, 1, 6)
    agree = [row("card", 1, 1, 200), row("card_like", -1, -1, 200), asked, row("account", 0, -1, 6)]  # cue words go with the form
    against = [row("card", 1, -1, 200), row("card_like", -1, 1, 200), asked, row("account", 0, -1, 6)]  # cue words stand where the form fails
    assert odds(agree, asked) > 0 > odds(against, asked)


def test_mistyped_and_local_numbers_are_decided_on(spark):
    good = [f"write to p{k}@mail.example.com or call +1 (383) 555-60{k:02d}, card 4111 1111 1111 1111" for k in range(40)]
    bad = [f"version {k} isbn4111111111111112x order 4111111111111113" for k in range(40)]
    got = pii.find(frame(spark, enumerate([*good, *bad, "call us, phone (383) 555-6083"]))).collect()
    by = {r.doc_id: r.spans for r in got}
    assert "local_phone:15:29" in by[80] and all("card_like" not in by[k] for k in range(40, 80))


# SentencePiece


def test_long_texts_are_encoded_in_parts(spark, monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tok.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    words = ["the", "Größe", "▁", "été", "日本", "a\nb", "  ", "token", "x" * 90, "zq" * 40, "😀"]
    long = " ".join(rng.choice(words) for _ in range(450_000))
    texts = ["one two", long, "no" * 1_200_000, *babble(6, [*words, " ", " "], 60, 40)]
    rows = odd(texts)
    got = sp_bpe.encode_documents(frame(spark, rows, "n_tokens string"), path).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(lib.decode(ids)))
    assert all(want[r.doc_id] == tuple(r)[1:] for r in got)
    assert sp_bpe.encode_documents(frame(spark, []).where("false"), path).count() == 0


def test_stepwise_and_single_walks_agree(monkeypatch):
    tok = pytest.importorskip("public_tokenizers")
    bpe = sp_bpe.model_of(open(tok.path("piece_bpe_32k.model"), "rb").read())
    texts = babble(8, list("abcdeinorst  éñ▁日\n"), 300, 60)
    whole = [bpe.encode(t) for t in texts]
    monkeypatch.setattr(sp_bpe, "STEPS", 2)
    assert [bpe.encode(t) for t in texts] == whole
    monkeypatch.setattr(sp_bpe, "PAIRS", 10)
    assert [bpe.encode(t) for t in texts] == whole


# Substring dedup


def test_substring_dedup_by_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkléñ") for _ in range(rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [" ".join([*(word() for _ in range(30)), *(rng.choice(shared) for _ in range(rng.randrange(3))), *(word() for _ in range(30))]) for _ in range(40)]
    rows = odd([*texts, texts[3], "short", "short"])
    chunk = {}
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        cuts, ends, _ = cdc.chunks(raw, np.array([0, len(raw)]))
        pieces = [raw[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]
        chunk[i] = [(a, b, p if b - a > cdc.REACH or k == 0 else pieces[k - 1] + p) for k, (a, b, p) in enumerate(zip(cuts, ends, pieces, strict=True))]
    owner = {}
    for i in sorted(k for k in chunk if k is not None):
        for _, _, p in chunk[i]:
            owner.setdefault(p, i)
    got = cdc.deduplicate(frame(spark, rows, "removed string")).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r.doc_id]
        if r.doc_id is None or t is None:
            assert r.text == t
            continue
        flags = [owner[p] < r.doc_id for _, _, p in chunk[r.doc_id]]
        runs, at = [], 0
        while at < len(flags):
            to = at
            while to < len(flags) and flags[to]:
                to += 1
            if to > at and (chunk[r.doc_id][to - 1][1] - chunk[r.doc_id][at][0] >= cdc.LEAST_RUN or to - at == len(flags)):
                runs.append((chunk[r.doc_id][at][0], chunk[r.doc_id][to - 1][1]))
            at = max(to, at + 1)
        raw = t.encode()
        kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)], strict=True))
        assert r.text == kept.decode() and r.removed == ",".join(f"{len(raw[:a].decode())}:{len(raw[:b].decode())}" for a, b in runs)
    assert cdc.deduplicate(frame(spark, []).where("false")).count() == 0


# Decontamination


def test_longest_matches_beyond_any_window(spark):
    w = [f"w{k}" for k in range(200)]
    item = " ".join(w)
    texts = [f"{' '.join(w[:100])} stop", f"{' '.join(w[:90])} other {' '.join(w[:150])}", f"a {' '.join(w[20:110])} b {' '.join(w[20:140])} c", "none of it", " ".join(w)]
    bench = spark.createDataFrame([(7, item), (30, " ".join(w[:13])), (8, "none")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.report(frame(spark, odd(texts), "hits string"), bench).collect()}
    assert [got[k].longest for k in range(5)] == [100, 150, 120, 1, 200]
    assert got[0].items_sha256 == sha("30,7") and got[3].items_sha256 == sha("8") and got[900].items_sha256 == sha("") and got[900].n_words == 0
    kept = decontam.locate(frame(spark, enumerate(texts), "hits string"), bench)
    assert kept.count() == 5 and kept.columns.count("hits") == 1
    assert decontam.drop_contaminated(frame(spark, enumerate(texts), "hits string"), bench).columns == ["doc_id", "text", "hits"]
    assert decontam.report(frame(spark, []).where("false"), bench).count() == 0


# Chat


def test_parts_are_decoded_along_the_path_of_the_whole(spark):
    rng = random.Random(3)
    model = chat_hmm.Hmm({(0, 2): 5.0, (2, 4): 30.0, (4, 2): 30.0, (2, 3): 20.0, (4, 5): 40.0, (3, 4): 9.0, (5, 2): 9.0}, {(2, 1, 4): 30.0, (4, 2, 2): 20.0, (5, 1, 5): 20.0}, {2: 5.0})
    lines = ["User: hi", "what is this?", "Assistant: it is", "- a", "and a much longer line that goes on for a while, as answers do", "", "well?", "> quoted", "System: be kind"]
    rows, want = [], {}
    for c in range(30):
        parts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(1 if c < 4 else rng.randrange(2, 7))]
        rows += [(c, k + 3, t) for k, t in enumerate(parts)]
        want[c] = model.path([chat_hmm.observed(x) for x in "\n".join(parts).split("\n")])
    df = spark.createDataFrame(rows, "conv_id long, part long, text string")
    shared = spark.sparkContext.broadcast(model)
    edge = {(r.conv_id, r.part): (r.before, r.last) for r in chat_hmm.edges(df, shared).collect()}
    assert {c for c, _ in edge} == set(range(4, 30))
    e = lambda path, obs: model.start[path[0]] + sum(model.trans[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(model.emitted(obs)[s, t] for t, s in enumerate(path))
    for c in range(30):
        path, text = [], []
        for _, k, t in sorted(r for r in rows if r[0] == c):
            path += model.path([chat_hmm.observed(x) for x in t.split("\n")], *edge.get((c, k), (None, None)))
            text += t.split("\n")
        assert math.isclose(e(path, [chat_hmm.observed(x) for x in text]), e(want[c], [chat_hmm.observed(x) for x in text]), rel_tol=1e-9)
    assert chat_hmm.format_chats(df, model).count() == len(rows)


def test_turns_over_the_edges_of_parts_are_whole(spark, monkeypatch):
    rng = random.Random(8)
    model = chat_hmm.Hmm({(0, 2): 5.3, (2, 4): 30.7, (4, 2): 31.1, (2, 3): 20.9, (4, 5): 43.3, (3, 3): 17.1, (5, 5): 60.1, (3, 4): 9.7, (5, 2): 8.9}, {(2, 1, 4): 30.1, (4, 2, 2): 20.3, (5, 1, 5): 25.7}, {2: 5.9})
    lines = ["what is this?", "it is so", "- a", "and a much longer line that goes on for a while, as answers do", "", "  well? ", "> quoted"]
    rows = [(c, t - 3, "user" if t % 2 == 0 else "assistant", "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 1, 2, 5, 40])))) for c in range(12) for t in range(1 + 3 * c)]
    rows += [(50, 7, "user", "same number"), (50, 7, "assistant", "twice"), (51, 0, None, None)]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ways = []
    for part, block in ((100_000, 1024), (9, 4)):
        monkeypatch.setattr(chat_hmm, "PART", part)
        monkeypatch.setattr(chat_hmm, "BLOCK", block)
        cut = chat_hmm.transcripts(frame_)
        whole, turns, text = {}, {}, {}
        for r in sorted(cut.collect(), key=lambda r: (r.conv_id, r.part)):
            assert sum(r.lines) == len(r.text.split("\n")) <= part
            whole.setdefault(r.conv_id, []).append(r.text)
            turns[r.conv_id] = turns.get(r.conv_id, 0) + sum(r.begins)
        for r in sorted(chat_hmm.format_chats(cut, model).collect(), key=lambda r: (r.conv_id, r.part)):
            text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
            assert len(r.starts) == len(r.found_roles) == r.rendered.count("<|end|>")
        ways.append(({c: "\n".join(t) for c, t in whole.items()}, turns, text))
    assert ways[0] == ways[1]
    assert ways[0][1] == {c: 1 + 3 * c for c in range(12)} | {50: 2, 51: 1}
    assert ways[0][2] == {c: chat_hmm.render(chat_hmm.turns(t, model)) for c, t in ways[0][0].items()}


def test_a_long_conversation_is_not_cut_in_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"what is {t}?" if t % 2 == 0 else f"It is number {t}.\nAnd more.") for c in (1, 2, 3, 4, 5, 6) for t in range(1030 if c == 1 else 6)]
    got = chat_hmm.recovered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r.n_turns for r in got if r.conv_id == 1) == 1030 and sorted(r.part for r in got) == [0] * 6 + [1]
    assert all(r.rendered.count("<|end|>") == r.n_found for r in got)


def test_chat_rows_that_name_no_turn_are_left_out(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (None, 0, "user", "x"), (2, None, "user", "y"), (3, 0, "tool", "z" * 300_000)]
    got = {r.conv_id: r for r in chat_hmm.recovered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 3} and got[1].n_turns == 2 and not got[3].same_roles
    assert chat_hmm.recovered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").where("false")).count() == 0


# Archives


def test_repeated_and_missing_page_ids(spark):
    rows = [(5, "u", "same"), (5, "u", "same"), (9, "v", "same"), (None, "w", "same"), (7, "x", "other")]
    got = sorted(map(tuple, warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "record_type", "refers_to").collect()))
    assert got == [(5, "response", None), (5, "response", None), (7, "response", None), (9, "revisit", 5)]


def test_an_id_with_several_payloads_has_a_record_for_each(spark, monkeypatch):
    rows = [(1, "BBB"), (5, "AAA"), (5, "BBB"), (2, "CCC"), (5, "CCC"), *[(100 + i, None if i % 2 else "") for i in range(40)], (7, "AAA")]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in rows], "page_id long, url string, html string").repartition(3)
    for share in (1000, 2, 1):  # how many payloads are told by broadcast changes nothing
        monkeypatch.setattr(warc, "SHARE", share)
        files = warc.write_archives(pages, f"{warc.shared_dir(spark)}/several-{share}")
        got = warc.read_archives(files).collect()
        first = {h: min(i for i, g in rows if (g or "") == h) for h in {h or "" for _, h in rows}}
        want = sorted((i, h or "", "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, h in rows)
        texts = {r.payload_digest: bytes(r.payload).decode() for r in got if r.record_type == "response"}
        assert sorted((r.page_id, texts[r.payload_digest], r.record_type, r.refers_to) for r in got) == want


def test_archives_of_other_writers(spark, tmp_path):
    def one(kind, ident, body, more=""):
        block = f"HTTP/1.1 200 OK\r\n\r\n{body}".encode() if kind == "response" else body.encode()
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Target-URI: http://{ident}/\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = gzip.compress(one("warcinfo", "0", "software: x") + one("response", "1", "first") + one("response", "2", "second", "WARC-Payload-Digest: sha256:abc\r\n"))
    named = gzip.compress(one("response", "3", "third"))
    named = named[:3] + bytes([named[3] | 8]) + named[4:10] + b"n" * 700 + b"\0" + named[10:]  # a file name makes the header long
    (tmp_path / "x.warc.gz").write_bytes(data + named + b"\x1f\x8b\x08 no member" + gzip.compress(one("response", "4", "fourth")))
    size = (tmp_path / "x.warc.gz").stat().st_size
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", size)], "path string, size long")
    for step in (11, 1 << 20):
        got = {r.url: (r.page_id, bytes(r.payload), r.payload_digest) for r in warc.read_archives(files, step).collect()}
        assert got == {"http://1/": (None, b"first", ""), "http://2/": (None, b"second", "sha256:abc"), "http://3/": (None, b"third", ""), "http://4/": (None, b"fourth", "")}


def test_paths_without_scheme_go_where_spark_looks(spark):
    assert warc.qualified(spark, "/a/b").startswith("file:///a/b") and warc.qualified(spark, "s3a://x/y") == "s3a://x/y"


# Embeddings


def test_exact_links_of_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dups, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((90, 12))
    v = np.r_[x, x[:50] + 0.25 * rng.standard_normal((50, 12)), x[:5]]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    least = np.arange(len(v))
    for _ in range(len(v)):
        least = np.array([min([least[i], *least[hit[i]]]) for i in range(len(v))])
    rows = [(i, r.tolist()) for i, r in enumerate(v)]
    rows += [rows[3], (500, None), (501, [])]
    got = embed_dups.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = (int(hit[r.vec_id].sum()), int(least[r.vec_id])) if r.vec_id < 500 else (0, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (*want, r.vec_id == want[1])
    assert embed_dups.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_components_of_the_sorted_passes(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16))
    v = np.r_[x, x[:200] + 0.1 * rng.standard_normal((200, 16))]
    got = {r.vec_id: r for r in embed_dups.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = [(i, 400 + i) for i in range(200) if u[i] @ u[400 + i] >= 0.9]
    found = sum(got[b].component_id <= a and not got[b].kept for a, b in near)
    assert len(near) > 150 and found >= 0.97 * len(near)


# Secrets


def plain_secrets(text):
    rules = (
        ("assign", r"(?ia:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return [(m.start(), k, kind, m.end()) for k, (kind, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m)]


def test_secrets_by_brute_force(spark):
    texts = babble(7, ["password", "PassWd", "api_key", "apikey", "Token", "secret", ":", "=", " ", "'", '"', "abc", "0123456789ab", "AKIA", "QWERTY12", "é", "ſ", "/x.y"], 600, 16)
    rows = odd(texts)
    got = secrets.scan(frame(spark, rows, "found string")).collect()
    assert len(got) == len(rows)
    want = {i: plain_secrets(t or "") for i, t in rows}
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want[r.doc_id]) for k in range(3))
        assert r.base_sha256 == sha(joined(want[r.doc_id])) and r.spans == joined(want[r.doc_id])
    assert secrets.scan(frame(spark, []).where("false")).count() == 0


def test_private_keys_of_any_length():
    body = "\n".join("A" * 64 for _ in range(800))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES,00\n\n{body}\n-----END RSA PRIVATE KEY-----"
    text = f"x {key} y -----BEGIN EC PRIVATE KEY----- {key}"
    assert [s for s in secrets.find(text) if s[2] == "pem"] == [(2, 6, "pem", 2 + len(key)), (len(text) - len(key), 6, "pem", len(text))]
    assert not secrets.find("-----BEGIN PRIVATE KEY-----\nnot base 64!\n-----END PRIVATE KEY-----")


# Pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    tok = pytest.importorskip("public_tokenizers")
    import sentencepiece

    import corpus_pipeline

    lib = sentencepiece.SentencePieceProcessor(model_file=tok.path("piece_bpe_32k.model"))
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("sol", "mar", "ven", "tor", "lin", "gus") for b in ("a", "er", "ith", "on", "um", "eka")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {k: text(rng.randrange(20, 60)) for k in range(200)}
    for k in range(0, 200, 5):
        docs[k] += rng.choice([" vermin scumbag", " such vermin you are", " a scumbag, really vermin"])
    for k in range(1, 60, 4):
        docs[300 + k] = docs[k] if k % 8 == 1 else docs[k] + " more"
    exam = text(30)
    docs |= {400: f"{text(20)} {exam} {text(20)}", 401: f"{text(30)} token = abcdef123456 {text(5)}", 402: None, 403: ""}
    labels = [(k, int(k % 5 == 0)) for k in range(200)]
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lex = toxicity.learn(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {k: t for k, t in docs.items() if plain_score(lex, t or "") < toxicity.THRESHOLD}
    assert all(k not in left for k in range(0, 200, 5)) and len(left) > 150
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w := (t or "").translate(LOWER).split()) > 4 else {tuple(w)} - {()} for k, t in left.items()}
    least = {k: k for k in left}
    for _ in range(5):
        least = {a: min([least[a], *(least[b] for b in sets if sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]))]) for a in sets}
    left = {k: t for k, t in left.items() if least[k] == k}
    grams = {tuple(exam.split()[i : i + 13]) for i in range(18)}

    def hit(t):
        w = (t or "").split()
        words_hit = {i + k for i in range(len(w)) if tuple(w[i : i + 13]) in grams for k in range(13)}
        return words_hit and 20 * len(words_hit) >= len(w)

    left = {k: t for k, t in left.items() if not hit(t)}
    assert 400 not in left and 401 in left
    for k, t in left.items():
        for a, _, _, b in sorted(plain_secrets(t or ""), reverse=True):
            t = t[:a] + "[SECRET]" + t[b:]
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        left[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(lib.decode(ids)))
    assert got == left


# Worst cases for patterns, and benchmark ids that are no numbers


def test_secrets_take_linear_time():
    import time

    head = "eyJhbGciOiJIUzI1NiJ9"
    worst = [
        "-----BEGIN RSA PRIVATE KEY-----" + " " * 1_000_000 + "!" + "-----END RSA PRIVATE KEY-----",
        "-----BEGIN PRIVATE KEY-----\n" + "a-b:\n" * 200_000 + "!" + "-----END PRIVATE KEY-----",
        "eyJ" * 330_000 + ".",
        "eyJ" * 330_000 + ".a.b",
        "secret" * 170_000 + " " * 100_000,
    ]
    start = time.time()
    assert [[s[2] for s in secrets.find(t) if s[2] in ("pem", "jwt")] for t in worst] == [[], [], [], [], []]
    assert time.time() - start < 20
    kinds = lambda t: [s[2] for s in secrets.find(t)]
    assert kinds(f"x {head}.e30.abc y") == ["jwt"] and kinds(f"eyJx.a {head}.e30.abc") == ["jwt"] and kinds("-----BEGIN PRIVATE KEY-----\nQUJD\nQUJDQUJDQUJD\n-----END PRIVATE KEY-----") == ["pem"]
    assert kinds("-----BEGIN PRIVATE KEY-----\nA: b\nQUJDQUJDQUJDQUJD\n-----END PRIVATE KEY-----") == ["pem"] and kinds("-----BEGIN PRIVATE KEY-----\nA: b\nQUJD\n-----END PRIVATE KEY-----") == []


def test_benchmark_ids_may_be_any_texts(spark):
    bench = spark.createDataFrame([("b-1", "one two three"), ("a", "four five"), ("b-1", "six seven"), (None, "one two"), ("c", None)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five y six seven"), (2, "one two")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (7, 2, sha("a,b-1")) and got[2].n_items == 0
