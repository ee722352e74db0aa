"""Token alignment, filter audit and HTML extraction: against brute force, and on odd tables."""

import base64
import hashlib
import html
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from dendrospark.llm import filter_audit, html_text, token_align

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAGES = "/root/testdata/sf0.001/pages.parquet"


# Token alignment


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups), with both libraries, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    one.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    piece = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in range(two.get_piece_size())]
    found, counts = [], Counter()
    for t in texts:
        a, b = (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)) if t else ([], [])
        spelled = [ranks[i] for i in a], [piece[i] for i in b]
        if not t or any(b"".join(s) != (" " + t).encode() for s in spelled):
            found.append(None)
            continue
        ranges = [list(itertools.pairwise([0, *itertools.accumulate(map(len, s))])) for s in spelled]
        both = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        parts, at = [], 0
        for e in both:
            parts.append("|".join(",".join(str(i) for i, (x, y) in zip(ids, r, strict=True) if at <= x and y <= e) for ids, r in zip((a, b), ranges, strict=True)))
            at = e
        links, low = [], 0
        for i, (x, y) in zip(a, ranges[0], strict=True):
            while ranges[1][low][1] <= x:
                low += 1
            for j in range(low, len(b)):
                if ranges[1][j][0] >= y:
                    break
                links.append((i, b[j]))
        counts.update(links)
        found.append((len(a), len(b), len(both), links, ";".join(parts)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[k] == best[k[1]] for k in f[3]), sum(counts[k] for k in f[3]), f[4]) for f in found]


def odd_texts():
    rng = random.Random(5)
    marks = ["the ", "straße ", "naïve", "日本語", " ", "  ", "\n", "\t", "12345", "...", "🙂", "<|endoftext|>", "<s>", "▁", "don't ", " ", "é", "\x00", "Wörter, "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(40))) for _ in range(120)]
    return [*texts, texts[3], texts[3], "", None, "word " * 4000, "x"]


def test_alignment_by_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i != 7 else None, t, "k", 5) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int").repartition(3)
    want = {i if i != 7 else None: w for i, w in enumerate(plain_alignment(texts))}
    for held in (token_align.HELD, 40):
        rows = token_align.aligned(docs, *FILES, with_groups=True, held=held).collect()
        assert len(rows) == len(texts)
        for r in rows:
            w = want[r.doc_id]
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == w
            assert r.groups_sha256 == (hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")
    assert token_align.aligned(docs.where("false"), *FILES).count() == 0
    assert {r.n_a for r in token_align.aligned(docs.where("text is null or text = ''"), *FILES).collect()} == {0}


def test_alignment_counts_in_small_shards_and_trees(spark, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    plain = {tuple(r) for r in token_align.pair_counts(docs, *FILES).rows().collect()}
    monkeypatch.setattr(token_align, "SHARD", 10)
    monkeypatch.setattr(token_align, "ROWS", 8)
    monkeypatch.setattr(token_align, "FAN", 2)
    monkeypatch.setattr(token_align, "FLUSH", 100)
    split = token_align.pair_counts(docs, *FILES)
    assert split.shards > 3 and {tuple(r) for r in split.rows().collect()} == plain


def test_perfect_hash_is_minimal_and_rejects_repeats():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**31, 20_000))
    table = token_align.PerfectHash.of(keys)
    assert sorted(table.index(keys).tolist()) == list(range(len(keys))) and (table.ordered(keys)[table.index(keys)] == keys).all()
    assert len(token_align.PerfectHash.of(keys[:0]).index(keys[:5])) == 5
    with pytest.raises(ValueError, match="repeat"):
        token_align.PerfectHash.of(np.array([4, 4, 9]))


def test_alignment_of_endless_white_space():
    aligner = token_align.Aligner(*map(token_align.read, FILES))
    text = "a" + " " * 400_000 + "b"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = aligner.align([text], raw, np.array([0, len(raw)]))
    assert found.has.all() and found.a_end[-1] == len(raw) + 1 == found.b_end[-1]


# Filter audit


def plain_audit(docs, labels):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t, _ in docs]
    fails = []
    for (i, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        same = [j for j, u, _ in docs if (u or "") == t and j is not None]
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > min(same))
        fails.append({c for c, f in zip("ABCDE", checks, strict=True) if f})
    good, toxic = ({i for i, *r in labels if i is not None and r[k] == 1} for k in (0, 1))
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(i, f) for (i, _, lang), f in zip(docs, fails, strict=True) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                lost = [(i, f) for i, f in left if c in f]
                gone = [f for _, f in mine if c in f]
                left = [(i, f) for i, f in left if c not in f]
                out[part, "".join(order), step] = [len(left), len(lost), len(gone) - len(lost), sum(f == {c} for _, f in mine), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
        for c in "ABCDE":
            mine_of = [k for k in out if k[0] == part and k[1][k[2] - 1] == c]
            total = sum(out[k][1] for k in mine_of)
            for k in mine_of:
                out[k].append(total)
    return out


def test_audit_by_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "AB", "of", "x#", "Word", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(320))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(250))] * 5 + ["É" * 3, "A\x0bB\x1cC D", "", None]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in range(150)]
    docs += [docs[5], docs[5], (3, texts[0], "fr"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got = filter_audit.document_audit(
        spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, lang string, n int, part string").repartition(3),
        spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string"),
    ).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step] and r.filter == r.filter_order[r.step - 1]


def test_audit_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.document_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert filter_audit.document_audit(one, labels).count() == 600


@pytest.mark.parametrize("n", range(1, 6))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in filter_audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(set(itertools.permutations(range(n))))


def test_diagram_shares_equal_parts_and_keeps_weights_through_swaps():
    masks = {m: (m % 3, m % 2, 0) for m in range(16)}
    diagram = filter_audit.Diagram(masks, 4)
    assert diagram.root.weight == tuple(map(sum, zip(*masks.values(), strict=True)))
    assert len(diagram.level(3)) < 8 and len(filter_audit.Diagram({m: (1,) for m in range(16)}, 4).level(3)) == 1
    for k in filter_audit.swaps(4):
        diagram.swap(k)
        gone = 0
        for f, kept, lost in diagram.steps():
            gone |= 1 << f
            assert kept[0] == sum(w[0] for m, w in masks.items() if not m & gone)
            assert lost[0] == sum(w[0] for m, w in masks.items() if m & gone == 1 << f)


# HTML extraction


def marked_article(page):
    """Blocks between the article tags of a generated page, by regular expressions."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
    blocks = (" ".join(html.unescape(re.sub("<br>", " ", b).replace("<b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the driver's tables are not here")
def test_generated_pages_by_brute_force(spark):
    pages = spark.read.parquet(PAGES)
    want = {r.page_id: (r.url, marked_article(r.html)) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


LONG = "A sentence of the story that goes on for a while, as stories do. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # No article element: the ratios find the story, the rest of its element comes with it.
        (f'<body><div><a href=x>Home</a> <a href=y>News</a></div><div><h2>Head</h2><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 4}</p></div><div><a href=z>Old</a></div></body>', f"Head\n{(LONG * 3).strip()}\nShort.\n{(LONG * 4).strip()}"),
        # A short article beside long surroundings.
        (f"<header>{LONG}</header><nav>{LONG}</nav><article><h1>T</h1><p>Hi.</p></article><aside>{LONG}</aside><footer>{LONG}</footer>", "T\nHi."),
        # Parts that markup declares as none of the article, inside and outside of it.
        (
            f'<main><article><header><h1>T</h1></header><p>One.</p><div class="adSlot">{LONG}</div><div role="alert">{LONG}</div><form><label>Mail</label><input></form><p>Two.</p>'
            f'<section id="comments"><article><p>{LONG * 5}</p></article></section></article><div class="cookie-notice">{LONG}</div></main>',
            "T\nOne.\nTwo.",
        ),
        ('<form action="/"><div><article><p>In a form.</p></article></div></form>', "In a form."),
        ("<article><p>a <i>b</i><b>c</b> d<br>e</p><ul><li>one<li>two<p>more</ul><table><tr><td>1<td>2</table>tail</article>", "a bc d e\none\ntwo\nmore\n1 2\ntail"),
        ("<article><p>&amp;lt; &lt;b&gt; &#65;&#x42; &unknown; x &amp y<p>  \n <p>z", "&lt; <b> AB &unknown; x & y\nz"),
        ('<article><p>one<script>var t="</p>";</script><style>p{}</style><!-- no --> two</p><p>cut <a href="x', "one two\ncut"),
        ("just text", "just text"),
        ("<nav>only a menu</nav>", ""),
        ("", ""),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_odd_pages(spark):
    rows = [(1, "u", None, "a"), (None, None, "<p>x</p>", "a"), (2, "u", "<article>" + "<p><b>x<br>" * 30_000, "a"), (2, "u", "<div>" * 30_000 + "deep" + "</b></p>" * 30_000, "a"), (3, "", "", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.text) for r in html_text.extract(pages).collect()}
    assert got == {(1, "u", ""), (None, None, "x"), (2, "u", "\n".join(["x"] * 30_000)), (2, "u", "deep"), (3, "", "")}
    assert html_text.extract(pages.where("false")).count() == 0
