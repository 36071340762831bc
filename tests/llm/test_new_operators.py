"""Whitening, alignment of tokenizers and main text of pages, next to plain versions and on odd rows."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionrank.llm import alignment, entries, htmltext, whitening
from sessionrank.llm.common import read

# ---- whitening


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [[3.0], [1.0, 1.0], [5, 4, 3, 2, 1], [1] * 6 + [0] * 6, list(10.0 ** -np.arange(14)), list(np.linspace(0, 1, 40)), [0.0] * 5, [1, 1, 1, 0.5, 0.5, 0.25, 0.25]],
)
def test_spectral_division_finds_leading_components(values):
    a = matrix(values)
    got, axes = whitening.spectral(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.abs(got - want).max() < 1e-13 * max(1, want.max())
    assert np.abs(a @ axes - axes * got).max() < 1e-13 and np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-13


def test_polar_factor_has_the_signs():
    a = matrix([3, 1, -1e-6, -2])
    u = whitening.polar(a)
    values, q = np.linalg.eigh(a)
    assert np.abs(u - (q * np.sign(values)) @ q.T).max() < 1e-9
    assert whitening.polar(np.diag([1.0, 0.0])) is None


def plain_whitening(rows, k=4):
    x = {i: np.floor(256 * np.asarray(v, float)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((fit - s / n).T, bias=True))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, {i: (int(((n * v - s) ** 2).sum()), (v - s / n) @ axes / np.sqrt(values)) for i, v in x.items()}, values


def test_whitening_query_next_to_numpy(spark, sf_dir):
    got = entries.QUERIES["op11_qdwh_whitening"](spark, sf_dir).collect()
    source = {r.vec_id: r.embedding for r in read(spark, sf_dir, "embeddings").collect() if r.embedding}
    n, want, values = plain_whitening(list(source.items()))
    assert len(got) == 4 * len(source)
    total = sum(r.explained for r in got if r.vec_id == got[0].vec_id)
    assert 0 < total < 1
    sign = {}
    for r in got:
        deviation, z = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-8
        z = z[r.component - 1]
        if abs(z) > 1e-3:
            assert sign.setdefault(r.component, np.sign(z * r.whitened)) == np.sign(z * r.whitened)
        assert abs(abs(z) - abs(r.whitened)) < 1e-8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((50, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(60, base[0].tolist()), (60, base[0].tolist())]
    odd = [(70, None), (71, []), (72, [1.0, None, 2.0]), (73, [float("nan")] * 3), (74, [1.0, float("inf"), 0.0]), (75, [1e300, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    other = [(80, [1.0, 2.0]), (81, [1.0, 2.0]), (82, [1.0, 4.0]), (90, [7.0])]
    df = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<double>").withColumn("white", F.lit("x"))
    found = whitening.whitened(df)
    assert found.columns == ["vec_id", "embedding", "white", "_white"]
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, []).append(r["_white"])
    assert set(got) == {*range(50), 60, None, 80, 81, 82, 90} and len(got[60]) == 2
    n, want, _ = plain_whitening([*rows, (None, [0.5, 0.5, 0.5])], 3)
    for i, own in got.items():
        if i in want:
            assert own[0].n == n and own[0].deviation == want[i][0]
            assert np.abs(np.abs(own[0].whitened) - np.abs(want[i][1])).max() < 1e-9
    flat = got[82][0]  # two distinct vectors have one component
    assert flat.n == 2 and abs(abs(flat.whitened[0]) - 1) < 1e-12 and flat.whitened[1] is None and flat.explained == [1.0, 0.0]
    alone = got[90][0]
    assert (alone.n, alone.deviation, alone.whitened, alone.explained, alone.identity_error) == (1, 0, [None], [None], None)
    assert whitening.whitened(df.limit(0)).count() == 0


def test_deviation_beyond_64_bits_is_null(spark):
    big = [float(1 << 40), 0.0]
    df = spark.createDataFrame([(1, big), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.white.deviation for r in whitening.whitened(df).collect()}
    x = {1: (1 << 48, 0), 2: (0, 256), 3: (0, 0)}
    exact = {i: sum((3 * a - b) ** 2 for a, b in zip(v, (1 << 48, 256), strict=True)) for i, v in x.items()}
    assert got == {i: d if d < 2**63 else None for i, d in exact.items()}


# ---- alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts):
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    first, second = alignment.byte_level(A), alignment.pieces(B)
    spell_a, spell_b = first.bytes.to_pylist(), second.bytes.to_pylist()
    out, counts = [], Counter()
    for text in texts:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(spell_a[i] for i in a) != want or b"".join(spell_b[i] for i in b) != want:
            a = b = []
        owner_a = [k for k, i in enumerate(a) for _ in spell_a[i]]
        owner_b = [k for k, i in enumerate(b) for _ in spell_b[i]]
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))
        ends_a = np.cumsum([len(spell_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(spell_b[i]) for i in b]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            x, y = p, q
        links = [(a[i], b[j]) for i, j in pairs]
        counts.update(set(links))
        out.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(na, nb, g, len(x), sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), text) for na, nb, g, x, text in out]


TEXTS = [
    "The river is wide.", "The river is wide.", None, "", " ", "  two  blanks ", "tab\tand\nline", "<|endoftext|> and </s> are text", "é è 漢字 🙂 ́x", "café café",
    "▁ stays ▁", "a" * 3000, "x\x00y", "ﬁ ligature ½", "don't we'll THE THE the", " nbsp　wide", "1234567890 3.14", "The river", "\U0010ffff", "\n\n",
]


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_alignment_of_odd_texts(spark, block, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 64)
    rows = [(None if i == 17 else i % 15, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id int, text string, a string").repartition(3)
    got = sorted((tuple(r) for r in alignment.aligned(df, block_bytes=block).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, plain_alignment(TEXTS), strict=True)), key=str)
    assert got == want
    assert sum(w[1] > 0 for w in want) >= 10 and any(w[1] == 0 for w in want)
    assert alignment.aligned(df.limit(0)).count() == 0
    assert [tuple(r)[1:] for r in alignment.aligned(df.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_long_texts_take_the_slower_encoder(spark, monkeypatch):
    texts = ["word " * 50, "It's 12 o'clock\n\n  somewhere " * 9]
    fast = alignment.encoders(A, public_tokenizers.path("byte_bpe_50k.tiktoken"), B)[0](texts)
    monkeypatch.setattr(alignment, "LONG", 10)
    assert alignment.encoders(A, public_tokenizers.path("byte_bpe_50k.tiktoken"), B)[0](texts) == fast == alignment.encoders(A, None, B)[0](texts)


def test_alignment_query_next_to_plain(spark, sf_dir):
    docs = sorted(read(spark, sf_dir, "documents").collect())
    plain = plain_alignment([r.text for r in docs])
    want = sorted((r.doc_id, *w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for r, w in zip(docs, plain, strict=True))
    got = entries.QUERIES["op12_arrow_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", *alignment.FIELDS, "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want


# ---- main text


@pytest.fixture(scope="module")
def tree(spark):
    return htmltext.trained(spark)


def main_text(tree, page):
    blocks = htmltext.text_blocks(page)
    return [b.text for b, keep in zip(blocks, tree(htmltext.features(blocks)).tolist(), strict=True) if keep]


def test_tree_agrees_with_its_labelled_table(tree):
    from sessionrank.llm.labelled_blocks import PAGES

    wrong = 0
    for page, labels in PAGES:
        wrong += int((tree(htmltext.features(htmltext.text_blocks(page))) != (np.array(labels.split()) == "1")).sum())
    assert wrong == 0


STORY = ["A headline of five words", "The first paragraph has a good many words, so that anyone can see that it is one.", "Short.", "Another paragraph &amp; its end &lt;here&gt;, with an <b>empha</b>sis and <a href='/x'>a link</a> inside."]
PLAIN = ["A headline of five words", "The first paragraph has a good many words, so that anyone can see that it is one.", "Short.", "Another paragraph & its end <here>, with an emphasis and a link inside."]
BODY = f"<h1>{STORY[0]}</h1>" + "".join(f"<p>{p}</p>" for p in STORY[1:])
LONGER = "<p>Many words stand here too, as many as in any paragraph of a story, though they belong to something else.</p>"
AROUND = [
    "<nav><ul><li><a href='/'>Home</a><li><a href='/n'>News</a></ul></nav>",
    "<header><a href='/'>The Paper</a><p>Since 1887, for all who read in the valley and beyond</p></header>",
    f"<aside><h3>More</h3>{LONGER}</aside>",
    f"<div class='cookie-banner'>{LONGER}<button>Yes</button></div>",
    f"<div class='ad'>{LONGER}</div>",
    f"<section id='comments'><h2>2 comments</h2><article>{LONGER}</article><div class='comment'>{LONGER}</div></section>",
    f"<form><label>Your mail</label>{LONGER}<input></form>",
    "<script>var t = '<p>no text</p>';</script><style>p{}</style><noscript>Turn it on</noscript>",
    f"<footer>{LONGER}&copy; 2021</footer>",
    f"<div class='sidebar-left'>{LONGER}</div>",
    f"<div style='display: none'>{LONGER}</div>",
    f"<div class='newsletter-signup'>{LONGER}</div>",
    f"<div role='alert'>{LONGER}</div>",
    f"<ul class='share-buttons'><li><a href='/f'>Tell a friend</a></li></ul>",
    f"<!-- {LONGER} -->",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<main><article>{}</article></main>", "<div class='page'><div class='post-body entry-content'>{}</div></div>"])
def test_article_among_other_parts(tree, wrap):
    for part in AROUND:
        for page in (part + wrap.format(BODY), wrap.format(BODY) + part, "<html><body>" + part * 2 + wrap.format(BODY) + part):
            assert main_text(tree, page) == PLAIN, (part, wrap)
    inside = wrap.format(f"<h1>{STORY[0]}</h1>" + "".join(f"<p>{p}</p>{part}" for p, part in zip(STORY[1:], AROUND[3:6], strict=True)))
    assert main_text(tree, "".join(AROUND) + inside) == PLAIN


def test_unnamed_parts_by_words_and_links(tree):
    menu = "<div><a href='/'>Home</a> | <a href='/n'>News</a></div>"
    assert main_text(tree, f"{menu}<div>{BODY}</div><div><a href='/o'>Another story of the day</a></div><div>&copy; 2021 The Paper</div>") == PLAIN
    assert main_text(tree, BODY) == PLAIN


def test_blocks_of_broken_pages():
    def texts(page):
        return [b.text for b in htmltext.text_blocks(page)]

    assert texts("<p>a&nbsp;b &#65;&#x42; &amp c &bogus; &eacute;</p>") == ["a b AB & c &bogus; é"]
    assert texts("<p>one<p>two<br>lines</div></p>three <b>bo</b>ld") == ["one", "two lines", "three bold"]
    assert texts("x<!-- <p>no</p> -->y<!-->z") == ["xyz"] and texts("a<!-- open <p>b") == ["a"]
    assert texts("<p title='a > b' class=c'd>it's</p><p") == ["it's"]
    assert texts('<a href="x>y</a><p>z</p>') == ["y", "z"]
    assert texts("<SCRIPT>'</p>'</script >a<script>b") == ["a"]
    assert texts("1 < 2 <3 </ > x") == ["1 < 2 <3 x"]
    assert texts("<table><tr><td>a</td><td>b</td></tr><tr><td>c") == ["a b", "c"]
    assert texts("") == texts("  \n ") == texts("<div><br></div>") == []
    for page in ('<a "' * 100_000, "<" * 300_000, "<!--" * 100_000, "<p class='" * 50_000 + '<p x="' * 50_000, "<div>" * 50_000 + "deep", "&" * 300_000):
        texts(page)  # in linear time


def test_pages_query_keeps_whole_articles(spark, sf_dir):
    """Against a plain reading of the given pages, whose article element holds paragraphs and one headline."""
    import html
    import re

    rows = {r.page_id: r.html for r in read(spark, sf_dir, "pages").collect()}
    for r in entries.QUERIES["op13_flat_blocks"](spark, sf_dir).collect():
        own = re.search(r"<article>(.*?)</article>", rows[r.page_id] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", own.group(1)) if own else []
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_main_text_of_odd_rows(spark, tree):
    rows = [(1, None), (1, ""), (2, "<p></p>"), (3, "plain words only"), (3, "plain words only"), (4, f"<article>{'<p>long text</p>' * 20_000}</article>"), (None, "<article><p>x</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit("t"), "words": F.lit(1)})
    found = htmltext.extracted(df, tree)
    assert found.columns == ["page_id", "html", "text", "words", "_text"]
    got = sorted(((r.page_id, r["_text"]) for r in found.collect()), key=str)
    want = [(1, ""), (1, ""), (2, ""), (3, "plain words only"), (3, "plain words only"), (4, "\n\n".join(["long text"] * 20_000)), (None, "x")]
    assert got == sorted(want, key=str)
    assert htmltext.extracted(df.limit(0), tree).count() == 0
