"""Trees of token counts that are kept between batches, and the learners next to plain versions."""

import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sessionrank.llm import entries, quality, simhash, tokencount, toxicity
from sessionrank.llm.common import labelled, read
from sessionrank.llm.components import forest
from sessionrank.settings import stage

EDITS = "doc_id long, edits array<struct<start:long,stop:long,new:string>>"


@pytest.fixture(scope="module")
def coding():
    return tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def edited(text, changes):
    for a, b, new in changes:
        a = min(max(a, 0), len(text))
        text = text[:a] + new + text[min(max(b, a), len(text)) :]
    return text


def test_kept_trees_follow_batches(spark, sf_dir, coding):
    """Each batch opens its own documents only; all counts and leaves equal those of encoding anew."""
    docs = read(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts)
    trees = stage(tokencount.plant(docs))
    batches = [
        {i: [(len(texts[i]) // 2, len(texts[i]) // 2 + 9, " it's\n\n 12"), (0, 0, "x")] for i in ids[::3]},
        {i: [(len(texts[i]) // 2 - 3, len(texts[i]) // 2 + 30, "  "), (3, 4, "été  ")] for i in ids[::6]},
        {ids[1]: [(0, 10**9, "")], ids[2]: [(5, 5, "")]},
        {ids[1]: [(0, 0, "born again ")], -7: [(0, 0, "nobody")]},
    ]
    for batch in batches:
        rows = spark.createDataFrame([(i, e) for i, e in batch.items()] + [(None, [(0, 0, "n")]), (ids[4], None)], EDITS)
        trees = stage(tokencount.apply_edits(trees, rows))
        texts |= {i: edited(texts[i], e) for i, e in batch.items() if i in texts}
        got = {r.doc_id: r for r in trees.select("*", tokencount.count_of().alias("n")).collect()}
        assert sorted(got) == ids
        for i, text in texts.items():
            r = got[i]
            assert r.pieces == coding.split(text) and r.n == len(coding.coding.encode_ordinary(text)), i
            assert r.tokens == coding.counts(r.pieces).tolist()
            if i not in batch:
                assert r.reencoded == 0
            elif len(r.pieces) > 200:
                assert r.reencoded < len(r.pieces) / 2


def test_kept_trees_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "no id", 7), (3, "two rows", 8), (3, "of an id", 9)], "doc_id long, text string, tokens int")
    trees = tokencount.plant(docs)
    assert trees.columns == ["doc_id", "pieces", "tokens"]
    rows = spark.createDataFrame([(1, [(0, 0, "b")]), (1, [(0, 0, "a"), None, (None, 1, "q")]), (2, []), (3, [(0, 3, "an")])], EDITS)
    got = sorted((str(r.doc_id), "".join(r.pieces), r.reencoded > 0) for r in tokencount.apply_edits(trees, rows).collect())
    assert got == sorted([("1", "ba", True), ("2", "", False), ("None", "no id", False), ("3", "an rows", True), ("3", "anan id", True)])
    assert tokencount.apply_edits(trees.limit(0), rows).count() == 0
    assert tokencount.apply_edits(trees, rows.limit(0)).where("reencoded > 0").count() == 0


def test_counts_of_all_documents(spark, sf_dir, coding):
    texts = {r.doc_id: r.text or "" for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in entries.op2(spark, sf_dir).collect():
        text = texts[r.doc_id]
        n = len(text)
        assert r.before == len(coding.coding.encode_ordinary(text))
        text = edited(text, [(n // 4, n // 4 + 17, ""), (n // 2, n // 2, " [see note 12] "), (3 * n // 4, 3 * n // 4 + 40, "It's been re-written;\n\n  twice")])
        assert r.after == len(coding.coding.encode_ordinary(text))


# learners --------------------------------------------------------------------------------------

ODD = ["", " ", "1", "A", "!", "!!", "a", "1", "YOU idiot!!", "Two  WORDS 12, twice twice", "line\nline\nother", "ünïcode Ä 日本 ...", "x" * 3_000 + " end"]

#: A sign or digit that may stand for a letter, between two letters.
HIDDEN = rb"(?<=[A-Za-z\x80-\xff])[013457@$!*_.-](?=[A-Za-z\x80-\xff])"


def test_features_of_a_text_do_not_depend_on_its_batch():
    for own in (quality.Shape(), toxicity.Featurizer([(" idiot ", 3.0)])):
        alone = np.concatenate([own.features(pa.array([t])) for t in ODD])
        assert (own.features(pa.array(ODD)) == alone).all()
        assert (own.features(pa.array(ODD[::-1]))[::-1] == alone).all()


def test_features_next_to_plain_counts(spark, sf_dir):
    texts = ODD + [r.text or "" for r in read(spark, sf_dir, "documents").select("text").limit(60).collect()]
    shape = quality.Shape().features(pa.array(texts))
    dense = toxicity.Featurizer([(" idiot ", 3.0)]).features(pa.array(texts))
    for text, q, t in zip(texts, shape, dense, strict=True):
        b = text.encode()
        size = max(1, len(b))
        words = b.split()
        capitals = len(re.findall(rb"[A-Z]", b))
        assert q[0] == t[0] == capitals / size
        assert q[1] == t[1] == len(re.findall(rb"(?<=[A-Z])[A-Z]", b)) / size
        assert t[6] == len(re.findall(HIDDEN, b)) / max(1, len(re.findall(rb"[\t-\r ]", b)) + 1)
        assert q[4] == sum(x == y and 32 < x < 127 and not chr(x).isalnum() for x, y in zip(b, b[1:])) / size
        assert t[3] == b.count(b"!") / size and t[5] == len(re.findall(rb"\d", b)) / size
        assert q[8] == b.count(b"\n") / size
        if words:
            assert math.isclose(q[11], len(set(words)) / len(words))
            assert math.isclose(q[13], sum(x == y for x, y in zip(words, words[1:])) / len(words))
        else:
            assert not q[11:].any()
        hits = len(re.findall(r"(?= idiot )", toxicity.blanked(text)))
        assert math.isclose(t[9], math.log1p(hits))


def test_lexicon_next_to_plain_odds(spark, sf_dir):
    sample = stage(labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "toxic", 10_000))
    rows = [(toxicity.terms(toxicity.blanked(r.text)), r.label) for r in sample.collect()]
    pos, neg = (sum(label == k for _, label in rows) for k in (1, 0))
    want = {}
    for term in set().union(*(t for t, _ in rows)):
        p = sum(label == 1 and term in t for t, label in rows)
        if p < max(toxicity.MIN_TEXTS, math.ceil(toxicity.MIN_SHARE * pos)):
            continue
        a, b = p + 0.5, sum(label == 0 and term in t for t, label in rows) + 0.5
        odds = math.log(a / (pos + 1 - a)) - math.log(b / (neg + 1 - b))
        if odds - 1.64 * math.sqrt(1 / a + 1 / b) > math.log(toxicity.MIN_ODDS):
            want[term] = odds
    got = dict(toxicity.lexicon(sample, 10**6))
    assert want and got.keys() == want.keys()
    assert all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)


def test_quality_next_to_plain_bradley_terry(spark, sf_dir):
    """The order of the scores is that of a plain fit to all pairs of the labelled texts."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    sample = labelled(docs, labels, "quality", 10_000).collect()
    x = quality.Shape().features(pa.array([r.text for r in sample]))
    y = np.array([r.label for r in sample])
    gap = (x[y == 1][:, None] - x[y == 0][None, :]).reshape(-1, x.shape[1])
    spread = np.where(gap.std(axis=0) > 0, gap.std(axis=0), 1)
    gap = gap / spread
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        grad = gap.T @ (p - 1) / len(gap) + 0.001 * w
        w -= np.linalg.solve((gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + 0.001 * np.eye(len(w)), grad)
    every = docs.select("doc_id", "text").where("text is not null")
    got = {r.doc_id: r.quality for r in quality.scored(every, docs, labels).collect()}
    texts = {r.doc_id: r.text for r in every.collect()}
    ids = sorted(got)
    plain = quality.Shape().features(pa.array([texts[i] for i in ids])) @ (w / spread)
    places = [np.argsort(np.argsort(v)) for v in (plain, np.array([got[i] for i in ids]))]
    assert np.corrcoef(*places)[0, 1] > 0.9


def test_deep_trees_lose_no_pair(spark, monkeypatch):
    """More leaves than fingerprints: the pairs of all against all."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, np.int64)
    near = base[:60] ^ (np.int64(1) << rng.integers(0, 63, 60)) ^ (np.int64(1) << rng.integers(0, 63, 60))
    fp = np.unique(np.concatenate([base, near, base[:20] ^ np.int64(7)]))
    prints = spark.createDataFrame([(int(v), i) for i, v in enumerate(fp)], "fp long, doc_id long")
    monkeypatch.setattr(simhash, "MAX_LEVELS", 9)
    got = {r.fp: r.component_id for r in simhash.groups(prints, leaf_rows=1).collect()}
    i, j = simhash.close_pairs(fp.view(np.uint64), fp.view(np.uint64), 2, True)
    low = forest(i, j, len(fp))
    assert got == {int(v): int(low[k]) for k, v in enumerate(fp)}
