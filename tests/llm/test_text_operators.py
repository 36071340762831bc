"""Operators on documents against plain versions, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionrank.llm import chat, decontaminate, entries, language, mixing, quality, simhash, tokencount, tokenfile, toxicity
from sessionrank.llm.common import read
from sessionrank.settings import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, a long text, and columns with the operators' own names."""
    rows = [
        (None, None, None, None, None),
        (1, "", "en", "a", 0),
        (1, "", "en", "a", 0),
        (2, " \n\t ", "en", None, 3),
        (3, "You stupid IDIOT! Éa 日本 12 a_b", "en", "b", 30),
        (3, "You stupid IDIOT! Éa 日本 12 a_b", "en", "b", 30),
        (4, "the of and to in " * 20_000, "en", "b", 340_000),
        (5, "x", "fr", "", 1),
        (None, "one two three four five six seven eight nine ten eleven", "de", "c", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = ["row", "row_no", "row_kept", "leak", "tokens", "toxicity", "quality", "features", "prediction", "copies", "size", "key", "name", "fp", "label", "edits"]
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}


# 1 ---------------------------------------------------------------------------------------------

PATTERN = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return PATTERN.findall((text or "").translate(ASCII_LOWER))


def plain_leaks(texts, items, span=10):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, own = plain_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    own |= got
        out.append((len(w), len(hit), sorted(i for i in own if i is not None)))
    return out


def spanned(rows):
    return [(r.leak.n_words, sum(b - a for a, b in zip(r.leak.starts, r.leak.stops)), list(r.leak["items"])) for r in rows]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_leaks_are_those_of_all_windows(spark, block):
    random.seed(3)
    word = lambda: random.choice(["a", "b", "A", "é", "x1", "the"])
    items = [(i, " ".join(word() for _ in range(random.choice([1, 3, 9, 10, 12, 40])))) for i in range(25)]
    items += [(90, None), (91, "..."), (None, "lonely words of nobody at all in here and there"), (3, items[3][1]), (92, items[4][1])]
    texts = [" ".join(word() for _ in range(random.randint(0, 60))) for _ in range(40)]
    texts += [f"say, {t}. ok" for _, t in items if t] + [None, "", "a" * 50_000, "a " * 3000]
    docs = docs_of(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block).orderBy("doc_id").collect()
    assert spanned(got) == plain_leaks(texts, items)


def test_leaks_of_given_tables(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    bench = read(spark, sf_dir, "benchmark")
    want = plain_leaks(texts.values(), [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = {r.doc_id: r for r in entries.op1(spark, sf_dir).collect()}
    for (doc_id, _), (words, hit, items) in zip(texts.items(), want, strict=True):
        r = got[doc_id]
        listed = ",".join(sorted(map(str, items)))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (words, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_leaks_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).count() == odd.count()
    bench = spark.createDataFrame([(7, "zwei One two THREE four five six seven eight nine ten")], "item_id long, text string")
    out = decontaminate.clean(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() - 1
    assert decontaminate.clean(odd.limit(0), bench).count() == 0


# 2 ---------------------------------------------------------------------------------------------


def test_counts_follow_edits():
    counter = tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    random.seed(1)
    parts = ["a", "  ", " ", "\n", "'s", "'", "don't", "word", "été", " 12", "...", "!?", "\t\n  ", "x y", "   z", "日本"]
    some = lambda n: "".join(random.choice(parts) for _ in range(random.randint(0, n)))
    for _ in range(600):
        text = some(40)
        tree = tokencount.Tree(text, counter)
        for _ in range(random.randint(1, 5)):
            a = random.randint(0, len(text) + 1)
            b, new = a + random.randint(0, 6), some(3)
            tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert tree.text() == text
            assert tree.tokens == len(counter.coding.encode_ordinary(text))


def test_counts_of_odd_rows(spark, odd, sf_dir):
    edits = F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(2).cast("long").alias("stop"), F.lit("q").alias("new")), F.lit(None))
    out = tokencount.recount(odd.withColumn("edits", edits))
    assert out.columns[-1] == "_tokens" and out.count() == odd.count()
    assert out.where("text is null").first()["_tokens"].after == 1
    coding = tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken")).coding
    for r in entries.op2(spark, sf_dir).join(read(spark, sf_dir, "documents"), "doc_id").limit(40).collect():
        text = r.text
        n = len(text)
        assert r.before == len(coding.encode_ordinary(text))
        for a, size, new in ((n // 4, 17, ""), (n // 2, 0, " [see note 12] "), (3 * n // 4, 40, "It's been re-written;\n\n  twice")):
            text = text[:a] + new + text[a + size :]
        assert r.after == len(coding.encode_ordinary(text))


# 3 ---------------------------------------------------------------------------------------------


def test_files_give_back_all_ids(spark, sf_dir):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    texts = texts_of(spark, sf_dir)
    got = {r.doc_id: r for r in entries.op3(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for doc_id in sorted(texts):
        ids = np.array([*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_encode_as_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, tok = tokenfile.Encoder(path), Tokenizer.from_file(path)
    random.seed(5)
    parts = ["It's", "IDIOT.", "a.b,", "x..", "été", "Éa", "́", "İI", "ΣΑΣ", "12,", "<|endoftext|>", "<|EndOfText|>", "日本。", " b", " ", "won't,", "“q”", "A1b2.", "...", "ſ."]
    for _ in range(400):
        text = "".join(random.choice(parts) + random.choice(["", " ", "\n", "\t "]) for _ in range(8))
        assert own.encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_grammar_expands_and_slices():
    random.seed(2)
    seq = np.array([random.choice([1, 2, 3, 3, 3, 9]) for _ in range(5000)] + [7] * 3000)
    last = np.zeros(len(seq), bool)
    last[sorted(random.sample(range(len(seq)), 40))] = True
    last[-1] = True
    body, ends, rules = tokenfile.repair(seq, last, 10, min_count=4)
    lengths = tokenfile.expansions(rules, 10)[0][10:]
    block = tokenfile.Block({"terminals": 10, "rules": rules.astype(np.int32).tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "body": body.astype(np.uint16).tobytes()})
    assert (block.ids() == seq).all() and len(body) < len(seq) / 2
    # symbols end where documents end
    assert (np.cumsum(block.lengths[block.body])[ends - 1] == np.flatnonzero(last) + 1).all()
    for _ in range(100):
        a = random.randrange(len(seq))
        b = random.randrange(a, len(seq) + 1)
        assert (block.slice(a, b) == seq[a:b]).all()


def test_files_of_odd_rows(spark, odd):
    path = shared_dir(spark)
    tokenfile.write(odd, path, block_tokens=50)
    rows = tokenfile.read_back(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1, 1]
    empty = shared_dir(spark)
    tokenfile.write(odd.limit(0), empty)
    assert tokenfile.read_back(spark, empty).count() == 0


# 5 ---------------------------------------------------------------------------------------------


def plain_phrases(text, sample):
    """Longest matches in a sample, by search."""
    n, a = 0, 0
    while a < len(text):
        b = a + 1
        while b <= len(text) and text[a:b] in sample:
            b += 1
        done = b <= len(text)
        n += done
        a = max(b - 1, a + 1)
    return n


def test_automata_find_longest_matches():
    sample = {"x": "abracadabra abba", "y": "the cat sat on the mat"}
    parser = language.Parser(sample)
    random.seed(4)
    texts = ["".join(random.choice("abrc tehmons") for _ in range(random.randint(1, 200))) for _ in range(30)]
    width = max(map(len, texts))
    codes = np.zeros((width, len(texts)), np.int32)
    for i, t in enumerate(texts):
        codes[: len(t), i] = parser.code[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
    got = parser.phrases(codes)
    for k, name in enumerate(parser.names):
        for i, t in enumerate(texts):
            # with classes: characters outside all samples are one class, in none of them
            assert abs(int(got[k, i]) - plain_phrases(t, sample[name])) <= sum(ch not in sample[name] for ch in t)
            if all(ch in sample[name] for ch in t):
                assert int(got[k, i]) == plain_phrases(t, sample[name])


def test_languages_of_held_out_texts(spark, sf_dir):
    out = entries.op5(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = out.where("held_out and length(text) > 200").collect()
    assert len(rows) > 20 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_language_samples_fold_copies_and_read_whole_texts(spark):
    random.seed(5)

    def prose(n):
        return " ".join("".join(random.choice("abcdefghij") for _ in range(7)) for _ in range(n // 8))

    # the first in the order of the signed hash is the one with copies
    few = sorted((prose(600) for _ in range(40)), key=lambda t: (xxhash.xxh64(t, seed=42).intdigest() + 2**63) % 2**64)
    opening = prose(400)
    long = [opening + prose(30_000) for _ in range(3)]
    short = [prose(16) for _ in range(3_000)]
    rows = [("copied", few[0])] * 1_000 + [("copied", t) for t in few[1:]] + [("long", t) for t in long] + [("short", t) for t in short]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = language.samples(docs)
    assert all(len(found[x]) == language.CHARS for x in ("copied", "long", "short"))
    spans = found["copied"].split("\n")
    assert len(set(spans)) == len(spans) and all(any(span in t for span in spans) for t in few)
    assert sum(span[:300] in opening for span in found["long"].split("\n")[:-1]) <= 3
    assert found == language.samples(docs.repartition(5).unionByName(docs))


def test_languages_of_odd_rows(spark, odd):
    said = odd.select("doc_id", "text", language.identify(odd, odd).alias("x")).collect()
    assert {r.x.lang_pred for r in said if not (r.text or "").strip()} == {"und"}
    nothing = odd.select(language.identify(odd, odd.limit(0)).alias("x")).collect()
    assert {(r.x.lang_pred, r.x.score) for r in nothing} == {("und", 0.0)}


# 6 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_groups(prints, distance=2):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprints_and_groups_of_given_tables(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, plain_groups(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in entries.op6(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("parts", [1, 2, 3])
@pytest.mark.parametrize("cell", [8192, 40])
def test_tree_loses_no_pair(spark, parts, cell):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    flips = [base]
    for _ in range(8):
        x = base.copy()
        for _ in range(rng.integers(1, 4)):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        flips.append(x)
    chain = np.array([(1 << k) - 1 for k in range(0, 61, 2)], np.uint64)
    x = np.unique(np.concatenate([*flips, chain, np.array([2**64 - 1], np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").withColumn("doc_id", F.col("fp"))
    got = {r.fp: r.component_id for r in simhash.groups(df, parts=parts, leaf_rows=20, cell_rows=cell).collect()}
    signed = [int(v) for v in x.view(np.int64)]
    own = plain_groups([int(v) for v in x])
    least = {}
    for v, g in zip(signed, own, strict=True):
        least[g] = min(least.get(g, v), v)
    assert got == {v: least[g] for v, g in zip(signed, own, strict=True)}


def test_near_copies_of_odd_rows(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert {r.component_id for r in found if r.fp == 0} == {1}
    kept = simhash.one_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id = 1").count() == 1
    assert kept.where("text is null").count() == 0  # in the group of empty texts
    assert simhash.one_each(odd.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    kind = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "bye"), (2, 0, None, None), (3, 0, "user", "x"), (None, 0, "user", "y")], kind)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "bye"), (2, 0, None, None), (4, 0, "assistant", "z")], kind)
    out = {r.pair_id: r for r in chat.preference_pairs(a, b).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    r = out[1]
    assert r.prompt == "<|user|>\nhi<|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nbye<|end|>\n"
    assert r.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nbye<|end|>\n"
    (s, n), = r.chosen_mask
    assert r.chosen[s : s + n] == "good<|end|>\n" and [len(r.rejected_mask), r.prompt_turns] == [1, 1]
    assert (out[2].prompt, out[2].chosen, out[2].rejected) == ("<|unknown|>\n<|end|>\n", "", "")
    assert (out[3].prompt, out[3].rejected, out[4].chosen) == ("", "", "")
    assert chat.preference_pairs(a.limit(0), b.limit(0)).count() == 0


# 8, 10 -----------------------------------------------------------------------------------------


def agreement(spark, sf_dir, out, target):
    rows = out.join(read(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return np.mean([r.predicted == r[target] for r in rows])


def test_toxicity_of_held_out_texts(spark, sf_dir):
    assert agreement(spark, sf_dir, entries.op8(spark, sf_dir), "toxic") > 0.8
    assert entries.op8(spark, sf_dir).count() == read(spark, sf_dir, "documents").count()


def test_quality_of_held_out_texts(spark, sf_dir):
    assert agreement(spark, sf_dir, entries.op10(spark, sf_dir), "quality") > 0.8


def test_disguised_words_are_found():
    words = [(" idiot ", 3.0)]
    import pyarrow as pa

    x = toxicity.Featurizer(words).features(pa.array(["you idiot", "you 1d1ot", "fine words", None, ""]))
    assert x[0, 9] > 0 and x[0, 13] > 0 and x[1, 9] == 0 and x[1, 14] > 0 and x[2, 9] == x[2, 14] == 0
    assert not x[3, 8:].any() and not x[4, 8:].any()


@pytest.mark.parametrize("module, target", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_odd_rows(spark, odd, module, target):
    kind = f"doc_id long, {target} int"
    for labels in ([], [(3, 1)], [(3, 1), (1, 0), (None, 1), (4, None), (99, 1), (3, 1)]):
        out = module.scored(odd, odd, spark.createDataFrame(labels, kind))
        got = out.collect()
        assert len(got) == odd.count() and out.columns[:-1] == odd.columns
        assert all(0 <= r[-1] <= 1 for r in got)
    assert module.scored(odd.limit(0), odd, spark.createDataFrame([], kind)).count() == 0


# 9 ---------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(share[s] for s in open_)
        over = {s for s in open_ if left * share[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * share[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_targets(spark):
    random.seed(8)
    rows = [(i, "w " * random.randint(0, 40), None, random.choice(["a", "B", "b", "é", None, "z", "", "tiny"])) for i in range(3000)]
    rows = [r for r in rows if r[3] != "tiny" or r[0] < 200]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    taken: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 21
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_documents(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    want = {}
    for r in mixing.mix(odd).collect():
        want[(r.doc_id, r.size)] = want.get((r.doc_id, r.size), 0) + r.copies
    got = {}
    for r in out.collect():
        k = (r.doc_id, len(regex.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0
