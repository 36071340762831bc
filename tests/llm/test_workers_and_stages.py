"""Workers without the package, stages on odd and empty tables, and encoders next to the tokenizer."""

import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sessionrank.llm import chat, entries, language, mixing, tokenfile
from sessionrank.llm.common import read

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_run_where_workers_lack_the_package(tmp_path, sf_dir):
    script = tmp_path / "job.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {REPO!r})
            from pyspark.sql import SparkSession
            spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
            def seen(batches):
                for b in batches:
                    try:
                        import sessionrank
                        raise RuntimeError("workers have the package")
                    except ImportError:
                        yield b
            assert spark.range(2).mapInArrow(seen, "id long").count() == 2
            import __spark_entry__ as e
            q = e.queries()
            for name in ("op1_winnowing", "op5_cross_parsing", "op11_qdwh_whitening", "op13_flat_blocks", "knn_items"):
                print(name, len(q[name](spark, {sf_dir!r}).collect()))
            """
        )
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("\n") == 5


ODD = [
    (None, None, None, None, None),
    (None, "no id but words", "en", None, 9),
    (1, "", "en", "a", 0),
    (1, "", "en", "a", 0),
    (2, " \n\t ", "en", None, 3),
    (3, "You stupid IDIOT! Éa 日本 12 a_b", "en", "b", 30),
    (3, "You stupid IDIOT! Éa 日本 12 a_b", "en", "b", 30),
    (4, "the of and to in " * 20_000, "en", "b", 340_000),
    (5, "x", "fr", "", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("row", "toxicity", "leak", "copies", "fp", "kept", "row_kept", "run", "pile"))])


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd):
    docs = odd
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        assert step(spark, docs.limit(0), sf_dir).count() == 0
        out = step(spark, docs, sf_dir)
        rows = out.collect()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == odd.columns
            texts = {r.text for r in rows}
            assert texts <= {r[1] for r in ODD}
            if i != 1:  # one of the wordless texts stands for all
                assert ODD[7][1] in texts and (i == 3 or {"", None} <= texts)
        else:
            assert len(rows) == docs.count() and {r.n_tokens >= 1 for r in rows} == {True}
            starts = sorted((r.start, r.n_tokens) for r in rows)
            assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_one_of_wordless_rows_stays(spark, sf_dir, odd):
    kept = corpus_pipeline.without_near_copies(spark, odd, sf_dir).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 4, 5]


def test_a_crowded_last_bucket_is_ordered_in_stretches(spark):
    from sessionrank.settings import HOT_ROWS_KEY

    rows = [(i, f"{i} 12 34", "s" if i % 3 else None) for i in range(300)]  # no letters: all of weight 0.1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    spark.conf.set(HOT_ROWS_KEY, "5")
    try:
        cut = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    finally:
        spark.conf.unset(HOT_ROWS_KEY)
    assert cut == plain and set(plain.values()) > {3}


def test_rank_encoder_equals_the_tokenizer(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = tokenfile.Encoder(path), Tokenizer.from_file(path)
    random.seed(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "éüñßçøœ aeiou", "abc123!?.,;:-_()[]{}*%$#@&+=/\\|~^°«»¿¡", "áéíóú.,"]
    made = ["".join(random.choice(random.choice(letters)) for _ in range(random.randint(1, 24))) for _ in range(20_000)]
    given = [w for r in read(spark, sf_dir, "documents").collect() for w in (r.text or "").split()]
    odd = ["'", "don't", "it'S", "\x00a\x00", "...", ",.", "a,b.c", "x" * 5000, "日本,", "İ", "ǅ", "ﬁ", "é", "<|endoftext|>", "a<|b", "½", "²", "ª", "A.", "Á,"]
    for words in (made, sorted(set(given)), odd):
        for a in range(0, len(words), 500):
            text = " ".join(words[a : a + 500])
            assert encoder.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_rules_go_on_until_no_pair_is_frequent():
    seq = np.tile(np.arange(5, 13), 4096)
    last = np.zeros(len(seq), bool)
    last[-1] = True
    body, _, rules = tokenfile.repair(seq, last, 100)
    lengths, _ = tokenfile.expansions(rules, 100)
    assert len(body) < 24 * 2 and lengths[body].sum() == len(seq)


def test_scripts_are_told_apart(spark):
    alphabets = {"el": (0x3B1, 24), "ru": (0x430, 32), "ar": (0x627, 28), "hi": (0x905, 50), "zh": (0x4E00, 900), "ja": (0x3041, 80), "ko": (0xAC00, 900), "en": (0x61, 26)}
    rng = random.Random(5)

    def text(lang, n):
        first, size = alphabets[lang]
        words = [[chr(first + rng.randrange(size)) for _ in range(4)] for _ in range(60)]
        return " ".join("".join(rng.choice(words)) for _ in range(n))

    train = [(lang, text(lang, 300)) for lang in alphabets for _ in range(10)]
    test = [(lang, text(lang, 40)) for lang in alphabets for _ in range(5)]
    docs = spark.createDataFrame(test, "lang string, text string")
    told = docs.select("lang", language.identify(docs, spark.createDataFrame(train, docs.schema)).alias("x")).collect()
    assert all(r.lang == r.x.lang_pred for r in told)


def test_swapped_answers_of_odd_conversations(spark, tmp_path):
    rows = [
        (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "bye"),
        (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 2, "assistant", "yo"),
        (2, None, "user", "first"), (2, 1, "assistant", "a2"), (2, 1, "assistant", "a2"),
        (3, None, "assistant", "only"), (3, None, "user", "q"),
        (4, 1, "user", "no answer"), (5, None, None, None), (None, 1, "user", "lost"), (None, None, "assistant", "lost"),
        (6, 1, "user", "w " * 50_000), (6, 2, "assistant", "z"), (7, 1, "user", "w " * 50_000), (7, 2, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clashing = df.withColumns({"place": F.lit(1), "pair_id": F.lit(2), "last_turn": F.lit(3), "has": F.lit(True)})
    out = {r.pair_id: r for r in chat.preference_pairs(*chat.swapped_answers(clashing)).collect()}
    assert set(out) == set(range(8))
    assert out[0].chosen_turns == 1 and "yo" in out[0].rejected and "bye" not in out[0].chosen
    assert out[2].prompt_turns == 1 and "first" in out[2].prompt and out[2].chosen_turns == 2 and "only" in out[2].rejected
    assert "q" in out[3].chosen and "a2" in out[3].rejected and out[3].prompt_turns == 0
    assert out[4].prompt_turns == 1 == out[5].prompt_turns and out[4].chosen == out[4].rejected == "" == out[5].chosen
    a, b = chat.swapped_answers(clashing.limit(0))
    assert chat.preference_pairs(a, b).count() == 0
    # the query on these rows next to its SQL
    import duckdb

    from registry.check import _key

    df.repartition(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = entries.QUERIES["op7_preference_pairs"](spark, str(tmp_path))
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entries.SQL['op7_preference_pairs']})").fetchall()
    assert sorted(_key(r) for r in got.select(*cols).collect()) == sorted(_key(r) for r in want)
