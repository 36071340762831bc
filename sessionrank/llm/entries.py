"""The operators of this package as queries on the given tables, with SQL where it can say the same."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionrank.llm import (
    alignment, chat, decontaminate, htmltext, language, mixing, quality, simhash, tokencount, tokenfile, toxicity, vectors, whitening,
)
from sessionrank.llm.common import batched, read
from sessionrank.settings import shared_dir

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def dealt(parts: int, part: int) -> Column:
    """Whether the CRC-32 of doc_id as text leaves this remainder; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return digest1(found)


def digest1(found: DataFrame, leak: str = "leak") -> DataFrame:
    length = F.zip_with(f"{leak}.stops", f"{leak}.starts", lambda b, a: b - a)
    n_hit = F.aggregate(length, F.lit(0).cast("long"), lambda s, v: s + v)
    items = F.array_join(F.array_sort(F.transform(f"{leak}.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col(f"{leak}.n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{leak}.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP1_SQL = f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", tokencount.review_edits().alias("edits"))
    return tokencount.recount(docs).select("doc_id", "tokens.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    tokenfile.write(read(spark, sf_dir, "documents"), path)
    return tokenfile.read_back(spark, path)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v
      WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT c.node, l.b FROM c JOIN l ON c.seen = l.a),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON vec_id = node LEFT JOIN k ON vec_id = a
"""


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    told = language.identify(docs, docs.where(~dealt(3, 1)))
    return docs.select("doc_id", dealt(3, 1).alias("held_out"), told.alias("told")).select("doc_id", "held_out", "told.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = chat.swapped_answers(read(spark, sf_dir, "conversations"))
    pairs = chat.preference_pairs(chosen, rejected)

    def spans(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))), ",").alias(c)

    return pairs.select(
        "pair_id",
        *[F.md5(c).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")],
        *[F.length(c).cast("long").alias(f"{c}_chars") for c in ("prompt", "chosen", "rejected")],
        *[F.col(f"{c}_turns").cast("long").alias(f"{c}_turns") for c in ("prompt", "chosen", "rejected")],
        spans("chosen_mask"),
        spans("rejected_mask"),
    )


def _side7(side: str) -> str:
    return f"""
{side}x AS (SELECT x.*, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS part,
         length(coalesce(role, 'unknown')) + 5 AS head, length(coalesce(text, '')) + 8 AS body, split
    FROM {side}n x JOIN splits USING (pair_id)),
{side}l AS (SELECT *, sum(CASE WHEN place >= split THEN head + body ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY place) - head - body AS pos FROM {side}x),
{side}a AS (SELECT pair_id, string_agg(part, '' ORDER BY place) FILTER (place < split) AS prompt,
         string_agg(part, '' ORDER BY place) FILTER (place >= split) AS own,
         count(*) FILTER (place < split) AS prompt_turns, count(*) FILTER (place >= split) AS turns,
         string_agg(CAST(CAST(pos + head AS BIGINT) AS VARCHAR) || ':' || CAST(body AS VARCHAR), ',' ORDER BY place)
           FILTER (place >= split AND role = 'assistant') AS mask
    FROM {side}l GROUP BY 1),"""


OP7_SQL = f"""
WITH t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last_turn, count(*) FILTER (role = 'assistant') > 0 AS has FROM t GROUP BY 1),
an AS (SELECT conv_id, last_turn, max(text) AS answer FROM t JOIN la USING (conv_id) WHERE turn IS NOT DISTINCT FROM last_turn AND role = 'assistant' GROUP BY 1, 2),
c AS (SELECT conv_id AS pair_id, turn, role, text, last_turn, has FROM t JOIN la USING (conv_id) WHERE NOT has OR turn IS NULL OR turn <= last_turn),
r AS (SELECT pair_id, turn, role, text FROM c WHERE NOT has OR turn < last_turn OR (turn IS NULL AND last_turn IS NOT NULL)
      UNION ALL
      SELECT a.conv_id, a.last_turn, 'assistant', b.answer FROM an a JOIN an b ON b.conv_id = a.conv_id + 1 - 2 * (a.conv_id % 2)),
cn AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM c),
rn AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM r),
splits AS (SELECT pair_id, coalesce(min(CASE WHEN cn.place IS NULL OR rn.place IS NULL OR cn.role IS DISTINCT FROM rn.role
             OR cn.text IS DISTINCT FROM rn.text THEN place END), 2147483647) AS split
           FROM cn FULL JOIN rn USING (pair_id, place) GROUP BY 1),
{_side7("c")}
{_side7("r")}
o AS (SELECT s.pair_id, coalesce(ca.prompt, '') AS prompt, coalesce(ca.own, '') AS chosen, coalesce(ra.own, '') AS rejected,
        coalesce(ca.prompt_turns, 0) AS prompt_turns, coalesce(ca.turns, 0) AS chosen_turns, coalesce(ra.turns, 0) AS rejected_turns,
        coalesce(ca.mask, '') AS chosen_mask, coalesce(ra.mask, '') AS rejected_mask
      FROM splits s LEFT JOIN ca ON s.pair_id = ca.pair_id LEFT JOIN ra ON s.pair_id = ra.pair_id)
SELECT pair_id, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5,
  length(prompt) AS prompt_chars, length(chosen) AS chosen_chars, length(rejected) AS rejected_chars,
  prompt_turns, chosen_turns, rejected_turns, chosen_mask, rejected_mask
FROM o
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, docs, read(spark, sf_dir, "labels").where(~dealt(5, 0)), name="score")
    return found.select("doc_id", dealt(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    greatest(0.1, coalesce(CAST(length(regexp_replace(text, '[^\p{L}\x20\x09-\x0D]', '', 'g')) AS DOUBLE) / greatest(length(text), 1), 0)) AS weight,
    md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS tie FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(tie, 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)) / weight AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
o AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS share FROM s),
p AS (SELECT *, row_number() OVER q AS pos,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(share) OVER () - coalesce(sum(share) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shares_left
  FROM o WINDOW q AS (ORDER BY CAST(3 * source_size AS DOUBLE) / share, source ASC NULLS LAST)),
f AS (SELECT * FROM p WHERE 3 * source_size * shares_left >= share * words_left ORDER BY pos LIMIT 1),
t AS (SELECT p.source, p.source_size, CASE WHEN p.pos < f.pos THEN CAST(3 * p.source_size AS DOUBLE)
    ELSE coalesce(CAST(p.share * f.words_left AS DOUBLE) / CAST(f.shares_left AS DOUBLE), 0) END AS target FROM p LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, e.source_size, target, epochs, target - epochs * e.source_size AS part,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, tie) - CAST(size AS DOUBLE) / 2 AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scored(docs, docs, read(spark, sf_dir, "labels").where(~dealt(4, 2)), name="score")
    return found.select("doc_id", dealt(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "white", F.posexplode("white.whitened").alias("pos", "whitened"))
    return each.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        "white.n",
        "white.deviation",
        "whitened",
        F.get("white.explained", F.col("pos")).alias("explained"),
        "white.identity_error",
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(read(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select(F.col("doc_id").cast("long"), *alignment.FIELDS, digest.alias("groups_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_winnowing": op1,
    "op2_edit_counts": op2,
    "op3_repair_files": op3,
    "op4_hyperplane_dedup": op4,
    "op5_cross_parsing": op5,
    "op6_simhash_tree": op6,
    "op7_preference_pairs": op7,
    "op8_boosted_toxicity": op8,
    "op9_weighted_mix": op9,
    "op10_pairwise_quality": op10,
    "op11_qdwh_whitening": op11,
    "op12_arrow_alignment": op12,
    "op13_flat_blocks": op13,
}
QUERIES = {name: batched(build) for name, build in QUERIES.items()}
SQL = {"op1_winnowing": OP1_SQL, "op4_hyperplane_dedup": OP4_SQL, "op7_preference_pairs": OP7_SQL, "op9_weighted_mix": OP9_SQL}
