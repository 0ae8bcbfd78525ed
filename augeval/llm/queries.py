"""The registered queries of the ten operators, each over its whole table, and their DuckDB SQL where SQL has them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augeval.session import load

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, digests of the ids and of the decoded bytes."""
    from augeval.llm.bpe import digests
    return digests(load(spark, sf_dir, "documents"))


# Jaccard at 0.9 over 3-word shingles: SQL sets per document, pairs that share a shingle, and reachability.
_OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
rare AS (SELECT doc_id, g FROM e),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
      WHERE 100 * inter >= 90 * (len(sa.sh) + len(sb.sh) - inter)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM s UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT node, min(low) AS component_id FROM r GROUP BY node) m ON m.node = s.doc_id
"""


@query("op2_ngram_jaccard_join", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at Jaccard 0.9 of their 3-word shingles: set size and link component."""
    from augeval.llm.jaccard_join import link_components
    return link_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# The ledger in SQL: the same words, lines and five-word windows, the same conditions of policy v1.
_OP4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, p, array_to_string(ws[p:p+4], ' ') AS gram FROM g),
t AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p + k) AS n FROM t, (SELECT unnest(range(5)) AS k) GROUP BY r),
m AS (SELECT d.r, d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(d.text, '[^a-z]', '', 'g')) AS n_lower
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_upper > n_upper + n_lower) AS kept
FROM b
"""


@query("op4_quality_rules", _OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger measurements of every document and the verdict of policy v1."""
    from augeval.llm.rules import apply_policy, ledger
    return apply_policy(ledger(load(spark, sf_dir, "documents")), "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents, every occurrence with its place."""
    from augeval.llm.suffix_dedup import find_passages
    return find_passages(load(spark, sf_dir, "documents")).drop("th")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model learned from the labels outside the held-out fold."""
    from augeval.llm.quality import FOLDS, score, train
    from augeval.llm.textops import crc32_mod
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, load(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model learned from the languages outside the held-out fold."""
    from augeval.llm.langid import FOLDS, HELD_OUT, predict, train
    from augeval.llm.textops import crc32_mod
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
                                             "lang_pred", "score", "rejected")


# The schedule in SQL: the same shares, the cycle slot by slot, and the documents' md5 order.
_OP9 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS src, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
c AS (SELECT src, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM d GROUP BY src),
b AS (SELECT src, 1 + (w * (1000 - count(*) OVER ())) // CAST(sum(w) OVER () AS BIGINT) AS base,
             (w * (1000 - count(*) OVER ())) % CAST(sum(w) OVER () AS BIGINT) AS rest FROM c),
s AS (SELECT src, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, src) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM b),
a AS (SELECT list(src ORDER BY src) AS srcs, list(CAST(share AS BIGINT) ORDER BY src) AS n FROM s),
e AS (SELECT -1 AS t, list_transform(n, lambda x: CAST(1 AS BIGINT)) AS nxt, n, CAST(NULL AS STRUCT(deadline BIGINT, i BIGINT)) AS p FROM a
      UNION ALL
      SELECT t + 1, list_transform(nxt, lambda v, k: CASE WHEN k = q.i THEN v + 1 ELSE v END), n, q
      FROM (SELECT t, nxt, n, list_min(list_transform(list_filter(range(1, len(n) + 1),
                     lambda k: nxt[k] <= n[k] AND ((nxt[k] - 1) * 1000) // n[k] <= t + 1),
                     lambda k: {'deadline': (nxt[k] * 1000 + n[k] - 1) // n[k], 'i': k})) AS q FROM e WHERE t < 999)),
o AS (SELECT a.srcs[p.i] AS src, CAST(t AS BIGINT) AS slot, a.n[p.i] AS share,
             row_number() OVER (PARTITION BY p.i ORDER BY t) AS j FROM e, a WHERE p IS NOT NULL),
r AS (SELECT doc_id, src, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS n FROM d),
k AS (SELECT r.doc_id, r.src, n // 32 AS block, n % 32 AS place FROM r)
SELECT k.doc_id, k.src AS source, k.block, (k.block // o.share) * 1000 + o.slot AS slot,
       (k.block // o.share) * 1000 + ((o.j - 1) * 1000) // o.share AS release,
       (k.block // o.share) * 1000 + (o.j * 1000 + o.share - 1) // o.share AS deadline, k.place
FROM k JOIN o ON o.src = k.src AND o.j = k.block % o.share + 1
"""


@query("op9_source_mixing", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and place of every document in the mixing schedule of the sources."""
    from augeval.llm.mixing import schedule
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return schedule(docs).select("doc_id", "source", "block", "slot", "release", "deadline", "place")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the template of its host."""
    from augeval.llm.template import extract
    return extract(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


_SIZES = " + ".join(f"(length(v) - length(replace(v, '{s}', ''))) // {len(s)}" for s in
                    ["\\", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"])
_OP3 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, (SELECT length(v) + {_SIZES} FROM (SELECT c.text AS v)) + (SELECT length(v) + {_SIZES} FROM (SELECT c.role AS v)) + 13 AS chars FROM c),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


@query("op3_chat_formatting", _OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1, read back from their formatted prefixes."""
    from augeval.llm.chat import digests, render
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    c = load(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(render(c.union(own)))


# Brute-force cosine within labels in double precision, links and reachability.
_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND list_sum(list_transform(e, lambda y: y * y)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.u) = len(y.u)
      WHERE list_dot_product(x.u, y.u) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op8_embedding_near_dedup", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98: links, component, kept."""
    from augeval.llm.hnsw import near_duplicates
    return near_duplicates(load(spark, sf_dir, "embeddings"))


# All pairs of anchors and rows: whole-number inner products, the first positives, the window of each.
_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * x.e[i])) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id % 50 = 0 AND x.vec_id <> a.vec_id AND len(a.e) = len(x.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector by whole-number inner products."""
    from augeval.llm.hard_negatives import mine, whole_vectors
    v = load(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine(whole_vectors(v), F.col("vec_id") % 50 == 0)


# Runs by document, crc32 as the sum without carry of each byte's share at its distance from the end, words, pairs by equal
# deletions (an inserted letter is the other word's deletion; a replaced one leaves equal texts at the same place), forms followed.
_OP12 = """
WITH RECURSIVE b(k, c, v) AS (
  SELECT 0, i, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT k + 1, c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM b WHERE k < 8),
t AS MATERIALIZED (SELECT c, v FROM b WHERE k = 8),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
r AS MATERIALIZED (SELECT doc || ':' AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM o WHERE length(run) >= 6 GROUP BY 1, 2),
y AS MATERIALIZED (SELECT doc, run, hex(encode(doc || run)) AS x, strlen(doc || run) AS size FROM r),
s(d, c, v) AS (SELECT 0, c, v FROM t UNION ALL
  SELECT d + 1, s.c, xor(s.v >> 8, t.v) FROM s JOIN t ON t.c = s.v & 255 WHERE d < (SELECT max(size) FROM y)),
z(k, v) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL
  SELECT k + 1, xor(z.v >> 8, t.v) FROM z JOIN t ON t.c = z.v & 255 WHERE k < (SELECT max(size) FROM y)),
e AS (SELECT doc, run, size, unnest(range(size)) AS i, x FROM y),
h AS (SELECT doc, run, size, bit_xor(s.v) AS part FROM e JOIN s ON s.d = size - 1 - i AND s.c =
        (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1
      GROUP BY doc, run, size),
f AS (SELECT doc, run, xor(xor(part, z.v), 4294967295) AS crc FROM h JOIN z ON z.k = h.size),
a AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
      FROM r JOIN f USING (doc, run)),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM w, range((SELECT max(length(word)) FROM w)) q(i) WHERE i < length(word)),
p AS (SELECT x.word, y.word AS form, y.n AS form_n FROM g x JOIN g y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
      UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.less
      UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.less),
m AS (SELECT word, count(*) AS n_near, first(form ORDER BY form_n DESC, form) AS form, max(form_n) AS form_n FROM p GROUP BY word),
v AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
             CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM w LEFT JOIN m USING (word)),
l(word, upto) AS (SELECT word, word FROM v UNION ALL SELECT l.word, v.form FROM l JOIN v ON v.word = l.upto WHERE v.form IS NOT NULL)
SELECT v.word, v.form, l.upto AS root, v.n, v.n_near, v.form_n
FROM v JOIN l ON l.word = v.word JOIN v u ON u.word = l.upto AND u.form IS NULL
"""


@query("op12_spelling_variants", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    from augeval.llm.spelling import count_words, variants
    return variants(count_words(load(spark, sf_dir, "documents")))


# All ten-word windows of documents and items, met by their text.
_OP13 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[p:p + 9], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
o AS (SELECT r, p, n.k, array_to_string(ws[p:p + n.k - 1], ' ') AS win
      FROM (SELECT d.r, d.ws, n.k, unnest(range(1, len(ws) - n.k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) n WHERE len(ws) >= n.k) n),
m AS (SELECT r, p, o.k, item FROM o JOIN i USING (win) WHERE o.k = i.k),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op13_decontamination", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and the items they belong to."""
    from augeval.llm.decontaminate import contamination
    c = contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
