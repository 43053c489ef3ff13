"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import format_chats
from .common import table
from .decontaminate import contaminated
from .language_model import score_texts
from .near_dedup import near_groups
from .quality import score_quality
from .sentence_pieces import encode_texts
from .suffix_dedup import repeat_digest
from .topk import top_k
from .toxicity import score_toxicity
from .url_rules import judge_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_sentence_pieces(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op5_near_dedup(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return repeat_digest(table(spark, sf_dir, "documents"), min_len=200, keep_first=False)


def op7_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_sentence_pieces, op2_lm_scoring, op3_toxicity, op4_exact_topk, op5_near_dedup, op6_suffix_dedup, op7_decontamination, op8_quality, op9_url_rules, op10_chat_format, pipeline)}


SQL_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, coalesce(m.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id
"""

SQL_REPEATS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS p, x FROM d WHERE length(x) >= 400),
f AS (SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS f FROM w),
k AS (SELECT f FROM f GROUP BY f HAVING count(*) > 1),
c AS (SELECT r, p, CASE WHEN p <= max(p + 200) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f JOIN k USING (f)),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM c),
s AS (SELECT r, i, min(p) AS s, max(p) + 200 AS e FROM i GROUP BY r, i),
l AS (SELECT d.r, s.s, s.e, d.x, coalesce(lag(s.e) OVER (PARTITION BY d.r ORDER BY s.s), 0) AS before, row_number() OVER (PARTITION BY d.r ORDER BY s.s DESC) AS back FROM s JOIN d USING (r)),
g AS (SELECT r, sum(e - s) AS gone, count(*) AS n, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || max(CASE WHEN back = 1 THEN substr(x, 2 * e + 1) ELSE '' END) AS x FROM l GROUP BY r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(g.x, d.x))) AS kept_sha256
FROM d LEFT JOIN g ON g.r = d.r
"""

SQL_URLS = """
WITH a AS (SELECT page_id, url, strpos(url, '://') AS mark FROM pages),
b AS (SELECT page_id, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest, coalesce(mark > 0, false) AS ok FROM a),
c AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM b),
r(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT c.page_id, c.host, c.path, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY c.page_id ORDER BY length(rhost || rpath) DESC) AS n
      FROM c LEFT JOIN r ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""

SQL_CHAT = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
p AS (SELECT conv_id, pos, lead(1) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS last,
             string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS text FROM t),
w AS (SELECT pos, text, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE last GROUP BY pos, text)
SELECT conv_id, CAST(pos AS INTEGER) AS n_turns, n_copies, text FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.last AND p.pos = w.pos AND p.text = w.text)
"""


def oracle_sql():
    return {"op4_exact_topk": SQL_TOPK, "op5_near_dedup": SQL_NEAR, "op6_suffix_dedup": SQL_REPEATS, "op9_url_rules": SQL_URLS, "op10_chat_format": SQL_CHAT}
