"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_ids, bpe_count, chat_views, mixing, near_dup, quality, spm, substring, topk, url_rules
from .common import table, words


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.views(table(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.label(table(spark, sf_dir, "documents"))


def op5_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_ids.store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_rules, op2_chat_views, op3_quality_rules, op4_near_dup, op5_arrow_ids, op6_top_k, op7_mix_sources, op8_substring_dedup, op9_sentencepiece, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": OP1, "op2_chat_views": OP2, "op6_top_k": OP6, "op7_mix_sources": OP7}


OP1 = r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM cut) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path),
globs(g, m) AS (VALUES ('cheap-pills.', '%cheap-pills.%'), ('spam-farm.', '%spam-farm.%'), ('/login/', '%/login/%'), ('*casino*', '%casino%')),
hit AS (
  SELECT host, path, min(g) AS pattern
  FROM (SELECT DISTINCT host, path FROM cut) JOIN globs ON host || path LIKE m
  GROUP BY host, path)
SELECT page_id, host, path, rule, pattern, coalesce(v, CASE WHEN pattern IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM cut LEFT JOIN fit USING (host, path) LEFT JOIN hit USING (host, path)
"""

OP2 = r"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(turn // 64, -1) AS part, role, coalesce(text, '') AS text FROM conversations),
cut AS (
  SELECT *, CASE WHEN count(*) OVER (PARTITION BY conv_id, part) > 256
                 THEN (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1) // 64 ELSE 0 END AS piece
  FROM rows),
speakers AS (SELECT DISTINCT conv_id, role AS participant FROM rows WHERE role IS NOT NULL AND role <> 'system'),
said AS (
  SELECT r.conv_id, participant, part, piece, turn, role, text, coalesce(role = participant, false) AS own,
         '<|im_start|>' || CASE WHEN role IS NULL THEN 'user' WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || replace(translate(role, chr(10) || chr(13), '  '), '<|im_', '<| im_') END || chr(10) AS head,
         replace(text, '<|im_', '<| im_') || '<|im_end|>' AS body
  FROM cut r JOIN speakers s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part, piece ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM said)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, participant, part, piece
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || source, '~') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord
  FROM documents),
sums AS (SELECT src, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY src),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS DOUBLE) AS w, CAST(sum(s) OVER () AS BIGINT) AS total, 3 * s AS most FROM sums),
filled AS (
  SELECT *, (total - coalesce(CAST(sum(most) OVER (ORDER BY most / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / sum(w) OVER (ORDER BY most / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pace FROM weighed),
aims AS (SELECT src, s AS source_size, least(CAST(most AS DOUBLE), w * max(CASE WHEN pace * w <= most THEN pace END) OVER ()) AS target FROM filled),
run AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY src ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN aims USING (src)),
items AS (
  SELECT src, ord, doc_id, size, CAST(source_size * e + upto AS BIGINT) / target AS finish
  FROM run, (VALUES (0), (1), (2)) AS t(e) WHERE size > 0 AND target > 0 AND 2 * CAST(source_size * e + upto AS BIGINT) - size <= 2 * target),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, src, ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM items),
won AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM queue WHERE used <= (SELECT sum(size) FROM docs) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM run LEFT JOIN won USING (doc_id)
"""

OP6 = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
