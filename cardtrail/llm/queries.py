"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardtrail.llm import byte_bpe, conversation_trie, divergence, exact_topk, main_text, mixing, neardup, nndescent, ppm, secret_scan, toxicity, url_filter, warc
from cardtrail.llm.common import table
from cardtrail.session import scratch_path


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_nn_descent, op3_mixing, op4_ppm_score, op5_warc, op6_toxicity, op7_byte_bpe, op8_exact_topk, op9_secrets, op10_main_text,
                                  op11_conversation_trie, op12_source_divergence, op13_url_filter)}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)""",
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5""",
    "op11_conversation_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
-- crc32 bit by bit
c AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
           lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
                                    lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t) d),
k AS (SELECT c.conv_id, count(t.pos) AS k FROM c LEFT JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h GROUP BY 1),
r AS (
  SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + k.k, role, text FROM c JOIN t USING (conv_id) JOIN k USING (conv_id) WHERE t.pos > c.h),
p AS (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         sha256(string_agg(sha256(sha256(role) || text), ',') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, min(conv_id) OVER (PARTITION BY d, key) AS node, max(d) OVER (PARTITION BY conv_id) AS stop FROM p),
n AS (
  SELECT d, node, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = stop)), sha256('')) AS ends_sha256 FROM m GROUP BY d, node),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
ch AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
l AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN ch USING (node, d)),
s AS (
  SELECT m.node, m.d, sum(l.saved) AS saved_tokens, count(*) FILTER (l.n_children = 0) AS n_leaves
  FROM l JOIN m ON m.conv_id = l.node AND m.d <= l.d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM l JOIN s USING (node, d)""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
gn AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gn.total, 0) + 2 * v.v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c.n) + 2)::HUGEINT // (any_value(ln.total) + 2 * any_value(v.v)) AS q
  FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10""",
    "op13_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
d AS (SELECT DISTINCT host, path FROM p),
f AS (
  SELECT d.host, d.path, arg_max(r.host || r.path, 1000000 * length(r.host) + length(r.path)) AS rule,
         arg_max(r.verdict, 1000000 * length(r.host) + length(r.path)) AS verdict
  FROM d JOIN r ON ('.' || d.host) LIKE ('%.' || r.host) AND starts_with(d.path, r.path) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (host, path)""",
}
