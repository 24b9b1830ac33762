"""The opN queries: each applies its operator, with production parameters, to its whole table and derives the columns of
its contract. ORACLES holds SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, byte_dedup, centroids, decontaminate, hard_negatives, html_extract, katz, language_id, near_dedup, substring_dedup, token_files, topk, warc
from .common import fold_of


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, public_tokenizers.PATTERN)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 100 == 0, k=10)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.contaminated(docs, items)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents", "doc_id", "text"), fold_of(F.col("doc_id"), 7) == 2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language_id.identify(docs, fold_of(F.col("doc_id"), 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", mislabelled), F.col("vec_id") % 100 == 0)


def op12_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.describe(*centroids.cluster(_table(spark, sf_dir, "embeddings", "vec_id", "embedding")), "vec_id")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_byte_bpe, op3_topk, op4_substring_dedup, op5_decontamination, op6_minhash, op7_katz, op8_token_files, op9_language_id, op10_warc, op11_hard_negatives, op12_run_index, op13_annulus)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Base-32 digits of 20 bits of a hexadecimal number.
_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {k}) & 31 AS BIGINT) + 1, 1)" for k in (15, 10, 5, 0))

#: One round of op13: v{k}, the centroids before it, gives v{k + 1}; a{k} has the assignments.
_ROUND = """
a{k} AS (SELECT vec_id, rid, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT v.vec_id, v.rid, z.c, CAST(list_sum(list_transform(list_zip(v.e, z.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, z{k} z) GROUP BY ALL)"""
_MOVE = """,
s{k} AS (SELECT best.c AS c, j, sum(e[j]) AS s, count(*) AS n FROM (SELECT best, e, unnest(range(1, 65)) AS j FROM a{k} JOIN v USING (rid)) GROUP BY ALL),
m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS e FROM s{k} GROUP BY c),
z{next} AS (SELECT z.c, coalesce(m.e, z.e) AS e FROM z{k} z LEFT JOIN m{k} m USING (c)),"""

ORACLES: dict[str, str] = {
    "op12_run_index": """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT rid, c, substr(h, CAST(2 * c + 1 AS BIGINT), 1398) AS h FROM (SELECT *, unnest(range(0, len(h) // 2 - 199, 500)) AS c FROM d WHERE len(h) >= 400)),
win AS (SELECT rid, c + j AS i, md5(substr(h, CAST(2 * j + 1 AS BIGINT), 400)) AS k FROM (SELECT *, unnest(range(0, least(500, len(h) // 2 - 199))) AS j FROM part)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 200, -1) AS new FROM win JOIN again USING (k)),
runs AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY rid ORDER BY i) AS run FROM gone) GROUP BY rid, run),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS free FROM runs),
r AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n, max(b) AS last, string_agg(substr(h, CAST(2 * free + 1 AS BIGINT), CAST(2 * (a - free) AS BIGINT)), '' ORDER BY a) AS front FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN r USING (rid)
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.rid, c.vec_id, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
    "op13_annulus": f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
z0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS INTEGER) AS c, e FROM (SELECT * FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), e LIMIT 16)),
{"".join(_ROUND.format(k=k) + (_MOVE.format(k=k, next=k + 1) if k < 3 else "") for k in range(4))}
SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.e, ',')) AS centroid_sha256 FROM a3 a JOIN z3 z ON a.best.c = z.c
""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT rid, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT *, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM win JOIN again USING (k)),
pos AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM pos ANTI JOIN gone USING (rid, j) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)
""",
    "op6_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 75 * (p.n + q.n - m)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
g AS (SELECT page_id, i, CAST('0x' || substr(sha1(html), CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) AS v FROM (SELECT *, unnest(range(0, 8)) AS i FROM p)),
d AS (SELECT page_id, string_agg({_DIGITS}, '' ORDER BY i) AS payload_digest FROM g GROUP BY page_id)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM p JOIN d USING (page_id)
""",
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
