"""Queries that apply the operators to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.llm import binary, bpe, fim, linededup, minhash, neardup_vectors, packing, periodic, search, sharding, substring, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER).drop("ids")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_duplicate_lines(table(spark, sf_dir, "documents"))
    lines = F.size(F.split("text", "\n", -1)).cast("long")
    return out.select("doc_id", F.when(F.col("text") != "", lines).otherwise(F.lit(0)).alias("lines_kept"), F.col("lines_removed").cast("long").alias("lines_removed"), F.sha2("text", 256).alias("text_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.crc32_of(binary.read_tokens(binary.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.rearranged(table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    chars = (F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle"))
    return rows.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.drop_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs, min_length=6, min_exponent=4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_toxicity": op2_toxicity, "op3_minhash": op3_minhash, "op4_warc": op4_warc, "op5_search": op5_search, "op6_bpe": op6_bpe, "op7_lines": op7_lines, "op8_embeddings": op8_embeddings, "op9_binary": op9_binary, "op10_sharding": op10_sharding, "op11_fim": op11_fim, "op12_substring": op12_substring, "op13_runs": op13_runs}


WARC_SQL = """
WITH r AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM r
), g AS (
  SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < g.first THEN g.first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes >= 1000
"""


MINHASH_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS set
  FROM w
), n AS (
  SELECT doc_id, len(set) AS n FROM s
), t AS (
  SELECT doc_id, unnest(set) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS root, doc_id AS id FROM documents UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.id
), m AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.id = n.doc_id
"""


SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r AS (
  SELECT vec_id AS root, vec_id AS id FROM embeddings UNION SELECT r.root, l.b FROM r JOIN l ON l.a = r.id
), m AS (
  SELECT id, min(root) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


SUBSTRING_SQL = """
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), x AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS x, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
), d AS (
  SELECT r, i, count(*) OVER (PARTITION BY x) > 1 AS again FROM x
), c AS (
  SELECT r, i, word, coalesce(bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), FALSE) AS gone FROM p LEFT JOIN d USING (r, i)
), g AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g USING (r)
"""


FIM_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT)) AS h FROM u
), f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:n], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_fim": FIM_SQL, "op12_substring": SUBSTRING_SQL, "op5_search": SEARCH_SQL, "op8_embeddings": EMBEDDINGS_SQL, "op3_minhash": MINHASH_SQL, "op4_warc": WARC_SQL}
