"""The operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, mixing, ngram, pii, quality, token_counts, toxicity, transport, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by a model of those whose remainder is not 1; a null doc_id has no remainder and is trained on."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = ngram.language_model_scores(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents by a model of labelled ones whose remainder is not 2; a null doc_id has no remainder and is not held out."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train=part != 2)
    return scored.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_column(_table(spark, sf_dir, "documents"), keep_media=False).drop("media", "times", "access")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no address: the source stands for the host, the language within it for the path
    documents = _table(spark, sf_dir, "documents")
    return quality.quality(documents, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: sizes and targets."""
    return op4_mixing(spark, sf_dir).drop("taken")


def transport_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the payloads as read back from the streams."""
    return op5_transport_stream(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op8: the base spans by kind."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: the sizes of the texts."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


_OPS = (op1_minhash_near_dedup, op2_ngram_scores, op3_toxicity, op4_mixing, op5_transport_stream, op6_warc, op7_quality, op8_pii, op9_token_counts, op10_decontamination)
QUERIES = {f.__name__: f for f in (*_OPS, mixing_targets, transport_payloads, personal_data_counts, token_bytes)}

OP1_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(h) AS n, sha256(h) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to FROM r
"""

TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
w AS (SELECT source, sum(size) AS n, 2.0::DOUBLE * sum(size) AS cap, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above, 1.5::DOUBLE * sum(n) OVER () AS total FROM w),
z AS (SELECT arg_min((total - below) / above, cap / w) AS level FROM l WHERE (total - below) / above * w <= cap)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, least(cap, level * w) AS target FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, z
"""

PAYLOADS_SQL = """
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT *, greatest(1, (n + 575) // 576) * 576 AS m FROM p)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || unhex(repeat('FF', (m - n)::BIGINT))) AS payload_sha256 FROM q
"""

_LUHN = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (reverse(x)[i]::INT * (2 - i % 2)) - CASE WHEN reverse(x)[i]::INT * (2 - i % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
PERSONAL_SQL = rf"""
WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g'))) AS x FROM p),
k AS (SELECT doc_id, count(*) AS n FROM c WHERE len(x) BETWEEN 13 AND 19 AND {_LUHN} GROUP BY doc_id)
SELECT p.doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda y: y::DOUBLE)) <= 255))::BIGINT AS n_ip,
  coalesce(k.n, 0) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM p LEFT JOIN k USING (doc_id)
"""

BYTES_SQL = "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents"

SQL = {"op1_minhash_near_dedup": OP1_SQL, "op6_warc": OP6_SQL, "mixing_targets": TARGETS_SQL, "transport_payloads": PAYLOADS_SQL, "personal_data_counts": PERSONAL_SQL, "token_bytes": BYTES_SQL}
