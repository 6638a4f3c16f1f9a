"""Registered queries opN_<name>, their SQL, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jaccard, media, mixing, quality, secrets, sharding, substrings, token_files
from .common import prepare


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document."""
    return secrets.digests(_read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that remain of each document once repeats of 13 words are removed."""
    return substrings.remove_repeats(_read(spark, sf_dir, "documents"), length=13, with_text=False)


def op4_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document stored as motion-JPEG and read back."""
    return media.digests(_read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document as read back from token files."""
    return token_files.digests(_read(spark, sf_dir, "documents"), _tokenizer())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's ids and of the text that they decode to."""
    return bpe.digests(_read(spark, sf_dir, "documents"), _tokenizer())


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.round("_target", 6).alias("target"), F.col("_taken").alias("taken")
    )


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document; shard counts differ by one at most."""
    docs = _read(spark, sf_dir, "documents")
    out = sharding.shuffle_into_shards(docs, shards=16, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have similarity 0.9 or more."""
    return jaccard.components(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_links": op1_embedding_links,
    "op2_secrets": op2_secrets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_avi": op4_avi,
    "op5_token_files": op5_token_files,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_mix_sources": op8_mix_sources,
    "op9_shard": op9_shard,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

ORACLES: dict[str, str] = {
    "op8_mix_sources": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS k
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM per
), weighed AS (
  SELECT source, source_size, CAST(r % 3 + 1 AS DOUBLE) AS w, 3.0 * source_size AS stop FROM ranked
), filled AS (
  SELECT *, (SELECT sum(source_size) FROM weighed) - coalesce((SELECT sum(b.stop) FROM weighed b WHERE b.stop / b.w < a.stop / a.w), 0) AS rest,
         (SELECT sum(b.w) FROM weighed b WHERE b.stop / b.w >= a.stop / a.w) AS open_w
  FROM weighed a
), lev AS (
  SELECT min_by(rest / open_w, stop / w) AS level FROM filled WHERE rest * w <= stop * open_w
), goal AS (
  SELECT source, source_size, CAST(CASE WHEN level IS NULL THEN stop ELSE least(stop, level * w) END AS DOUBLE) AS target FROM weighed, lev
), running AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, round(g.target, 6) AS target,
       CAST(floor(round(g.target) / greatest(g.source_size, 1)) * d.size
         + greatest(0, least(d.size, round(g.target) - floor(round(g.target) / greatest(g.source_size, 1)) * g.source_size - d.before)) AS BIGINT) AS taken
FROM running d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
""",
    "op1_embedding_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
         label IS NOT NULL AND coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS sound
  FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND a.sound AND b.sound
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
""",
    "op2_secrets": r"""
WITH patterns(kind, place, pattern, shortest, part) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
  ('access', 1, '(AKIA[A-Z0-9]+)()', 20, 1),
  ('hex', 2, '([0-9a-f]+)()', 24, 1)
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, kind, place, shortest, string_split_regex(text, pattern) AS gaps, regexp_extract_all(text, pattern, 0) AS hits,
         CASE part WHEN 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern, 1) END AS parts
  FROM docs, patterns
), hit AS (
  SELECT doc_id, kind, place, shortest, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, parts FROM cut
), span AS (
  SELECT doc_id, kind, place, len(hits[i]) AS n, CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS BIGINT) AS start
  FROM hit WHERE len(parts[i]) >= shortest
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, place) AS spans
  FROM span GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)
""",
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS content FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), first AS (
  SELECT content, min(doc_id) AS least FROM windows GROUP BY content
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN first USING (content) WHERE doc_id > least
), every AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM every ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (before IS DISTINCT FROM place - 1) AS stretches FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM gone) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, coalesce(stretches, 0) AS n_repeats, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
""",
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 2], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""",
}
