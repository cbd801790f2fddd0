"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import chat, decontam, exact_dedup, hard_negatives, langid, line_dedup, mixing, ngram_lm, simhash, substring_dedup, token_files, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The conversation that every run formats beside the table's.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(rows))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_corpus(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         lower_az AS key
  FROM (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents))
),
keys AS (
  SELECT key, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n
  FROM lines WHERE length(key) >= 10 GROUP BY key
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(k.n >= 2 AND k.first_id <> l.doc_id, false) AS gone
  FROM lines l LEFT JOIN keys k ON l.key = k.key AND length(l.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


_ASSIGNED = """
  SELECT rid, part, entry, dist FROM (
    SELECT rid, part, entry, dist, row_number() OVER (PARTITION BY rid, part ORDER BY dist, entry) AS place
    FROM (SELECT c.rid, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS dist
          FROM cells c JOIN {book} b ON c.part = b.part AND c.pos = b.pos
          GROUP BY c.rid, c.part, b.entry))
  WHERE place = 1
"""
_MOVED = """
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x
  FROM {book} b LEFT JOIN (
    SELECT a.part, a.entry, c.pos, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM {assigned} a JOIN cells c ON a.rid = c.rid AND a.part = c.part
    GROUP BY a.part, a.entry, c.pos) m
  ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
"""
OP11_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0
),
cells AS MATERIALIZED (
  SELECT rid, (pos - 1) // (n // 16) AS part, (pos - 1) % (n // 16) AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, len(embedding) AS n, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM kept)
),
book0 AS MATERIALIZED (SELECT part, rid AS entry, pos, x FROM cells WHERE rid < 64),
assigned0 AS MATERIALIZED ({_ASSIGNED.format(book="book0")}),
book1 AS MATERIALIZED ({_MOVED.format(book="book0", assigned="assigned0")}),
assigned1 AS MATERIALIZED ({_ASSIGNED.format(book="book1")}),
book2 AS MATERIALIZED ({_MOVED.format(book="book1", assigned="assigned1")}),
codes AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM ({_ASSIGNED.format(book="book2")}) GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM kept JOIN codes USING (rid)
"""

OP13_SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings)
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(CAST(x AS DOUBLE)) OR isinf(CAST(x AS DOUBLE)))) = 0
),
scored AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.rid <> c.rid
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= 5
),
negatives AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
  WHERE 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_line_dedup": op5_line_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_language_id": op10_language_id,
        "op11_vector_codes": op11_vector_codes,
        "op12_token_files": op12_token_files,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op8_exact_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_hard_negatives": OP13_SQL}
