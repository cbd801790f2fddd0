"""Exact document dedup by content-defined chunk recipes (native).

Each text is cut where its own content says so (a line or sentence end after a
minimum length, a hard limit else), chunks are deduplicated to *verified*
identifiers, and documents are equal when their ordered identifier lists are.
Long texts are moved once, as distinct chunks; documents then meet as short
lists of 64-bit numbers.

Edge cases: a null text counts as empty and empty texts equal each other; a null
``doc_id`` ranks below every number; rows that repeat both ``doc_id`` and text share one
decision, and where rows are dropped one of them stays; texts of any length are cut
into chunks; an empty table gives an empty result; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import kept_rows

#: Chunk bounds in code points; a chunk ends at the first ``.`` or newline past the minimum.
MIN_CHUNK, MAX_CHUNK = 256, 2048
#: A group of equal documents is spread over so many join keys.
SALTS = 16


def chunk_list(text: Column, smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> Column:
    """The chunks of a text, in order; joined they give the text again."""
    pattern = rf"(?s).{{{smallest},{largest - 1}}}?[.\n]|.{{1,{largest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _digest(chunk: Column, bits: int) -> Column:
    whole = F.xxhash64(chunk)
    return whole if bits == 64 else F.pmod(whole, F.lit(1 << bits))


def chunk_library(texts: DataFrame, bits: int = 64) -> DataFrame:
    """The distinct ``(digest, chunk)`` pairs of a one-column table ``text``."""
    chunks = texts.select(F.explode(chunk_list(F.col("text"))).alias("chunk"))
    return chunks.select(_digest(F.col("chunk"), bits).alias("digest"), "chunk").distinct()


def recipes(documents: DataFrame, bits: int = 64) -> DataFrame:
    """``doc_id, text_sha256, recipe``: ordered verified chunk identifiers of every row.

    A digest names one content unless the library shows otherwise. Digests that
    several contents share are told apart by a number joined on the content, so
    the identifiers are right whatever the hash does.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    library = chunk_library(rows.select("text"), bits)
    shared = library.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    sha = F.sha2("text", 256).alias("text_sha256")
    if shared.isEmpty():
        ids = F.transform(chunk_list(F.col("text")), lambda c: _digest(c, bits))
        return rows.select("doc_id", sha, ids.alias("recipe"))
    ranked = library.join(shared, "digest", "left_semi").withColumn(
        "variant", F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))
    )
    pieces = (
        rows.select("doc_id", sha, "text").distinct()
        .select("doc_id", "text_sha256", F.posexplode(chunk_list(F.col("text"))).alias("pos", "chunk"))
        .withColumn("digest", _digest(F.col("chunk"), bits))
        .join(ranked, ["digest", "chunk"], "left")
    )
    ordered = pieces.groupBy("doc_id", "text_sha256").agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", F.coalesce("variant", F.lit(0)).alias("variant")))).alias("p")
    )
    flat = F.flatten(F.transform("p", lambda x: F.array(x["digest"], x["variant"].cast("bigint"))))
    mine = rows.select("doc_id", sha).alias("r")
    lists = ordered.select("doc_id", "text_sha256", flat.alias("recipe")).alias("o")
    return mine.join(
        lists, F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.text_sha256") == F.col("o.text_sha256")), "left"
    ).select("r.doc_id", "r.text_sha256", F.coalesce("o.recipe", F.array().cast("array<bigint>")).alias("recipe"))


def exact_duplicates(documents: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays.
    """
    listed = recipes(documents, bits)
    groups = listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = groups.filter("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(many, ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the largest ``doc_id``."""
    decided = exact_duplicates(documents).select("doc_id", F.xxhash64("text_sha256").alias("key"), "kept")
    return kept_rows(documents, decided, F.xxhash64(F.sha2(F.coalesce("text", F.lit("")), 256)))
