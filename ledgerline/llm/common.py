"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.materialise import materialise

#: Copies of the smaller side of a join whose key may be hot.
SALTS = 16
#: Decisions on rows that may be broadcast, some 60 bytes each.
MARKS = 500_000
#: Bytes of text that a Python worker turns into arrays at once.
SLICE_BYTES = 8 << 20


def salted_left_join(rows: DataFrame, lookup: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join on ``key`` where a few keys may hold a large part of ``rows``.

    ``lookup`` has one row a key and is repeated ``salts`` times; ``spread`` is the
    column of ``rows`` that deals a hot key's rows over the salts.
    """
    many = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(many, [key, "_salt"], "left").drop("_salt")


def text_key() -> Column:
    """A 64-bit key of a row's text; beside ``doc_id`` it tells rows apart that share an id. Null is empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def kept_rows(documents: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """The rows of ``documents`` that ``decided`` keeps, with all their columns.

    ``decided`` has a row ``doc_id, key, kept`` per document; ``key`` computes that key
    from a document, both 64-bit numbers. Null ids equal each other. Rows alike in id and
    key share one decision, and of those to be kept one stays. Up to ``MARKS`` decisions, counted
    first, go to the rows by broadcast; more of them meet the rows by a shuffle of both.
    """
    per = decided.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")
    )
    marks = materialise(per.filter("not _kept or _n > 1"), "row-marks")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own"), key.alias("_text"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    repeated, number = marks.agg(F.count_if("_kept"), F.count(F.lit(1))).first()
    marks = F.broadcast(marks) if number <= MARKS else marks
    if not repeated:
        return rows.join(marks, same, "left_anti").select("row.*")
    marked = rows.join(marks, same, "left").filter("_kept is null or _kept")
    alone = marked.filter("_kept is null").select("row.*")
    return alone.unionByName(marked.filter("_kept").dropDuplicates(["_id", "_key"]).select("row.*"))


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has much more than ``limit`` bytes of text (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def words(raw: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case (bytes methods know ASCII only)."""
    return raw.lower().split()
