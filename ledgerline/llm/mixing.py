"""Mixing sources to target weights by Sainte-Lague apportionment (native).

Sizes are word counts. Sources get targets by weight, water-filled under a cap
of two passes. The mix is counted in blocks of ``BLOCK`` words: blocks go to
sources by highest quotients, then within a source to its shards (documents
dealt by a seeded hash), again by highest quotients. A shard lays its documents
end to end in seeded order and takes its quota as one circular run of blocks
from a seeded starting block, so selection is closed-form arithmetic on running
sums and no shard's documents are gathered.

The source table (one row per source) passes through single-task windows: it is
the ranking the weights are defined by. Shards hold about ``SHARD`` words and ``ROWS``
rows at most, however large their source is. The seeded hash covers id and text, so
rows that share an id or have none are spread like all others.

Edge cases: null text has size 0; a null source is a source, ranked last; size 0
rows take 0; ties in the seeded order fall to doc_id, then size; repeated rows
are separate rows; a very long text is one row like any other, and its shard as large as
it is; a source of empty texts takes nothing, whatever its weight; a table without words
takes nothing; empty in, empty out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise

#: Fixed values of the mix: weights by source rank, total against all sizes, most passes.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words in a block, words and rows aimed at in a shard, and the seed of order and start.
BLOCK, SHARD, ROWS, SEED = 16, 1_000_000, 200_000, 20_240_229


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, source_rows, target`` from rows of ``source, size``.

    With sources in ascending order of cap/weight, those before the break reach
    their cap; the level of the others follows from what is left.
    """
    every = Window.partitionBy()
    order = F.col("source").asc_nulls_last()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    ranked = per.withColumn("rank", F.row_number().over(every.orderBy(order)) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    )
    cap = (F.col("source_size") * PASSES).cast("double")
    filled = every.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = every.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * SHARE
    level = (total - F.coalesce(F.sum(cap).over(filled), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("cap", cap)
    first = levels.withColumn("at", F.row_number().over(every.orderBy(F.col("cap") / F.col("weight"), "rank")))
    stop = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("at"))).over(every)
    final = first.withColumn("stop", stop).withColumn(
        "open_level", F.max(F.when(F.col("at") == F.col("stop"), F.col("level"))).over(every)
    )
    target = F.when(F.col("at") < F.col("stop"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight"))
    return final.select("source", "source_size", "source_rows", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], votes: str, limit: str, seats: str) -> DataFrame:
    """Add ``quota``: ``seats`` of each group dealt to its rows by highest quotients votes/(2k+1).

    ``limit`` is the most a row may hold; seats that no row may hold stay free.
    Rows need a unique ``party`` column, which breaks ties. The divisor total/seats
    already places each row within a window of the right quota, so only the
    quotients in that window are ranked.
    """
    within = Window.partitionBy(*group)
    v, lim, n = F.col(votes), F.col(limit), F.col(seats)
    sized = (
        parties.withColumn("_v", F.sum(v).over(within))
        .withColumn("_n", F.count(F.lit(1)).over(within))
        .withColumn("_base", F.when(F.col("_v") > 0, F.floor(v * n / F.col("_v") + 0.5)).otherwise(0).cast("long"))
        .withColumn("_slack", F.when(F.col("_v") > 0, F.ceil(v / F.col("_v") * F.col("_n") / 2)).otherwise(0).cast("long") + 2)
        .withColumn("_low", F.least(F.greatest(F.col("_base") - F.col("_slack"), F.lit(0)), lim))
        .withColumn("_high", F.least(F.col("_base") + F.col("_slack"), lim))
        .withColumn("_open", n - F.sum("_low").over(within))
    )
    quotients = sized.filter("_high > _low").select(
        *group, "party", "_open", v.alias("_q"), F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k")
    )
    order = Window.partitionBy(*group).orderBy((F.col("_q") / (2 * F.col("_k") + 1)).desc(), "party", "_k")
    won = (
        quotients.withColumn("_at", F.row_number().over(order)).filter("_at <= _open")
        .groupBy("party").agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        sized.join(won, "party", "left")
        .withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
        .drop("_v", "_n", "_base", "_slack", "_low", "_high", "_open", "_won")
    )


def mix(documents: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, rows: int = ROWS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``, one row per document."""
    # Texts are read once; everything below works on what is written here.
    sized = materialise(
        documents.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("draw"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sized)
    blocks = F.floor(F.col("target") / block + 0.5).cast("long")
    total = F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5).cast("long")
    bound = F.floor(F.col("source_size") * PASSES / block).cast("long")
    sources = (
        targets.withColumn("seats", total).withColumn("bound", F.greatest(bound, blocks))
        .withColumn("all", F.lit(1)).withColumn("party", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    )
    sources = materialise(
        sainte_lague(sources, ["all"], "target", "bound", "seats").select(
            "source", "source_size", "target", F.col("quota").alias("source_blocks"),
            F.greatest(F.ceil(F.col("source_size") / shard), F.ceil(F.col("source_rows") / rows), F.lit(1)).cast("long").alias("shards"),
        ),
        "mix-sources",
    )
    # Both sides hold a source as (value, is it null); the source table is joined where each document is.
    dealt = (
        sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "d.source", "size", "draw", "source_size", "target", "source_blocks",
                F.pmod(F.xxhash64("draw"), F.col("shards")).alias("shard"))
    )
    per = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.first("source_blocks").alias("source_blocks"),
    )
    per = (
        per.withColumn("votes", F.col("shard_size").cast("double"))
        .withColumn("most", F.ceil(F.col("shard_size") * PASSES / block).cast("long"))
        .withColumn("party", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard"))
        .withColumn("owner", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    )
    quotas = sainte_lague(materialise(per, "mix-shards"), ["owner"], "votes", "most", "source_blocks").select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size",
        F.least(F.col("quota") * block, F.col("shard_size") * PASSES).alias("words"),
    )
    placed = dealt.join(
        quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard"))
    )
    lane = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    s, start = F.col("shard_size"), F.col("start")
    turns = placed.withColumn("at", F.coalesce(F.sum("size").over(lane), F.lit(0))).withColumn(
        "start", F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest(F.floor(s / block), F.lit(1)).cast("long")) * block
    )
    whole = F.when(s > 0, F.floor(F.col("words") / s)).otherwise(0)
    left = F.col("words") - whole * s
    # The circular run [start, start + left) as two straight ones.
    first = F.least(F.col("at") + F.col("size"), start + left, s) - F.greatest(F.col("at"), start)
    second = F.least(F.col("at") + F.col("size"), start + left - s) - F.col("at")
    taken = whole * F.col("size") + F.greatest(first, F.lit(0)) + F.greatest(second, F.lit(0))
    return turns.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
