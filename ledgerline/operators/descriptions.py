"""Description quality, repeated issues and reworded issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.config import JACCARD, LEAST_TOKENS, SAMPLE_IDS, TIER_WEIGHTS, TOP_GROUPS
from ledgerline.functions import text as X
from ledgerline.functions.text import quoted
from ledgerline.operators.completeness import percent
from ledgerline.plans.components import connected_components
from ledgerline.plans.distinct import per_distinct
from ledgerline.plans.groups import first_rows, with_group_count
from ledgerline.plans.materialise import materialise
from ledgerline.plans.set_join import similar_sets
from ledgerline.plans.spread import widened


def measured(df: DataFrame, column: str, shortest: int = 20, longest: int = 5000) -> DataFrame:
    """Add ``text, length, group_size, score, tier`` of a description column to every row."""
    stripped = df.withColumn("text", X.strip(F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))))
    n, group = F.col("length"), F.col("group_size")
    counted = with_group_count(stripped.withColumn("length", F.length("text")), F.col("text"), "_same", long=True)
    grouped = counted.withColumn("group_size", F.when(n == 0, 0).otherwise(F.col("_same")).cast("long")).drop("_same")
    scored = grouped.withColumn("score", X.quality_score(n, group, shortest, longest))
    return scored.withColumn("tier", X.quality_tier(n, F.col("score"), shortest, longest, group))


def row_scores(df: DataFrame, column: str, shortest: int = 20, longest: int = 5000) -> DataFrame:
    """The table with ``<column> Score`` and ``<column> Tier``."""
    return measured(df, column, shortest, longest).select(
        *[F.col(quoted(c)) for c in df.columns], F.col("score").alias(f"{column} Score"), F.col("tier").alias(f"{column} Tier")
    )


def quality_summary(rows: DataFrame, shortest: int = 20, longest: int = 5000) -> DataFrame:
    """One row from ``measured`` rows: lengths, shares, tier counts and the field's score."""
    n = F.col("length")
    held = F.when(n > 0, n)
    empty, short, long = F.count_if(n == 0), F.count_if((n > 0) & (n < shortest)), F.count_if(n > longest)
    tiers = {t: F.count_if(F.col("tier") == t) for t in TIER_WEIGHTS}
    weight = sum((F.when(F.col("tier") == t, w).otherwise(0) for t, w in TIER_WEIGHTS.items()), F.lit(0))
    total = F.count(F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.agg(
        total.alias("total"), empty.alias("empty"), short.alias("too_short"), long.alias("too_long"),
        percent(empty, total).alias("empty_pct"), percent(short, total).alias("too_short_pct"), percent(long, total).alias("too_long_pct"),
        zero(F.min(held)).alias("min_length"), zero(F.max(held)).alias("max_length"),
        F.coalesce(F.round(F.avg(held), 1), F.lit(0.0)).alias("avg_length"), zero(F.median(held).cast("int")).alias("median_length"),
        *[c.alias(t.lower()) for t, c in tiers.items()],
        zero(F.floor(F.sum(weight) / F.greatest(total, F.lit(1)))).cast("int").alias("overall_score"),
    )


def quality_samples(rows: DataFrame, shortest: int = 20, longest: int = 5000) -> dict[str, list[str]]:
    """The first five short texts, and the first three long ones cut to 120 characters."""
    short = rows.filter((F.col("length") > 0) & (F.col("length") < shortest)).orderBy("_row_id").limit(5)
    long = rows.filter(F.col("length") > longest).orderBy("_row_id").limit(3)
    return {
        "too_short": [r["text"] for r in short.select("text").collect()],
        "too_long": [r["t"] + "..." for r in long.select(F.substring("text", 1, 120).alias("t")).collect()],
    }


def tier_table(summaries: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per field, tiers as columns."""
    out = None
    for name, summary in summaries:
        row = summary.select(F.lit(name).alias("Field"), *[F.col(t.lower()).alias(t) for t in TIER_WEIGHTS])
        out = row if out is None else out.unionByName(row)
    return out


# Repetition


def normalised_rows(df: DataFrame, column: str, id_column: str | None = None, distinct: bool = False) -> DataFrame:
    """``_row_id, text, key, id`` of every row; id is ``row N`` without an id column.

    With ``distinct`` each distinct text is cleaned once, which pays where many rows repeat others' texts.

    Rows with an empty key are not filtered here: a filter on the key would move below
    the redistribution and clean the texts a second time, in the tasks of the scan.
    """
    text = X.strip(F.coalesce(F.col(quoted(column)).cast("string"), F.lit("")))
    sample = F.col(quoted(id_column)).cast("string") if id_column else F.concat(F.lit("row "), F.col("_row_id").cast("string"))
    rows = df.select("_row_id", text.alias("text"), sample.alias("id"))
    if distinct:
        return per_distinct(rows, F.col("text"), lambda t: {"key": X.normalise(t)}).select("_row_id", "text", "key", "id")
    rows = widened(rows)
    return rows.select("_row_id", "text", X.normalise(F.col("text")).alias("key"), "id")


def exact_groups(rows: DataFrame) -> DataFrame:
    """``key, count, first_row`` of every distinct normalised text that is not empty."""
    groups = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("count"), F.min("_row_id").alias("first_row"), F.max(F.length("key")).alias("_length")
    )
    return groups.filter("_length > 0").drop("_length")


def worded(groups: DataFrame) -> DataFrame:
    """``first_row, count, words`` of distinct texts: 64-bit hashes of their words."""
    return groups.select("first_row", "count", F.transform(X.tokens(F.col("key")), lambda t: F.xxhash64(t)).alias("words"))


def token_pairs(groups: DataFrame, jaccard: float = JACCARD, least: int = LEAST_TOKENS) -> DataFrame:
    """``a, b, similarity``: pairs of distinct texts (by first row) whose words overlap enough.

    Texts with fewer than ``least`` words are left out. A pair must share a word that is
    in at most max(50, 5 %) of the rows; rows are counted by weight, so repeated texts
    count as often as they occur. Sets are put in one order of words, rarest first as bounded counts of
    hashed words tell, too common ones last, and written once, in blocks of texts of a size class. Sizes of a pair differ by the
    threshold at most, so a block meets those of its class and the next; ``plans.set_join``
    says how. No pair is shuffled before it is proved.
    """
    sized = materialise(worded(groups).filter(F.size("words") >= least), "issue-words")
    return similar_sets(sized, jaccard)


def token_links(groups: DataFrame, jaccard: float = JACCARD, least: int = LEAST_TOKENS) -> DataFrame:
    """``a, b, similarity``: pairs that connect all texts whose words overlap enough, however common the words they share.

    Not all such pairs are listed, as a group of near copies has as many as the square of its size.
    """
    sized = materialise(worded(groups).filter(F.size("words") >= least), "issue-words")
    return similar_sets(sized, jaccard, links=True)


def similar_groups(groups: DataFrame) -> DataFrame:
    """``component, count, first_row, texts``: reworded issues, as components of the similarity graph, no word being too common."""
    linked = connected_components(token_links(groups), "a", "b")
    groups = materialise(groups.select("first_row", "count"), "issue-groups")
    return linked.join(groups, linked["node"] == groups["first_row"]).groupBy("component").agg(
        F.sum("count").alias("count"), F.min("first_row").alias("first_row"), F.count(F.lit(1)).alias("texts")
    )


def _listed(rows: DataFrame, texts: DataFrame, members: DataFrame, groups: DataFrame, kind: str, total: Column) -> DataFrame:
    """Text and sample ids of chosen groups; ``members`` maps keys to the groups' first rows ``g``, whose ``texts`` are shown."""
    firsts = first_rows(rows.join(members, "key"), ["g"], [F.col("_row_id")], SAMPLE_IDS)
    shown = firsts.groupBy("g").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_row_id", "id"))), lambda x: x["id"]).alias("sample_ids"),
    )
    return groups.join(shown, "g").join(texts.join(F.broadcast(groups.select("g")), "g"), "g").select(
        F.lit(kind).alias("kind"), "count", percent(F.col("count"), total).alias("pct"), "text", "sample_ids", F.col("g").alias("first_row")
    )


def recurring_issues(df: DataFrame, column: str, id_column: str | None = None, top: int = TOP_GROUPS, similar: bool = True) -> DataFrame:
    """``kind, count, pct, text, sample_ids, first_row``: the largest repeated and reworded issues.

    Rows are stored by digests of their cleaned texts; texts are read again for the groups that are shown.
    """
    cleaned = normalised_rows(df, column, id_column)
    digest = F.unhex(F.sha2("key", 256))
    rows = materialise(cleaned.select("_row_id", "id", digest.alias("key"), (F.length("key") > 0).alias("held")), "issue-rows")
    texts = df.select(F.col("_row_id").alias("g"), F.substring(X.strip(F.coalesce(F.col(quoted(column)).cast("string"), F.lit(""))), 1, 200).alias("text"))
    groups = rows.filter("held").groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("_row_id").alias("first_row"))
    total = df.agg(F.count(F.lit(1))).scalar()
    order = [F.desc("count"), F.col("first_row")]
    best = groups.filter("count > 1").orderBy(*order).limit(top)
    named = best.select("key", F.col("first_row").alias("g"))
    out = _listed(rows, texts, F.broadcast(named), best.select(F.col("first_row").alias("g"), "count"), "exact", total)
    if similar:
        linked = connected_components(token_pairs(exact_groups(cleaned)), "a", "b")
        joined = linked.join(groups, linked["node"] == groups["first_row"])
        sized = joined.groupBy("component").agg(F.sum("count").alias("count"), F.min("first_row").alias("g"))
        big = sized.orderBy(F.desc("count"), "g").limit(top)
        members = joined.select("component", "key").join(F.broadcast(big.select("component", "g")), "component").select("key", "g")
        out = out.unionByName(_listed(rows, texts, members, big.select("g", "count"), "similar", total))
    return out.orderBy(F.desc("count"), "kind", "first_row").limit(top)


def repetition_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: ``exact_group_count, exact_repeated_rows, exact_repeated_pct``."""
    groups = exact_groups(normalised_rows(df, column)).filter("count > 1")
    total = df.agg(F.count(F.lit(1))).scalar()
    repeated = F.coalesce(F.sum("count"), F.lit(0))
    return groups.agg(
        F.count(F.lit(1)).alias("exact_group_count"), repeated.cast("long").alias("exact_repeated_rows"),
    ).withColumn("exact_repeated_pct", percent(F.col("exact_repeated_rows"), total))


def recurring_table(issues: DataFrame, column: str) -> DataFrame:
    kind = F.when(F.col("kind") == "exact", "Repeated").otherwise("Reworded")
    return issues.select(
        F.lit(column).alias("Column"), kind.alias("Type"), F.col("count").alias("Tickets"), F.col("pct").alias("% of Rows"),
        F.array_join("sample_ids", ", ").alias("Sample Ticket IDs"), F.col("text").alias("Description"),
    ).orderBy(F.desc("Tickets"))
