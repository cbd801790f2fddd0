"""Line dedup with levelled sorted runs of line hashes (native).

Documents arrive in batches of ascending ``doc_id``. The store keeps, for every
line key seen so far, the smallest document holding it, as immutable runs sorted
and bucketed by a 128-bit hash of the key. A batch merge-anti-joins the runs,
adds what is new as a run of its own, and when a level holds ``fanout`` runs
they are merged into one run of the next level. Runs are bucketed tables in the
warehouse, which the cluster shares, so joining them needs no shuffle of the store.

Edge cases: a null or empty text is one empty line, which is too short to be a
key; a null ``doc_id`` counts as the largest; rows repeating a ``doc_id`` are the
same document; copies of a line inside its first document all stay; an empty
table gives an empty result; further columns are ignored by the digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.materialise import discard, materialise
from ledgerline.session import remove_path, scratch_path

#: Shortest key, in code points, that is deduplicated.
MIN_KEY = 10
#: Batches a whole table is dealt into, and runs a level may hold.
BATCHES, FANOUT = 4, 3
#: A key is hot if it has more than this part of a batch's lines; fewer than so many are.
HOT = 1000
_BLANK = " \t\n\x0b\f\r"
_LAST = (1 << 63) - 1


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, nothing else; plain ``lower`` where the text is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, upper, upper.lower())).otherwise(F.lower(c))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(documents: DataFrame) -> DataFrame:
    """``owner, th, pos, h, g`` of every line long enough; ``th`` tells rows of one doc_id apart."""
    rows = documents.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("owner"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.posexplode(_lines(F.col("text"))).alias("pos", "line"),
    ).filter(F.octet_length("line") >= MIN_KEY)
    keyed = rows.select("owner", "th", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= MIN_KEY).select(
        "owner", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g")
    )


class LineRuns:
    """The levelled store. ``runs[level]`` lists table names, newest last."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made, self.runs = f"line_runs_{uuid.uuid4().hex[:12]}", 0, [[]]

    def tables(self) -> list[str]:
        return [t for level in self.runs for t in level]

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        placed = rows.select("h", "g", "owner").repartition(self.buckets, "h", "g")
        placed.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").format("parquet").saveAsTable(table)
        return table

    def add(self, firsts: DataFrame) -> None:
        """Add ``h, g, owner`` keys that no run holds yet, then compact full levels."""
        for table in self.tables():
            firsts = firsts.join(self.spark.table(table).select("h", "g"), ["h", "g"], "left_anti")
        self.runs[0].append(self._write(firsts))
        level = 0
        while len(self.runs[level]) >= self.fanout:
            merged, old = None, self.runs[level]
            for table in old:
                run = self.spark.table(table)
                merged = run if merged is None else merged.unionByName(run)
            if level + 1 == len(self.runs):
                self.runs.append([])
            self.runs[level + 1].append(self._write(merged))
            self.runs[level] = []
            for table in old:
                self.spark.sql(f"DROP TABLE {table}")
            level += 1

    def close(self) -> None:
        for table in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.runs = [[]]

    def owners(self, keys: DataFrame) -> DataFrame:
        """``h, g, first`` of the keys that the runs hold."""
        found = None
        for table in self.tables():
            run = self.spark.table(table).withColumnRenamed("owner", "first")
            hit = keys.join(run, ["h", "g"])
            found = hit if found is None else found.unionByName(hit)
        return found

    def foreign(self, lines: DataFrame, hot: DataFrame) -> DataFrame:
        """The lines whose key belongs to another, smaller document.

        ``hot`` holds keys of which a thousandth of the lines or more are each; there
        are a thousand at most, so they and their owners are broadcast, and no merge
        join meets a key's lines in one task.
        """
        common = lines.join(F.broadcast(self.owners(hot)), ["h", "g"])
        rest = self.owners(lines.join(F.broadcast(hot), ["h", "g"], "left_anti"))
        return common.unionByName(rest).filter("first <> owner").select("owner", "th", "pos")


def _batches(documents: DataFrame, n: int) -> list[Column]:
    """Conditions that part the rows by ascending doc_id, nulls last."""
    shares = [i / n for i in range(1, n)]
    cuts = documents.agg(F.percentile_approx("doc_id", shares, 10_000).alias("c")).first()["c"] or []
    cuts, key = sorted(set(cuts)), F.coalesce("doc_id", F.lit(_LAST))
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = F.lit(True)
        if low is not None:
            part &= key > low
        if high is not None:
            part &= F.col("doc_id") <= high
        parts.append(part)
    return parts


def dropped_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``owner, th, dropped``: the line numbers each document loses; documents that lose none are absent."""
    spark = documents.sparkSession
    store, path = LineRuns(spark, fanout=fanout), scratch_path(spark, "line-drops")
    scratch: list[DataFrame] = []

    def written(frame: DataFrame, label: str) -> DataFrame:
        scratch.append(materialise(frame, label))
        return scratch[-1]

    try:
        for part in _batches(documents, batches):
            lines = written(keyed_lines(documents.filter(part)), "line-keys")
            firsts = written(lines.groupBy("h", "g").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n")), "line-firsts")
            store.add(firsts.drop("n"))
            every = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            hot = firsts.filter(F.col("n") * HOT > every).select("h", "g")
            gone = store.foreign(lines, hot).groupBy("owner", "th").agg(F.collect_set("pos").alias("dropped"))
            gone.write.mode("append").parquet(path)
            while scratch:
                discard(scratch.pop())
    except BaseException:
        remove_path(spark, path)
        raise
    finally:  # a batch that failed leaves neither runs nor scratch behind
        store.close()
        while scratch:
            discard(scratch.pop())
    return spark.read.schema("owner long, th long, dropped array<int>").parquet(path)


def dedup_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: the texts with repeated lines taken out."""
    gone = dropped_lines(documents, batches, fanout)
    rows = documents.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("whole"),
        F.coalesce("doc_id", F.lit(_LAST)).alias("owner"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
    )
    joined = rows.join(gone, ["owner", "th"], "left")
    split = joined.withColumn("lines", _lines(F.col("whole")))
    kept = F.filter("lines", lambda line, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n"))
    return split.select(
        "doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
