"""Value counts, distributions, inflow, cubes and cross-tabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import CUBE_DIMENSIONS, CUBE_DISTINCT, CUBE_ROWS, EXPAND_LIMIT, MIX_TOP, TOP_VALUES
from ledgerline.functions import dates
from ledgerline.functions.text import quoted
from ledgerline.operators.completeness import data_columns, percent


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, count, pct`` of the non-null values; the share is of all rows, nulls too.

    Nulls are one more group of the same aggregation, so all rows are its total, which
    is added up from the groups' partial sums and not in a window over all of them.
    """
    counted = df.groupBy(F.col(quoted(column)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count")).scalar()
    return (
        counted.withColumn("pct", percent(F.col("count"), total)).filter(F.col("value").isNotNull())
        .orderBy(F.desc("count"), "value")
    )


def pivot_columns(df: DataFrame, id_column: str | None = None) -> list[str]:
    """Columns worth counting: the telling names in file order, then the rest by name, without the id."""
    names = [f.name for f in data_columns(df) if f.name != id_column]
    telling = [c for c in names if any(w in c.lower() for w in ("priority", "state", "status", "assignment", "tower"))]
    return telling + sorted(c for c in names if c not in telling)


def all_value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``position, column, value, count``: every column's counts from one aggregation of unpivoted cells."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value"))
        for i, c in enumerate(columns)
    ])
    return df.select(F.inline(cells)).groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("count"))


def distributions(df: DataFrame, columns: list[str], expand: int = EXPAND_LIMIT, top: int = TOP_VALUES) -> DataFrame:
    """``position, column, rank, value, count, pct``: the top values and one row for the rest.

    A column with more than ``expand`` values is one row that says so. Columns with
    many values never rank them all: distinct values are counted before ranking.
    """
    counted = all_value_counts(df, columns)
    per = Window.partitionBy("position")
    sized = counted.groupBy("position", "column").agg(
        F.count("value").alias("distinct"), F.sum("count").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("held")
    ).filter("distinct > 0")
    wide = sized.filter(F.col("distinct") > expand).select(
        "position", "column", F.lit(1).alias("rank"),
        F.concat(F.lit("(not summarised - "), F.format_number("distinct", 0), F.lit(" distinct values)")).alias("value"),
        F.col("held").alias("count"), percent(F.col("held"), F.col("rows")).alias("pct"),
    )
    small = counted.filter("value is not null").join(sized.filter(F.col("distinct") <= expand).drop("column"), "position")
    ranked = small.withColumn("rank", F.row_number().over(per.orderBy(F.desc("count"), "value")))
    folded = ranked.withColumn("rank", F.least("rank", F.lit(top + 1))).groupBy("position", "column", "rank").agg(
        F.sum("count").alias("count"), F.count(F.lit(1)).alias("n"), F.min("value").alias("value"), F.first("rows").alias("rows")
    )
    more = F.concat(F.lit("(and "), F.format_number("n", 0), F.lit(" more values)"))
    named = folded.select(
        "position", "column", "rank", F.when(F.col("rank") > top, more).otherwise(F.col("value")).alias("value"),
        "count", percent(F.col("count"), F.col("rows")).alias("pct"),
    )
    return wide.unionByName(named)


def text_distributions(df: DataFrame, top: int = 8) -> dict[str, DataFrame]:
    """Top values of the first column named like a priority, a state, a status."""
    out = {}
    for word in ("priority", "state", "status"):
        column = next((f.name for f in data_columns(df) if word in f.name.lower()), None)
        if column and column not in out:
            out[column] = value_counts(df, column).limit(top)
    return out


def dimension_mix(counts: DataFrame, value: str = "value", count: str = "count", top: int = MIX_TOP, noun: str = "values") -> DataFrame:
    """``rank, value, count``: the top values, the rest as ``Other (k values)``.

    Only the top values are ranked; the rest is what all values add up to, less those.
    """
    listed = counts.select(F.col(value).alias("value"), F.col(count).alias("count"))
    sums = [F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"), F.count(F.lit(1)).alias("n")]
    best = listed.orderBy(F.desc("count"), "value").limit(top)
    place = F.row_number().over(Window.orderBy(F.desc("count"), "value"))  # over the top values alone
    parts = listed.agg(*sums).unionByName(best.agg((-F.coalesce(F.sum("count"), F.lit(0))).cast("long").alias("count"), (-F.count(F.lit(1))).alias("n")))
    rest = parts.agg(F.sum("count").alias("count"), F.sum("n").alias("n")).filter("n > 0")
    other = F.concat(F.lit("Other ("), F.col("n").cast("string"), F.lit(f" {noun})"))
    return best.select(place.alias("rank"), "value", F.col("count").cast("long").alias("count")).unionByName(
        rest.select(F.lit(top + 1).alias("rank"), other.alias("value"), "count")
    )


def month_counts(ts: Column, df: DataFrame) -> DataFrame:
    """``month, count`` in order; rows without a date and months without rows are absent."""
    return df.filter(ts.isNotNull()).groupBy(dates.month_text(ts).alias("month")).agg(F.count(F.lit(1)).alias("count")).orderBy("month")


def monthly_inflow(df: DataFrame, ts: Column) -> DataFrame:
    """``month, count, pct``: rows per month and their share of the dated rows."""
    counted = month_counts(ts, df)
    return counted.withColumn("pct", percent(F.col("count"), counted.agg(F.sum("count")).scalar())).orderBy("month")


def inflow_kpis(df: DataFrame, ts: Column) -> DataFrame:
    """``total, months, peak_month, peak_count, mean, undated``; of equal peaks the first."""
    counted = df.groupBy(dates.month_text(ts).alias("month")).agg(F.count(F.lit(1)).alias("count"))
    dated = F.col("month").isNotNull()
    return counted.agg(
        F.coalesce(F.sum(F.when(dated, F.col("count"))), F.lit(0)).alias("total"),
        F.count("month").alias("months"),
        F.min_by("month", F.when(dated, F.struct(-F.col("count"), F.col("month")))).alias("peak_month"),
        F.max(F.when(dated, F.col("count"))).alias("peak_count"),
        F.round(F.avg(F.when(dated, F.col("count")))).cast("long").alias("mean"),
        F.coalesce(F.sum(F.when(~dated, F.col("count"))), F.lit(0)).alias("undated"),
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact number of non-null values per column, in one job of two aggregations."""
    rows = all_value_counts(df, columns).groupBy("position").agg(F.count("value").alias("n")).collect()
    found = {columns[r["position"]]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in columns}


def choose_dimensions(df: DataFrame, columns: list[str], most: int = CUBE_DIMENSIONS, values: int = CUBE_DISTINCT) -> tuple[list[str], list[str]]:
    """Columns fit to be cube dimensions, and a note on each reason another is not."""
    times = [f.name for f in df.schema.fields if dates.is_typed(f.dataType) and f.name in columns]
    rest = [c for c in columns if c not in times]
    counts = distinct_counts(df, rest) if rest else {}
    fit = [c for c in rest if counts[c] <= values]
    notes = [f"{', '.join(times)}: times are no dimensions, see monthly inflow"] if times else []
    notes += [f"{c}: {counts[c]:,} distinct values, over {values}" for c in rest if counts[c] > values]
    if fit[most:]:
        notes.append(f"{', '.join(fit[most:])}: the cube takes {most} dimensions")
    return fit[:most], notes


def pivot_cube(df: DataFrame, columns: list[str], most_rows: int = CUBE_ROWS, blank: str = "(blank)") -> tuple[DataFrame | None, list[str], list[str]]:
    """The cube, its dimensions and notes; the last dimension goes until the cube is small enough."""
    dims, notes = choose_dimensions(df, columns)
    if not dims:
        return None, [], [*notes, "no column has few enough distinct values"]
    dropped = []
    while len(dims) > 1:
        cells = df.select(*[F.col(quoted(d)) for d in dims]).distinct().limit(most_rows + 1).count()
        if cells <= most_rows:
            break
        dropped.append(dims.pop())
    if dropped:
        notes.append(f"dropped {', '.join(dropped)} to keep the cube within {most_rows:,} rows")
    return cube(df, dims, blank), dims, notes


def cube(df: DataFrame, dims: list[str], blank: str = "(blank)") -> DataFrame:
    """Rows per combination of the dimensions; null is a value of its own."""
    keys = [F.coalesce(F.col(quoted(d)).cast("string"), F.lit(blank)).alias(d) for d in dims]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("Ticket count")).orderBy(F.desc("Ticket count"), *[F.col(quoted(d)) for d in dims])


def native_pivot(cube_frame: DataFrame, dim: str) -> DataFrame:
    """Sum by one dimension of a cube, with a grand total row."""
    d = F.col(quoted(dim))
    rolled = cube_frame.rollup(d).agg(F.sum("Ticket count").alias("Ticket count"), F.grouping_id().alias("level"))
    return rolled.select(F.when(F.col("level") == 1, "Grand Total").otherwise(d).alias(dim), "Ticket count", "level")


def area_by_result(register: DataFrame) -> DataFrame:
    """Number of findings per area and outcome, outcomes as columns."""
    outcomes = ["Fail", "Not checked", "Review", "Pass"]
    wide = register.groupBy("Area").pivot("Result", outcomes).count().na.fill(0, outcomes)
    return wide.orderBy(F.desc("Fail"), F.desc("Not checked"), F.desc("Review"), "Area")


def failing_by_area(register: DataFrame) -> DataFrame:
    return register.filter(F.col("Result") == "Fail").groupBy("Area").agg(F.count(F.lit(1)).alias("failing")).orderBy("Area")
