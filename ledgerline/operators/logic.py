"""Logic rules as boolean columns: the same expression counts, filters and labels."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ledgerline.config import FLAG_LABELS, AuditConfig
from ledgerline.functions import dates, state
from ledgerline.functions.text import is_blank, quoted
from ledgerline.operators.completeness import null_cells
from ledgerline.operators.roles import CLOSED, CREATED, ID, PRIORITY, STATE, Roles, bind_roles
from ledgerline.plans.groups import with_group_count
from ledgerline.plans.materialise import is_stored, materialise


@dataclass
class AuditContext:
    """A table, its roles, the settings and the moment it is judged at."""

    df: DataFrame
    roles: Roles
    config: AuditConfig = field(default_factory=AuditConfig)
    as_of: datetime.datetime = field(default_factory=lambda: datetime.datetime.now().replace(microsecond=0))
    #: What ``snapshot`` has counted over the whole table, where it has run.
    counts: Row | None = None

    @classmethod
    def open(cls, df: DataFrame, config: AuditConfig | None = None, as_of: datetime.datetime | None = None) -> AuditContext:
        config = config or AuditConfig()
        roles = bind_roles(df, config.column_overrides)
        return cls(df, roles, config, **({"as_of": as_of} if as_of else {}))

    def snapshot(self) -> AuditContext:
        """The same context over a table that further checks can read column by column, with nulls and rules counted.

        A table that has to be worked out (joined, aggregated, parsed from text) is worked out once
        and written to the shared folder, and counted as it is written. One that is
        columnar files already is only counted.
        """
        if self.counts is not None:
            return self
        asked = [*count_columns(self), null_cells(self.df)]
        if is_stored(self.df):
            return replace(self, counts=flagged_rows(self).agg(*asked).first())
        seen = Observation()
        counted = flagged_rows(self).observe(seen, *asked)
        df = materialise(counted.select(*[F.col(quoted(c)) for c in self.df.columns]), "audited-table")
        return replace(self, df=df, counts=Row(**seen.get))

    def column(self, role: str) -> str | None:
        return self.roles.get(role)

    @cached_property
    def orders(self) -> dict[str, dict]:
        """Field order of each text date column; one small job for both."""
        from ledgerline.operators.calendar import date_order

        out = {}
        for role in (CREATED, CLOSED):
            name = self.column(role)
            if name and name not in out and not dates.is_typed(self.df.schema[name].dataType):
                out[name] = date_order(self.df, name).first().asDict()
        return out

    def day_first(self, name: str) -> bool:
        """The pinned order, else day first where the values prove it."""
        if self.config.date_dayfirst is not None:
            return self.config.date_dayfirst
        return self.orders.get(name, {}).get("date_order") == "day_first"

    def time(self, role: str) -> Column | None:
        name = self.column(role)
        if not name:
            return None
        kind = self.df.schema[name].dataType
        return dates.parse(F.col(quoted(name)), kind, False if dates.is_typed(kind) else self.day_first(name))

    def value(self, role: str) -> Column | None:
        name = self.column(role)
        return F.col(quoted(name)) if name else None


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def row_flags(ctx: AuditContext, kind: Column | None = None) -> tuple[dict[str, Column], list[str]]:
    """The rules that can run as columns that are never null, and the names of those that cannot.

    ``kind`` is a column with the class of the state, for callers that have worked it out.
    """
    created, closed = ctx.time(CREATED), ctx.time(CLOSED)
    status, priority = ctx.value(STATE), ctx.value(PRIORITY)
    if status is not None and kind is None:
        kind = state.classify(status)
    now = F.lit(ctx.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    found: dict[str, Column] = {}
    if created is not None and closed is not None:
        found["closed_before_created"] = _true(closed < created)
    if created is not None:
        found["future_created"] = _true(created > now)
    if closed is not None:
        found["future_closed"] = _true(closed > now)
    if status is not None and closed is not None:
        found["closed_no_date"] = (kind == "terminal") & closed.isNull()
        found["open_with_date"] = (kind == "active") & closed.isNotNull()
    if status is not None and priority is not None:
        found["open_missing_priority"] = (kind == "active") & is_blank(priority)
    return found, [f for f in FLAG_LABELS if f not in found]


def flagged_rows(ctx: AuditContext) -> DataFrame:
    """The table with what ``count_columns`` counts: ``_kind`` of the state and a column ``_is_<rule>`` per rule.

    The state is classified once a row, and rules are columns, so that counts of several things
    do not work them out again.
    """
    status = ctx.value(STATE)
    df = ctx.df if status is None else ctx.df.withColumn("_kind", state.classify(status))
    flags, _ = row_flags(ctx, None if status is None else F.col("_kind"))
    return df.withColumns({f"_is_{name}": c for name, c in flags.items()}) if flags else df


def logic_counts(ctx: AuditContext) -> DataFrame:
    """One row: every rule's count (null: could not run), states by class, rows flagged at all, sum of rules."""
    return flagged_rows(ctx).agg(*count_columns(ctx))


def count_columns(ctx: AuditContext) -> list[Column]:
    """The aggregates of ``logic_counts`` over ``flagged_rows``, to be computed beside others in one pass."""
    names = list(row_flags(ctx)[0])
    status = ctx.value(STATE)
    out = [F.count(F.lit(1)).alias("rows")]
    out += [(F.count_if(f"_is_{f}") if f in names else F.lit(None).cast("long")).alias(f) for f in FLAG_LABELS]
    if status is None:
        out += [F.lit(None).cast("long").alias(n) for n in ("open_count", "closed_count", "unclassified_count")]
    else:
        for name, value in (("open_count", "active"), ("closed_count", "terminal"), ("unclassified_count", "unknown")):
            out.append(F.count_if(F.col("_kind") == value).alias(name))
    anything = F.lit(False)
    every = F.lit(0)
    for name in names:
        anything, every = anything | F.col(f"_is_{name}"), every + F.col(f"_is_{name}").cast("long")
    out += [F.count_if(anything).alias("rows_flagged"), F.coalesce(F.sum(every), F.lit(0)).cast("long").alias("issues_total")]
    return out


#: Check and severity of each counted rule, in report order.
RULES = [
    ("closed_before_created", "Date sequence", "Critical"),
    ("future_created", "Future dates", "Medium"),
    ("future_closed", "Future dates", "Medium"),
    ("closed_no_date", "State / resolution", "High"),
    ("open_with_date", "State / resolution", "High"),
    ("open_missing_priority", "Open ticket priority", "Medium"),
    ("unclassified_count", "State classification", "Low"),
]


def rule_results(counts: DataFrame) -> DataFrame:
    """``position, rule, check, severity, rows_affected, result`` from ``logic_counts``: one row per rule."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(rule).alias("rule"), F.lit(check).alias("check"),
                 F.lit(severity).alias("severity"), F.col(rule).cast("long").alias("rows_affected"))
        for i, (rule, check, severity) in enumerate(RULES)
    ])
    found = counts.select(F.inline(cells))
    n = F.col("rows_affected")
    result = (
        F.when(n.isNull(), "Not checked").when(n == 0, "Pass")
        .when(F.col("check") == "State classification", "Review").otherwise("Fail")
    )
    return found.withColumn("result", result)


def check_date_logic(ctx: AuditContext) -> dict:
    """Counts of the date rules, which need both dates, with one sentence per finding."""
    created, closed = ctx.column(CREATED), ctx.column(CLOSED)
    if not (created and closed):
        return {"has_date_columns": False, "issues": ["Could not identify date columns for logic check"]}
    row = logic_counts(ctx).first()
    out = {"has_date_columns": True, "created_col": created, "closed_col": closed}
    out |= {k: row[k] for k in ("closed_before_created", "future_created", "future_closed")}
    told = {
        "closed_before_created": f"{closed} is before {created} in {{}} rows",
        "future_created": f"{created} is in the future in {{}} rows",
        "future_closed": f"{closed} is in the future in {{}} rows",
    }
    return out | {"issues": [text.format(out[k]) for k, text in told.items() if out[k]]}


def check_cross_field_logic(ctx: AuditContext) -> dict:
    row = logic_counts(ctx).first().asDict()
    has = {"has_state": ctx.column(STATE), "has_closed_date": ctx.column(CLOSED), "has_priority": ctx.column(PRIORITY)}
    names = ("closed_no_date", "open_with_date", "open_missing_priority", "open_count", "closed_count", "unclassified_count")
    return {k: bool(v) for k, v in has.items()} | {k: row[k] for k in names}


def evidence(ctx: AuditContext, rule: str, fields: list[str], limit: int | None = 200) -> DataFrame:
    """Id and fields of the rows a rule flags, in file order."""
    flags, _ = row_flags(ctx)
    names = list(dict.fromkeys([c for c in (ctx.column(ID), *fields) if c]))
    found = ctx.df.filter(flags[rule]).orderBy("_row_id")
    return (found.limit(limit) if limit else found).select(*[F.col(quoted(n)) for n in names])


# Identity


def duplicate_summary(df: DataFrame, id_column: str) -> DataFrame:
    """One row: ``surplus, ids_affected, rows_involved``; null ids are no duplicates here."""
    c = F.col(quoted(id_column))
    counted = df.filter(c.isNotNull()).groupBy(c.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    zero = F.lit(0)
    return counted.agg(
        F.coalesce(F.sum(F.col("n") - 1), zero).cast("long").alias("surplus"),
        F.count(F.lit(1)).alias("ids_affected"),
        F.coalesce(F.sum("n"), zero).cast("long").alias("rows_involved"),
    )


def duplicate_ids(df: DataFrame, id_column: str, limit: int | None = None) -> DataFrame:
    """``id, n`` of repeated ids, most frequent first."""
    c = F.col(quoted(id_column))
    counted = df.filter(c.isNotNull()).groupBy(c.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ordered = counted.orderBy(F.desc("n"), "id")
    return ordered.limit(limit) if limit else ordered


def with_id_occurrences(df: DataFrame, id_column: str) -> DataFrame:
    """Add ``id_occurrences`` (0 for a null id) and ``is_duplicate`` (null ids equal each other)."""
    c = F.col(quoted(id_column))
    counted = with_group_count(df, c, "_same")
    return counted.select(
        *[F.col(quoted(x)) for x in df.columns],
        F.when(c.isNull(), F.lit(0)).otherwise(F.col("_same")).cast("long").alias("id_occurrences"),
        (F.col("_same") > 1).alias("is_duplicate"),
    )


def duplicate_rows(df: DataFrame, id_column: str) -> DataFrame:
    return with_id_occurrences(df, id_column).filter("is_duplicate").select(*[F.col(quoted(x)) for x in df.columns])


def cancelled_states(ctx: AuditContext) -> dict:
    """State column, its cancelled values in order, rows that hold one, and the mask (None without a state)."""
    status = ctx.value(STATE)
    if status is None:
        return {"state_col": None, "values": [], "rows": 0, "mask": None}
    mask = state.is_cancelled(status)
    row = ctx.df.agg(F.count_if(mask).alias("rows"), F.array_sort(F.collect_set(F.when(mask, status.cast("string")))).alias("values")).first()
    return {"state_col": ctx.column(STATE), "values": row["values"], "rows": row["rows"], "mask": mask}
