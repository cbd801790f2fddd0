"""Which column plays which role: names scored on the driver, values from one sample job."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.config import (
    ABSENT, DATE_SAMPLE, EXCLUDED_NAMES, ID_PREFIXES, ROLE_KEYWORDS, ROLE_THRESHOLD, VALUE_PATTERNS, VALUE_SAMPLE,
)
from ledgerline.functions import dates
from ledgerline.functions.text import quoted

ID, STATE, CREATED, CLOSED, PRIORITY = "Ticket Identification", "State/Status", "Created", "Closed", "Priority"
DESCRIPTIONS = ("Short Description", "Description")
ID_VALUE = re.compile(rf"({'|'.join(ID_PREFIXES)})\d+|\d+$")


@dataclass(frozen=True)
class Roles:
    """Ranked columns per role, all scores, and what became of overrides."""

    ranked: dict[str, list[str]]
    scores: dict[str, list[tuple[str, int]]]
    overridden: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    created: str | None = None
    closed: str | None = None

    def get(self, role: str) -> str | None:
        if role == CREATED:
            return self.created
        if role == CLOSED:
            return self.closed
        return next(iter(self.ranked.get(role, [])), None)

    @property
    def missing(self) -> list[str]:
        return [r for r in ROLE_KEYWORDS if not self.ranked.get(r)]

    @property
    def descriptions(self) -> list[tuple[str, str]]:
        """(role, column) of the description fields, short one first."""
        return [(r, c) for r in DESCRIPTIONS if (c := self.get(r))]


def normalised(name: str) -> str:
    return re.sub(r"[ \-]", "_", name.strip().lower())


def name_score(role: str, name: str) -> int:
    """100 for a keyword, 80 as a suffix, 70 as a prefix, 50 as a word within; the best keyword counts."""
    own, best = normalised(name), 0
    for key in ROLE_KEYWORDS[role]:
        if own == key:
            score = 100
        elif own.endswith(f"_{key}"):
            score = 80
        elif own.startswith(f"{key}_"):
            score = 70
        elif len(key) >= 3 and re.search(rf"(?:^|_){re.escape(key)}(?:_|$)", own):
            score = 50
        else:
            score = 0
        best = max(best, score)
    return best


def is_excluded(role: str, name: str) -> bool:
    return any(re.match(p, normalised(name)) for p in EXCLUDED_NAMES.get(role, []))


def _mostly(values: list[str], fits) -> bool:
    return bool(values) and sum(map(fits, values)) > len(values) / 2


def value_samples(df: DataFrame, columns: list[str], size: int = VALUE_SAMPLE) -> dict[str, list[str]]:
    """The first non-null values of each column in file order.

    The first ``size`` rows have them for most columns; only columns with nulls among
    those are read on, each to its first ``size`` values.
    """
    if not columns:
        return {}
    rows = df.orderBy("_row_id") if "_row_id" in df.columns else df
    text = [F.col(quoted(name)).cast("string").alias(str(i)) for i, name in enumerate(columns)]
    head = rows.limit(size).select(*text).collect()
    out = {name: [r[i] for r in head if r[i] is not None] for i, name in enumerate(columns)}
    if len(head) < size:
        return out
    found = None
    for i, name in enumerate(columns):
        if len(out[name]) < size:
            c = F.col(quoted(name))
            kept = rows.filter(c.isNotNull()).limit(size).select(F.lit(i).alias("i"), c.cast("string").alias("v"))
            found = kept if found is None else found.unionByName(kept)
            out[name] = []
    for row in found.collect() if found is not None else []:
        out[columns[row["i"]]].append(row["v"])
    return out


def has_id_values(values: list[str]) -> bool:
    return _mostly(values, lambda v: len(v.strip()) <= 50 and ID_VALUE.match(v.strip().upper()) is not None)


def has_role_values(role: str, values: list[str]) -> bool:
    patterns = [re.compile(p, re.IGNORECASE) for p in VALUE_PATTERNS.get(role, [])]
    return bool(patterns) and _mostly(values, lambda v: any(p.match(v.strip()) for p in patterns))


_DATE_WORDS = {CREATED: ("created", "opened"), CLOSED: ("closed", "resolved")}
_PEOPLE = ("by", "user", "name", "person", "agent", "owner")


def _date_fallback(df: DataFrame, role: str, samples: dict[str, list[str]]) -> str | None:
    """The first column named like the role, not like a person, half of whose first values are dates."""
    for f in df.schema.fields:
        low = f.name.lower()
        if not any(w in low for w in _DATE_WORDS[role]) or any(w in low for w in _PEOPLE):
            continue
        if dates.is_typed(f.dataType):
            return f.name
        values = samples.get(f.name, [])[:DATE_SAMPLE]
        if not values:
            continue
        frame = df.sparkSession.createDataFrame([(v,) for v in values], "v string")
        good = frame.filter(dates.parse(F.col("v"), T.StringType(), False).isNotNull()).count()
        if good * 2 >= len(values):
            return f.name
    return None


def bind_roles(df: DataFrame, overrides: dict[str, str] | None = None) -> Roles:
    """Score every column for every role; ties keep the order of the file, winners leave later roles."""
    overrides = overrides or {}
    columns = [c for c in df.columns if c != "_row_id"]
    typed = {f.name for f in df.schema.fields if dates.is_typed(f.dataType)}
    samples = value_samples(df, [c for c in columns if c not in typed])
    ranked: dict[str, list[str]] = {}
    scores: dict[str, list[tuple[str, int]]] = {}
    taken: set[str] = set()
    for role in ROLE_KEYWORDS:
        rows = []
        for name in columns:
            if name in taken or is_excluded(role, name):
                continue
            score = name_score(role, name)
            if score and has_role_values(role, samples.get(name, [])):
                score += 30
            if role == ID and has_id_values(samples.get(name, [])):
                score = score + 30 if score else 60
            if score >= ROLE_THRESHOLD:
                rows.append((name, score))
        rows.sort(key=lambda r: -r[1])
        scores[role] = rows
        if rows:
            ranked[role] = [name for name, _ in rows]
            taken.add(rows[0][0])
    overridden, ignored, absent = [], [], set()
    for role, name in overrides.items():
        if role not in ROLE_KEYWORDS:
            ignored.append(f"Unknown category '{role}'")
        elif name == ABSENT:
            ranked.pop(role, None)
            absent.add(role)
            overridden.append(role)
        elif name not in columns:
            ignored.append(f"'{name}' is not a column of this file ({role})")
        else:
            ranked[role] = [name, *(c for c in ranked.get(role, []) if c != name)]
            overridden.append(role)
    when = {}
    for role in (CREATED, CLOSED):
        found = next(iter(ranked.get(role, [])), None)
        when[role] = found or (None if role in absent else _date_fallback(df, role, samples))
    return Roles(ranked, scores, overridden, ignored, when[CREATED], when[CLOSED])


def check_columns(df: DataFrame, roles: Roles) -> DataFrame:
    """One row per role: ``role, found, matched_columns, score, candidates, overridden``."""
    rows = []
    for role in ROLE_KEYWORDS:
        matched, by = roles.ranked.get(role, []), dict(roles.scores.get(role, []))
        rows.append((role, bool(matched), matched, by.get(matched[0], 0) if matched else 0,
                     [f"{c} ({s})" for c, s in roles.scores.get(role, [])], role in roles.overridden))
    return df.sparkSession.createDataFrame(
        rows, "role string, found boolean, matched_columns array<string>, score int, candidates array<string>, overridden boolean"
    )


def column_choices(roles: Roles) -> dict[str, dict]:
    """What an override dialog needs: the chosen column and the others with their scores."""
    out = {}
    for role in ROLE_KEYWORDS:
        chosen = next(iter(roles.ranked.get(role, [])), None)
        scored = roles.scores.get(role, [])
        out[role] = {
            "chosen": chosen, "score": dict(scored).get(chosen, 0), "overridden": role in roles.overridden,
            "alternatives": [(c, s) for c, s in scored if c != chosen],
        }
    return out


def unused_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Columns that no role chose."""
    chosen = {roles.get(r) for r in ROLE_KEYWORDS}
    return [c for c in df.columns if c not in chosen and c != "_row_id"]


def extract_date_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Created and closed first, then every column that holds times."""
    first = [c for c in (roles.created, roles.closed) if c]
    return first + [f.name for f in df.schema.fields if dates.is_typed(f.dataType) and f.name not in first]
