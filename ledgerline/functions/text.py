"""Text predicates, cleaning and scores as Column functions.

Java's ``trim`` knows spaces only and its ``\\w`` ASCII only, so patterns carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.config import CELL_CHARS, CLEAN_PATTERNS, STOP_WORDS

_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """White space of every kind off both ends."""
    return F.regexp_replace(c, _EDGES, "")


def fold(c: Column) -> Column:
    """Lower case, stripped; null is the empty string."""
    return F.coalesce(F.lower(strip(c.cast("string"))), F.lit(""))


def is_missing(name: str, kind: T.DataType) -> Column:
    """Null; NaN too, where the type has one."""
    c = F.col(quoted(name))
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (strip(c.cast("string")) == "")


def quoted(name: str) -> str:
    """A column name that may hold dots or spaces, for ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def _needed(pattern: str) -> str | None:
    """What a text must hold for a cleaning pattern to match; None where that is no one thing."""
    if "@" in pattern or pattern.startswith(r"\["):
        return "@" if "@" in pattern else r"\["
    if pattern.startswith(("https?:", "/[")):
        return "/"
    if pattern.startswith("[A-Za-z]:"):
        return ":"
    if pattern.startswith("www"):
        return "www"
    return r"\p{Nd}" if r"\d" in pattern or "[0-9]+" in pattern else None


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _removed(c: Column) -> Column:
    """A text without what the cleaning patterns match.

    Unicode classes are slow, so ASCII texts take plain patterns, and a pattern is left
    out where the text as written lacks what a match needs: deletions add nothing.
    """
    needs = {n: f"n{i}" for i, n in enumerate(sorted({_needed(p) or "" for p, _ in CLEAN_PATTERNS} - {""}))}
    facts = F.struct(
        c.alias("t"), c.rlike(r"[^\x00-\x7F]").alias("wide"), *[c.rlike(n).alias(name) for n, name in needs.items()]
    )

    def step(x: Column, pattern: str, any_case: bool):
        wide, plain = ("(?iU)" if any_case else "(?U)") + pattern, ("(?i)" if any_case else "") + pattern
        live = x[needs[_needed(pattern)]] if _needed(pattern) else F.lit(True)
        return lambda y: F.when(~live, y).when(x["wide"], F.regexp_replace(y, wide, "")).otherwise(F.regexp_replace(y, plain, ""))

    def chain(x: Column) -> Column:
        out = x["t"]
        for pattern, any_case in CLEAN_PATTERNS:
            out = bound(out, step(x, pattern, any_case))
        return out

    return bound(facts, chain)


def clean(c: Column) -> Column:
    """Ids, codes, addresses, paths, tags, dates, numbers and acronyms out, white space squeezed."""
    return strip(F.regexp_replace(_removed(c), r"(?U)[^\S ]\s*| \s+", " "))


def clean_flat(c: Column) -> Column:
    """As ``clean``, without lambdas: the form that can be the input of a Python function."""
    for pattern, any_case in CLEAN_PATTERNS:
        c = F.regexp_replace(c, ("(?iU)" if any_case else "(?U)") + pattern, "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: Column) -> Column:
    """The key under which descriptions count as the same: cleaned, lower case, ASCII letters and digits."""
    low = F.lower(_removed(F.coalesce(c.cast("string"), F.lit(""))))
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def tokens(normalised: Column) -> Column:
    """Distinct words of four letters or more that are not stop words."""
    long = F.filter(F.split(normalised, " "), lambda w: F.length(w) >= 4)
    return F.array_except(F.array_distinct(long), F.array(*[F.lit(w) for w in STOP_WORDS]))


def length_class(text: Column, shortest: int, longest: int) -> tuple[Column, Column, Column, Column]:
    """Length of the stripped text, and whether it is empty, short, long."""
    n = F.length(strip(F.coalesce(text.cast("string"), F.lit(""))))
    return n, n == 0, (n > 0) & (n < shortest), n > longest


def quality_score(n: Column, group: Column, shortest: int, longest: int) -> Column:
    """0 to 100: empty 0, over-long 40, short 5-39, repeated 45 or 58, else 65-100 by length."""
    short = F.floor(F.greatest(F.lit(5.0), F.least(F.lit(39.0), n / max(shortest, 1) * 39.0)))
    scaled = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(35.0), (n - shortest) / 1000.0 * 35.0)))
    return (
        F.when(n == 0, 0).when(n > longest, 40).when(n < shortest, short)
        .when(group >= 10, 45).when(group >= 3, 58).otherwise(65 + scaled).cast("int")
    )


def quality_tier(n: Column, score: Column, shortest: int, longest: int, group: Column) -> Column:
    return (
        F.when(n == 0, "Critical").when(n > longest, "Fair").when(n < shortest, "Poor")
        .when(group >= 3, "Fair").when(score >= 90, "Excellent").otherwise("Good")
    )


def shown(c: Column, limit: int) -> Column:
    """White space squeezed, cut to ``limit`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def sanitise(frame: DataFrame, cell_limit: int | None = CELL_CHARS) -> DataFrame:
    """Values fit for a sheet or CSV: no control characters, Yes/No for booleans, zone-less times."""
    out = []
    for f in frame.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StringType):
            c = F.regexp_replace(c, _CONTROL, "")
            if cell_limit:
                cut = F.concat(F.substring(c, 1, cell_limit - 1), F.lit("…"))
                c = F.when(F.length(c) > cell_limit, cut).otherwise(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, "Yes").when(~c, "No")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return frame.select(*out)


def formula_columns(frame: DataFrame) -> list[str]:
    """Text columns in which some value starts with ``=``."""
    names = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return []
    row = frame.agg(*[F.coalesce(F.bool_or(F.col(quoted(n)).startswith("=")), F.lit(False)).alias(str(i)) for i, n in enumerate(names)]).first()
    return [n for i, n in enumerate(names) if row[i]]
