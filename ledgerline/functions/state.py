"""What a state value says about a ticket."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.config import ACTIVE_WORDS, NO_STATE, TERMINAL_WORDS
from ledgerline.functions.text import fold


def classify(c: Column) -> Column:
    """terminal, active or unknown; a closed word wins over an open one."""
    f = fold(c)
    return (
        F.when(f.isin(NO_STATE), "unknown")
        .when(f.rlike("|".join(TERMINAL_WORDS)), "terminal")
        .when(f.rlike("|".join(ACTIVE_WORDS)), "active")
        .otherwise("unknown")
    )


def is_terminal(c: Column) -> Column:
    return classify(c) == "terminal"


def is_active(c: Column) -> Column:
    return classify(c) == "active"


def is_cancelled(c: Column) -> Column:
    return fold(c).contains("cancel")


def reads_as(c: Column) -> Column:
    k = classify(c)
    return F.when(k == "terminal", "Closed").when(k == "active", "Open").otherwise("Unrecognised")
