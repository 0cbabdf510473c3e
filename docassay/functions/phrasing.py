"""Small text helpers for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.patterns import WS
from docassay.functions.text import js_trim, lookup

STATE_MARKS = {"pass": "[x]", "warn": "[!]", "fail": "[ ]", "info": "[-]"}
STATE_WORDS = {"pass": "fine", "warn": "could be better", "fail": "to fix", "info": "not judged"}


def excerpt(c: Column, limit: int = 90) -> Column:
    """Shorten to ``limit`` characters, at a blank if one lies past position 40."""
    clean = js_trim(F.regexp_replace(c, WS + "+", " "))
    cut = F.left(clean, F.lit(limit))
    blank = F.length(cut) - F.locate(" ", F.reverse(cut))
    ends = F.when(F.contains(cut, F.lit(" ")) & (blank > 40), blank).otherwise(F.lit(limit))
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.left(cut, ends), F.lit("…"))
    )


def list_phrase(items: Column, limit: int = 3) -> Column:
    """``a, b and c``; ``a, b, c and n more`` beyond the limit."""
    n = F.size(items)
    more = F.concat(
        F.array_join(F.slice(items, 1, limit), ", "),
        F.lit(" and "), (n - limit).cast("string"), F.lit(" more"),
    )
    full = F.concat(
        F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
        F.lit(" and "), F.element_at(items, -1),
    )
    return (
        F.when(n == 0, F.lit(""))
        .when(n > limit, more)
        .when(n == 1, F.element_at(items, 1))
        .otherwise(full)
    )


def pluralise(n: Column, singular: str, plural: str | None = None) -> Column:
    noun = F.when(n == 1, F.lit(singular)).otherwise(F.lit(plural or singular + "s"))
    return F.concat(n.cast("string"), F.lit(" "), noun)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def tone(pct: Column) -> Column:
    return F.when(pct >= 80, F.lit("good")).when(pct >= 50, F.lit("warn")).otherwise(F.lit("bad"))


def state_mark(state: Column) -> Column:
    return lookup(state, STATE_MARKS)


def state_words(state: Column) -> Column:
    return lookup(state, STATE_WORDS)


def percent(part: Column, whole: Column) -> Column:
    """``floor(100 * part / whole + 0.5)``, 0 when there is nothing to divide by."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(100.0)
    return F.coalesce(F.floor(share + F.lit(0.5)), F.lit(0)).cast("int")
