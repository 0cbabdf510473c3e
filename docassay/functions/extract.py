"""Extractors: what a text mentions, as arrays or flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions.patterns import java, spelled
from docassay.functions.text import js_trim, literals

EMAIL = java(lx.EMAIL)
PHONE = java(lx.PHONE)
NO_STRINGS = "array<string>"


def _all(c: Column, pattern: str, ignore_case: bool = False, first: str = "") -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern, ignore_case, first)), F.lit(0))


def emails(c: Column) -> Column:
    """Distinct addresses; texts without ``@`` are not scanned at all."""
    found = F.when(F.contains(c, F.lit("@")), _all(c, lx.EMAIL))
    return F.array_distinct(F.coalesce(found, F.array().cast(NO_STRINGS)))


def phones(c: Column) -> Column:
    """Phone-like runs of 10 to 14 digits."""
    return F.filter(
        _all(c, lx.PHONE, first="[+(0-9]"),
        lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(10, 14),
    )


def urls(c: Column) -> Column:
    found = F.when(F.contains(c, F.lit("://")), _all(c, r"https?://[^\s)<>" + "\"']+", True))
    return F.array_distinct(F.coalesce(found, F.array().cast(NO_STRINGS)))


def years(c: Column) -> Column:
    return _all(c, lx.YEAR, first="[12]")


def date_ranges(c: Column) -> Column:
    return _all(c, lx.DATE_RANGE, True, "[12jfmasond]")


def metrics(c: Column) -> Column:
    """Distinct number-plus-unit mentions."""
    return F.array_distinct(_all(c, lx.METRIC, True, "[0-9]"))


def pronouns(c: Column) -> Column:
    return _all(c, lx.PRONOUN, True, "[im]")


def link_kinds(searchable: Column) -> Column:
    """Kinds of profile links present, in fixed order."""
    flags = []
    for kind, pattern in lx.LINK_PATTERNS.items():
        if kind == "portfolio":
            first = F.regexp_extract(searchable, java(pattern, True), 0)
            hit = (first != "") & ~first.rlike(java(lx.MAIL_HOSTS, True))
        else:
            hit = searchable.rlike(java(pattern, True))
        flags.append(F.when(hit, F.lit(kind)))
    any_kind = java("(?:" + "|".join(lx.LINK_PATTERNS.values()) + ")", True, "[lgbcmdhsnkw]")
    found = F.when(searchable.rlike(any_kind), F.array_compact(F.array(*flags)))
    return F.coalesce(found, F.array().cast(NO_STRINGS))


def has_location(header: Column) -> Column:
    city = r"\b(?:" + "|".join(lx.CITIES) + r")\b"
    return header.rlike(java(city, True, "[bmdnghcpkajilr]")) | header.rlike(java(lx.PLACE_PAIR, first="[A-Z]"))


def typos(lower: Column) -> Column:
    """Distinct known misspellings in order of appearance."""
    tokens = F.regexp_extract_all(lower, F.lit(spelled("[a-z']{4,}")), F.lit(0))
    return F.array_intersect(tokens, literals(lx.TYPOS))


def brand_slips(text: Column) -> Column:
    """Split brand names, as ``found → usual`` notes."""
    notes = []
    for pattern, usual in lx.BRAND_SLIPS:
        hit = F.regexp_extract(text, java(rf"\b{pattern}\b", True, f"[{pattern[0]}]"), 0)
        notes.append(F.when(hit != "", F.concat(hit, F.lit(f" → {usual}"))))
    any_slip = java("(?:" + "|".join(p for p, _ in lx.BRAND_SLIPS) + ")", True, "[jnmgp]")
    found = F.when(text.rlike(any_slip), F.array_compact(F.array(*notes)))
    return F.coalesce(found, F.array().cast(NO_STRINGS))


def first_word(sentence: Column) -> Column:
    """First blank-separated token, lower case, letters only."""
    token = F.regexp_extract(js_trim(sentence), java(r"^\S*"), 0)
    return F.regexp_replace(F.lower(token), "[^a-z]", "")


def shouting_lines(trimmed_lines: Column) -> Column:
    """Lines of 25 or more characters and 15 or more letters without a lower-case letter."""
    return F.filter(
        trimmed_lines,
        lambda x: (F.length(x) >= 25)
        & ~x.rlike("[a-z]")
        & (F.length(F.regexp_replace(x, "[^A-Z]", "")) >= 15),
    )
