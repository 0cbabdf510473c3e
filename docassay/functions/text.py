"""Column functions that clean and split text. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions.patterns import WS, WS_BUT_LF, WS_CHARS, java, quote, spelled

BULLET = java(rf"^\s*(?:[{lx.BULLET_MARKERS}]|\d{{1,2}}[.)])\s+")

# Fixed values: (code points, replacement), applied in this order after line ends are unified.
_REPLACEMENTS = [
    ([0xA0, 0x2007, 0x202F], " "),
    ([0x2018, 0x2019, 0x201B, 0x2032], "'"),
    ([0x201C, 0x201D, 0x201F, 0x2033], '"'),
    ([0x2010, 0x2011], "-"),
    ([0x2026], "..."),
    ([0xFB01], "fi"),
    ([0xFB02], "fl"),
    ([0x09], "    "),
]
#: One pass that every replaced character stops; texts without any are left alone.
_REPLACED = "[\r\t\xa0\u2007-\ufb02]"
#: The same for blanks that are neither a space nor a line feed, and for just the characters that are replaced.
_ODD = "[\t\r\x0b\f\xa0[\u1680-\ufeff&&[" + "".join(
    sorted({w for w in WS_CHARS if w > "\xa0"} | {chr(p) for points, _ in _REPLACEMENTS for p in points if p > 0xA0})
) + "]]]"


def js_trim(c: Column) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def normalise_text(c: Column) -> Column:
    """Unify line ends, blanks, quotes, dashes and ligatures; squeeze blanks; trim lines.

    Most texts are so already but for their ends, which a few searches tell.
    """
    plain = c
    done = ~plain.rlike(_ODD)
    for found in ("  ", " \n", "\n\n\n"):
        done = done & ~F.contains(plain, F.lit(found))
    for found, instead in [("\r\n", "\n"), ("\r", "\n")] + [
        (chr(point), instead) for points, instead in _REPLACEMENTS for point in points
    ]:
        c = F.replace(c, F.lit(found), F.lit(instead))
    c = F.when(plain.rlike(_REPLACED), c).otherwise(plain)
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, WS_BUT_LF + r"+(?=\n|\z)", "")
    return js_trim(F.when(done, plain).otherwise(c))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def is_blank(line: Column) -> Column:
    return js_trim(line) == ""


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def strip_bullet(line: Column) -> Column:
    return js_trim(F.regexp_replace(line, BULLET, ""))


def words(c: Column) -> Column:
    trimmed = js_trim(c)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def word_count(c: Column) -> Column:
    """Number of words of a trimmed text: gaps plus one, without building an array."""
    gaps = F.regexp_count(c, F.lit(WS + "+"))
    return F.when(c == "", F.lit(0)).otherwise(gaps + 1)


def char_count(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(c, WS + "+", ""))


def bullet_texts(trimmed_lines: Column) -> Column:
    """List items whose text is longer than 10 characters, without the marker."""
    texts = F.transform(trimmed_lines, lambda x: F.when(is_bullet(x), strip_bullet(x)))
    return F.filter(texts, lambda x: F.length(x) > 10)


def header(lines: Column) -> Column:
    """The first six lines that are not blank."""
    return F.array_join(F.slice(F.filter(lines, lambda x: ~is_blank(x)), 1, 6), "\n")


def tokenise(c: Column) -> Column:
    """Lower-case tokens of ``a-z0-9+#.-/``; outer dots and dashes are dropped."""
    bare = F.transform(
        F.split(F.lower(c), spelled("[^a-z0-9+#./-]+")), lambda t: F.btrim(t, F.lit("-."))
    )
    return F.filter(bare, lambda t: t != "")


#: Characters from the most frequent on; others are rarer than all of these.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def rare_part(phrase: str) -> str:
    """The end of a phrase from its rarest character on, of three characters at least."""
    places = range(max(len(phrase) - 2, 1))
    rank = lambda i: _FREQUENT.find(phrase[i]) % 100
    return phrase[max(places, key=lambda i: (rank(i), -i)) :] if phrase else phrase


def find_phrases(lower: Column, phrases: list[str]) -> Column:
    """Entries of the list contained anywhere in the text, in list order.

    Bytes are searched twice as fast as strings. A search compares wherever the first byte stands, so each
    phrase is first searched for from its rarest character on; few are then searched for as a whole.
    """
    whole, parts = literals(phrases), literals([rare_part(p) for p in phrases])

    def found(text: Column) -> Column:
        return F.filter(
            whole, lambda p, i: F.contains(text, F.get(parts, i).cast("binary")) & F.contains(text, p.cast("binary"))
        )

    return F.get(F.transform(F.array(lower.cast("binary")), lambda text: F.when(text.isNotNull(), found(text))), F.lit(0))


def between(array: Column, first: Column, last: Column, change=lambda x: x) -> Column:
    """Elements ``first..last`` (0-based, inclusive), cost in their number only.

    ``slice`` copies its whole input first, which turns quadratic inside a lambda.
    """
    positions = F.when(first <= last, F.sequence(first, last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(positions, lambda i: change(F.get(array, i)))


#: A run's head: leading dots and what follows up to the next dot.
HEAD = "[.]*[^.]*"
#: What a run has after its head.
AFTER_HEAD = spelled(r"\.(?<=[a-z0-9+#]\.)[a-z0-9+#.]*")
#: Terms that are the head of every run they start.
WHOLE_HEAD = "^[.]*[a-z0-9+#]+$"


def head_of(run: Column) -> Column:
    return F.regexp_extract(run, HEAD, 0)


def heads(lower: Column) -> Column:
    """Heads of the maximal runs of ``[a-z0-9+#.]``.

    A term of the form :data:`WHOLE_HEAD` stands in the text (left side free, right side free
    or a dot) exactly when it is one of these.
    """
    return F.split(F.regexp_replace(lower, AFTER_HEAD, ""), spelled("[^a-z0-9+#.]+"))


def is_whole_head(term: str) -> bool:
    return re.fullmatch(WHOLE_HEAD[1:-1], term) is not None


def find_terms(lower: Column, terms: list[str]) -> Column:
    """Entries of the list that stand as whole terms, in list order.

    Terms that are heads are looked up among the :func:`heads` of the text, all at once; the few
    with inner dots, blanks, dashes or slashes start with a head of the text (or a dot or a sign)
    and are only then located and checked by regex.
    """
    multi = [t for t in terms if not is_whole_head(t)]
    lead = {t: re.match("[a-z0-9+#]*", t).group() for t in multi}
    wanted = dict.fromkeys([t for t in terms if is_whole_head(t)] + [k for k in lead.values() if k])

    def found(among: Column) -> Column:
        hits = F.array_intersect(literals([t for t in terms if is_whole_head(t)]), among)
        extra = F.filter(
            literals(multi),
            lambda t: (F.array_contains(among, lookup(t, lead)) | (lookup(t, lead) == "")) & F.contains(lower, t),
        )
        sure = F.filter(
            extra,
            lambda t: F.regexp_like(
                lower,
                F.concat(
                    F.lit("(^|[^a-z0-9+#.])"),
                    lookup(t, {t: quote(t) for t in multi}),
                    F.lit("($|[^a-z0-9+#])"),
                ),
            ),
        )
        return F.array_intersect(literals(terms), F.concat(hits, sure))

    # Probing the few wanted ones with all heads costs less than a set of all heads.
    known = literals(list(wanted))
    among = F.array_intersect(known, F.array_intersect(heads(lower), known))
    return F.get(F.transform(F.array(among), found), F.lit(0)) if multi else among


def literals(values) -> Column:
    """A constant array of strings, built in one call and folded by the optimizer."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small constant table."""
    flat = "\x1f".join(f"{k}\x1e{v}" for k, v in table.items())
    return F.element_at(F.str_to_map(F.lit(flat), F.lit("\x1f"), F.lit("\x1e")), key)
