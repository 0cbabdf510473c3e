"""Regular expressions with one meaning in both regex dialects used here.

Patterns are written once, in the browser dialect (ASCII ``\\b``, Unicode ``\\s``), and
rendered for the JVM (:func:`java`) or for an RE2 engine (:func:`re2`). JDK 17 treats accented
letters as word characters at ``\\b`` and only knows ASCII ``\\s``, so both are spelled out.
"""

from __future__ import annotations

import re

#: Every character that counts as white space.
WS_CHARS = "\t\n\x0b\f\r " + "".join(
    map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
_WIDE = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_FLAT_WS = "\t-\r \xa0" + _WIDE
# The wide blanks sit behind one range test; the narrow ones are listed, so they are decided by a bit set.
_NESTED_WS = "\t\n\x0b\f\r \xa0[\u1680-\ufeff&&[" + _WIDE + "]]"
WS = f"[{_NESTED_WS}]"
WS_BUT_LF = WS.replace("\n", "")
RE2_WS = f"[{_FLAT_WS}]"
_WORD = "[A-Za-z0-9_]"


def spelled(pattern: str) -> str:
    """The same JVM pattern with ranges below U+0100 listed one by one.

    The JVM keeps single characters of a class in one bit set, but asks every range by a call of its own.
    """
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        ahead = pattern[i + 1 : i + 3]
        if c == "\\":
            out.append(c + ahead[:1])
            i += 2
        elif depth and c not in "[]" and len(ahead) == 2 and ahead[0] == "-" and ahead[1] not in "[]\\" and ord(c) < ord(ahead[1]) < 256:
            for point in range(ord(c), ord(ahead[1]) + 1):
                one = chr(point)
                out.append("\\" + one if 32 < point < 127 and not one.isalnum() else one)
            i += 3
        else:
            depth += (c == "[") - (c == "]" and depth > 0)
            out.append(c)
            i += 1
    return "".join(out)


def _render(pattern: str, jvm: bool) -> str:
    out, in_class, negated, i = [], False, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            token = pattern[i : i + 2]
            if token == r"\s" and in_class:
                token = _NESTED_WS if jvm and not negated else _FLAT_WS
            elif token == r"\s":
                token = WS if jvm else RE2_WS
            elif token == r"\S":
                token = f"[^{_FLAT_WS}]"
            elif token == r"\b" and jvm:
                token = f"(?<!{_WORD})" if i == 0 else f"(?!{_WORD})"
            out.append(token)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class, negated = True, pattern[i + 1] == "^"
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False, first: str = "") -> str:
    """JVM form. A leading ``\\b`` opens a word, any later one closes a word.

    ``first`` is a class every match starts with; testing it first spares the look-behind.
    """
    ahead = f"(?={first})" if first else ""
    return ("(?i)" if ignore_case else "") + spelled(ahead + _render(pattern, True))


def re2(pattern: str, ignore_case: bool = False) -> str:
    """RE2 form; its ``\\b`` is already ASCII."""
    return ("(?i)" if ignore_case else "") + _render(pattern, False)


def quote(literal: str) -> str:
    """Escape a literal for either dialect."""
    return re.sub(r"([.*+?^${}()|\[\]\\/-])", r"\\\1", literal)


def term_regex(term: str) -> str:
    """A whole-term match: left side not ``[a-z0-9+#.]``, right side not ``[a-z0-9+#]``."""
    return f"(^|[^a-z0-9+#.]){quote(term)}($|[^a-z0-9+#])"
