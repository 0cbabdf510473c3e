"""Secrets in texts: every rule in one byte pass of a combined automaton."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.automaton import Automaton, Rule
from docassay.llm.common import spans_of, table

#: The contract's base rules.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 8, r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Published formats: authorization headers, keys of large services, signed web tokens, key files, addresses with a password.
ADDED = (
    Rule("bearer", r"[A-Za-z0-9._~+/-]+=*", 20, r"[Bb]earer\x20+"),
    Rule("key", r"(gh[pousr]_|AIza|xox[abprs]-|[prs]k_live_)[A-Za-z0-9_-]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
    Rule("url", r"(https?|ftp|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$*-]+@[A-Za-z0-9.-]+"),
)


def long_enough(rule: Rule, span: str) -> bool:
    """Whether what follows the span's head has the rule's least length."""
    head = re.match(rule.head, span, re.IGNORECASE if rule.any_case else 0)
    return len(span) - head.end() >= rule.least


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, base: Sequence[Rule] = BASE, added: Sequence[Rule] = ADDED) -> DataFrame:
    """``docs`` with n_<kind> for every base rule, base and spans (kind:start:end, comma-joined).

    Offsets are code points, ends exclusive; spans come by start, then in the order of the rules.
    Within a rule they are leftmost, longest and apart; rules may overlap each other. A null text is
    an empty one and has no span. Rows are taken one by one: repeats give equal results. Columns of
    ``docs`` named like an added one are replaced.
    """
    rules = (*base, *added)
    kinds = [r.kind for r in rules]
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(rules))  # its size follows from the rules alone
    new = [*(f"n_{r.kind}" for r in base), "base", "spans"]

    @F.pandas_udf(", ".join(f"n_{r.kind} long" for r in base) + ", base string, spans string")
    def scan(text: pd.Series) -> pd.DataFrame:
        automaton = shared.value
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in text]
        found: list[list[tuple[int, int, int]]] = [[] for _ in raw]
        for low, high in spans_of([len(t) for t in raw], 1 << 21):
            part = raw[low:high]
            for i, r, start, end in automaton.matches(part):
                span = part[i][start:end].decode("ascii")
                if long_enough(rules[r], span):
                    found[low + i].append((start, r, end))
        rows = []
        for i, own in enumerate(found):
            own.sort()
            if own and len(raw[i]) != len(text.iloc[i]):  # bytes to code points
                lead = np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)
                own = [(int(lead[a]) - 1, r, int(lead[b - 1])) for a, r, b in own]
            named = [(kinds[r], a, b) for a, r, b in own]
            first = [s for s, (_, r, _) in zip(named, own, strict=True) if r < len(base)]
            rows.append((*(sum(r == k for _, r, _ in own) for k in range(len(base))), joined(first), joined(named)))
        return pd.DataFrame(rows, columns=new).astype({"base": object, "spans": object})

    out = docs.drop(*new)
    struct = "_secrets" + "_" * max(map(len, docs.columns), default=0)  # clashes with no column
    return out.withColumn(struct, scan("text")).select(*[F.col(f"`{c}`") for c in out.columns], f"{struct}.*")


def redact_secrets(found: DataFrame) -> DataFrame:
    """``found`` with redacted: the text, every span's characters replaced by its kind in brackets."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            parts, at = [], 0
            for kind, a, b in (x.split(":") for x in (s or "").split(",") if x):
                if int(a) >= at:
                    parts += [t[at : int(a)], f"[{kind}]"]
                at = max(at, int(b))
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return found.withColumn("redacted", cut("text", "spans"))


def _sql() -> str:
    """Matches by extraction, their places by the lengths of what lies between them."""
    parts = []
    for i, r in enumerate((*BASE, *ADDED)):
        regex = ("(?i)" if r.any_case else "") + r.regex.replace(r"\"", '"').replace("'", "''")
        if r.kind == "hex":  # a run that is too short holds no other match
            regex = f"[0-9a-f]{{{r.least},}}"
        head = ("(?i)" if r.any_case else "") + "^" + r.head.replace(r"\"", '"').replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS r, '{r.kind}' AS kind, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + list_sum(list_transform(found[1:k], lambda g: length(g))) - length(m) AS start
  FROM (SELECT doc_id, found, string_split_regex(text, '{regex}') AS gaps, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS k
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}') AS found FROM docs) WHERE len(found) > 0))
WHERE length(m) - length(regexp_extract(m, '{head}')) >= {r.least}"""
        )
    spans = "\nUNION ALL\n".join(parts)
    counts = ", ".join(f"count(*) FILTER (r = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))
    one = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans}),
found AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY start, r) FILTER (r < {len(BASE)}) AS base,
                 string_agg({one}, ',' ORDER BY start, r) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


SQL = _sql()


def op13_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{r.kind}" for r in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
