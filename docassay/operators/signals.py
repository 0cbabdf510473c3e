"""Measurements the rules decide on, one column each, computed once per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions import extract as ex, text as tx
from docassay.functions.patterns import WS, java

c = F.col
EVIDENCE_KEYS = ("projects", "experience")


def _first_pos(keys: Column, wanted: tuple[str, ...]) -> Column:
    """Smallest 1-based position of any wanted key, null when there is none."""
    return F.array_min(
        F.filter(F.array(*[F.array_position(keys, k) for k in wanted]), lambda p: p > 0)
    )


def _body(sections: Column, keys: tuple[str, ...]) -> Column:
    return F.flatten(
        F.transform(F.filter(sections, lambda s: s["key"].isin(*keys)), lambda s: s["body"])
    )


def sorted_openers(first_words: Column) -> Column:
    """Openers as ``(word, pos)`` with equal words side by side."""
    first = F.transform(
        first_words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))
    )
    return F.array_sort(F.filter(first, lambda o: o["word"] != ""))


def opener_groups(openers: Column) -> Column:
    """Where each word starts in the sorted openers, as ``(at, pos, word)``."""
    starts = F.transform(
        openers,
        lambda o, i: F.when(
            (i == 0) | (F.get(openers, i - 1)["word"] != o["word"]),
            F.struct(i.alias("at"), o["pos"].alias("pos"), o["word"].alias("word")),
        ),
    )
    return F.array_compact(starts)


def repeated_openers(groups: Column, openers: Column) -> Column:
    """Words opening three or more items as ``(less, pos, word, n)``, most frequent first."""
    counted = F.transform(
        groups,
        lambda g, i: F.struct(
            (g["at"] - F.coalesce(F.get(groups, i + 1)["at"], F.size(openers))).alias("less"),
            g["pos"].alias("pos"),
            g["word"].alias("word"),
            (F.coalesce(F.get(groups, i + 1)["at"], F.size(openers)) - g["at"]).alias("n"),
        ),
    )
    return F.array_sort(F.filter(counted, lambda o: o["n"] >= 3))


def add_signals(facts: DataFrame, lists: dict | None = None) -> DataFrame:
    """Add the ``s_*`` columns. ``lists`` overrides word lists by name."""
    use = {
        "verbs": lx.ACTION_VERBS, "filler": lx.FILLER_PHRASES, "personal": lx.PERSONAL_DETAILS,
        "weak_openers": lx.WEAK_OPENERS, "skills": lx.SKILL_GROUPS, "soft": lx.SOFT_SKILLS,
        "nicknames": lx.EMAIL_NICKNAMES,
    } | (lists or {})
    terms = list(dict.fromkeys(t for group in use["skills"].values() for t in group))
    df = facts.withColumns(
        {
            "s_emails": ex.emails(c("text")),
            "s_phones": ex.phones(c("text")),
            "s_links": ex.link_kinds(
                F.concat(c("text"), F.lit("\n"), F.array_join("hyperlinks", "\n"))
            ),
            "s_terms": tx.find_terms(c("lower"), terms),
            "s_first_words": F.transform("bullets", ex.first_word),
            "s_evidence_body": _body(c("sections"), EVIDENCE_KEYS),
            "s_skills_section": F.get(F.filter("sections", lambda s: s["key"] == "skills"), F.lit(0)),
            "s_keys": F.transform("sections", lambda s: s["key"]),
            "s_first_line": F.coalesce(F.get("nonblank", F.lit(0)), F.lit("")),
            "s_ranges": ex.date_ranges(c("text")),
            "s_metrics": ex.metrics(c("text")),
            "s_filler": tx.find_phrases(c("lower"), use["filler"]),
            "s_weak_openers": tx.find_phrases(c("lower"), use["weak_openers"]),
            "s_soft": tx.find_phrases(c("lower"), use["soft"]),
            "s_personal": tx.find_phrases(c("lower"), use["personal"]),
            "s_typos": ex.typos(c("lower")),
            "s_slips": ex.brand_slips(c("text")),
            "s_shouting": F.size(ex.shouting_lines(c("trimmed"))),
            "s_pronouns": F.size(ex.pronouns(c("text"))),
            "s_years": F.size(ex.years(c("text"))),
            "s_duties": F.filter("bullets", lambda b: b.rlike(java(lx.DUTY_OPENER, True))),
            "s_bullet_words": F.transform("bullets", lambda b: F.size(F.split(b, WS + "+"))),
            "s_header_contact": c("header").rlike(ex.EMAIL) | c("header").rlike(ex.PHONE),
            "s_location": ex.has_location(c("header")),
            "s_full_url": c("text").rlike(java(r"https?://\S", True)),
            "s_bare_domain": c("text").rlike(
                java(r"(?:^|\s)(?:www\.)?(?:linkedin\.com|github\.com)/\S", True)
            ),
        }
    )
    df = df.withColumn("s_email_local", F.lower(F.split(F.get("s_emails", F.lit(0)), "@")[0]))
    df = df.withColumns(
        {
            "s_groups": F.array_compact(
                F.array(
                    *[
                        F.when(F.arrays_overlap("s_terms", tx.literals(group)), F.lit(name))
                        for name, group in use["skills"].items()
                    ]
                )
            ),
            "s_verbs": F.array_intersect("s_first_words", tx.literals(use["verbs"])),
            "s_points": F.expr(
                "if(array_contains(section_keys, 'education'), 3, 0)"
                " + if(array_contains(section_keys, 'skills'), 3, 0)"
                " + if(arrays_overlap(section_keys, array('projects', 'experience')), 4, 0)"
            ),
            "s_odd_local": F.expr("length(regexp_extract(s_email_local, '[0-9]{4,}', 0)) >= 5")
            | F.exists(tx.literals(use["nicknames"]), lambda w: F.contains(c("s_email_local"), w)),
            "s_opener_list": sorted_openers(c("s_first_words")),
            "s_detail": F.size(
                F.filter("s_evidence_body", lambda x: x.rlike(java(lx.DETAIL_BULLET)))
            ),
            "s_first_evidence": _first_pos(c("s_keys"), EVIDENCE_KEYS),
            "s_first_private": _first_pos(c("s_keys"), ("personal", "declaration")),
            "s_has_evidence": F.arrays_overlap(c("section_keys"), tx.literals(EVIDENCE_KEYS)),
            "s_long": F.size(F.filter("s_bullet_words", lambda n: n > 34)),
            "s_short": F.size(F.filter("s_bullet_words", lambda n: n < 6)),
            "s_spelling": F.size("s_typos") + F.size("s_slips"),
            "s_evidence_text": F.lower(F.array_join("s_evidence_body", "\n")),
            "s_listed_text": F.lower(F.array_join(c("s_skills_section.body"), "\n")),
        }
    )
    df = df.withColumns(
        {
            "s_opener_groups": opener_groups(c("s_opener_list")),
            "s_strong": F.filter(
                "bullets", lambda b, i: F.array_contains("s_verbs", F.get("s_first_words", i))
            ),
        }
    )
    # Listed skills are those of the document that stand in the skills section; the rest of the
    # comparison is set algebra on short arrays.
    df = df.withColumns(
        {
            "s_openers": repeated_openers(c("s_opener_groups"), c("s_opener_list")),
            "s_listed": F.array_intersect("s_terms", tx.find_terms(c("s_listed_text"), terms)),
            "s_in_evidence": tx.find_terms(c("s_evidence_text"), terms),
        }
    )
    return df.withColumns(
        {
            "s_shown": F.array_intersect("s_listed", "s_in_evidence"),
            "s_unbacked": F.array_except("s_listed", "s_in_evidence"),
        }
    )
