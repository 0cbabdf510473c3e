"""The default pack: 36 rules in six categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions.patterns import WS, java
from docassay.functions import phrasing as ph
from docassay.functions.text import lookup
from docassay.operators.rulepack import Branch, Rule, RulePack

c = F.col


#: Where the branches of the default pack part. Another pack may move any of them.
CUTS: dict[str, float] = {
    "parse.text.pass": 1200, "parse.text.warn": 400, "parse.order.right_share": 0.35,
    "parse.containers.box_chars": 60, "parse.containers.table_rows": 6, "parse.shape.lines": 8,
    "structure.sections.warn": 6, "structure.depth.pass": 6, "structure.depth.warn": 2, "structure.dates.pass": 2,
    "structure.order.sections": 3, "impact.verbs.pass": 0.7, "impact.verbs.warn": 0.35, "impact.metrics.pass": 4,
    "impact.metrics.warn": 1, "impact.pronouns.warn": 2, "impact.filler.warn": 2, "skills.named.pass": 8,
    "skills.named.warn": 4, "skills.breadth.pass": 3, "skills.fluff.warn": 0.35, "skills.evidence.pass": 0.4,
    "skills.evidence.warn": 0.2, "hygiene.personal.warn": 2, "hygiene.length.good": 300, "hygiene.length.least": 200,
    "hygiene.length.most": 700, "hygiene.length.long": 900, "hygiene.spelling.warn": 2, "hygiene.caps.warn": 1,
}


def _n(array: str):
    return F.size(array)


def _now(part):
    return part() if callable(part) else part


def _late(fn):
    """Put a column function off until a report asks for texts."""

    def build(*args):
        return lambda: fn(*[_now(a) for a in args])

    return build


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_text = _late(_join)
_num = _late(lambda x: F.expr(x).cast("string") if isinstance(x, str) else x.cast("string"))
_either = _late(lambda test, yes, no: F.when(test, F.lit(yes) if isinstance(yes, str) else yes).otherwise(F.lit(no) if isinstance(no, str) else no))
_head = _late(lambda name, k: F.slice(name, 1, k))
_all = _late(F.col)
excerpt, list_phrase, pluralise, thousands = map(_late, (ph.excerpt, ph.list_phrase, ph.pluralise, ph.thousands))


def parse_rules(k: dict[str, float]) -> list[Rule]:
    meta = c("meta")
    pasted = c("source_kind") == "text"
    density = meta["text_density"]
    columns = meta["multi_column"]
    boxes = meta["text_box_chars"]
    images = meta["image_count"]
    blank_pages = F.size(meta["image_only_pages"])
    return [
        Rule("parse.text", "Text can be selected", 10, (
            Branch("pass", 10, _text(thousands(density), " characters were read."), when=density >= k["parse.text.pass"]),
            Branch("warn", 5, _text("No more than ", thousands(density), " characters were read."),
                   "Look for content locked into pictures and describe the work in more detail.", when=density >= k["parse.text.warn"]),
            Branch("fail", 0, _either(blank_pages > 0, _text(pluralise(blank_pages, "page"), " without any text."),
                                      "Hardly any text was found."),
                   "Pictures of text look empty to software. Export real text from the editor."),
        )),
        Rule("parse.order", "Order of reading", 6, (
            Branch("info", 0, "Plain text carries no layout to judge.", "Submit the file itself to judge its layout.", when=pasted),
            Branch("fail", 0, "The page is set in two columns.", "Software reads across columns. Use one column from top to bottom.", when=columns),
            Branch("warn", 3, "Many rows begin on the right side.", "Side blocks may be read out of turn; keep the content in one column.",
                   when=meta["right_column_ratio"] > k["parse.order.right_share"]),
            Branch("pass", 6, "One column, in order."),
        )),
        Rule("parse.fonts", "Characters decode", 3, (
            Branch("info", 0, "Plain text has no fonts to judge.", when=pasted),
            Branch("fail", 0, "Most extracted characters make no sense.", "The font lacks a usable character map. Export again with a common font.",
                   when=meta["broken_glyphs"]),
            Branch("pass", 3, "Characters come out as written."),
        )),
        Rule("parse.containers", "Boxes and tables", 4, (
            Branch("info", 0, "Plain text has no boxes to judge.", when=pasted),
            Branch("fail", 0, _either(boxes > 60, _text(_num(boxes), " characters are inside text boxes."),
                                      "Table cells carry the layout."),
                   "Boxes are often skipped. Use normal paragraphs.", when=(boxes > k["parse.containers.box_chars"]) | columns),
            Branch("warn", 2, _text(pluralise(meta["tabular_rows"], "row"), " look like a table."),
                   "Software may mix up the cells of a table. Write them out as sentences.", when=meta["tabular_rows"] >= k["parse.containers.table_rows"]),
            Branch("pass", 4, "Nothing but plain paragraphs."),
        )),
        Rule("parse.images", "Pictures", 2, (
            Branch("warn", 1, _text(pluralise(images, "picture"), " in the file."), "Software cannot read pictures. Leave them out.", when=images > 0),
            Branch("pass", 2, "No pictures."),
        ), emitted=~pasted & ((images > 0) | (c("source_kind") == "docx"))),
        Rule("parse.header", "Page header", 4, (
            Branch("fail", 0, "Contact details are only in the page header.", "Page headers get dropped. Repeat the details in the body."),
        ), emitted=meta["contact_in_header_only"]),
        Rule("parse.format", "File type", 3, (
            Branch("info", 0, "Plain text has no file type to judge.", "Send a PDF unless Word is asked for.", when=pasted),
            Branch("pass", 3, _either(c("source_kind") == "pdf", "PDF: safe.", "Word file: reads well.")),
        )),
        Rule("parse.shape", "Line structure", 3, (
            Branch("fail", 0, "Only a few lines are left.", "Line breaks went missing. Export again instead of copying."),
        ), emitted=(c("word_count") > 0) & (_n("nonblank") < k["parse.shape.lines"])),
    ]


LINK_NAMES = {
    "linkedin": "LinkedIn", "code": "a code host", "portfolio": "an own site", "writing": "published work",
}
GROUP_NAMES = {
    "languages": "languages", "frontend": "frontend", "backend": "backend", "data": "data",
    "infra": "infrastructure", "tools": "tools",
}


def contact_rules(k: dict[str, float]) -> list[Rule]:
    email, phone = _n("s_emails") > 0, _n("s_phones") > 0
    first_email = F.get("s_emails", F.lit(0))
    links = c("s_links")
    on_linkedin = F.array_contains(links, "linkedin")
    on_code = F.array_contains(links, "code") | F.array_contains(links, "portfolio")
    names = _late(lambda kinds: F.transform(kinds, lambda k: lookup(k, LINK_NAMES)))(links)
    return [
        Rule("contact.reachable", "Email and phone", 8, (
            Branch("pass", 8, "Email and phone are given.", when=email & phone,
                   evidence=lambda: F.array(first_email, F.btrim(F.get("s_phones", F.lit(0))))),
            Branch("warn", 4, _either(email, "There is an email address but no phone number.",
                                      "There is a phone number but no email address."),
                   "Give both right under the name.", when=email | phone),
            Branch("fail", 0, "Neither email nor phone was found.", "Without either nobody can answer. Put both into the first lines."),
        )),
        Rule("contact.position", "Contact details on top", 3, (
            Branch("pass", 3, "Contact details are in the first lines.", when=c("s_header_contact")),
            Branch("warn", 1, "Contact details come late.", "Move them under the name."),
        ), emitted=email | phone),
        Rule("contact.email-tone", "Serious address", 3, (
            Branch("warn", 1, _text("\"", excerpt(first_email, 44), "\" looks like a private nickname."),
                   "Use an address made of first and last name.", when=c("s_odd_local")),
            Branch("pass", 3, "The address is built on a name.", evidence=lambda: F.array(first_email)),
        ), emitted=email),
        Rule("contact.links", "Links to work", 7, (
            Branch("pass", 7, _text("Linked: ", list_phrase(names), "."), when=on_linkedin & on_code, evidence=names),
            Branch("warn", 4, _text("Linked so far: ", list_phrase(names), "."), "Link code or a live project as well.",
                   when=on_linkedin),
            Branch("warn", 4, _text("Linked so far: ", list_phrase(names), "."), "Link a LinkedIn profile as well.",
                   when=F.size(links) > 0),
            Branch("fail", 0, "No profile or work is linked.", "Link LinkedIn and a code host with full addresses."),
        )),
        Rule("contact.url-form", "Full addresses", 2, (
            Branch("pass", 2, "Links are complete.", when=c("s_full_url") | (F.size("hyperlinks") > 0)),
            Branch("warn", 1, _either(c("s_bare_domain"), "Links lack https://.", "Links cannot be clicked."),
                   "Write the address in full, with https://."),
        ), emitted=F.size(links) > 0),
        Rule("contact.location", "Place", 2, (
            Branch("pass", 2, "A place is named on top.", when=c("s_location")),
            Branch("warn", 0, "No place near the name.", "Name a city or say that moving is possible."),
        )),
    ]


def structure_rules(k: dict[str, float]) -> list[Rule]:
    keys = c("section_keys")
    education, skills = F.array_contains(keys, "education"), F.array_contains(keys, "skills")
    evidence = c("s_has_evidence")
    missing = lambda: F.array_compact(F.array(
        F.when(~education, F.lit("Education")), F.when(~skills, F.lit("Skills")),
        F.when(~evidence, F.lit("Projects or Experience")),
    ))
    points = "s_points"
    expected = [k for k, _, wanted, _ in lx.SECTION_HEADINGS if wanted]
    headings = lambda: F.transform(
        F.filter("sections", lambda s: s["key"].isin(*expected)), lambda s: s["heading"]
    )
    use_plain = "Name the sections Education, Skills, Projects and Experience so that software can file them."
    detail = c("s_detail")
    early = F.get("s_keys", c("s_first_private") - 1)
    first = c("s_first_line")
    name_like = (
        (F.length(first).between(1, 48)) & ~first.rlike("@|[0-9]{4}")
        & (F.size(F.split(first, WS + "+")) <= 5) & first.rlike(java(lx.PERSON_NAME))
    )
    return [
        Rule("structure.sections", "Usual headings", 10, (
            Branch("pass", points, "Education, Skills and Projects or Experience have headings.", when=education & skills & evidence, evidence=headings),
            Branch("warn", points, _text("Not found: ", list_phrase(missing), "."), use_plain,
                   when=c("s_points") >= k["structure.sections.warn"]),
            Branch("fail", points, _text("Not found: ", list_phrase(missing), "."), use_plain),
        )),
        Rule("structure.depth", "Detail per entry", 5, (
            Branch("pass", 5, _text(pluralise(detail, "list item"), " describe projects and experience."), when=detail >= k["structure.depth.pass"]),
            Branch("warn", 3, _text("Just ", pluralise(detail, "list item"), " for projects and experience."),
                   "Give each entry two or three items: what, with which tools, to what end.", when=detail >= k["structure.depth.warn"]),
            Branch("fail", 0, "Projects are bare titles.", "Add two or three items below every title."),
        ), emitted=evidence),
        Rule("structure.dates", "Dated entries", 4, (
            Branch("pass", 4, _text(pluralise(_n("s_ranges"), "dated entry", "dated entries"), "."),
                   when=_n("s_ranges") >= k["structure.dates.pass"], evidence=_head("s_ranges", 3)),
            Branch("warn", 2, "Dates are given in part.", "Date every entry in one format.",
                   when=(_n("s_ranges") == 1) | (c("s_years") >= 2)),
            Branch("fail", 0, "No date ranges.", "Add month and year to every entry."),
        )),
        Rule("structure.order", "Order of sections", 3, (
            Branch("fail", 0, _text("The section ", early, " comes before the work itself."), "Work first; private details last or not at all.",
                   when=F.coalesce(c("s_first_private") < c("s_first_evidence"), F.lit(False))),
            Branch("pass", 3, "The strongest sections lead."),
        ), emitted=_n("sections") >= k["structure.order.sections"]),
        Rule("structure.name", "Name on line one", 3, (
            Branch("pass", 3, _text("Read as \"", first, "\"."), when=name_like, evidence=lambda: F.array(first)),
            Branch("warn", 1, "Line one does not look like a name.", "Begin with the name alone."),
        )),
    ]


def impact_rules(k: dict[str, float]) -> list[Rule]:
    n = _n("bullets")
    strong = _n("s_strong")
    share = strong.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    opened = _text(_num(strong), " of ", _num(n), " items open with a verb.")
    some = _late(lambda col, k: F.transform(F.slice(col, 1, k), lambda b: ph.excerpt(b, 70)))
    metrics = _n("s_metrics")
    trimmed_metrics = _late(lambda k: F.transform(F.slice("s_metrics", 1, k), lambda m: F.btrim(m)))
    said_i = c("s_pronouns")
    filler = _n("s_filler")
    average = lambda: F.expr(
        "string(floor(aggregate(s_bullet_words, 0, (a, x) -> a + x) / nullif(size(bullets), 0) + 0.5))"
    )
    opener = lambda: F.get("s_openers", F.lit(0))
    return [
        Rule("impact.verbs", "Items open with a verb", 9, (
            Branch("fail", 0, "There are no list items.", "Turn prose into items that start with what was done.", when=n == 0),
            Branch("pass", 9, opened, when=share >= k["impact.verbs.pass"], evidence=some("s_strong", 2)),
            Branch("warn", 5, opened, "Let the other items start with the action too.", when=share >= k["impact.verbs.warn"], evidence=some("s_duties", 2)),
            Branch("fail", 0, opened, "Duties say little. Start with the action taken.", evidence=some("s_duties", 3)),
        )),
        Rule("impact.metrics", "Outcomes in numbers", 8, (
            Branch("pass", 8, _text(pluralise(metrics, "figure"), " given."), when=metrics >= k["impact.metrics.pass"], evidence=trimmed_metrics(4)),
            Branch("warn", 4, _text("Just ", pluralise(metrics, "figure"), "."), "Put a figure into most items.",
                   when=metrics >= k["impact.metrics.warn"], evidence=trimmed_metrics(3)),
            Branch("fail", 0, "No figures.", "Say how many, how much or how fast."),
        )),
        Rule("impact.pronouns", "No first person", 3, (
            Branch("pass", 3, "No first person.", when=said_i == 0),
            Branch("warn", 2, _text(pluralise(said_i, "first-person word"), "."), "Leave the subject out.", when=said_i <= k["impact.pronouns.warn"]),
            Branch("fail", 0, _text(pluralise(said_i, "first-person word"), "."), "Leave the subject out and start with the verb."),
        )),
        Rule("impact.filler", "No stock phrases", 5, (
            Branch("pass", 5, "No stock phrases.", when=filler == 0),
            Branch("warn", 3, _text("Stock phrases: ", list_phrase(c("s_filler")), "."), "Show it instead of saying it.",
                   when=filler <= k["impact.filler.warn"], evidence=_all("s_filler")),
            Branch("fail", 0, _text(pluralise(filler, "stock phrase"), " such as ", list_phrase(c("s_filler"), 2), "."),
                   "Remove them and use the room for results.", evidence=_head("s_filler", 6)),
        )),
        Rule("impact.objective", "A summary worth reading", 4, (
            Branch("pass", 4, "The summary is not a template.", when=_n("s_weak_openers") == 0),
            Branch("fail", 0, _text("Template wording: \"", excerpt(F.get("s_weak_openers", F.lit(0)), 52), "\"."),
                   "Drop the wish and state in two lines what has been done.", evidence=_all("s_weak_openers")),
        ), emitted=F.array_contains("section_keys", "summary") | (_n("s_weak_openers") > 0)),
        Rule("impact.bullet-length", "Length of items", 3, (
            Branch("pass", 3, _text("About ", average, " words per item."), when=(c("s_long") == 0) & (c("s_short") <= 1)),
            Branch("warn", 1, _text(pluralise(c("s_long"), "item"), " with more than 34 words."), "Cut or split long items.", when=c("s_long") > 0),
            Branch("warn", 1, _text(pluralise(c("s_short"), "item"), " with a few words only."), "Say what was made and what came of it."),
        ), emitted=n >= 3),
        Rule("impact.variety", "Varied openings", 2, (
            Branch("pass", 2, "Openings vary.", when=_n("s_openers") == 0),
            Branch("warn", 1, lambda: _join("\"", opener()["word"], "\" opens ", opener()["n"].cast("string"), " items."),
                   "Use different verbs.",
                   evidence=lambda: F.transform("s_openers", lambda o: _join(o["word"], " ×", o["n"].cast("string")))),
        ), emitted=n >= 4),
    ]


def skills_rules(k: dict[str, float]) -> list[Rule]:
    n = _n("s_terms")
    groups = lambda: F.transform("s_groups", lambda g: lookup(g, GROUP_NAMES))
    soft = _n("s_soft")
    ratio = F.when(n > 0, soft.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))).otherwise(soft.cast("double"))
    listed, shown = _n("s_listed"), _n("s_shown")
    cover = F.when(listed > 0, shown.cast("double") / F.nullif(listed.cast("double"), F.lit(0.0))).otherwise(F.lit(1.0))
    known = pluralise(n, "known skill")
    return [
        Rule("skills.named", "Concrete skills", 8, (
            Branch("pass", 8, _text(known, "."), when=n >= k["skills.named.pass"], evidence=_head("s_terms", 8)),
            Branch("warn", 5, _text(known, ": ", list_phrase(c("s_terms"), 4), "."), "Name every tool that was really used.",
                   when=n >= k["skills.named.warn"], evidence=_all("s_terms")),
            Branch("fail", 0, _either(n == 0, "No known skills.", _text("Just ", list_phrase(c("s_terms")), ".")),
                   "Name the exact tools people search for."),
        )),
        Rule("skills.breadth", "Range of skills", 3, (
            Branch("pass", 3, _text("Spans ", list_phrase(groups), "."), when=F.size("s_groups") >= k["skills.breadth.pass"]),
            Branch("warn", 1, _text("Stays within ", list_phrase(groups), "."), "Add the storage, versioning and hosting that were used."),
        ), emitted=n >= 3),
        Rule("skills.fluff", "No padding", 3, (
            Branch("pass", 3, "Only concrete skills.", when=soft == 0),
            Branch("warn", 2, _text("Padding: ", list_phrase(c("s_soft")), "."), "Nobody searches for these. Take them out.",
                   when=ratio <= k["skills.fluff.warn"], evidence=_all("s_soft")),
            Branch("fail", 0, _text(pluralise(soft, "soft entry", "soft entries"), " next to ", _num(n), " concrete ones."),
                   "Keep only what can be tested.", evidence=_head("s_soft", 6)),
        ), emitted=(soft > 0) | (n > 0)),
        Rule("skills.evidence", "Skills in use", 4, (
            Branch("pass", 4, _text(_num(shown), " of ", _num(listed), " listed skills are used in the work described."), when=cover >= k["skills.evidence.pass"]),
            Branch("warn", 2, _text("Just ", _num(shown), " of ", _num(listed), " listed skills are used in the work described."),
                   "Mention each tool where it was used.", when=cover >= k["skills.evidence.warn"], evidence=_head("s_unbacked", 6)),
            Branch("fail", 0, "Listed skills and described work do not meet.", "Mention each tool where it was used.",
                   evidence=_head("s_unbacked", 6)),
        ), emitted=(n >= 3) & c("s_skills_section").isNotNull() & (F.length("s_evidence_text") > 80)),
    ]


def hygiene_rules(k: dict[str, float]) -> list[Rule]:
    personal, words = _n("s_personal"), c("word_count")
    pages = c("page_count")
    base = F.regexp_replace("file_name", r"[.][^.]+\z", "")
    tidy = (
        ~base.rlike(java(lx.SLOPPY_FILE, True)) & base.rlike(java(lx.NAMED_FILE, True)) & (F.length(base) >= 6)
    )
    wrong = c("s_spelling")
    notes = lambda: F.concat(
        F.transform("s_typos", lambda t: _join(t, " → ", lookup(t, lx.TYPOS))), c("s_slips")
    )
    mistakes = _text(pluralise(wrong, "probable mistake"), ".")
    return [
        Rule("hygiene.personal", "No private details", 6, (
            Branch("pass", 6, "No private details.", when=personal == 0),
            Branch("warn", 3, _text("Private details: ", list_phrase(c("s_personal")), "."), "Take them out; nobody may ask for them.",
                   when=personal <= k["hygiene.personal.warn"], evidence=_all("s_personal")),
            Branch("fail", 0, _text(pluralise(personal, "private detail"), " such as ", list_phrase(c("s_personal"), 3), "."),
                   "Take the whole block out and use the room for work.", evidence=_head("s_personal", 8)),
        )),
        Rule("hygiene.length", _text("Size: ", _num(words), " words"), 5, (
            Branch("pass", 5, "A page or so.", when=words.between(k["hygiene.length.good"], k["hygiene.length.most"])),
            Branch("warn", 3, "Rather short.", "Add a project or more items; 300 to 700 words are good.", when=(words >= k["hygiene.length.least"]) & (words < k["hygiene.length.good"])),
            Branch("warn", 3, "Rather long.", "Shorten towards 700 words.", when=(words > k["hygiene.length.most"]) & (words <= k["hygiene.length.long"])),
            Branch("fail", 0, _text("No more than ", _num(words), " words."), "Too little to judge. Describe two or three projects.", when=words < k["hygiene.length.least"]),
            Branch("fail", 0, _text(_num(words), " words are too many."), "Shorten to one page."),
        )),
        Rule("hygiene.pages", _text("Pages: ", _num(pages)), 4, (
            Branch("pass", 4, "One page.", when=pages == 1),
            Branch("warn", 2, "Two pages.", "Shorten to one page.", when=pages == 2),
            Branch("fail", 0, _text(_num(pages), " pages."), "Keep the strongest work on a single page."),
        ), emitted=c("source_kind") != "text"),
        Rule("hygiene.filename", "Name of the file", 2, (
            Branch("pass", 2, _text("\"", c("file_name"), "\" is fine."), when=tidy),
            Branch("warn", 0, _text("\"", c("file_name"), "\" says little."), "Name the file after the author."),
        ), emitted=c("file_name").isNotNull() & (c("file_name") != "")),
        Rule("hygiene.spelling", "Spelling", 4, (
            Branch("pass", 4, "No known misspellings.", when=wrong == 0),
            Branch("warn", 2, mistakes, "Correct these and read it once more.", when=wrong <= k["hygiene.spelling.warn"], evidence=notes),
            Branch("fail", 0, mistakes, "Use a spell checker and a second reader.", evidence=lambda: F.slice(notes(), 1, 8)),
        )),
        Rule("hygiene.caps", "Normal case", 2, (
            Branch("warn", 1, "One long line is in capitals.", "Keep capitals for short headings.", when=c("s_shouting") <= k["hygiene.caps.warn"]),
            Branch("fail", 0, _text(pluralise(c("s_shouting"), "long line"), " in capitals."), "Write body text in normal case."),
        ), emitted=c("s_shouting") > 0),
    ]


def default_pack(cuts: dict[str, float] | None = None, weights: dict[str, int] | None = None) -> RulePack:
    """The 36 rules; ``cuts`` moves cut-offs of :data:`CUTS`, ``weights`` gives rules other weights."""
    if unknown := set(cuts or {}) - set(CUTS):
        raise ValueError(f"no such cut-offs: {sorted(unknown)}")
    pack = RulePack()
    for rules in (parse_rules, contact_rules, structure_rules, impact_rules, skills_rules, hygiene_rules):
        for rule in rules(CUTS | (cuts or {})):
            pack.add(rule)
    return pack.weighted(weights or {})


def packs_from(parameters: DataFrame) -> dict[str, RulePack]:
    """Variants of the default pack from a table ``(pack, kind, name, value)``, kind ``cut`` or ``weight``.

    A pack of default values alone is a row with a null kind. The table is configuration and is read
    by the driver; its values become constants of the scoring expressions.
    """
    found: dict[str, dict[str, dict[str, float]]] = {}
    for r in parameters.collect():
        own = found.setdefault(r["pack"], {"cut": {}, "weight": {}})
        if r["kind"] is not None:
            own[r["kind"]][r["name"]] = float(r["value"])
    return {name: default_pack(v["cut"], {k: int(w) for k, w in v["weight"].items()}) for name, v in sorted(found.items())}
