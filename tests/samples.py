"""Golden documents: invented people, counted out to known outcomes."""

WEAK = "\n".join([
    "Leena Fernandes",
    "leena.fernandes@example.org, +91 91234 56780",
    "",
    "PROFILE",
    "Seeking a position near the coast. I like tidy screens, my notes are kept with care and friends ask me for help.",
    "",
    "EXPERIENCE",
    "Harbour Freight Forms",
    "* Responsible for the Java booking screens of the depot at night",
    "* Exposure to MySQL lookups whenever the day shift was short of hands",
    "Tern and Gull Travel",
    "* Familiar with moving old Bootstrap pages to another brand",
    "* Known for calm answers in the Jira queue of the front office",
    "",
    "SKILLS",
    "Java, JavaScript, MySQL, Bootstrap, Jira, Punctuality, quick learner",
    "",
    "EDUCATION",
    "Diploma in Computing, Coastal Polytechnic",
    "",
    "PERSONAL DETAILS",
    "Marital status: single",
    "Languages known: Konkani and English",
    "Blood group: on request",
    "Interests: tide tables, chess",
])

WEAK_CHECKS = {
    "parse.text": ("warn", 5, 10), "parse.order": ("info", 0, 0), "parse.fonts": ("info", 0, 0),
    "parse.containers": ("info", 0, 0), "parse.format": ("info", 0, 0),
    "contact.reachable": ("pass", 8, 8), "contact.position": ("pass", 3, 3),
    "contact.email-tone": ("pass", 3, 3), "contact.links": ("fail", 0, 7), "contact.location": ("warn", 0, 2),
    "structure.sections": ("pass", 10, 10), "structure.depth": ("warn", 3, 5),
    "structure.dates": ("fail", 0, 4), "structure.order": ("pass", 3, 3), "structure.name": ("pass", 3, 3),
    "impact.verbs": ("fail", 0, 9), "impact.metrics": ("fail", 0, 8), "impact.pronouns": ("fail", 0, 3),
    "impact.filler": ("fail", 0, 5), "impact.objective": ("fail", 0, 4),
    "impact.bullet-length": ("pass", 3, 3), "impact.variety": ("pass", 2, 2),
    "skills.named": ("warn", 5, 8), "skills.breadth": ("pass", 3, 3), "skills.fluff": ("warn", 2, 3),
    "skills.evidence": ("pass", 4, 4),
    "hygiene.personal": ("fail", 0, 6), "hygiene.length": ("fail", 0, 5), "hygiene.spelling": ("pass", 4, 4),
}
WEAK_ACTIONS = ["impact.verbs", "impact.metrics", "contact.links", "hygiene.personal", "impact.filler"]

_ITEM = "- {} the {} service for the platform team and its partners, serving {} users every month"
STRONG = "\n".join([
    "Mira Kapoor",
    "mira.kapoor@example.com | +91 98765 43210 | Pune, India",
    "https://linkedin.com/in/mira-k | https://github.com/mira-k",
    "",
    "SUMMARY",
    "Backend developer with four years of practice in Python and PostgreSQL, at home in payments and reporting.",
    "",
    "EXPERIENCE",
    "Lead Developer, Acme, Pune (May 2022 - Present)",
    *[_ITEM.format(v, n, u) for v, n, u in [
        ("Built", "Python billing", 1200), ("Designed", "Django reporting", 3400), ("Automated", "Docker release", 560),
        ("Reduced", "PostgreSQL archive", 7800), ("Migrated", "Redis session", 910), ("Shipped", "React console", 450)]],
    "Developer, Lakeside Labs, Pune (Jan 2019 - Apr 2022)",
    *[_ITEM.format(v, n, u) for v, n, u in [
        ("Developed", "TypeScript client", 130), ("Tested", "FastAPI gateway", 220), ("Improved", "SQL export", 340),
        ("Measured", "Git hosting", 250), ("Launched", "HTML mail", 670), ("Maintained", "CSS theme", 820)]],
    "",
    "CERTIFICATIONS",
    *[f"- Passed the {n} course with distinction after a term of evening classes (20{y} - 20{y + 1})"
      for n, y in [("cloud", 18), ("database", 19)]],
    "",
    "SKILLS",
    "Languages: Python, TypeScript, SQL, HTML, CSS",
    "Frameworks: Django, React, FastAPI",
    "Data and tools: PostgreSQL, Redis, Docker, Git, GitHub, Jest",
    "",
    "EDUCATION",
    "B.Tech, Computer Science, Lakeside College (2015 - 2019)",
    "",
    "ACHIEVEMENTS",
    "- Published a field guide to slow queries that several user groups hand out (Sep 2018)",
    "- Organised repair evenings for old laptops at the town library (2017 - 2019)",
])

DEGENERATE = ["", "   ", "x", "a\nb\nc", "•" * 200, "12345 67890"]

POSTING = "\n".join([
    "Payments crew, backend seat (Python)",
    "",
    "Small shops send their daily takings through our ledger, and the ledger must never lose a cent.",
    "* Own the Django services and the PostgreSQL schema behind them",
    "* Write Python jobs that reconcile bank files every night",
    "* Ship with Docker and Git, and answer for what you ship",
    "Helpful: Kubernetes, GraphQL, Redis. Machine learning is a plus, since fraud checks use machine learning.",
])
