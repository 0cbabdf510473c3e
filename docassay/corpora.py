"""Derived inputs: documents with sections, items, links and layout facts, made from a prose table.

The prose tables at hand have no headings, lists or dates, so most rules would only ever see
one branch. Every word of the source text is used, nine to a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions import text as tx
from docassay.functions.rows import pin

HEADINGS = [
    "SKILLS", "PROJECTS", "Experience", "EDUCATION", "Summary", "CERTIFICATIONS",
    "Personal Details", "Declaration",
]
VERBS = ["Built", "Reduced", "Led", "Tested", "Designed", "Shipped"]
FIRST_LINES = ["Asha Rao", "RESUME 2024", "Lee O'Neil-Kim", ""]
FILES = ["asha-rao-cv.pdf", "resume_final_v2.pdf", "x.pdf", None]
KINDS = ["pdf", "docx", "text"]
EXTRA_LINES = [
    "", "", "", "I am a hardworking team player; my experiance with Java Script and Git Hub did recieve praise",
    "", "THIS LINE IS SET ENTIRELY IN CAPITAL LETTERS",
    "THIS LINE IS SET ENTIRELY IN CAPITAL LETTERS\nAND SO IS THIS ONE BELOW IT, SIR",
    "see www.gmail.com and my blog on medium.com", "visit https://asha.dev/work today", "", "",
]


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def structured_text(d: Column, words: Column) -> Column:
    """Lay the words out as a structured document; ``d`` varies the shape."""
    contact = F.when(d % 5 == 0, F.concat(F.lit("asha.rao"), d.cast("string"), F.lit("@example.com | +91 98765 43210"))) \
        .when(d % 5 == 1, F.concat(F.lit("rockstar"), d.cast("string"), F.lit("@example.com"))) \
        .when(d % 5 == 2, F.lit("+91 98765 43210 | Pune, India")) \
        .when(d % 5 == 3, F.lit("https://linkedin.com/in/asha | github.com/asha")) \
        .otherwise(F.lit(""))
    tools = F.concat(
        F.lit("Python, React, Docker"),
        F.when(d % 7 < 3, F.lit(", Node.js, PostgreSQL, Git, C++, CI/CD, Google Cloud, team player"))
        .when(d % 7 == 4, F.lit(", MS Office, punctuality")).otherwise(F.lit("")),
        F.when(d % 2 == 0, F.lit(" (Jan 2020 - Mar 2022)")).otherwise(F.lit(" 2021")),
    )

    def line(i: Column) -> Column:
        first = (i * 9).cast("int")
        nine = F.array_join(tx.between(words, first, F.least(first + 8, F.size(words) - 1)), " ")
        item = F.concat(
            F.lit("- "), pick(VERBS, (i + d) % 6), F.lit(" "), nine,
            F.when((i + d) % 4 == 0, F.concat(F.lit(" by "), (i + 5).cast("string"), F.lit("%")))
            .when((i + d) % 4 == 1, F.concat(F.lit(" for "), (i * 3).cast("string"), F.lit(" users")))
            .otherwise(F.lit("")),
        )
        text = F.when(d % 3 == 0, item).when(d % 3 == 1, F.concat(F.lit("• Responsible for "), nine)).otherwise(nine)
        return (
            F.when(i % 6 == 0, F.concat(F.lit("\n"), pick(HEADINGS, (F.floor(i / 6) + d) % 8), F.lit("\n"), text))
            .when((i % 6 == 1) & (d % 7 < 5), F.concat(tools, F.lit("\n"), text))
            .otherwise(text)
        )

    n_lines = F.ceil(F.size(words) / F.lit(9))
    body = F.when(n_lines > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_lines - 1), line)) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(
        pick(FIRST_LINES, d % 4), F.lit("\n"), contact, F.lit("\n"), pick(EXTRA_LINES, d % 11),
        F.lit("\n"), F.array_join(body, "\n"),
    )


def structured_documents(prose: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Document contract built from ``(doc_id, text)`` prose."""
    from docassay.functions import extract

    d = F.col("doc_id")
    staged = prose.select("doc_id", *keep, tx.words(F.col("text")).alias("words"))
    staged = staged.select("doc_id", *keep, structured_text(d, F.col("words")).alias("raw"))
    staged = pin(staged, "text", tx.normalise_text(F.col("raw"))).drop("raw")
    return staged.withColumns(
        {
            "source_kind": pick(KINDS, d % 3),
            "file_name": pick(FILES, d % 4),
            "page_count": (d % 3 + 1).cast("int"),
            "hyperlinks": extract.urls(F.col("text")),
            "meta": F.struct(
                tx.char_count(F.col("text")).cast("long").alias("text_density"),
                F.when(d % 20 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("image_only_pages"),
                (d % 10 == 0).alias("multi_column"),
                ((d % 9) / F.lit(10.0)).alias("right_column_ratio"),
                (d % 13 == 0).alias("broken_glyphs"),
                (d % 8).alias("tabular_rows"),
                ((d % 6) * 20).alias("text_box_chars"),
                F.when(d % 4 == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("image_count"),
                (d % 12 == 0).alias("contact_in_header_only"),
            ),
        }
    )
