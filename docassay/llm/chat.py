"""Reply trees to conversations: paths by iterative self-joins, branches ranked by score, one text a path.

Self-joins double the distance to an ancestor each time, so a thread of n replies takes about log2 n
of them, and each joins on (tree, message): a tree with a third of all messages is spread out. Only
the finished conversation, which is one text and so one row anyway, brings its messages together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.common import stored, table

TURN, END = "<|turn|>", "<|end|>\n"
#: What templates of chat models take for control: a backslash goes behind the bracket, also where some are.
_CONTROL = r"([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|)"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?INST\]|/?s>|/?SYS>>|\|)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reply_paths(messages: DataFrame, n_paths: int = 1) -> DataFrame:
    """``(tree_id, leaf_id, msg_id, depth)`` for the ``n_paths`` best root-to-leaf paths of each tree.

    ``messages``: tree_id, msg_id (unique in its tree), parent_id, score. A branch scores the sum of
    its messages, a null score counting 0; ties go to the smaller leaf. A parent that does not exist
    makes its reply a root. Replies in a ring have no root and are on no path.
    """
    own = messages.select("tree_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = own.select("tree_id", F.col("msg_id").alias("parent_id")).withColumn("there", F.lit(True))
    step = stored(
        own.join(known, ["tree_id", "parent_id"], "left").select(
            "tree_id", "msg_id", F.when(F.col("there"), F.col("parent_id")).alias("up"),
            F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"),
        ),
        "steps",
    )
    first, jumps, n_all, reach = step, [], None, 1
    while True:
        open_ = step.filter("up is not null")
        n_open, n_all = open_.count(), step.count() if n_all is None else n_all
        if not n_open or reach > n_all:
            break
        jumps.append(open_.select("tree_id", F.col("msg_id").alias("from"), F.col("up").alias("to")))
        above = step.select("tree_id", F.col("msg_id").alias("at"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        low = open_.withColumnRenamed("up", "at").join(above, ["tree_id", "at"])
        low = low.select("tree_id", "msg_id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"))
        step = stored(low.union(step.filter("up is null")), "steps")
        reach *= 2
    done = step.filter("up is null").drop("up")
    parents = first.filter("up is not null").select("tree_id", F.col("up").alias("msg_id")).distinct()
    leaves = done.join(parents, ["tree_id", "msg_id"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.col("total").desc(), "msg_id")
    leaves = leaves.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n_paths)
    path = leaves.select("tree_id", F.col("msg_id").alias("leaf_id"), F.col("msg_id").alias("from"))
    for jump in reversed(jumps):
        # One reference to the path so far: each step keeps a message and adds the ancestor it jumps to.
        both = F.explode(F.array_compact(F.array("from", "to")))
        path = path.join(jump, ["tree_id", "from"], "left").select("tree_id", "leaf_id", both.alias("from"))
    path = stored(path.withColumnRenamed("from", "msg_id").distinct(), "paths")
    return path.join(done.select("tree_id", "msg_id", "depth"), ["tree_id", "msg_id"])


def format_conversations(messages: DataFrame, n_paths: int = 1, learn: str = "assistant") -> DataFrame:
    """One row a path: tree_id, leaf_id, n_turns, formatted, loss (spans of code points, end exclusive).

    ``messages`` has role and text besides what ``reply_paths`` takes; null ones are empty. The loss
    spans hold the texts (not the marks) of turns whose role is ``learn``.
    """
    paths = reply_paths(messages, n_paths)
    said = messages.select("tree_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, ["tree_id", "msg_id"]).withColumns(
        {"head": F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))}
    )
    width = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("tree_id", "leaf_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == learn, F.struct("start", (F.col("start") + F.length("body")).alias("stop")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    made = turns.groupBy("tree_id", "leaf_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return made.select(
        "tree_id", "leaf_id", "n_turns", F.array_join("turns.piece", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out = []
    for piece in formatted.split(TURN)[1:]:
        role, text = piece[: -len(END)].split("\n", 1)
        out.append((unescape_role(role), unescape(text)))
    return out


def digests(conversations: DataFrame) -> DataFrame:
    """What formatted conversations say when read back."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for tree, text, loss in zip(f["tree_id"], f["formatted"], f["loss"], strict=True):
                turns, learned = read_turns(text), "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, learned)]
                rows.append((tree, len(turns), sha[0], len(learned), sha[1], len(text)))
            yield pd.DataFrame(rows, columns=["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree_id", "formatted", "loss").mapInPandas(
        read, "tree_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def threads(rows: DataFrame) -> DataFrame:
    """Messages of ``(conv_id, turn, role, text)`` rows: each answers the one before it by turn (then role, then text; nulls first)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree_id"), "msg_id",
        F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), F.length("text").cast("double").alias("score"), "role", "text",
    )


SAMPLE = "</s>[INST] ok [/INST]"

SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', 'x'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', 'x'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|)', '\1\\\2\3', 'g'))
             + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?INST\]|/?s>|/?SYS>>|\|)', '\1\\\2\3', 'g'))
             + 17 AS width FROM m)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(width)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SAMPLE), (-1, 1, "assistant", SAMPLE)], rows.schema)
    read = digests(format_conversations(threads(rows.union(extra))))
    return read.select(F.col("tree_id").try_cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
