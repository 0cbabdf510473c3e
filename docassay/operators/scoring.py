"""From rule branches to scores, bands, actions and counts, all within the row."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay import lexicon as lx
from docassay.functions.phrasing import percent
from docassay.functions.rows import explode_rows


def band_id(score: Column) -> Column:
    out = F.lit(lx.BANDS[-1][0])
    for name, low in reversed(lx.BANDS[:-1]):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def bands_table(spark) -> DataFrame:
    """The four bands as a range table ``(band_id, low, high)``; ``high`` is exclusive, and null in the top band."""
    highs = [None] + [low for _, low in lx.BANDS[:-1]]
    rows = [(name, low, high) for (name, low), high in zip(lx.BANDS, highs)]
    return spark.createDataFrame(rows, "band_id string, low int, high int")


def sum_of(array: Column, name: str) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x[name])


def needs_work(state: Column) -> Column:
    return state.isin("fail", "warn")


def top_actions(checks: Column, k: int = 5) -> Column:
    """The ``k`` checks that lose most: failures count 1.35 times, ties keep pack order.

    Sorting structs orders by priority first and pack order second. The priority is held as a
    whole number of hundredths so that equal losses compare equal.
    """
    ranked = F.transform(
        F.filter(checks, lambda x: needs_work(x["state"])),
        lambda x: F.struct(
            (-(x["weight"] - x["score"]) * F.when(x["state"] == "fail", 135).otherwise(100)).alias("gain"),
            x["check_ord"].alias("check_ord"),
            x.alias("check"),
        ),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda r: r["check"])


def with_scores(graded: DataFrame) -> DataFrame:
    """Totals over ``categories``: ``total_score, total_weight, score, band_id``."""
    df = graded.withColumns(
        {
            "total_score": sum_of(F.col("categories"), "score"),
            "total_weight": sum_of(F.col("categories"), "weight"),
        }
    )
    df = df.withColumn("score", percent(F.col("total_score"), F.col("total_weight")))
    return df.withColumn("band_id", band_id(F.col("score")))


def action_rows(scored: DataFrame, k: int = 5) -> DataFrame:
    """Long form of :func:`top_actions`: ``(doc_id, rank, id, state, score, weight)``."""
    ranked = F.transform(
        top_actions(F.col("checks"), k),
        lambda x, i: F.struct(
            (i + 1).alias("rank"), x["id"].alias("id"), x["state"].alias("state"),
            x["score"].alias("score"), x["weight"].alias("weight"),
        ),
    )
    return explode_rows(scored, ["doc_id"], ranked)


def count_states(checks: Column) -> dict[str, Column]:
    """Counts behind the all / to do / passing filter and the passing line."""

    def n(test) -> Column:
        return F.size(F.filter(checks, test))

    return {
        "n_all": F.size(checks),
        "n_todo": n(lambda x: needs_work(x["state"])),
        "n_pass": n(lambda x: x["state"] == "pass"),
        "n_scored": n(lambda x: x["weight"] > 0),
        "n_scored_pass": n(lambda x: (x["weight"] > 0) & (x["state"] == "pass")),
    }


def view_checks(checks: Column, view: str) -> Column:
    """Checks shown under the ``all``, ``todo`` or ``pass`` filter."""
    if view == "all":
        return checks
    if view == "pass":
        return F.filter(checks, lambda x: x["state"] == "pass")
    if view == "todo":
        return F.filter(checks, lambda x: needs_work(x["state"]))
    raise ValueError(f"unknown view {view!r}")


def check_results(scored: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form: one row per document and check."""
    return explode_rows(scored, ["doc_id", *keep], "checks")


def category_rows(scored: DataFrame) -> DataFrame:
    """Long form: one row per document and category."""
    return explode_rows(scored, ["doc_id"], "categories")


def category_scores(results: DataFrame) -> DataFrame:
    """The same totals from a stored long table of checks (one shuffle, combined map-side)."""
    sums = results.groupBy("doc_id", "category").agg(
        F.sum("score").alias("score"), F.sum("weight").alias("weight")
    )
    order = reduce(
        add, [F.when(F.col("category") == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(lx.CATEGORY_IDS)]
    )
    return sums.select(
        "doc_id", order.alias("ord"), F.col("category").alias("id"), "score", "weight",
        percent(F.col("score"), F.col("weight")).alias("pct"),
    )


def per_category(checks: Column, make) -> Column:
    """One struct per category of ``checks``: its name and what ``make`` derives from its checks, within the row."""
    names = F.array_distinct(F.transform(checks, lambda x: x["category"]))
    return F.transform(names, lambda k: F.struct(k.alias("category"), *make(F.filter(checks, lambda x: x["category"] == k))))


def todo_per_category(scored: DataFrame) -> DataFrame:
    """Open points per document and category, and whether the group starts open."""

    def todo(of: Column) -> tuple[Column, Column]:
        n = F.size(F.filter(of, lambda x: needs_work(x["state"]))).cast("long")
        return n.alias("n_todo"), (n > 0).alias("is_open")

    return explode_rows(scored, ["doc_id"], per_category(F.col("checks"), todo))


def band_lookup(scored: DataFrame, bands: DataFrame) -> DataFrame:
    """Range-join form of :func:`band_id`; ``bands`` has four fixed rows."""
    s = F.col("score")
    return scored.drop("band_id").join(
        F.broadcast(bands), (s >= F.col("low")) & (F.col("high").isNull() | (s < F.col("high"))), "left"
    ).drop("low", "high")


def corpus_rollup(results: DataFrame, dims: list[str], how: str = "rollup") -> DataFrame:
    """How often each rule passes, warns or fails, and the points lost, by any dimensions.

    ``how`` is ``rollup``, ``cube`` or ``group``. All measures add up: the checks are counted once
    per combination of the dimensions (combined map-side, so hot dimensions do not matter), and
    only these counts are repeated for the upper levels.
    """
    state = F.col("state")
    base = results.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(state == "pass").alias("n_pass"),
        F.count_if(state == "warn").alias("n_warn"),
        F.count_if(state == "fail").alias("n_fail"),
        F.sum(F.col("weight") - F.col("score")).alias("points_lost"),
    )
    grouped = {"rollup": base.rollup, "cube": base.cube, "group": base.groupBy}[how](*dims)
    level = [F.grouping_id().alias("level")] if how != "group" else [F.lit(0).alias("level")]
    measures = ("n_checks", "n_pass", "n_warn", "n_fail", "points_lost")
    return grouped.agg(*level, *[F.sum(m).alias(m) for m in measures])
