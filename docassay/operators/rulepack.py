"""Rules as data: ordered branches of column conditions, evaluated as one projection."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay import lexicon as lx

#: A text: fixed, or built from columns only when a report asks for texts.
Text = str | Callable[[], Column]


def _column(value: Text | None) -> Column:
    return value() if callable(value) else F.lit(value).cast("string")


def _sql(value: int | str) -> str:
    return str(value) if isinstance(value, int) else f"({value})"


@dataclass(frozen=True)
class Branch:
    """One outcome. ``when=None`` is the last branch and always holds.

    ``score`` is a number or a SQL expression; ``evidence`` builds an array when it is needed.
    """

    state: str
    score: int | str
    summary: Text
    fix: Text | None = None
    when: Column | None = None
    evidence: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Rule:
    """A weighted check. It is left out where ``emitted`` is false; ``info`` weighs nothing."""

    id: str
    label: Text
    weight: int
    branches: tuple[Branch, ...]
    emitted: Column | None = None
    prefix: str = "b_"

    @property
    def category(self) -> str:
        return self.id.split(".")[0]

    @property
    def column(self) -> str:
        return self.prefix + self.id.replace(".", "_").replace("-", "_")

    def weighing(self, weight: int) -> Rule:
        """The rule with another weight; the scores of its branches keep their share of it, rounded half up."""

        def scaled(score: int | str) -> int | str:
            if isinstance(score, int):
                return (2 * score * weight + self.weight) // (2 * self.weight)
            return f"int(floor(double({score}) * {weight} / {self.weight} + 0.5D))"

        if weight == self.weight:
            return self
        if self.weight == 0:
            raise ValueError(f"rule {self.id} weighs nothing")
        return replace(self, weight=weight, branches=tuple(replace(b, score=scaled(b.score)) for b in self.branches))

    def branch(self) -> Column:
        """1-based number of the branch that holds, null when the rule is left out."""
        pick = F.lit(len(self.branches))
        for i, b in reversed(list(enumerate(self.branches, start=1))):
            if b.when is not None:
                pick = F.when(b.when, F.lit(i)).otherwise(pick)
        return pick if self.emitted is None else F.when(self.emitted, pick)

    def _case(self, values: Iterable[str]) -> str:
        whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values, start=1))
        return f"CASE {self.column} {whens} END"

    def state(self) -> str:
        return self._case(f"'{b.state}'" for b in self.branches)

    def score(self) -> str:
        return self._case(_sql(b.score) for b in self.branches)

    def weighs(self) -> str:
        return self._case("0" if b.state == "info" else str(self.weight) for b in self.branches)

    def choose(self, values: Iterable[Column]) -> Column:
        """The text that belongs to the chosen branch."""
        values = list(values)
        at = F.col(self.column)
        out = F.when(at == 1, values[0])
        for i, v in enumerate(values[1:], start=2):
            out = out.when(at == i, v)
        return out


@dataclass
class RulePack:
    """An ordered list of rules. Order decides ties, so it is part of the result."""

    rules: list[Rule] = field(default_factory=list)

    def add(self, rule: Rule) -> RulePack:
        if any(r.id == rule.id for r in self.rules):
            raise ValueError(f"rule {rule.id} is already in the pack")
        self.rules.append(rule)
        return self

    def weighted(self, weights: dict[str, int]) -> RulePack:
        """The pack with other weights for some rules, by their ids."""
        if unknown := set(weights) - {r.id for r in self.rules}:
            raise ValueError(f"no such rules: {sorted(unknown)}")
        return RulePack([r.weighing(weights.get(r.id, r.weight)) for r in self.rules])

    def apart(self, number: int) -> RulePack:
        """The pack with columns of its own, to be evaluated beside others."""
        return RulePack([replace(r, prefix=f"b{number}_") for r in self.rules])

    def categories(self) -> list[str]:
        present = {r.category for r in self.rules}
        known = [k for k in lx.CATEGORY_IDS if k in present]
        return known + sorted(present - set(known))

    def decide(self, signals: DataFrame) -> DataFrame:
        """Add one small integer per rule: the branch that holds."""
        return signals.withColumns({r.column: r.branch() for r in self.rules})

    def totals(self) -> Column:
        """``categories``: one ``(ord, id, score, weight, pct)`` per category with a rule."""
        entries = []
        for i, cat in enumerate(self.categories()):
            own = [r for r in self.rules if r.category == cat]
            score = " + ".join(f"coalesce({r.score()}, 0)" for r in own)
            weight = " + ".join(f"coalesce({r.weighs()}, 0)" for r in own)
            some = " OR ".join(f"{r.column} IS NOT NULL" for r in own)
            entries.append(
                f"CASE WHEN {some} THEN named_struct('ord', {i}, 'id', '{cat}', "
                f"'score', {score}, 'weight', {weight}) END"
            )
        pct = "int(coalesce(floor(double(t.score) / nullif(double(t.weight), 0D) * 100D + 0.5D), 0))"
        return F.expr(
            f"transform(array_compact(array({', '.join(entries)})), t -> named_struct('ord', t.ord, "
            f"'id', t.id, 'score', t.score, 'weight', t.weight, 'pct', {pct}))"
        )

    def checks(self, texts: bool = True) -> Column:
        """``checks``: one struct per emitted rule, in pack order."""
        base = [
            f"named_struct('check_ord', {i}, 'id', '{r.id}', 'category', '{r.category}', "
            f"'state', {r.state()}, 'score', {r.score()}, 'weight', {r.weighs()})"
            for i, r in enumerate(self.rules)
        ]
        if not texts:
            cases = [f"CASE WHEN {r.column} IS NOT NULL THEN {b} END" for r, b in zip(self.rules, base)]
            return F.expr(f"array_compact(array({', '.join(cases)}))")
        none = F.array().cast("array<string>")
        entries = []
        for rule, struct in zip(self.rules, base):
            core = F.expr(struct)
            evidence = [b.evidence() if b.evidence else none for b in rule.branches]
            full = F.struct(
                *[core[k].alias(k) for k in ("check_ord", "id", "category", "state", "score", "weight")],
                _column(rule.label).alias("label"),
                rule.choose(_column(b.summary) for b in rule.branches).alias("summary"),
                rule.choose(_column(b.fix) for b in rule.branches).alias("fix"),
                F.coalesce(rule.choose(evidence), none).alias("evidence"),
            )
            entries.append(F.when(F.col(rule.column).isNotNull(), full))
        return F.array_compact(F.array(*entries))
