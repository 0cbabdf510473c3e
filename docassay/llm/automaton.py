"""Several rules as one minimal deterministic automaton over bytes.

A rule's regex is made a non-deterministic automaton; the subset construction keeps its threads apart
by where they started, earliest first, so each rule finds its leftmost longest matches one after
another, as a search that resumes at the end of a match does. The rules run side by side in one
automaton, which is minimised and laid out as one array of transitions. A match's end is where the
rule stops accepting; its start is found by running the rule backwards from its first accepting byte.
"""

from __future__ import annotations

import re._parser as parser
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes between cuts of a long text, about; fewer lanes than FEW are finished one by one.
LANE, FEW = 512, 24


@dataclass(frozen=True)
class Rule:
    """``head`` and ``value`` find the span; it counts if what follows its head has ``least`` characters.

    Both are ASCII regexes without anchors, look-around or lazy repeats; no text may be split into
    head and value in two ways.
    """

    kind: str
    value: str
    least: int = 1
    head: str = ""
    any_case: bool = False

    @property
    def regex(self) -> str:
        return self.head + self.value


def _both_cases(codes: set[int]) -> frozenset[int]:
    letters = {c for c in codes if chr(c).isascii() and chr(c).isalpha()}
    return frozenset(codes | {c ^ 32 for c in letters})


class Threads:
    """A rule's non-deterministic automaton: byte edges, empty edges, one start and one end."""

    def __init__(self, rule: Rule):
        self.edges: list[tuple[int, frozenset[int], int]] = []
        self.empty: list[tuple[int, int]] = []
        self.size, self.any_case = 0, rule.any_case
        self.start = self._node()
        self.end = self._sequence(parser.parse(rule.regex), self.start)
        self.kind = rule.kind
        self._forward, self._forward_empty = self._tables(self.edges, self.empty)
        self._back, self._back_empty = self._tables([(b, c, a) for a, c, b in self.edges], [(b, a) for a, b in self.empty])
        self._steps: dict[tuple[frozenset[int], int], frozenset[int]] = {}

    def _node(self) -> int:
        self.size += 1
        return self.size - 1

    @staticmethod
    def _tables(edges, empty):
        byte: dict[int, list[tuple[frozenset[int], int]]] = {}
        free: dict[int, list[int]] = {}
        for a, codes, b in edges:
            byte.setdefault(a, []).append((codes, b))
        for a, b in empty:
            free.setdefault(a, []).append(b)
        return byte, free

    def _codes(self, op, value) -> frozenset[int]:
        if op is parser.LITERAL:
            codes = {value}
        elif op is parser.IN:
            codes = set()
            for kind, v in value:
                if kind is parser.LITERAL:
                    codes.add(v)
                elif kind is parser.RANGE:
                    codes.update(range(v[0], v[1] + 1))
                else:
                    raise ValueError(f"{kind} is not supported in a class")
        else:
            raise ValueError(f"{op} is not supported in a rule")
        if max(codes) > 127:
            raise ValueError("rules are over ASCII")
        return _both_cases(codes) if self.any_case else frozenset(codes)

    def _sequence(self, items, at: int) -> int:
        for op, value in items:
            if op is parser.SUBPATTERN:
                at = self._sequence(value[3], at)
            elif op is parser.BRANCH:
                ends, out = [self._sequence(branch, at) for branch in value[1]], self._node()
                self.empty += [(e, out) for e in ends]
                at = out
            elif op is parser.MAX_REPEAT:
                low, high, body = value
                for _ in range(low):
                    at = self._sequence(body, at)
                if high is parser.MAXREPEAT:
                    loop = self._node()
                    self.empty += [(at, loop), (self._sequence(body, loop), loop)]
                    at = loop
                else:
                    out = self._node()
                    for _ in range(high - low):
                        self.empty.append((at, out))
                        at = self._sequence(body, at)
                    self.empty.append((at, out))
                    at = out
            else:
                new = self._node()
                self.edges.append((at, self._codes(op, value), new))
                at = new
        return at

    @staticmethod
    def _closed(nodes: Iterable[int], free: dict[int, list[int]]) -> frozenset[int]:
        out, todo = set(nodes), list(nodes)
        while todo:
            for b in free.get(todo.pop(), ()):
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return frozenset(out)

    def move(self, nodes: frozenset[int], byte: int) -> frozenset[int]:
        return self._closed({b for a in nodes for codes, b in self._forward.get(a, ()) if byte in codes}, self._forward_empty)

    def first(self) -> frozenset[int]:
        return self._closed([self.start], self._forward_empty)

    def accepts_at_once(self) -> bool:
        fresh = self.first()
        return all(self.end in self._closed([b], self._forward_empty) for a in fresh for _, b in self._forward.get(a, ()))

    def begin(self, data: bytes, at: int, bound: int) -> int:
        """The smallest start, not before ``bound``, of a match whose last byte is ``at``; -1 without one."""
        nodes, best = self._closed([self.end], self._back_empty), -1
        while at >= bound:
            key = (nodes, data[at])
            nodes = self._steps.get(key)
            if nodes is None:
                moved = {b for a in key[0] for codes, b in self._back.get(a, ()) if key[1] in codes}
                nodes = self._steps[key] = self._closed(moved, self._back_empty)
            if not nodes:
                break
            if self.start in nodes:
                best = at
            at -= 1
        return best


def leftmost(threads: Threads, alphabet: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction of one rule over one byte of each class: transitions and accepting states.

    A state is the sets of threads by start, earliest first. A rule is refused if it can match
    nothing, if a later start could accept before an earlier one is decided, if a match could go on
    after a byte that is no match's end, or if two matches could meet without a byte between them.
    """
    fresh = threads.first()
    if threads.end in fresh:
        raise ValueError(f"{threads.kind}: the rule matches nothing at all")

    def step(state: tuple[frozenset[int], ...], byte: int) -> tuple[frozenset[int], ...]:
        won, seen, sets = bool(state) and threads.end in state[0], set(), []
        for nodes in state:
            new = threads.move(nodes, byte) - seen
            if new:
                sets.append(new)
                seen |= new
        if won and sets:
            if threads.end not in sets[0]:
                raise ValueError(f"{threads.kind}: a match goes on after a byte that does not end one")
            return (sets[0],)
        new = threads.move(fresh, byte) - seen
        if new:
            sets.append(new)
        ends = [i for i, nodes in enumerate(sets) if threads.end in nodes]
        if ends and (won or ends[0]):
            raise ValueError(f"{threads.kind}: which match comes first is not decided in one pass")
        return (sets[0],) if ends else tuple(sets)

    numbers: dict[tuple[frozenset[int], ...], int] = {(): 0}
    order, rows = [()], []
    for state in order:  # grows on the way
        row = []
        for byte in alphabet:
            new = step(state, byte)
            if new not in numbers:
                numbers[new] = len(order)
                order.append(new)
            row.append(numbers[new])
        rows.append(row)
    return np.array(rows), np.array([bool(s) and threads.end in s[0] for s in order])


def minimised(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest automaton with the same marks after every input; the start stays state 0."""
    block = np.unique(marks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() == block.max():
            break
        block = new
    number = np.full(new.max() + 1, -1)
    firsts = np.unique(new, return_index=True)[1]
    number[new[np.sort(firsts)]] = np.arange(len(firsts))  # blocks in the order of their first state
    keep = np.sort(firsts)
    return number[new[table[keep]]], marks[keep]


class Automaton:
    """All rules in one table: ``table[state, kind of byte]``; bit r of ``marks[state]`` says that rule r accepts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.threads = [Threads(r) for r in rules]
        cut = np.zeros(256, np.int64)  # bytes that no edge tells apart are one kind
        for codes in {c for t in self.threads for _, c, _ in t.edges}:
            member = np.zeros(256, np.int64)
            member[list(codes)] = 1
            cut = np.unique(cut * 2 + member, return_inverse=True)[1]
        self.kinds = cut.astype(np.uint8)
        alphabet = [int(np.flatnonzero(cut == k)[0]) for k in range(cut.max() + 1)]
        parts = [leftmost(t, alphabet) for t in self.threads]
        tables, ends = [p[0] for p in parts], [p[1] for p in parts]
        start = (0,) * len(parts)
        numbers, order, rows = {start: 0}, [start], []
        for state in order:
            following = zip(*(t[s].tolist() for t, s in zip(tables, state, strict=True)), strict=True)
            row = []
            for new in following:
                if new not in numbers:
                    numbers[new] = len(order)
                    order.append(new)
                row.append(numbers[new])
            rows.append(row)
        marks = np.array([sum(1 << r for r, s in enumerate(state) if ends[r][s]) for state in order], np.int64)
        table, self.marks = minimised(np.array(rows), marks)
        self.table = table.astype(np.int32)
        # Rules that accept from the first byte on: what is accepted without a gap is the match.
        self.at_once = [t.accepts_at_once() for t in self.threads]
        self._rows: list[list[int]] | None = None
        # Pairs of kinds after which every state is the start: a text may be cut behind them.
        after = self.table[self.table]  # state, first kind, second kind
        self.resets = (after == 0).all(axis=0)

    def lanes(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of stretches that can be scanned apart; ``ends`` are the texts' separators."""
        kind = self.kinds[data]
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = [starts]
        long = np.flatnonzero(ends - starts > 2 * LANE)
        if len(long):
            free = np.flatnonzero(self.resets[kind[:-1], kind[1:]]) + 2
            for i in long:
                wanted = np.arange(starts[i] + LANE, ends[i] - LANE, LANE)
                at = np.searchsorted(free, np.maximum(wanted, starts[i] + 2))
                at = free[at[at < len(free)]]
                cuts.append(at[at < ends[i]])
        begin = np.unique(np.concatenate(cuts))
        stop = np.append(begin[1:], len(data))
        closed = np.zeros(len(data) + 1, bool)
        closed[ends + 1] = True
        return begin, stop - begin - closed[stop]

    def states(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each byte, all texts at once: one byte of every lane in a step."""
        begin, size = self.lanes(data, ends)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        kind, width = self.kinds[data], self.table.shape[1]
        flat, out = self.table.ravel(), np.zeros(len(data), np.int32)
        state, t = np.zeros(len(begin), np.int32), 0
        shorter = -size
        active = len(size)
        while True:
            active = int(np.searchsorted(shorter[:active], -t))  # lanes longer than t
            if active < FEW:
                break
            at = begin[:active] + t
            state = flat[state[:active] * width + kind[at]]
            out[at] = state
            t += 1
        if active:
            if self._rows is None:
                self._rows = self.table.tolist()
            rows = self._rows
            for i in range(active):
                s, low, high = int(state[i]) if t else 0, int(begin[i]) + t, int(begin[i] + size[i])
                path = []
                for k in kind[low:high].tolist():
                    s = rows[s][k]
                    path.append(s)
                out[low:high] = path
        return out

    def matches(self, texts: Sequence[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, rule, start, end) in bytes of every match, in the order of rules, then of texts and starts.

        Of a rule that accepts from its first byte on, only matches of its least length are returned.
        """
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1 if texts else np.zeros(0, np.int64)
        if not len(ends):
            return []
        joined = b"\n".join(texts) + b"\n"
        accepted = self.marks[self.states(np.frombuffer(joined, np.uint8), ends)]
        accepted[ends] = 0
        hits, out = np.flatnonzero(accepted), []
        if not len(hits):
            return out
        starts = np.concatenate(([0], ends[:-1] + 1))
        for r, threads in enumerate(self.threads):
            at = hits[(accepted[hits] >> r) & 1 == 1]
            if not len(at):
                continue
            new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            first, last = at[new], at[np.append(new[1:], len(at)) - 1]
            if self.at_once[r]:
                enough = np.flatnonzero(last - first + 1 >= self.rules[r].least)
                first, last = first[enough], last[enough]
            owner, bound = np.searchsorted(ends, first), -1
            for i, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
                origin = int(starts[i])
                begin = threads.begin(joined, a, max(origin, bound))
                out.append((i, r, begin - origin, b + 1 - origin))
                bound = b + 1
        return out
