"""Differences between two versions of a source text as edits of its syntax tree."""

from __future__ import annotations

import ast
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs, most cells of a quadratic alignment, most reported changes, most characters of a text.
UPDATE, INSERT, MISMATCH = 0.5, 1.0, 2.1
MAX_CELLS, MAX_CHANGES, MAX_TEXT = 250_000, 2_048, 512


@dataclass
class Node:
    label: str
    text: str
    children: list[Node] = field(default_factory=list)


def _indent_tree(text: str) -> Node:
    """A tree of lines by indentation, for languages without a parser here."""
    root = Node("text", text)
    stack = [(-1, root)]
    for line in text.split("\n"):
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        while stack[-1][0] >= depth:
            stack.pop()
        node = Node("line", line.strip())
        stack[-1][1].children.append(node)
        stack.append((depth, node))

    def gather(n: Node) -> str:
        if n is not root and n.children:
            n.text = n.text + "\n" + "\n".join(gather(c) for c in n.children)
        elif n is root:
            for c in n.children:
                gather(c)
        return n.text

    gather(root)
    return root


def tree_of(text: str, language: str) -> Node:
    if language == "python":
        try:
            parsed = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return _indent_tree(text)

        def build(n: ast.AST) -> Node:
            return Node(type(n).__name__, ast.unparse(n) if not isinstance(n, ast.Module) else text, [build(c) for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.Load, ast.Store, ast.Del))])

        return build(parsed)
    return _indent_tree(text)


class Diff:
    """distance, changes as (op, label, old_text, new_text), and whether alignment or reporting was bounded."""

    def __init__(self, old: str, new: str, language: str = "text"):
        self.distance, self.changes, self.bounded, self.truncated = 0.0, [], False, False
        if old != new:
            self.distance = self._nodes(tree_of(old, language), tree_of(new, language))

    def _add(self, op: str, label: str, a: str | None, b: str | None) -> None:
        if len(self.changes) >= MAX_CHANGES:
            self.truncated = True
            return
        cut = lambda t: t if t is None or len(t) <= MAX_TEXT else t[:MAX_TEXT] + "…"
        self.changes.append((op, label, cut(a), cut(b)))

    def _gone(self, n: Node) -> float:
        self._add("delete", n.label, n.text, None)
        return INSERT

    def _new(self, n: Node) -> float:
        self._add("insert", n.label, None, n.text)
        return INSERT

    def _nodes(self, a: Node, b: Node) -> float:
        if a.label != b.label:
            self._gone(a)
            self._new(b)
            return 1.0
        if a.text == b.text:
            return 0.0
        if not a.children and not b.children:
            self._add("update", a.label, a.text, b.text)
            return UPDATE
        cost = self._children(a.children, b.children)
        if cost == 0.0:
            self._add("update", a.label, a.text, b.text)
            return UPDATE
        return cost

    def _children(self, a: list[Node], b: list[Node]) -> float:
        head = 0
        while head < min(len(a), len(b)) and a[head].label == b[head].label and a[head].text == b[head].text:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail].label == b[-1 - tail].label and a[-1 - tail].text == b[-1 - tail].text:
            tail += 1
        a, b = a[head : len(a) - tail], b[head : len(b) - tail]
        if len(a) * len(b) > MAX_CELLS:
            return self._keyed(a, b)
        m, n = len(a), len(b)
        cost = [[0.0] * (n + 1) for _ in range(m + 1)]
        for i in range(m + 1):
            for j in range(n + 1):
                if i == 0 or j == 0:
                    cost[i][j] = float(i + j)
                    continue
                x, y = a[i - 1], b[j - 1]
                sub = MISMATCH if x.label != y.label else 0.0 if x.text == y.text else UPDATE
                cost[i][j] = min(cost[i - 1][j - 1] + sub, cost[i - 1][j] + INSERT, cost[i][j - 1] + INSERT)
        total, i, j, steps = 0.0, m, n, []
        while i or j:
            if i and j:
                x, y = a[i - 1], b[j - 1]
                sub = MISMATCH if x.label != y.label else 0.0 if x.text == y.text else UPDATE
                if cost[i][j] == cost[i - 1][j - 1] + sub:
                    steps.append((x, y))
                    i, j = i - 1, j - 1
                    continue
            if i and cost[i][j] == cost[i - 1][j] + INSERT:
                steps.append((a[i - 1], None))
                i -= 1
            else:
                steps.append((None, b[j - 1]))
                j -= 1
        for x, y in reversed(steps):
            total += self._nodes(x, y) if x is not None and y is not None else self._gone(x) if x is not None else self._new(y)
        return total

    def _keyed(self, a: list[Node], b: list[Node]) -> float:
        """Alignment by (label, first line) in linear memory, equal keys first come, first served."""
        self.bounded = True
        by: dict[tuple, deque] = defaultdict(deque)
        key = lambda n: (n.label, n.text.split("\n", 1)[0])
        for x in a:
            by[key(x)].append(x)
        total = 0.0
        for y in b:
            q = by.get(key(y))
            total += self._nodes(q.popleft(), y) if q else self._new(y)
        return total + sum(self._gone(x) for q in by.values() for x in q)


def diff_pairs(pairs: DataFrame, key: str, old: str, new: str, language: str | None = None) -> DataFrame:
    """(key, distance, op, label, old_text, new_text, bounded, truncated) of each change between two text columns; null texts count as empty.

    bounded tells that some alignment was by key, truncated that changes beyond
    MAX_CHANGES are missing; both are of the pair, on each of its rows.
    """
    kind = dict(pairs.dtypes)[key]
    lang = F.col(language) if language else F.lit("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, a, c, g in zip(b[key], b["a"], b["b"], b["g"]):
                d = Diff(a or "", c or "", g or "text")
                rows += [(k, d.distance, *x, d.bounded, d.truncated) for x in d.changes]
            yield pd.DataFrame(rows, columns=[key, "distance", "op", "label", "old_text", "new_text", "bounded", "truncated"])

    src = pairs.select(key, F.col(old).alias("a"), F.col(new).alias("b"), lang.alias("g"))
    return src.mapInPandas(run, f"{key} {kind}, distance double, op string, label string, old_text string, new_text string, bounded boolean, truncated boolean")
