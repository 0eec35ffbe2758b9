"""The MATCH language: one edge pattern, lowered to joins that Catalyst plans.

    query := MATCH '(' id ')' '-' '[' id? (':' Type)? ']' '->' '(' id ')'
             [WHERE cond (AND cond)*] RETURN id (',' id)* [LIMIT int]
    cond  := id '.' field ('=' | CONTAINS | STARTS WITH | ENDS WITH) string

``=`` minds the letter case; the other comparisons do not. With an edge type
the result is the edges, without one the distinct nodes of both sides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of edges, names of fields and their columns, limits.
EDGE_TYPES = ["Calls", "Imports", "Defines", "References", "Inherits", "Contains"]
FIELDS = {
    "name": "name",
    "kind": "kind",
    "file_path": "file_path",
    "filepath": "file_path",
    "path": "file_path",
    "language": "language",
    "lang": "language",
    "signature": "signature",
    "qualified_name": "qualified_name",
    "qualifiedname": "qualified_name",
    "qualified": "qualified_name",
}
MAX_CHARS, MAX_TOKENS, MAX_LIMIT, DEFAULT_LIMIT = 16_384, 2_048, 10_000, 1_000

_TOKEN = re.compile(r"""\s+|(?P<arrow>->)|(?P<punct>[()\[\]:,.=-])|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<word>[A-Za-z_]\w*)""")


class MatchError(ValueError):
    """A query that does not follow the grammar, or names what it did not bind."""


@dataclass(frozen=True)
class Condition:
    alias: str
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Query:
    left: str
    right: str
    edge: str | None
    edge_type: str | None
    conditions: list[Condition] = field(default_factory=list)
    returns: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT


def _tokens(text: str) -> list[tuple[str, str]]:
    if len(text) > MAX_CHARS:
        raise MatchError(f"longer than {MAX_CHARS} characters")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise MatchError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            value = m.group()
            if m.lastgroup == "string":
                value = re.sub(r"\\(.)", r"\1", value[1:-1])
            out.append((m.lastgroup, value))
    if len(out) > MAX_TOKENS:
        raise MatchError(f"more than {MAX_TOKENS} tokens")
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or (value is not None and v.upper() != value):
            raise MatchError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def maybe(self, kind: str, value: str) -> bool:
        k, v = self.peek()
        if k == kind and v.upper() == value:
            self.at += 1
            return True
        return False

    def node(self) -> str:
        self.take("punct", "(")
        name = self.take("word")
        self.take("punct", ")")
        return name

    def condition(self) -> Condition:
        alias = self.take("word")
        self.take("punct", ".")
        name = self.take("word").lower()
        if name not in FIELDS:
            raise MatchError(f"unknown field {name}")
        if self.maybe("punct", "="):
            op = "eq"
        elif self.maybe("word", "CONTAINS"):
            op = "contains"
        elif self.maybe("word", "STARTS"):
            self.take("word", "WITH")
            op = "startswith"
        elif self.maybe("word", "ENDS"):
            self.take("word", "WITH")
            op = "endswith"
        else:
            raise MatchError(f"unknown comparison {self.peek()[1]}")
        return Condition(alias, FIELDS[name], op, self.take("string"))

    def query(self) -> Query:
        self.take("word", "MATCH")
        left = self.node()
        self.take("punct", "-")
        self.take("punct", "[")
        edge = self.take("word") if self.peek()[0] == "word" else None
        kind = None
        if self.maybe("punct", ":"):
            name = self.take("word")  # a keyword such as Contains is a type here
            kind = next((t for t in EDGE_TYPES if t.lower() == name.lower()), None)
            if kind is None:
                raise MatchError(f"unknown edge type {name}")
        self.take("punct", "]")
        self.take("arrow")
        right = self.node()
        if left == right:
            raise MatchError("both nodes have one alias")
        conds = []
        if self.maybe("word", "WHERE"):
            conds.append(self.condition())
            while self.maybe("word", "AND"):
                conds.append(self.condition())
        self.take("word", "RETURN")
        returns = [self.take("word")]
        while self.maybe("punct", ","):
            returns.append(self.take("word"))
        limit = DEFAULT_LIMIT
        if self.maybe("word", "LIMIT"):
            limit = int(self.take("int"))
            if not 1 <= limit <= MAX_LIMIT:
                raise MatchError(f"LIMIT must be in 1..{MAX_LIMIT}")
        if self.peek()[0] != "end":
            raise MatchError(f"unexpected {self.peek()[1]} at the end")
        known = {left, right, *([edge] if edge else [])}
        for name in [*returns, *(c.alias for c in conds)]:
            if name not in known:
                raise MatchError(f"unknown alias {name}")
        if any(c.alias == edge for c in conds):
            raise MatchError("conditions on an edge are not supported")
        return Query(left, right, edge, kind, conds, returns, limit)


def parse(text: str) -> Query:
    return _Parser(text).query()


def _test(c: Condition, columns: list[str]) -> Column:
    col = F.coalesce(F.col(c.column), F.lit("")) if c.column in columns else F.lit("")
    if c.op == "eq":
        return col == c.value
    return getattr(F.lower(col), c.op)(c.value.lower())


def run(text: str, nodes: DataFrame, edges: DataFrame, limit: bool = True) -> DataFrame:
    """Rows of a query: (src, dst, edge_type) with an edge type, else nodes; in order of their keys up to the limit.

    Conditions filter each node side before the join, and columns that the
    result does not show are never read. Edges with an unknown end do not match.
    """
    q = parse(text)
    cols = nodes.columns
    conds = {q.left: F.lit(True), q.right: F.lit(True)}
    for c in q.conditions:
        conds[c.alias] = conds[c.alias] & _test(c, cols)
    e = edges if q.edge_type is None else edges.filter(F.col("edge_type") == q.edge_type)
    e = e.select("src", "dst", "edge_type").distinct()
    left = nodes.filter(conds[q.left]).select(F.col("id").alias("src"))
    right = nodes.filter(conds[q.right]).select(F.col("id").alias("dst"))
    hit = e.join(left, "src", "left_semi").join(right, "dst", "left_semi")
    if q.edge_type is not None:
        out = hit.select("src", "dst", "edge_type")
        return out.orderBy("src", "dst", "edge_type").limit(q.limit) if limit else out
    ids = hit.select(F.col("src").alias("id")).union(hit.select("dst")).distinct()
    out = nodes.join(ids, "id", "left_semi")
    return out.orderBy("id").limit(q.limit) if limit else out
