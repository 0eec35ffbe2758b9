"""Symbols and edges of source files: a table function over (path, content).

Python is read by its own syntax tree, the brace languages by an island scan
that knows comments, strings and balanced braces, Vue files block by block.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = (
    "id string, name string, kind string, signature string, file_path string, start_line long, start_col long, end_line long, end_col long, "
    "docstring string, parent_id string, children array<string>, language string, token_count long, qualified_name string"
)
EDGES = "src string, dst string, edge_type string, tags array<string>"

#: Languages of the parsers by extension.
LANGUAGE = {
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "dart": "dart", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "typescript", "vue": "vue", "html": "html", "htm": "html", "css": "css",
}


@dataclass
class Symbol:
    name: str
    kind: str
    signature: str
    start: int
    col: int
    end: int
    end_col: int
    doc: str | None = None
    bases: list[str] = field(default_factory=list)
    parent: int | None = None
    id: str = ""


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    refs: list[tuple[int, str, str]] = field(default_factory=list)  # line, name, type


def tokens_of(text: str) -> int:
    return -(-len(text.split()) * 13 // 10)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def _python(text: str) -> Parsed:
    out = Parsed()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out
    lines = text.split("\n")
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "Class" if isinstance(n, ast.ClassDef) else "Function"
            bases = [b for b in map(_dotted, n.bases) if b] if kind == "Class" else []
            out.symbols.append(Symbol(n.name, kind, lines[n.lineno - 1].strip(), n.lineno, n.col_offset + 1, n.end_lineno, n.end_col_offset + 1, ast.get_docstring(n), bases))
        elif isinstance(n, ast.Call):
            name = _dotted(n.func)
            if name:
                out.refs.append((n.lineno, name, "Calls"))
        elif isinstance(n, ast.Import):
            out.refs += [(n.lineno, a.name, "Imports") for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.refs += [(n.lineno, f"{n.module or ''}.{a.name}".strip("."), "Imports") for a in n.names]
    return out


_LEX = re.compile(r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^'\n]*|[^'\\\n])'|`(?:\\.|[^`\\])*`?)|(?P<open>\{)|(?P<close>\})", re.S)
_MOD = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|inline|virtual|override|extern|unsafe|const|sealed|partial|synchronized|pub(?:\([^)]*\))?)\s+)*"
#: Declarations of the brace languages, their pattern and kind.
_DECL = [
    (re.compile(rf"^[ \t]*{_MOD}(?:data\s+)?class\s+([A-Za-z_$][\w$]*)"), "Class"),
    (re.compile(rf"^[ \t]*{_MOD}struct\s+([A-Za-z_]\w*)"), "Struct"),
    (re.compile(r"^[ \t]*type\s+([A-Za-z_]\w*)\s+struct\b"), "Struct"),
    (re.compile(r"^[ \t]*type\s+([A-Za-z_]\w*)\s+interface\b"), "Interface"),
    (re.compile(rf"^[ \t]*{_MOD}interface\s+([A-Za-z_$][\w$]*)"), "Interface"),
    (re.compile(rf"^[ \t]*{_MOD}trait\s+([A-Za-z_]\w*)"), "Trait"),
    (re.compile(rf"^[ \t]*{_MOD}protocol\s+([A-Za-z_]\w*)"), "Protocol"),
    (re.compile(rf"^[ \t]*{_MOD}enum\s+(?:class\s+)?([A-Za-z_]\w*)"), "Enum"),
    (re.compile(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"), "Impl"),
    (re.compile(rf"^[ \t]*{_MOD}(?:namespace|mod|module)\s+([A-Za-z_][\w.]*)"), "Namespace"),
    (re.compile(rf"^[ \t]*{_MOD}fn\s+([A-Za-z_]\w*)"), "Function"),
    (re.compile(r"^[ \t]*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), "Function"),
    (re.compile(rf"^[ \t]*{_MOD}function\s*\*?\s*([A-Za-z_$][\w$]*)"), "Function"),
    (re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"), "Function"),
    (re.compile(rf"^[ \t]*{_MOD}(?:get|set)\s+([A-Za-z_$][\w$]*)\s*\([^;{{}}]*\)[^;{{}}]*\{{"), "Accessor"),
    (re.compile(rf"^[ \t]*{_MOD}(?!(?:if|for|while|switch|catch|return|else|match|do|try|new|throw|with|function|sizeof)\b)(?:[\w$<>\[\],*&:?.]+[ \t*&]+)*([A-Za-z_$~][\w$]*)\s*\([^;{{}}]*\)\s*[^;{{}}=]*\{{"), "Function"),
]
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*)!?\s*\(")
_NOT_CALL = frozenset("if for while switch catch return function fn func match sizeof new typeof await super defer go else do with print".split())
_IMPORT = re.compile(r"^\s*(?:import\s+(?:[^'\"]*?from\s+)?[\"']([^\"']+)[\"']|(?:const|let|var)\s+[^=]*=\s*require\(\s*[\"']([^\"']+)|use\s+([\w:]+)|import\s+(?:static\s+)?([\w.]+)\s*;|#include\s*[<\"]([^>\"]+))", re.M)
_BASES = re.compile(r"\b(?:extends|implements|:)\s+([A-Za-z_$][\w$.,\s]*)")
_DOC_LINE = re.compile(r"^\s*(?:/{2,3}!?|/\*\*?|\*+/?|#)\s?|\s*\*/\s*$")


def clean_doc(text: str | None) -> str | None:
    if not text:
        return None
    out = "\n".join(_DOC_LINE.sub("", _DOC_LINE.sub("", x)).strip() for x in text.split("\n")).strip()
    return out or None


def _braces(text: str, language: str) -> Parsed:
    out = Parsed()
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    line_of = lambda off: bisect_right(starts, off)
    close, opens, stack, comments, plain, at = {}, [], [], {}, [], 0
    for m in _LEX.finditer(text):
        plain.append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "open":
            stack.append(m.start())
            opens.append(m.start())
            plain.append("{")
        elif kind == "close":
            if stack:
                close[stack.pop()] = m.start()
            plain.append("}")
        else:
            if kind != "text":
                a, b = line_of(m.start()), line_of(max(m.start(), m.end() - 1))
                if not lines[a - 1][: m.start() - starts[a - 1]].strip():
                    comments[b] = (a, m.group())
            plain.append(re.sub(r"[^\n]", " ", m.group()) if kind != "text" else m.group()[0] + re.sub(r"[^\n]", "_", m.group()[1:-1]) + m.group()[-1:])
    plain.append(text[at:])
    code = "".join(plain)
    code_lines = code.split("\n")
    for i, line in enumerate(code_lines, 1):
        for rule, kind in _DECL:
            m = rule.match(line)
            if not m:
                continue
            k = bisect_right(opens, starts[i - 1] - 1)
            end = i
            end_col = len(lines[i - 1]) + 1
            semi = code.find(";", starts[i - 1])
            if k < len(opens) and not (0 <= semi < opens[k] and code.count("(", starts[i - 1], semi) == code.count(")", starts[i - 1], semi)):
                off = close.get(opens[k], len(text) - 1)
                end, end_col = line_of(off), off - starts[line_of(off) - 1] + 2
            elif kind in ("Function", "Accessor", "Impl"):
                break
            doc, top = [], i - 1
            while top in comments and not (doc and comments[top][1].startswith("/*")):
                doc.insert(0, comments[top][1])
                top = comments[top][0] - 1
            if kind == "Accessor":
                kind = "Getter" if re.match(r".*\bget\s", line) else "Setter"
            bases = []
            if kind in ("Class", "Struct", "Interface", "Trait", "Enum"):
                for b in _BASES.findall(line):
                    bases += [x.strip() for x in b.split(",") if x.strip() and x.strip() not in ("implements", "extends")]
                bases = [re.split(r"\s", b)[0] for b in bases]
            name = m.group(1)
            if language in ("javascript", "typescript") and kind == "Function" and name[:1].isupper():
                kind = "Component"
            out.symbols.append(Symbol(name, kind, lines[i - 1].strip(), i, len(line) - len(line.lstrip()) + 1, end, end_col, clean_doc("\n".join(doc)), bases))
            break
    defs = {(s.start, s.name) for s in out.symbols}
    for i, line in enumerate(code_lines, 1):
        for m in _CALL.finditer(line):
            name = m.group(1)
            if re.split(r"\.|::|->", name)[-1] not in _NOT_CALL and (i, name) not in defs and not re.search(r"\b(?:fn|func|function|def|new)\s+$", line[: m.start()]):
                out.refs.append((i, name, "Calls"))
    for m in _IMPORT.finditer(text):
        out.refs.append((line_of(m.start()), next(g for g in m.groups() if g), "Imports"))
    return out


_BLOCK = re.compile(r"<(template|script|style)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)
_OPEN_TAG = re.compile(r"<([A-Za-z][A-Za-z0-9_.:-]*)")


def component_tags(template: str) -> list[str]:
    """Names of open tags that hold a hyphen or start with a capital."""
    return [t for t in _OPEN_TAG.findall(template) if "-" in t or t[0].isupper()]


def attribute(attrs: str, name: str) -> str | None:
    m = re.search(rf"\b{re.escape(name)}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", attrs)
    return next((g for g in m.groups() if g is not None), None) if m else None


def sfc_blocks(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, attributes, content, lines before the content) of each block, in order."""
    return [(m.group(1).lower(), m.group(2), m.group(3), text.count("\n", 0, m.start(3))) for m in _BLOCK.finditer(text)]


def _vue(text: str, path: str) -> Parsed:
    out = Parsed()
    lines = text.split("\n")
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out.symbols.append(Symbol(name, "Component", f"<{name}>", 1, 1, len(lines), len(lines[-1]) + 1))
    for kind, attrs, body, offset in sfc_blocks(text):
        if kind == "script":
            lang = attribute(attrs, "lang") or "js"
            sub = _braces(body, LANGUAGE.get(lang, "javascript"))
            for s in sub.symbols:
                s.start, s.end = s.start + offset, s.end + offset
            out.symbols += sub.symbols
            out.refs += [(ln + offset, n, t) for ln, n, t in sub.refs]
        elif kind == "template":
            for i, line in enumerate(body.split("\n")):
                out.refs += [(i + 1 + offset, t, "References") for t in component_tags(line)]
    return out


def _tags(text: str, language: str) -> Parsed:
    out = Parsed()
    pattern = r"\bid\s*=\s*[\"']([^\"']+)" if language == "html" else r"(?m)^\s*([.#][\w-]+)[^{};]*\{"
    for m in re.finditer(pattern, text):
        line = text.count("\n", 0, m.start(1)) + 1
        out.symbols.append(Symbol(m.group(1), "Tag" if language == "html" else "Symbol", text.split("\n")[line - 1].strip(), line, 1, line, 1))
    return out


def parse(path: str, text: str | None) -> Parsed:
    """Definitions and references of one file; an unknown extension or null text has none."""
    language = LANGUAGE.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if not text or language is None:
        return Parsed()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if language == "python":
        return _python(text)
    if language == "vue":
        return _vue(text, path)
    if language in ("html", "css"):
        return _tags(text, language)
    if language == "ruby":
        out = Parsed()
        for i, x in enumerate(text.split("\n"), 1):
            m = re.match(r"^\s*(def|class|module)\s+([\w.:?!]+)(?:\s*<\s*([\w:]+))?", x)
            if m:
                out.symbols.append(Symbol(m.group(2), {"def": "Function", "class": "Class", "module": "Module"}[m.group(1)], x.strip(), i, 1, i, len(x) + 1, None, [m.group(3)] if m.group(3) else []))
        return out
    return _braces(text, language)


def rows_of(path: str, text: str | None) -> tuple[list[tuple], list[tuple]]:
    """Rows of SYMBOLS and EDGES of one file: nesting, roles and qualified names settled, references bound to the narrowest symbol."""
    p = parse(path, text)
    language = LANGUAGE.get(path.rsplit(".", 1)[-1].lower(), "other")
    syms = sorted(p.symbols, key=lambda s: (s.start, -s.end, s.col))
    stack: list[int] = []
    for i, s in enumerate(syms):
        s.id = f"{path}#{s.name}:L{s.start}C{s.col}"
        while stack and syms[stack[-1]].end < s.start:
            stack.pop()
        s.parent = stack[-1] if stack else None
        stack.append(i)
    objects = ("Class", "Struct", "Impl", "Trait", "Interface", "Protocol", "Enum")
    for s in syms:
        up = syms[s.parent] if s.parent is not None else None
        if s.kind == "Function" and up is not None and up.kind in objects:
            s.kind = "Constructor" if s.name in ("__init__", up.name, "constructor") else "Method"
    kids: dict[int, list[str]] = {}
    edges = []
    for s in syms:
        if s.parent is not None:
            kids.setdefault(s.parent, []).append(s.id)
            edges.append((syms[s.parent].id, s.id, "Contains", []))
        edges += [(s.id, b, "Inherits", []) for b in s.bases]
    for line, name, kind in p.refs:
        around = [s for s in syms if s.start <= line <= s.end]
        src = min(around, key=lambda s: (s.end - s.start, s.id)).id if around else path
        edges.append((src, name, kind, []))
    rows = []
    for i, s in enumerate(syms):
        up = syms[s.parent] if s.parent is not None else None
        rows.append((s.id, s.name, s.kind, s.signature, path, s.start, s.col, s.end, s.end_col, s.doc, up.id if up else None, kids.get(i, []), language, tokens_of(s.signature), f"{up.name}::{s.name}" if up else s.name))
    return rows, list(dict.fromkeys((a, b, c, tuple(t)) for a, b, c, t in edges))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def extract_symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS of files (path, content), one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b.path, b.content) for r in rows_of(p, t)[0]], columns=_names(SYMBOLS))

    return files.filter(F.col("path").isNotNull()).select("path", "content").mapInPandas(run, SYMBOLS)


def extract_edges(files: DataFrame) -> DataFrame:
    """EDGES of files (path, content), one narrow pass; each (src, dst, type) once per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(a, d, c, list(t)) for p, x in zip(b.path, b.content) for a, d, c, t in rows_of(p, x)[1]], columns=_names(EDGES))

    return files.filter(F.col("path").isNotNull()).select("path", "content").mapInPandas(run, EDGES)
