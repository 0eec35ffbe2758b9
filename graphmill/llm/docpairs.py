"""Functions paired with their documentation.

An island grammar per language parses only documentation comments, annotations,
signatures and balanced bodies; everything else is water and is skipped. Pairs
join the islands of the current files with the current symbols: the grammar
tells whether a symbol of unknown kind is a function, and the documentation that
it parses above or inside the island is what must say something. Where the file
is gone or holds other documentation, the symbol's own is parsed instead.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a file whose symbols are handled together.
BLOCK_LINES = 4_096
#: The kinds of symbol that count as functions.
FUNCTION_KINDS = ("function", "method", "constructor", "getter", "setter")

# --- documentation that says nothing -----------------------------------------------------

#: Words that add nothing to a function's own name.
_FILLERS = frozenset(
    "the a an this that of for to and is function method class constructor getter setter helper procedure routine "
    "brief summary description name de la le el der die das".split()
)
#: Words of notes that documentation is missing, beside the marks TODO, FIXME, XXX.
_MISSING = frozenset(
    "todo fixme xxx tbd hack add write fill insert enter put missing need needs needed document documentation docs doc "
    "docstring comment comments description describe explain summary here this me it in later soon yet no not none to be "
    "please the a an function method text goes undocumented documented n/a na pending "
    "pendiente pendientes documentar documentación sin falta à a documenter compléter documentation dokumentation fehlt "
    "noch nicht dokumentiert dokumentieren offen hier manque".split()
)
_DIRECTIVE = re.compile(
    r"^(?:#!|type:\s*ignore|noqa\b|pragma\b|pylint:|flake8:|mypy:|ruff:|isort:|fmt:\s*(?:on|off|skip)|yapf:|nolint|nolintnextline|"
    r"rustfmt::|clippy::|allow\(|clang-format|clang-tidy|prettier-ignore|eslint|jshint|jslint|tslint:|istanbul|c8 ignore|"
    r"@ts-(?:ignore|expect-error|nocheck|check)|@override\b|@suppress|@formatter|go:|\+build|-\*-|coding[:=]|vim:|"
    r"cppcheck-suppress|lint:|checkstyle|nosonar|sonar|webpackchunkname|@jsx\b|region\b|endregion\b|cspell:|spell-?checker:|coverage:|spotless:|ktlint|swiftlint|rubocop|phpcs|skipcq|nosec)",
    re.I,
)
_TAG_ONLY = re.compile(
    r"^(?:[@\\](?:param|arg|argument|tparam|property|prop|throws|exception|raises?|see|since|version|author|override|internal|private|public|module|class|function|method|name|memberof)\b(?:\s*\{[^}]*\})?(?:\s+[\w.$\[\]*#()<>:/-]+)?|"
    r"[@\\]returns?(?:\s*\{[^}]*\})?|:(?:param|type|raises?|rtype|return|returns|arg)(?:\s+[\w.]+)*\s*:\s*|\{?@inheritdoc\}?|"
    r"(?:args|arguments|parameters|params|returns?|raises|yields|throws|notes?|examples?|attributes)\s*:|[-*]?\s*\w+\s*:|-{3,}|={3,})\s*$",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^(?:\$\{[^}]*\}|\{\{[^}]*\}\}|<%.*%>|<[a-z][\w .-]*>|\[[a-z][\w .-]*\]|_+[a-z]\w*_+|%[a-z_]+%|@@\w+@@|"
    r"(?:add|insert|enter|write|your|put)?\s*(?:a |the |your )?(?:description|summary|documentation|docstring|comment|text)(?:\s+(?:goes\s+)?here)?|lorem ipsum.*)\W*$",
    re.I,
)
_LEGAL = re.compile(
    r"^(?:copyright\b|\(c\)\s|©|spdx-license-identifier|spdx-|licen[sc]ed? (?:under|to)\b|all rights reserved|no warranty|"
    r"you may (?:use|copy|not use|obtain|change|redistribute)\b|permission is hereby granted|redistribution and use|"
    r"released under (?:the|a)\b|distributed under (?:the|a)\b|this (?:file|program|software|library|source|code|work) is (?:free|licen[sc]ed|part of|subject|provided|distributed|released|made available)|"
    r"the above copyright notice|see (?:the )?(?:file )?licen[sc]e\b|mit licen[sc]e|apache licen[sc]e|provided .as is.|without warrant)",
    re.I,
)
_GENERATED = re.compile(
    r"^(?:(?:this|the) (?:\w+ )?(?:is|was|has been|were) (?:auto\w*[- ]?)?(?:automatically )?generated\b|auto[- ]?generated\b|automatically generated\b|"
    r"generated (?:by|from|with|using|automatically|stub|code|method|at)\b|code generated\b|machine[- ]generated\b|@generated\b|do not (?:edit|modify)\b|"
    r"(?:automatisch erzeugt|généré automatiquement|generado automáticamente))",
    re.I,
)
_STALE = re.compile(r"^(?:old|outdated|obsolete|stale) (?:note|comment|docs?)\b.{0,40}$|^see (?:above|below|history|template|source|code)\W*$", re.I)
_CODE = re.compile(
    r"^(?:[{}()\[\];,]+|\}\s*(?:else\b.*|\)\s*;?|;)?|(?:if|for|while|switch|match|else|try|catch|elif|with|def|fn|func|function|class|import|from|package|use|let|const|var|int|return|print|assert|raise|throw|del|pass|break|continue)\b.*[;{}:)\]]|"
    r"(?:return|let|const|var)\b[^.]*;|[\w.\[\]'\"$&*>-]+\s*(?:[-+*/|&]?=|:=|<-)\s*[^=].*|(?:[\w$]+(?:\.|::|->))*[\w$]+(?:::<[^>]*>)?\s*\([^)]*\)(?:\?|\.\w+\([^)]*\))*;?|[^\s].*\w\)\??;)$"
)
_OPEN = re.compile(r"(?:(?:/\*+!?|\*+/|///+!?|//+!?|#+!?|--+|;;+|%+|\"\"\"|'''|<!--|\(\*|\*(?=\s|$)|\*+(?=[^\w*]))\s*)+")
_CLOSE = ("*/", '"""', "'''", "-->", "*)")
_XML = re.compile(r"</?(?:summary|remarks|para|param|returns?|value|inheritdoc|see|c|p|br|code|example|exception|typeparam)\b[^<>]*/?>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+")
_LETTER = re.compile(r"[^\W_]")


def strip_marks(doc: str) -> list[str]:
    """The lines of a documentation comment without comment marks and XML documentation tags."""
    out = []
    for line in doc.splitlines():
        line = line.strip()
        m = _OPEN.match(line)
        line = line[m.end() :] if m else line
        while line.endswith(_CLOSE):
            line = line[:-2].rstrip("*/-\"'") if line.endswith(("*/", "*)")) else line[:-3]
            line = line.rstrip()
        out.append(_XML.sub(" ", line).strip())
    return out


def _stem(w: str) -> str:
    """A word without plural or third-person ending and without its last y or e: copy, copies and copys meet."""
    w = w.lower()
    if not w.endswith("ss"):
        for end in ("ies", "es", "s"):
            if w.endswith(end) and len(w) - len(end) >= 2:
                w = w[: -len(end)]
                break
    return w[:-1] if len(w) > 2 and w[-1] in "yei" else w


def _only_name(text: str, name: str | None) -> bool:
    said = [_stem(w) for w in _NAME_PART.findall(re.sub(r"^[@\\]brief\b", "", text.strip()))]
    if not said:
        return True
    own = {_stem(w) for w in _NAME_PART.findall(name or "")}
    rest = [w for w in said if w not in own and w not in _FILLER_STEMS]
    if not rest:
        return True
    flat = "".join(c for c in (name or "").lower() if c.isalnum())
    bare = "".join(re.findall(r"[^\W_]+", text)).lower()
    return bool(flat) and (bare == flat or "".join(x for x in re.findall(r"[^\W_]+", text.lower()) if x not in _FILLERS) in (flat, flat + "s"))


_FILLER_STEMS = frozenset(_stem(w) for w in _FILLERS) | _FILLERS
_MARK = re.compile(r"\b(?:TODO|FIXME|XXX|TBD|T\.B\.D\.?|HACK)\b", re.I)


def _says_nothing(text: str, name: str | None) -> bool:
    text = text.strip()
    if not _LETTER.search(text):
        return True
    bare = text.strip(" \t-*•·–—.!?:;,()[]<>\"'`_=#/")
    for rule in (_DIRECTIVE, _TAG_ONLY, _PLACEHOLDER, _LEGAL, _GENERATED, _STALE):
        if rule.match(text) or rule.match(bare):
            return True
    if _only_name(text, name):
        return True
    said = re.findall(r"n/a|t\.b\.d|[^\W\d_]+", text.lower())
    if said and all(w in _MISSING or w == "t.b.d" for w in said):
        return True
    if _MARK.match(bare) and len(said) <= 4 and said[-1] in ("docs", "doc", "documentation", "comment", "comments", "description"):
        return True
    return False


def describe(doc: str | None, name: str | None = None) -> str | None:
    """The documentation without comment marks, or None where it is trivial.

    Trivial: null or blank, or each line and sentence of it is one of: no
    letters or digits, the symbol's own name in words, a note that documentation
    is missing, an unfilled template, a tool directive, a tag without a
    description, disabled code, licence or copyright text, or a remark that the
    code was generated. One sentence that says more makes the whole count.
    """
    if doc is None:
        return None
    lines = strip_marks(doc)
    prose: list[str] = []
    told = False
    for line in [*lines, ""]:
        if line and not (_TAG_ONLY.match(line) or _CODE.match(line) or _DIRECTIVE.match(line)):
            # a tag with its own text starts a sentence of its own
            if re.match(r"^(?:[@\\]\w+|:\w+[^:]*:)", line) and prose:
                told = told or any(not _says_nothing(s, name) for s in _SENTENCE.split(" ".join(prose)))
                prose = []
            prose.append(line)
            continue
        if prose:
            told = told or any(not _says_nothing(s, name) for s in _SENTENCE.split(" ".join(prose)))
            prose = []
    return "\n".join(lines).strip() if told else None


# --- island grammars ---------------------------------------------------------------------

@dataclass(frozen=True)
class Grammar:
    """The islands of one brace language: how a function begins, which lines above are annotations and which comments documentation.

    begins: beginnings of a declaration line up to its name, which must be followed by a parameter list, or by `=` and a function.
    """

    begins: str
    annotation: str = r"@\w"
    documentation: tuple[str, ...] = ("/**", "/*")
    raw_string: str = ""

    @property
    @cache
    def definition(self) -> re.Pattern:
        return re.compile(rf"^[ \t]*(?:{self.begins})", re.S)

    @property
    @cache
    def token(self) -> re.Pattern:
        """What hides braces: comments and strings; and the braces themselves."""
        raw = f"|{self.raw_string}" if self.raw_string else ""
        return re.compile(rf"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z)){raw}|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.[^'\n]*|[^'\\\n])'|(?P<brace>[{{}}])", re.S)

    @property
    @cache
    def notes(self) -> re.Pattern:
        return re.compile(rf"^\s*(?:{self.annotation})")

    def defines(self, signature: str) -> str | None:
        """The name of the function that a signature declares, None where it declares something else."""
        m = self.definition.match(signature.strip() + ("" if "{" in signature or "=>" in signature else " {"))
        return next((g for g in m.groups() if g), None) if m else None


_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|else|match|do|try|new|throw|with|class|struct|enum|interface|namespace|union|record|typedef|sizeof|import|package|use|await|function)\b)"
_TYPED = rf"(?:{_NOT_NAMES}[\w$<>\[\],.*&:?]+[ \t*&]+)*?{_NOT_NAMES}([\w$~]+)\s*\([^;{{}}]*\)[^;{{}}=]*\{{"
_JS = (
    r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*[(<]|"
    r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)|"
    rf"(?:(?:public|private|protected|static|async|abstract|override|readonly|get|set|\*)\s+)*{_NOT_NAMES}(?:#)?([\w$]+)\s*(?:<[^>]*>)?\s*\([^;{{}}]*\)\s*(?::[^{{}};]*)?\{{"
)
#: The grammars by file extension; Python has its own by indentation.
GRAMMARS = {
    "rs": Grammar(r"(?:(?:pub(?:\([^)]*\))?|async|const|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)\s*[(<]", r"#!?\[", ("///", "//!", "/**", "/*!"), r"r(?P<hashes>#*)\".*?\"(?P=hashes)"),
    "go": Grammar(r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]", r"//go:", ("//", "/*"), r"`[^`]*`"),
    "java": Grammar(rf"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]*>\s*)?{_TYPED}", r"@\w", ("/**",)),
    "js": Grammar(_JS, raw_string=r"`(?:\\.|[^`\\])*`"),
    "ts": Grammar(_JS, raw_string=r"`(?:\\.|[^`\\])*`"),
    "c": Grammar(rf"(?:(?:static|inline|extern|const|unsigned|signed|struct|enum|virtual|constexpr)\s+)*{_TYPED}", r"\[\[|__attribute__", ("/**", "/*", "//"), r"R\"\(.*?\)\""),
}
_SAME = {"jsx": "js", "mjs": "js", "cjs": "js", "tsx": "ts", "mts": "ts", "cts": "ts", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hh": "c", "cs": "java", "kt": "java", "scala": "java", "swift": "java", "dart": "java", "php": "js"}
_BY_NAME = {"rust": "rs", "go": "go", "java": "java", "javascript": "js", "typescript": "ts", "c": "c", "c++": "c", "cpp": "c", "python": "py"}
_PY_DEF = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)")
_PY_TRIPLE = re.compile(r"^\s*[rRuUbB]{0,2}(\"\"\"|''')")


def _left_open(line: str) -> str | None:
    """The triple quote that a line opens and does not close."""
    first = re.search(r"\"\"\"|'''", line)
    if not first or line.lstrip().startswith("#"):
        return None
    return first.group() if line.count(first.group()) % 2 else None


def _python_islands(lines: list[str]) -> Iterator[dict]:
    n = len(lines)
    i = 0
    triple = None
    while i < n:
        if triple:  # inside a string: water
            if triple in lines[i]:
                triple = None
            i += 1
            continue
        m = _PY_DEF.match(lines[i])
        if not m:
            triple = _left_open(lines[i])
            i += 1
            continue
        top = i
        while top and lines[top - 1].lstrip().startswith("@") and lines[top - 1].strip():
            top -= 1
        depth, j, single, ended = 0, i, False, False
        while j < n and not ended:
            bare = re.sub(r"#.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[j])
            for at, c in enumerate(bare):
                depth += (c in "([{") - (c in ")]}")
                if c == ":" and depth == 0:  # the colon that ends the signature
                    ended, single = True, bool(bare[at + 1 :].strip())
                    break
            if not ended:
                j += 1
        width = len(m.group("indent").expandtabs(8))
        k, last, inside = j + 1, min(j, n - 1), None
        while k < n and not single:
            line = lines[k]
            if inside:
                last = k
                if inside in line:
                    inside = None
            elif line.strip():
                if len(line[: len(line) - len(line.lstrip())].expandtabs(8)) <= width:
                    break
                last = k
                inside = _left_open(line)
            k += 1
        doc = None
        first = j + 1
        if first <= last:
            t = _PY_TRIPLE.match(lines[first])
            if t:
                body = "\n".join(lines[first : last + 1])
                q = body.index(t.group(1)) + 3
                e = body.find(t.group(1), q)
                doc = body[q : e if e >= 0 else len(body)]
        yield {"line": i + 1, "end_line": last + 1, "name": m.group("name"), "doc": doc, "annotations": "\n".join(lines[top:i]), "signature": "\n".join(lines[i : min(j, n - 1) + 1]).strip()}
        i = j + 1  # nested functions are islands as well


def _brace_islands(text: str, lines: list[str], grammar: Grammar) -> Iterator[dict]:
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda off: bisect_right(starts, off)  # noqa: E731  1-based
    close: dict[int, int] = {}
    opens: list[int] = []
    stack: list[int] = []
    comments: dict[int, tuple[int, str]] = {}  # last line -> first line, text
    water: set[int] = set()
    for m in grammar.token.finditer(text):
        kind = m.lastgroup
        if kind == "brace":
            if m.group() == "{":
                stack.append(m.start())
                opens.append(m.start())
            elif stack:
                close[stack.pop()] = m.start()
        elif kind in ("line", "block"):
            a, b = line_of(m.start()), line_of(max(m.start(), m.end() - 1))
            if not lines[a - 1][: m.start() - starts[a - 1]].strip():
                comments[b] = (a, m.group())
                water.update(range(a, b + 1))
        elif "\n" in m.group():
            water.update(range(line_of(m.start()) + 1, line_of(m.end() - 1) + 1))
    for i, line in enumerate(lines, 1):
        if i in water or "(" not in line:
            continue
        m = grammar.definition.match(line)
        if not m and not line.rstrip().endswith((";", "}", ":")):  # a signature over several lines
            brace = text.find("{", starts[i - 1])
            m = grammar.definition.match(text[starts[i - 1] : brace + 1]) if 0 <= brace and line.count("(") > line.count(")") else None
        name = next((g for g in m.groups() if g), None) if m else None
        if name is None:
            continue
        k = bisect_right(opens, starts[i - 1] - 1)
        if k >= len(opens):
            continue
        semi = text.find(";", starts[i - 1], opens[k])
        if semi >= 0 and text.count("(", starts[i - 1], semi) == text.count(")", starts[i - 1], semi):
            continue  # a declaration without a body
        end = close.get(opens[k], len(text) - 1)
        top = i - 1
        notes = []
        while top >= 1 and (top not in water or top in comments) and grammar.notes.match(lines[top - 1]):
            notes.insert(0, lines[top - 1])
            top -= 1
        doc, gap = [], 0
        while top >= 1:
            if top in comments:
                a, c = comments[top]
                if not c.startswith(grammar.documentation) or grammar.notes.match(c):
                    break
                if doc and c.startswith("//") != doc[0].startswith("//"):
                    break
                doc.insert(0, c)
                top, gap = a - 1, 0
                if c.startswith("/*"):
                    break
            elif not lines[top - 1].strip() and gap < 1 and not doc:
                top, gap = top - 1, gap + 1
            else:
                break
        yield {"line": i, "end_line": line_of(end), "name": name, "doc": "\n".join(doc) or None, "annotations": "\n".join(notes), "signature": text[starts[i - 1] : opens[k] + 1].strip()}


def grammar_of(path: str | None, language: str | None = None) -> str:
    """The name of the grammar by the path's extension, else by the language; "" where neither tells."""
    ext = path.rsplit(".", 1)[-1].lower() if path and "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("py", "pyi"):
        return "py"
    name = _SAME.get(ext, ext)
    return name if name in GRAMMARS else _BY_NAME.get((language or "").strip().lower(), "")


def declares(signature: str | None, grammar: str) -> bool:
    """Whether a signature declares a function or method by the grammar, or by any one where it is unknown."""
    if not signature or not signature.strip():
        return False
    if grammar == "py":
        return bool(_PY_DEF.match(signature.strip()))
    known = [GRAMMARS[grammar]] if grammar else list(GRAMMARS.values())
    return any(g.defines(signature) for g in known) or (not grammar and bool(_PY_DEF.match(signature.strip())))


def islands(text: str | None, path: str, language: str | None = None) -> list[dict]:
    """The functions of a source text: line, end_line (from 1), name, doc, annotations, signature.

    The grammar follows the path's extension, else the language; a text of
    neither has no islands, nor has a null or empty one. Braces in strings and
    comments do not count; a body that never closes ends the text.
    """
    grammar = grammar_of(path, language)
    if not text or not grammar:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    return list(_python_islands(lines) if grammar == "py" else _brace_islands(text, lines, GRAMMARS[grammar]))


# --- operators ---------------------------------------------------------------------------


_PAIR = (
    "id string, path string, line long, end_line long, name string, kind string, language string, signature string, "
    "annotations string, description string, code string, balanced boolean"
)
_WORDS = re.compile(r"\w+")


def _pair(s, path: str | None, lines: list[str], land_at: dict) -> tuple | None:
    """The pair of one symbol, None where the grammar finds no function or its documentation says nothing."""
    grammar = grammar_of(path, s["language"])
    here = land_at.get(s["line"], [])
    f = next((x for x in here if x["name"] == s["name"]), here[0] if here else None)
    own = f is not None and f["name"] == s["name"]
    if not (s["kind"] or "").strip() and not own and not declares(s["signature"], grammar):
        return None
    parsed = f["doc"] if own and f["doc"] else None
    same = parsed is not None and _WORDS.findall(parsed) == _WORDS.findall(s["docstring"])
    description = describe(parsed if same else s["docstring"], s["name"])
    if description is None:
        return None
    end = s["end_line"] or (f["end_line"] if f else None)
    code = balanced = None
    if s["line"] and end and 1 <= s["line"] <= end and s["line"] <= len(lines):
        code = "\n".join(lines[int(s["line"]) - 1 : int(end)])
        balanced = f is not None and f["end_line"] == end
    return s["id"], path or None, s["line"], end, s["name"], s["kind"], s["language"], f["signature"] if own else s["signature"], f["annotations"] if f else None, description, code, balanced


def doc_pairs(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Code-description pairs, one row per living function or method whose documentation says something.

    symbols: one current row per id; files: one current row per path. The kind
    tells a function (case and blanks aside); where it is null or blank, the
    island at the symbol's line or the grammar of its signature does. The
    description is the documentation that the island's grammar parses where it
    has the words of the stored one, else the stored one. code holds the file's
    lines from the symbol's first to its last; balanced tells whether the
    island's body ends where the symbol does. Where the file is gone, has no
    content or ends before the symbol, code and balanced are null and the
    description still comes out. A symbol without an end takes the island's.

    Each file's text meets its symbols once, all symbols of BLOCK_LINES lines
    together, and is parsed once for them; symbols without path or line meet none.
    """
    kind = F.lower(F.trim("kind"))
    mine = symbols.filter("deleted_at is null").filter(F.trim("docstring") != "").filter(kind.isNull() | kind.isin("", *FUNCTION_KINDS))
    cols = ["id", F.col("file_path").alias("path"), F.col("start_line").alias("line"), "end_line", "name", "kind", "language", "signature", "docstring"]
    mine = mine.select(*cols)
    fields = ["id", "line", "end_line", "name", "kind", "language", "signature", "docstring"]
    placed = F.col("path").isNotNull() & F.col("line").isNotNull()
    lost = mine.filter(~placed).select("path", F.array(F.struct(*fields)).alias("spans"), F.lit(None).cast("string").alias("content"))
    spans = mine.filter(placed).groupBy("path", F.floor(F.col("line") / BLOCK_LINES).alias("block")).agg(F.collect_list(F.struct(*fields)).alias("spans"))
    land = files.filter(F.col("path").isNotNull()).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, spans_, text in zip(b.path, b.spans, b.content):
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if text else []
                land_at: dict = {}
                for f in islands(text, path, spans_[0]["language"]):
                    land_at.setdefault(f["line"], []).append(f)
                rows += [r for r in (_pair(s, path, lines, land_at) for s in spans_) if r]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PAIR.split(", ")], dtype=object)

    return spans.join(land, "path", "left").select("path", "spans", "content").unionByName(lost).mapInPandas(run, _PAIR)
