"""Which source files nobody wrote by hand: belief propagation over directory trees.

Every file gets evidence for the labels handwritten, generated, minified,
vendored and blob from its name, its leading comments and its code; every folder
from its name. Folders and files form a forest along their paths. Sum-product
belief propagation on it, level by level up and then down, combines what the
files of a folder say with what the folder and its parents say: a mild remark
that tells nothing in an ordinary folder decides among generated siblings.
Siblings are no independent witnesses, so a folder's incoming messages are
tempered to the weight of a few; they are sums, aggregated before the shuffle,
and the number of files in one folder does not matter. Files of equal code hang
together by a noisy-or factor: any vendored one makes the others copies of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.paths import parent_dir, plain_path
from graphmill.session import durable

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
H, G, M, V, B = range(5)

#: Folder names that tell third-party code, and those that tell build output.
VENDOR_DIRS = (
    "vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages "
    "pods carthage deps extern external externals site-packages dist-packages .venv venv .bundle .cargo .gradle .tox .yarn"
).split()
OUTPUT_DIRS = "gen generated __generated__ autogen dist target out .next .nuxt .svelte-kit coverage __pycache__ .output .turbo .cache".split()
#: Likelihood ratios: what a clear name or remark tells, what a vague one tells, what the form of written code tells for hand-written and for vendored files, what a folder's name tells.
STRONG, MILD, SOME, ELSEWHERE, FOLDER = 2_000.0, 6.0, 3.0, 1.5, 1e5
#: Most children that a folder's children count for together.
WITNESSES = 6
#: Chance that a file equal to a vendored one is a copy of it.
COPY = 0.999
#: Levels of one plan before it is cut.
LEVELS = 6
#: Compatibility of a folder's label (row) with that of a folder in it (column). Only a name,
#: or more than three quarters of the files being of one kind, make a folder within an ordinary one anything else.
FOLDER_FOLDER = (
    (0.9996, 1e-4, 1e-4, 1e-4, 1e-4),
    (0.001, 0.996, 0.001, 0.001, 0.001),
    (0.001, 0.001, 0.996, 0.001, 0.001),
    (0.001, 0.001, 0.001, 0.996, 0.001),
    (0.001, 0.001, 0.001, 0.001, 0.996),
)
#: The same for a file in it, or a folder whose own name tells; an ordinary folder holds these of any kind.
FOLDER_FILE = (
    (0.70, 0.09, 0.07, 0.07, 0.07),
    (0.004, 0.981, 0.005, 0.005, 0.005),
    (0.004, 0.005, 0.981, 0.005, 0.005),
    (0.004, 0.005, 0.005, 0.981, 0.005),
    (0.004, 0.005, 0.005, 0.005, 0.981),
)
#: Share of each label among the folders at the top.
PRIOR = (0.999996, 1e-6, 1e-6, 1e-6, 1e-6)
#: Shortest code, in characters without comments and white space, whose equality counts as a copy.
COPY_CHARS = 60
#: Shortest code that is judged by its form.
FORM_CHARS = 200

_GENERATED_NAME = re.compile(
    r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|d\.ts|ts)|\.pb(?:-c)?\.\w+|\.pb\.(?:go|cc|h)|[._-](?:generated|gen|autogen|designer|g)\.\w+|_generated\.\w+|OuterClass(?:\.pb)?\.java|"
    r"^zz_generated[._]\S+|_(?:string|easyjson|moq|mock|ffjson)_gen\.go|_gen\.go|_string\.go|\.g\.dart|\.freezed\.dart|_grpc\.pb\.\w+|\.yy\.\w+|\.tab\.[ch]\w*|^moc_\w+|^ui_\w+\.h)$",
    re.I,
)
_MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:js|mjs|cjs|ts|css)|(?:^|[.-])(?:bundle|chunk|vendor|app|main|runtime)[.-][0-9a-f]{6,}\.\w+|[.-]bundle\.(?:js|ts))$", re.I)
_MARK = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+/?|--+|;+|<!--|%+|\"\"\"|''')\s?|\s*(?:\*/|-->)\s*$")
_GENERATED_NOTE = re.compile(
    r"^(?:this|the) (?:file|code|module|source|class|package) (?:is|was|has been) (?:auto\w*[- ]?)?(?:automatically |machine[- ])?(?:generated|created|produced|written) ?(?:by|from|with|using|automatically|;|\.|,|$)|"
    r"^this file is auto-?\s?generated|^auto-?\s?generated (?:by|from|file|code|with|using|on)|^automatically generated\b|^machine[- ]generated\b|^<auto-generated|^@generated\b|^(?:machine|tool)[- ]made\b|^code generated (?:by|from)\b|"
    r"^(?:code|file|source) (?:produced|emitted|created|written) by \S+.{0,40}\bdo not (?:edit|modify|change)|^generated (?:by|from|with|using) (?:the )?\S+.{0,60}(?:do not|from|at|on|v?\d)|"
    r"^(?:do not (?:edit|modify|change)(?: by hand| manually| this file)?[.!;,:-]).{0,80}(?:created|generated|produced|emitted|built)|^output of \S.{0,60}\bregenerate|"
    r"\bdo not edit\b\W*$|^diese datei wurde (?:automatisch )?(?:erzeugt|generiert|erstellt)|^automatisch (?:erzeugt|generiert)|^(?:ce )?fichier (?:a été )?(?:généré|produit)|"
    r"^(?:este )?(?:archivo|fichero|código) (?:fue |ha sido )?generado|^generado (?:por|automáticamente)|^généré (?:par|automatiquement)",
    re.I,
)
_VENDORED_NOTE = re.compile(
    r"^third[- ]party (?:code|source|file|copy|software|library)\b\s*[:;,-]|^vendored (?:from|copy of|in from)\b|^(?:copied|imported|taken|forked|ported) (?:verbatim |unchanged |unmodified )?from (?:the )?\S+.{0,60}(?:project|repository|revision|commit|version|release|v?\d+\.\d+)|"
    r"\|\s*\(c\).*\|\s*\S+|^bundled copy\b|^upstream(?: source| version)?\s*:|^(?:unmodified|verbatim) copy of\b|^code tiers?\s*:|^fremdcode\b|^copié (?:tel quel )?(?:de|depuis)\b|^übernommen aus\b|^copiado (?:sin cambios )?de\b|"
    r"^(?:drittanbieter|code de tiers|código de terceros)",
    re.I,
)
_VAGUE = (
    (G, re.compile(r"\b(?:auto)?-?generated\b|\bdo not (?:edit|modify)\b|\bmachine[- ]made\b|\bregenerate\b", re.I)),
    (V, re.compile(r"\bthird[- ]party\b|\bvendored\b|\bupstream\b|\b(?:copied|imported|taken|adapted|borrowed) from\b|\(c\)|©", re.I)),
)
_VAGUE_NAME = (
    (G, re.compile(r"(?:^|[._-])(?:gen|generated|autogen|auto|compiled|stubs?|mocks?)[._-]|[._-](?:gen|generated|autogen|compiled|stubs?|mocks?)\.\w+$", re.I)),
    (M, re.compile(r"[.-](?:packed|prod|dist|pack|compressed|ugly)\.(?:js|mjs|css)$", re.I)),
)
_ABOUT = re.compile(r"^(?:reads?|reports?|finds?|checks?|skips?|ignores?|handles?|compares?|lists?|removes?|replaces?|this (?:replaces|reads|checks|handles|skips)|minified output|never|if|when|whether|files? marked|tests?)\b", re.I)
_COMMENT_OR_STRING = re.compile(r"(//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^\s*#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma|undef|import|\[))[^\n]*)|(?m:(?<=\s)#\s[^\n\"']*$))|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)", re.S)
_DOCSTRING = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)", re.S)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*\b")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
#: Keywords that are no names.
_KEYWORDS = frozenset("var let const function return if else for while do new this typeof void null true false in of switch case break continue try catch throw class".split())


def leading_comment(text: str) -> list[str]:
    """The lines of the comment block with which a text starts, without marks; doc comments of a declaration do not count."""
    out, inside = [], None
    lines = text.lstrip("﻿").splitlines()
    for i, line in enumerate(lines):
        s = line.strip()
        if inside:
            out.append(_MARK.sub("", _MARK.sub("", line)).strip())
            if inside in s:
                inside = None
            continue
        if not s or (i == 0 and s.startswith("#!")):
            continue
        if s.startswith(("///", "/**")) and not s.startswith(("/**/", "////")):
            break
        if s.startswith(("//", "--", "<!--", ";;")) or (s.startswith("#") and not re.match(r"#\s*(?:include|define|if|pragma|import|undef|\[)", s)):
            out.append(_MARK.sub("", _MARK.sub("", line)).strip())
        elif s.startswith("/*"):
            out.append(_MARK.sub("", _MARK.sub("", line)).strip())
            if "*/" not in s[2:]:
                inside = "*/"
        else:
            break
    return [x for x in out if x]


def code_of(text: str) -> str:
    """The text without comments; strings stay."""
    text = _DOCSTRING.sub("", text)
    return _COMMENT_OR_STRING.sub(lambda m: "" if m.group(1) is not None else m.group(0), text)


def fingerprint(code: str) -> str | None:
    """Digest of the code without white space, None when too short to tell a copy."""
    bare = "".join(code.split())
    return xxhash.xxh3_128_hexdigest(bare.encode("utf-8", "replace")) if len(bare) >= COPY_CHARS else None


def file_evidence(path: str, text: str | None) -> tuple[list[float], str | None]:
    """(likelihood of each label, code fingerprint) of one file; all ones where nothing speaks.

    Vague evidence of a label counts once, however often it occurs, and not
    beside clear evidence of it.
    """
    like, vague = [1.0] * 5, set()
    name = path.rsplit("/", 1)[-1]
    if _GENERATED_NAME.search(name):
        like[G] *= STRONG
    if _MINIFIED_NAME.search(name):
        like[M] *= STRONG
    vague.update(k for k, rule in _VAGUE_NAME if rule.search(name))
    fp = None
    if text and text.strip():
        for line in leading_comment(text):
            if _ABOUT.match(line) and not line.lower().startswith("this file is auto"):
                continue
            if _GENERATED_NOTE.search(line):
                like[G] *= STRONG
            if _VENDORED_NOTE.search(line):
                like[V] *= STRONG
            vague.update(k for k, rule in _VAGUE if rule.search(line))
        code = code_of(text)
        fp = fingerprint(code)
        bare = "".join(code.split())
        if len(bare) >= FORM_CHARS:
            _form(code, bare, like, vague)
    for k in vague:
        if like[k] < STRONG:
            like[k] *= MILD
    return like, fp


def _form(code: str, bare: str, like: list[float], vague: set[int]) -> None:
    """What the form of the code tells: tables of literals, packed code, or code as people write it, here or elsewhere."""
    literal = 0
    rest = []
    at = 0
    for m in _COMMENT_OR_STRING.finditer(code):
        literal += m.end() - m.start()
        rest.append(code[at : m.start()])
        at = m.end()
    rest.append(code[at:])
    plain = " ".join(rest)
    literal += sum(len(m.group()) for m in _NUMBER.finditer(plain))
    plain = _NUMBER.sub(" ", plain)
    words = [w for w in _NAME.findall(plain) if w not in _KEYWORDS]
    letters = sum(map(len, words))
    share = literal / (literal + letters + 1)
    if share > 0.85 and literal > 0.5 * len(bare):
        like[B] *= STRONG
        return
    blank = 1 - len(bare) / max(1, len(code))
    short = sum(len(w) <= 2 for w in words) / max(1, len(words))
    longest = max(map(len, code.splitlines()))
    if blank < 0.10 and (short > 0.5 or longest > 400):
        like[M] *= STRONG
    elif share > 0.7 and literal > 0.4 * len(bare):
        vague.add(B)
    elif blank < 0.12 and (short > 0.35 or longest > 400):
        vague.add(M)
    elif blank > 0.12 and short < 0.5:
        like[H] *= SOME
        like[V] *= ELSEWHERE


# Beliefs and messages are arrays of five logarithms, in the order of LABELS.


def _rows(to_child: bool, fit: tuple) -> str:
    """A compatibility table as SQL, one row per label of the receiver."""
    told = [[fit[s][r] if to_child else fit[r][s] for s in range(5)] for r in range(5)]
    return "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in told) + ")"


def _message(beliefs: str, to_child: bool, folder: bool = False) -> Column:
    """Log message for each label of the receiver, from the sender's log beliefs; between folders, the child's `named` tells whether its own name speaks."""
    rows = _rows(to_child, FOLDER_FILE)
    if folder:
        rows = f"if(named, {rows}, {_rows(to_child, FOLDER_FOLDER)})"
    inner = " + ".join(f"r[{s}] * exp({beliefs}[{s}] - array_max({beliefs}))" for s in range(5))
    return F.expr(f"transform({rows}, r -> ln({inner}) + array_max({beliefs}))")


def _plus(a: str, b: str, factor: str = "1D") -> Column:
    return F.expr(f"zip_with({a}, coalesce({b}, array(0D, 0D, 0D, 0D, 0D)), (x, y) -> x + {factor} * y)")


def _sums(c: str) -> Column:
    return F.array(*[F.sum(F.col(c)[i]) for i in range(5)])


def _named(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).isin(*VENDOR_DIRS, *OUTPUT_DIRS)


def folder_evidence(path: Column) -> Column:
    """Log likelihood of each label from a folder's own name."""
    name = F.lower(F.substring_index(path, "/", -1))
    told = lambda names: F.when(name.isin(*names), F.lit(math.log(FOLDER))).otherwise(F.lit(0.0))
    return F.array(F.lit(0.0), told(OUTPUT_DIRS), F.lit(0.0), told(VENDOR_DIRS), F.lit(0.0))


_EVIDENCE = "path string, version timestamp_ntz, e array<double>, fp string"


def evidence_of(files: DataFrame, version: str | None) -> DataFrame:
    """One row per path with its log evidence and code fingerprint; the latest `version` counts.

    The text is read once, in a narrow pass, and only its evidence is shuffled.
    """
    ver = F.col(version).cast("timestamp_ntz") if version else F.lit(None).cast("timestamp_ntz")
    rows = files.select(plain_path(F.col("path")).alias("path"), ver.alias("version"), "content").filter("path <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [file_evidence(p, t) for p, t in zip(b.path, b.content)]
            out = pd.DataFrame({"path": b.path, "version": b.version})
            out["e"] = [[math.log(x) for x in e] for e, _ in got]
            out["fp"] = [f for _, f in got]
            yield out

    found = rows.mapInPandas(run, _EVIDENCE)
    return found.groupBy("path").agg(F.max(F.struct("version", "fp", "e")).alias("x")).select("path", "x.fp", "x.e")


def _up(base: DataFrame, deepest: int) -> DataFrame:
    """base with the beliefs of each folder from all that lies below it, level by level from the deepest."""
    levels = [base.filter(F.col("depth") == deepest)]
    for d in range(deepest - 1, -1, -1):
        sent = levels[-1].select(F.col("parent").alias("path"), _message("b", False, True).alias("m")).groupBy("path").agg(_sums("m").alias("m"))
        here = base.filter(F.col("depth") == d).join(sent, "path", "left").select("path", "parent", "depth", "named", "temper", _plus("b", "m", "temper").alias("b"))
        levels.append(durable(here) if (deepest - d) % LEVELS == 0 else here)
    return durable(reduce(DataFrame.unionByName, levels))


def _down(up: DataFrame, deepest: int) -> DataFrame:
    """(path, temper, b): full beliefs of the folders; each hears its parent without what it said itself."""
    prior = F.array(*[F.lit(math.log(p)) for p in PRIOR])
    full = up.filter("depth = 0").withColumn("prior", prior).select("path", "temper", _plus("b", "prior").alias("b"))
    levels = [full]
    for d in range(1, deepest + 1):
        said = up.filter(F.col("depth") == d).select("path", "parent", "named", F.col("temper").alias("own"), F.col("b").alias("o"), _message("b", False, True).alias("m"))
        met = said.join(full.withColumnRenamed("path", "parent"), "parent").withColumn("b", _plus("b", "m", "-temper"))
        full = met.select("path", F.col("own").alias("temper"), "o", _message("b", True, True).alias("m")).select("path", "temper", _plus("o", "m").alias("b"))
        full = durable(full) if d % LEVELS == 0 else full
        levels.append(full)
    return reduce(DataFrame.unionByName, levels)


def label_files(files: DataFrame, version: str | None = None) -> DataFrame:
    """(path, label, belief, copy_of_vendored) of every distinct path of files (path, content).

    Paths are told apart in plain spelling; null and blank paths are left out.
    A null or blank content leaves the name and the folders to tell. label is
    the likeliest one (ties: the first of LABELS); belief is its probability.
    copy_of_vendored: the file is labelled vendored for the code that it shares
    with a vendored one.
    """
    ev = durable(evidence_of(files, version).withColumn("parent", parent_dir(F.col("path"))).withColumn("m", _message("e", False)))
    told = ev.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("leaves"), _sums("m").alias("u"))
    # every folder above a file, each once; the top is ''
    segs = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda k: F.array_join(F.slice(segs, 1, k), "/"))
    dirs = told.select(F.explode(above).alias("path")).distinct()
    inner = dirs.filter("path <> ''").groupBy(parent_dir(F.col("path")).alias("path")).agg(F.count("*").alias("folders"))
    children = F.coalesce("leaves", F.lit(0)) + F.coalesce("folders", F.lit(0))
    base = dirs.join(told, "path", "left").join(inner, "path", "left").withColumn("temper", WITNESSES / F.greatest(F.lit(WITNESSES), children)).withColumn("own", folder_evidence(F.col("path")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(segs)).alias("depth")
    base = durable(base.select("path", F.when(F.col("path") != "", parent_dir(F.col("path"))).alias("parent"), depth, _named(F.col("path")).alias("named"), "temper", _plus("own", "u", "temper").alias("b")))
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return ev.select("path", F.lit("").alias("label"), F.lit(0.0).alias("belief"), F.lit(False).alias("copy_of_vendored")).filter("false")
    folders = _down(_up(base, deepest), deepest)
    # files: the folder's belief without the file's own message
    heard = ev.join(folders.withColumnRenamed("path", "parent"), "parent").withColumn("b", _plus("b", "m", "-temper"))
    final = heard.withColumn("m", _message("b", True)).select("path", "fp", _plus("e", "m").alias("b"))
    share = F.expr("transform(b, x -> exp(x - array_max(b)) / aggregate(b, 0D, (a, y) -> a + exp(y - array_max(b))))")
    judged = durable(final.select("path", "fp", share.alias("b")))
    # equal code: the chance that no file of it that counts as vendored hands the label on, from the sum over all without the own term
    label = lambda c: F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(F.col(c), F.array_max(c)).cast("int"))
    judged = judged.withColumn("own", label("b"))
    silent = F.when(F.col("own") == "vendored", F.log(1 - COPY * F.col("b")[V])).otherwise(F.lit(0.0))
    third = judged.filter("fp is not null").groupBy("fp").agg(F.sum(silent).alias("none")).filter("none < 0")
    new = judged.join(third, "fp", "left").withColumn("alone", F.coalesce(F.least(F.lit(1.0), F.exp(F.col("none") - silent)), F.lit(1.0)))
    new = new.withColumn("b", F.expr(f"transform(b, (x, i) -> x * alone + if(i = {V}, 1 - alone, 0D))"))
    return new.select("path", label("b").alias("label"), F.array_max("b").alias("belief"), ((label("b") == "vendored") & (F.col("own") != "vendored")).alias("copy_of_vendored"))
