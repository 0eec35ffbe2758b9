"""Classification of paths, symbols and edges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.functions.paths import extension, fold_path

# Directories that hold output, not source.
GENERATED_DIRS = ["node_modules", "target", "dist", "coverage", ".next", ".nuxt", ".svelte-kit", ".venv", "venv", "__pycache__"]

# Languages by file extension.
LANGUAGES = {
    "Rust": "rs",
    "Python": "py pyi",
    "JavaScript": "js jsx mjs cjs",
    "TypeScript": "ts tsx mts cts",
    "Vue": "vue",
    "Dart": "dart",
    "C": "c h",
    "C++": "cc cpp cxx hpp hh",
    "Go": "go",
    "Java": "java",
    "C#": "cs",
    "Ruby": "rb",
    "PHP": "php phtml",
    "Swift": "swift",
    "HTML": "html htm",
    "CSS": "css scss sass less",
}

# Layers by what a path holds, the first that fits.
LAYERS = [
    ("tests", ["/test", "/spec", "__tests__"]),
    ("ui", ["/ui/", "/components/", "/views/", "/frontend/"]),
    ("api", ["/api/", "/routes/", "/controllers/", "/handlers/"]),
    ("domain", ["/domain/", "/models/"]),
    ("data", ["/data/", "/storage/", "/repository/", "/db/"]),
    ("tooling", ["/scripts/", "/tools/", "/build/"]),
]

# Kinds of contract, kinds by capture prefix, weight of each type of edge.
CONTRACT_KINDS = ["Interface", "Trait", "Protocol", "Mixin", "Annotation"]
KIND_OF_PREFIX = {
    "func": "Function",
    "struct": "Struct",
    "enum": "Enum",
    "trait": "Trait",
    "impl": "Impl",
    "class": "Class",
    "interface": "Interface",
    "type": "Type",
    "alias": "TypeAlias",
    "union": "Union",
    "module": "Module",
    "namespace": "Namespace",
    "method": "Method",
    "constructor": "Constructor",
    "property": "Property",
    "field": "Field",
    "record": "Record",
    "annotation": "Annotation",
    "mixin": "Mixin",
    "extension": "Extension",
    "protocol": "Protocol",
    "variant": "EnumVariant",
    "constant": "Constant",
    "tag": "Tag",
    "css": "Symbol",
}
EDGE_PRIORITY = {"Inherits": 1.0, "Calls": 0.96, "Defines": 0.94, "Imports": 0.86, "References": 0.78, "Contains": 0.74}
PREFETCH_WEIGHT = {"Calls": 1.0, "Inherits": 0.9, "Defines": 0.8, "Imports": 0.7, "References": 0.6, "Contains": 0.5}


def _pick(c: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def extensions() -> list[str]:
    return [e for v in LANGUAGES.values() for e in v.split()]


def is_supported(path: Column) -> Column:
    return extension(path).isin(extensions())


def in_generated_dir(path: Column) -> Column:
    return F.exists(F.split(F.lower(path), "/"), lambda s: s.isin(GENERATED_DIRS))


def language_of(path: Column) -> Column:
    """Display language of a path by its extension, 'Other' for any other."""
    return _pick(extension(path), {e: name for name, exts in LANGUAGES.items() for e in exts.split()}, "Other")


def layer_of(path: Column) -> Column:
    p = fold_path(path)
    out = None
    for name, marks in LAYERS:
        hit = p.contains(marks[0])
        for m in marks[1:]:
            hit = hit | p.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("core")


def is_entrypoint(name: Column, path: Column) -> Column:
    return F.lower(name).isin("main", "app", "application", "server") | path.rlike(r"(main\.rs|main\.py|index\.ts|index\.js)$")


def is_contract(kind: Column) -> Column:
    return kind.isin(CONTRACT_KINDS)


def node_category(degree: Column, kind: Column, path: Column) -> Column:
    """god from degree 20 on, else ui or api by kind and path, else code."""
    k, p = F.lower(kind), F.lower(path)
    ui = k.contains("component") | k.contains("widget") | p.rlike(r"\.(vue|tsx|dart)$")
    api = p.contains("/api/") | p.contains("\\api\\") | k.contains("endpoint") | k.contains("handler")
    return F.when(degree >= 20, "god").when(ui, "ui").when(api, "api").otherwise("code")


def kind_of_prefix(c: Column) -> Column:
    return _pick(c, KIND_OF_PREFIX, "Symbol")


def edge_priority(kind: Column, tags: Column, trace_id: Column) -> Column:
    """Weight by type times evidence, at most 1.1."""
    traced = trace_id.isNotNull() | F.coalesce(F.array_contains(tags, "execution-trace"), F.lit(False))
    graph = F.coalesce(F.array_contains(tags, "stack-graphs"), F.lit(False))
    return F.least(_pick(kind, EDGE_PRIORITY, None) * F.when(traced, 1.12).when(graph, 1.08).otherwise(1.0), F.lit(1.1))


def edge_evidence(tags: Column, trace_id: Column) -> Column:
    graph = F.coalesce(F.array_contains(tags, "stack-graphs"), F.lit(False))
    return (
        F.when(trace_id.isNotNull(), F.concat(F.lit("execution_trace:"), trace_id))
        .when(graph, "stack_graph")
        .when(tags.isNull() | (F.size(tags) == 0), "ast_extracted")
        .otherwise(F.array_join(tags, ","))
    )


def prefetch_weight(kind: Column) -> Column:
    return _pick(kind, PREFETCH_WEIGHT, 0.5)


def risk_score(degree: Column, fan_in: Column) -> Column:
    return F.least(F.lit(100.0), 18 * F.log1p(degree) + 8 * F.sqrt(fan_in))


def degree_penalty(degree: Column) -> Column:
    return 1 / (1 + 0.14 * F.log1p(degree))
