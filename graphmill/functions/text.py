"""Text and identifier functions as column expressions; all stay in the JVM.

A null argument gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOPWORDS = ["a", "an", "and", "are", "code", "does", "for", "from", "in", "is", "me", "of", "show", "that", "the", "to", "where", "which", "with"]

# Verbs that name a relation.
RELATIONS = {
    "Calls": "call calls called calling invoke invokes request requests send sends dispatch dispatches forward forwards uses".split(),
    "Imports": "import imports include includes require requires depend depends dependency dependencies".split(),
    "Inherits": "inherit inherits extend extends implement implements".split(),
    "Contains": "contain contains inside within".split(),
    "Defines": "define defines declares".split(),
    "References": "reference references reads writes publishes subscribes emits consumes".split(),
}

# Groups of words and the words that each of them is expanded to.
SYNONYMS = [
    ("auth authentication authenticate authorization authorize", "auth authentication login identity session token oauth jwt"),
    ("api endpoint route", "api endpoint route handler http request client fetch"),
    ("database db repository", "database db repository storage sql query"),
    ("cache cached memoize", "cache cached memoize lru redis"),
    ("ui component view widget", "ui component view widget frontend"),
    ("service", "service manager provider client"),
    ("array list slice vec vector sequence", "array list slice vec vector sequence"),
    ("map hashmap dictionary dict table", "map hashmap dictionary dict table lookup"),
    ("queue deque channel", "queue deque channel buffer"),
    ("tree trie ast syntax", "tree trie ast syntax node"),
    ("graph dag adjacency edge node", "graph dag adjacency edge node topology"),
    ("lock mutex semaphore atomic synchronization", "lock mutex semaphore atomic synchronization"),
    ("error exception failure result", "error exception failure result retry"),
]

# Concepts and the words that stand for each.
CONCEPTS = {
    "auth": "auth authentication authenticate authorization authorize identity login oauth jwt",
    "api": "api endpoint route handler http",
    "database": "database db repository storage sql",
    "cache": "cache cached memoize lru redis",
    "ui": "ui component view widget frontend",
    "service": "service manager provider",
    "sequence": "array list slice vec vector",
    "map": "map hashmap dictionary dict table",
    "queue": "queue deque channel",
    "tree": "tree trie ast syntax",
    "graph": "graph dag adjacency edge node",
    "sync": "lock mutex semaphore atomic synchronization",
    "error": "error exception failure result",
}

# Names too general to tell anything.
GENERIC_NAMES = ["main", "run", "get", "set", "new", "init", "data", "item", "value", "handler"]

#: Fixed value: the characters with the Unicode property White_Space, for use inside a bracket expression.
WHITE_SPACE = "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Longest query that is analysed, in characters, most useful and most expanded terms.
QUERY_CHARS, USEFUL_TERMS, EXPANDED_TERMS = 2_048, 24, 32


def _long(c: Column) -> Column:
    return c.cast("long")


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def map_literal(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def relation_map() -> dict[str, str]:
    return {verb: kind for kind, verbs in RELATIONS.items() for verb in verbs}


def synonym_map() -> dict[str, list[str]]:
    return {w: to.split() for words, to in SYNONYMS for w in words.split()}


def concept_map() -> dict[str, str]:
    return {w: concept for concept, words in CONCEPTS.items() for w in words.split()}


def count_tokens(c: Column) -> Column:
    """13 * words / 10 rounded up, words being parted by Unicode white space; 0 for blank text."""
    return _long(F.floor((F.regexp_count(c, F.lit(f"[^{WHITE_SPACE}]+")) * 13 + 9) / 10))


def code_tokens(c: Column) -> Column:
    """Identifier words: split where a capital follows a small letter or digit, lower case, at least two bytes each."""
    spaced = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]", " "), " +")
    return F.filter(words, lambda t: F.octet_length(t) > 1)


def is_stopword(c: Column) -> Column:
    return c.isin(STOPWORDS)


def relation_for(c: Column) -> Column:
    """Relation that a verb names, null for other words."""
    return F.try_element_at(map_literal(relation_map()), c)


def useful_terms(tokens: Column) -> Column:
    """Distinct terms in order without stopwords and relation verbs, at most USEFUL_TERMS."""
    drop = _array(STOPWORDS + list(relation_map()))
    return F.slice(F.array_sort(F.array_distinct(F.array_except(tokens, drop))), 1, USEFUL_TERMS)


def expand_terms(terms: Column, limit: int | None = None) -> Column:
    """The terms with their synonyms, distinct and in order."""
    table = F.create_map(*[x for w, to in synonym_map().items() for x in (F.lit(w), _array(to))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    out = F.array_sort(F.array_distinct(F.concat(terms, more)))
    return F.slice(out, 1, limit) if limit else out


def canonical_terms(terms: Column) -> Column:
    table = map_literal(concept_map())
    return F.array_sort(F.array_distinct(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), t))))


def escape_term(c: Column) -> Column:
    """Letters, digits and underscores only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")


def analyze_query(c: Column) -> Column:
    """Struct of a query's parts: terms, expanded, relation, subject, object, canonical, lexical_query.

    The first relation verb parts the subject's terms from the object's; without
    one both are empty. canonical is ``relation|subject|object|terms`` with
    ``any`` for no relation.
    """
    tokens = code_tokens(F.substring(F.trim(c), 1, QUERY_CHARS))
    rel = F.transform(tokens, relation_for)
    at = F.coalesce(F.array_position(F.transform(rel, lambda r: r.isNotNull()), F.lit(True)), F.lit(0))
    none = F.array().cast("array<string>")
    relation = F.when(at > 0, F.try_element_at(rel, at.cast("int")))
    subject = F.when(at > 0, useful_terms(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))).otherwise(none)
    obj = F.when(at > 0, useful_terms(F.slice(tokens, (at + 1).cast("int"), F.size(tokens)))).otherwise(none)
    terms = useful_terms(tokens)
    expanded = expand_terms(terms, EXPANDED_TERMS)
    canonical = F.concat_ws(
        "|",
        F.coalesce(F.lower(relation), F.lit("any")),
        F.array_join(canonical_terms(subject), "+"),
        F.array_join(canonical_terms(obj), "+"),
        F.array_join(expanded, "+"),
    )
    lexical = F.array_join(F.transform(expanded, escape_term), " ")
    return F.struct(
        terms.alias("terms"), expanded.alias("expanded"), relation.alias("relation"), subject.alias("subject"), obj.alias("object"), canonical.alias("canonical"), lexical.alias("lexical_query")
    )


def text_match_score(terms: Column, haystack: Column) -> Column:
    """Share of the terms among the haystack's code tokens; 0.35 for no terms."""
    hit = F.size(F.filter(terms, lambda t: F.array_contains(code_tokens(haystack), t)))
    return F.when(F.size(terms) == 0, F.lit(0.35)).otherwise(hit / F.size(terms))


def word_set(c: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection by that of the union of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(c: Column) -> Column:
    """Lower-case three-letter windows in order, none for shorter text."""
    low = F.lower(c)
    n = F.length(low) - 2
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(n >= 1, grams).otherwise(F.array().cast("array<string>"))


def leaf_name(c: Column) -> Column:
    """What follows the last dot, else the last double colon."""
    return F.when(c.contains("."), F.substring_index(c, ".", -1)).otherwise(F.substring_index(c, "::", -1))


def path_leaf(c: Column) -> Column:
    """The last non-empty part between any of . : / and backslash; the text itself without one."""
    part = F.regexp_extract(c, r"([^.:/\\]+)[.:/\\]*$", 1)
    return F.when(part == "", c).otherwise(part)


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def line_count(c: Column) -> Column:
    """Number of lines; a trailing line break ends the last line, blank text has none."""
    n = F.size(F.split(c, "\n", -1))
    return _long(F.when(c == "", 0).when(c.endswith("\n"), n - 1).otherwise(n))


def body_slice(c: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, end clamped) joined again, '' for a start out of range."""
    lines = lines_of(c)
    n = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))
    return F.when((start < 1) | (start > F.size(lines)), "").otherwise(F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), n), "\n"))


def line_col(c: Column, offset: Column) -> Column:
    """Struct (line, col), both from 1, of a 0-based character offset; the offset is clamped to the text."""
    head = F.substring(c, F.lit(1), F.least(F.greatest(offset, F.lit(0)), F.length(c)))
    line = _long(F.size(F.split(head, "\n", -1)))
    col = _long(F.length(F.substring_index(head, "\n", -1)) + 1)
    return F.struct(line.alias("line"), col.alias("col"))


def is_boundary(line: Column) -> Column:
    """Whether a source line is a good place to cut after."""
    s = F.regexp_replace(line, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")
    return (s == "") | s.rlike(r"[};]$|^(match |if |for |while |try:|except )")


def bounded_text(c: Column, chars: int = 512) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)


def is_well_named(name: Column) -> Column:
    """A telling name: at least eight characters, none of GENERIC_NAMES, several words."""
    return (F.octet_length(name) >= 8) & ~F.lower(name).isin(GENERIC_NAMES) & name.rlike(r"_|\p{Ll}\p{Lu}")


def elided_signature(kind: Column, signature: Column) -> Column:
    """Signature without its opening brace and with an ellipsis for kinds that have a body."""
    bare = F.trim(F.regexp_replace(signature, r"\{+$", ""))
    return F.when(kind.isin("Function", "Method", "Impl", "Class", "Struct", "Enum", "Interface"), F.concat(bare, F.lit(" { ... }"))).otherwise(signature)


def retrieval_text(signature: Column, docstring: Column, body: Column) -> Column:
    """Signature, documentation if any, and body, one per line."""
    return F.concat_ws("\n", signature, F.nullif(docstring, F.lit("")), body)


def event_type(c: Column) -> Column:
    """Letters, digits and underscores, at most 48; 'unknown' when nothing is left."""
    kept = F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_]", ""), 1, 48)
    return F.when(kept == "", "unknown").otherwise(kept)


def full_regex(c: Column, pattern: str) -> Column:
    """Whether the whole lower-case text matches the lower-case pattern."""
    return F.lower(c).rlike(f"^(?:{pattern.lower()})$")


def url_quote(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits, - _ . ~ and / as they are."""
    enc = F.url_encode(c)
    for a, b in (("\\+", "%20"), ("%2F", "/"), ("%7E", "~"), ("\\*", "%2A")):
        enc = F.regexp_replace(enc, a, b)
    return enc
