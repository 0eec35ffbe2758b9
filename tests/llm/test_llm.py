"""Training-data operators against brute force, round trips and defined edge cases."""

import base64
import os
import random
import re
from collections import defaultdict

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import compare
from graphmill.llm import docpairs, handwritten, leakage, packing, queries, residue, splitting, tokenizer

# --- 1 ---


def _best_fit(sizes, cap):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(cap - s)
    return len(rooms)


def test_pack_is_as_tight_as_best_fit():
    rnd = random.Random(5)
    for _ in range(40):
        cap = rnd.choice([50, 100, 777])
        sizes = sorted((rnd.randint(1, cap) for _ in range(rnd.randint(1, 120))), reverse=True)
        texts = [rnd.choice(["read log file", "readLogStore", "", None, "token_map"]) for _ in sizes]
        boxes = packing.pack(sizes, texts, cap)
        fill = defaultdict(int)
        for s, b in zip(sizes, boxes):
            fill[b] += s
        assert max(fill.values()) <= cap and len(fill) <= _best_fit(sizes, cap) * 1.08 + 1
    assert packing.pack([], [], 5) == []


def test_fill_containers_keeps_all_tokens(spark):
    rnd = random.Random(2)
    rows = [("hot", f"i{k}", rnd.randint(1, 90), 0.5, 100, f"name{k % 7}") for k in range(700)]
    rows += [("s", "big", 250, float("nan"), 100, None), ("s", "even", 200, None, 100, ""), ("s", "none", None, -1.0, 100, "x"), ("s", "neg", -5, 1.0, 100, "x"), ("s", "zero", 0, 1.0, 100, "x")]
    rows += [(None, "a", 5, 0.1, 100, "x"), ("n", None, 5, 0.1, 100, "x"), ("c", "a", 5, 0.1, 0, "x")]
    df = spark.createDataFrame(rows, "grp string, item string, tokens long, score double, capacity long, txt string").withColumn("container", F.lit("clash"))
    out = packing.fill_containers(df, shard_items=100).collect()
    fill, placed, parts = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in out:
        fill[r.grp, r.container] += r.tokens
        placed[r.grp, r.item] += r.tokens
        parts[r.grp, r.item] += 1
    assert max(fill.values()) <= 100
    assert placed == {(g, i): max(t or 0, 0) for g, i, t, *_ in rows if g and i and g != "c"}
    assert all(n == 1 for (g, i), n in parts.items() if i not in ("big", "even")) and parts["s", "big"] == 3 and parts["s", "even"] == 2
    hot = [v for (g, _), v in fill.items() if g == "hot"]
    assert sum(hot) / (100 * len(hot)) > 0.93
    assert packing.fill_containers(df.limit(0)).count() == 0


def test_large_groups_are_packed_like_small_ones(spark):
    """A group of many shards: nothing is lost, and it takes few more containers than space; also where sizes just exceed half of it."""
    rnd = random.Random(3)
    rows = [("wide", f"i{k}", rnd.randint(1, 60), 0.5, 100, f"name{k % 50} part{k % 7}") for k in range(10_000)] + [("halves", f"h{k}", rnd.randint(51, 70), 0.5, 100, "same name") for k in range(2_000)]
    df = spark.createDataFrame(rows, "grp string, item string, tokens long, score double, capacity long, txt string")
    fill, items = defaultdict(int), defaultdict(int)
    for r in packing.fill_containers(df, shard_items=500).collect():
        fill[r.grp, r.container] += r.tokens
        items[r.grp] += 1
    assert items == {"wide": 10_000, "halves": 2_000} and max(fill.values()) <= 100
    least = sum(r[2] for r in rows if r[0] == "wide") / 100
    assert sum(g == "wide" for g, _ in fill) <= 1.02 * least + 1 and sum(g == "halves" for g, _ in fill) == 2_000


def test_common_terms_retrieve(spark):
    """Terms of all items still lead to neighbours."""
    index = packing.Index(["mod read", "mod write", "mod", None])
    found, score = index.neighbours(2, __import__("numpy").array([True] * 4), 5)
    assert found.tolist() == [0, 1] and (score > 0).all()


def test_chunks_are_packed_by_their_text(spark, tmp_path):
    topics = {"a": "alpha beta gamma", "b": "delta epsilon zeta"}
    rows = []
    for t, words in topics.items():
        for k in range(4):
            rows.append((f"r/src/f{t}{'pqrs'[k]}.rs#{t}{'wxyz'[k]}:L{k + 1}C1", " ".join([words] * 525)))  # 1,575 words are 2,048 tokens, half a container
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    boxes = defaultdict(set)
    for r in queries.p1_pack_chunks(spark, str(tmp_path)).collect():
        boxes[r.container].add(r.chunk_id.split("#")[1][0])
    assert len(boxes) == 4 and all(len(b) == 1 for b in boxes.values())


# --- 2 ---

TRIVIAL = [
    "", "  \n", "/** */", "///", "read_log", "Reads the log.", "TODO", "TODO: document this", "fixme write docs", "tbd", "N/A", "${doc}", "{{description}}", "<summary></summary>",
    "_summary_", "[summary]", "noqa: E501", "eslint-disable-next-line no-undef", "@param x\n@returns", ":param a:\n:return:", "Args:\n x:\nReturns:", "{@inheritDoc}", "x = f(y)\nprint(x)",
    "if (a != null) { b(a); }", "Copyright 2019 Someone.\nAll rights reserved.", "SPDX-License-Identifier: MIT", "Licensed under the terms in LICENSE.", "This method was generated automatically.",
    "Auto-generated method stub", "à documenter", "Dokumentation fehlt", "=====", "...",
]
TELLING = [
    "Not thread-safe.", "O(n) in worst case.", "TODO lists of the budget are read here and sorted by key; see the map for how they end.", "Generated ids stay stable across runs.",
    "Puts the licence line on top of each page that has none.", "Deprecated: use the other reader instead.", "/**\n * Must run before the gate opens.\n * @return see above\n */", "Liefert den Plan oder nichts.",
    "Reads the log and\nskips blank lines.", "# Caller owns the memory.",
]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial_docs(doc):
    assert docpairs.describe(doc, "read_log") is None


@pytest.mark.parametrize("doc", TELLING)
def test_telling_docs(doc):
    assert docpairs.describe(doc, "read_log")


PY = '''import x

class A:
    @cached
    def f(self,
          a="):"):
        """Says {something}.
        """
        if a:
            return "def g(): pass"

        def inner():
            return 1
    def g(self): return 2

x = """
def water():
    pass
"""
def h():
    pass'''
RS = '''use a;
/// Opens it.
/// Twice.
#[inline]
pub(crate) fn open(x: &str) -> Result<A> {
    let s = "}"; // }
    if x { y() }
}
fn decl(x: i32);
struct S { a: A }
impl S {
    fn m(&self) -> A { A {} }
}
'''


def test_islands():
    got = [(f["name"], f["line"], f["end_line"]) for f in docpairs.islands(PY, "a/b.py")]
    assert got == [("f", 5, 13), ("inner", 12, 13), ("g", 14, 14), ("h", 20, 21)]
    f = docpairs.islands(PY, "b.py")[0]
    assert "Says {something}." in f["doc"] and f["annotations"].strip() == "@cached"
    got = docpairs.islands(RS, "a.rs")
    assert [(f["name"], f["line"], f["end_line"]) for f in got] == [("open", 5, 8), ("m", 12, 12)]
    assert got[0]["doc"] == "/// Opens it.\n/// Twice." and got[0]["annotations"] == "#[inline]"
    assert docpairs.islands(None, "a.py") == [] == docpairs.islands("", "a.rs")


@pytest.mark.parametrize(
    ("grammar", "yes", "no"),
    [
        ("py", ["def f():", "async def f(x) -> int:"], ["class A(B):", "X = f(1)"]),
        ("rs", ["pub(crate) fn a(b: C) -> D {", "pub async unsafe fn a<T>(b: T)"], ["pub struct A {", "impl A {", "use a::b(c);"]),
        ("java", ["public static <T> List<T> a(B b) throws C {", "protected Scope resolve() {", "Foo(int a) {"], ["public class A(B) {", "private int a = f(1);", "interface A {"]),
        ("go", ["func (r *T) Name(a int) error {", "func name() {"], ["type X struct {", "var a = f(1)"]),
        ("js", ["export default async function f(a) {", "get size() {", "const f = (a) => {", "constructor(a, b) {"], ["const a = require(\"./a\");", "class A extends B {", "if (a) {"]),
        ("ts", ["private load(a: B): C {", "export const f = async (a: B): Promise<C> => {"], ["let a: B = f(1);", "interface A {"]),
        ("c", ["static int f(struct X *a) {", "void g(void)"], ["struct A {", "typedef int (*f)(int);", "return f(a);"]),
        ("", ["def f():", "fn a() {"], ["class A {", None, " "]),
    ],
)
def test_signatures_by_grammar(grammar, yes, no):
    assert [s for s in yes if not docpairs.declares(s, grammar)] == [] and [s for s in no if docpairs.declares(s, grammar)] == []


def test_grammar_decides(sf, monkeypatch):
    """Without its grammars the operator finds less: they tell the functions among symbols of unknown kind."""
    con = compare.connect(sf.replace("sf0.001", "sf0.01"))
    rel = con.execute("select * from symbols where nullif(trim(kind), '') is null and deleted_at is null and trim(docstring) <> ''")
    names = [d[0] for d in rel.description]
    rows = [dict(zip(names, r)) | {"line": None} for r in rel.fetchall()]
    found = lambda: {s["id"] for s in rows if docpairs._pair(s, s["file_path"], [], {})}
    whole = found()
    monkeypatch.setattr(docpairs, "declares", lambda *_: False)
    assert whole and not found()


def test_documentation_by_grammar():
    rs = docpairs.islands("// plain\nfn a() {}\n\n/// Told.\n#[inline]\nfn b() {}\n", "x.rs")
    assert [(f["name"], f["doc"], f["annotations"]) for f in rs] == [("a", None, ""), ("b", "/// Told.", "#[inline]")]
    go = docpairs.islands("// Told.\n//go:noinline\nfunc a(\n\tb int,\n) error {\n\ts := `}`\n}\n", "x.go")
    assert [(f["name"], f["doc"], f["end_line"]) for f in go] == [("a", "// Told.", 7)]
    assert docpairs.islands("int a() {}", "x.unknown") == [] and docpairs.islands("int a() {}", "x", "C")[0]["name"] == "a"


def test_pairs_keep_symbols_without_code(spark):
    cols = "id string, name string, kind string, signature string, file_path string, start_line long, end_line long, docstring string, language string, deleted_at timestamp_ntz"
    syms = spark.createDataFrame(
        [("1", "h", "Function", None, "p.py", 20, 21, "Does it well.", None, None), ("2", "g", None, "def g():", "gone.py", 1, 2, "Goes on.", "python", None), ("3", "g", "Method", "", None, None, None, "Goes on.", None, None), ("4", "g", "Method", "", "p.py", 14, 14, None, None, None)],
        cols,
    )
    files = spark.createDataFrame([("p.py", PY), (None, "x"), ("q.py", None)], "path string, content string")
    got = {r.id: r for r in docpairs.doc_pairs(syms, files).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].code == "def h():\n    pass" and got["1"].balanced and got["2"].code is None


# --- 5 ---


def test_file_evidence():
    def label(path, text):
        like, _ = handwritten.file_evidence(path, text)
        return [n for n, v in zip(handwritten.LABELS, like) if v > 100]

    assert label("a/x_pb2.py", None) == ["generated"] and label("a/x.min.js", "") == ["minified"]
    assert label("a/codegen.py", "import x\n") == [] and label("a/vendor_invoice.js", None) == []
    assert label("a/x.go", "// Licensed under X.\n// Code produced by t v2. DO NOT EDIT.\npackage a\n") == ["generated"]
    assert label("a/x.go", "// Reads files marked DO NOT EDIT and reports who changed them anyway.\npackage a\n") == []
    assert label("a/x.py", "# Vendored from abc 1.2.3, see UPSTREAM\nimport a\n") == ["vendored"]
    assert label("a/x.py", "# This replaces the vendored abc; the copy under third_party is gone.\nimport a\n") == []
    assert label("a/x.py", "TABLE = [\n" + "  0.123, 4.567, -8.9, 0x1f,\n" * 40 + "]\n") == ["blob"]
    assert label("a/x.js", "!function(e,r){" + "for(;e<r;)e++;var a=r.b(1);a&&e(r);" * 20 + "}(this);") == ["minified"]


def test_note_after_a_long_leading_comment():
    licence = "".join(f"// Line {k} of the licence.\n" for k in range(70))
    like, _ = handwritten.file_evidence("a/x.go", licence + "// Code generated by t v2. DO NOT EDIT.\npackage a\n")
    assert [n for n, v in zip(handwritten.LABELS, like) if v > 100] == ["generated"]
    assert "Line 69 of the licence." in handwritten.leading_comment(licence + "package a\n// no more\n") and "no more" not in handwritten.leading_comment(licence + "package a\n// no more\n")


def test_folders_and_copies(spark):
    code = "import q\ndef work(alpha, beta):\n    gamma = alpha.find(beta)\n    return gamma.close(alpha)\n" * 3
    rows = [
        ("r/src/a.py", code.replace("work", "own")), ("r/src/b.py", None), ("r/src/copy.py", "# other remark\n" + code), ("r/node_modules/k/lib/c.py", code), ("r/node_modules/k/lib/e.py", None),
        ("r/gen/deep/f.py", code.replace("work", "made")), ("r/src/vendor_portal/g.py", code.replace("work", "portal")), ("./r/src/a.py", code.replace("work", "own")), (None, code), ("  ", code),
    ]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("label", F.lit("clash"))
    got = {r.path: r.label for r in handwritten.label_files(df).collect()}
    assert got == {"r/src/a.py": "handwritten", "r/src/b.py": "handwritten", "r/src/copy.py": "vendored", "r/node_modules/k/lib/c.py": "vendored", "r/node_modules/k/lib/e.py": "vendored", "r/gen/deep/f.py": "generated", "r/src/vendor_portal/g.py": "handwritten"}
    assert handwritten.label_files(df.limit(0)).count() == 0


def test_propagation_decides_what_files_alone_do_not(spark):
    """Vague remarks and plain files follow nearly unanimous siblings, parents and copies; the same files elsewhere stay hand-written."""
    plain = "import q\n\n\ndef work_{0}(alpha, beta):\n    gamma = alpha.find_{0}(beta)\n    return gamma.close(alpha, {0})\n\n\nclass Keeper{0}:\n    def visit(self, node):\n        return self.store.get(node)\n\n    def close(self):\n        self.store.flush(self.pending)\n        self.pending = None\n"
    clear, vague = "# Code generated by tool v2. DO NOT EDIT.\n", "# The generated parts of the interface.\n"
    rows = [(f"r/api/f{k}.py", clear + plain.format(k)) for k in range(12)] + [("r/api/vague.py", vague + plain.format(50)), ("r/api/bare.py", None), ("r/api/plain.py", plain.format(51))]
    rows += [(f"r/src/f{k}.py", plain.format(100 + k)) for k in range(12)] + [("r/src/vague.py", vague + plain.format(52)), ("r/src/bare.py", None), ("r/src/clear.py", clear + plain.format(53))]
    rows += [(f"r/lib/f{k}.py", plain.format(300 + k)) for k in range(12)] + [(f"r/net/f{k}.py", plain.format(400 + k)) for k in range(12)]
    rows += [(f"r/vendor/x/f{k}.py", plain.format(200 + k)) for k in range(40)] + [("r/src/copy.py", plain.format(207)), ("r/src/twice.py", plain.format(100))]
    got = {r.path: r for r in handwritten.label_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    own = {p: handwritten.LABELS[max(range(5), key=lambda i: (like[i] * handwritten.FOLDER_FILE[0][i], -i))] for p, t in rows for like in [handwritten.file_evidence(p, t)[0]]}
    true = {p: "generated" if "/api/" in p or p == "r/src/clear.py" else "vendored" if "/vendor/" in p or p == "r/src/copy.py" else "handwritten" for p, _ in rows}
    assert {p: r.label for p, r in got.items()} == true
    assert sum(own[p] != true[p] for p in true) == 44 and all(own[p] == "handwritten" for p in true if own[p] != true[p])
    assert [p for p, r in got.items() if r.copy_of_vendored] == ["r/src/copy.py"] and all(0.5 < r.belief <= 1 for r in got.values())


# --- 6 ---


def _walk(text, most, over):
    """(start, end, words) of the greedy pieces, cut by cut."""
    table = {x[0]: x[1:] for x in splitting.successors(text, most, over)}
    at, out = 0 if table else -1, []
    while at >= 0:
        at, *piece = table[at]
        out.append(tuple(piece))
    return out


def test_joined_successors_equal_the_walk(spark):
    rnd = random.Random(8)
    glue = [" ", " ", " ", "\n", "\n\n", ". ", "; ", "\u3000"]
    rows = [(f"c{k}", "p", "".join(rnd.choice(["ab", "c", "word", "né"]) + rnd.choice(glue) for _ in range(rnd.choice([0, 1, 30, 700]))), rnd.choice([1, 7, 20, 100]), rnd.choice([0, 2, 30])) for k in range(40)]
    rows += [("long", "p", "x " * 9000, 13, 0), ("c1", None, "same id other text " * 40, 20, 5), ("empty", "p", "", 5, 0), ("blank", "p", " \n ", 5, 0)]
    big = spark.createDataFrame(rows, "id string, parent_symbol_id string, text string, max_tokens long, overlap_tokens long")
    got = sorted(((r.id, r.parent_symbol_id, r.piece_index, r.text, r.token_count, r.start_char) for r in splitting.pieces(big).collect()), key=str)
    want = [(i, p, k, t[s:e], (n * 13 + 9) // 10, s) for i, p, t, most, over in rows for k, (s, e, n) in enumerate(_walk(t, most, over))]
    assert got == sorted(want, key=str) and sum(r[0] == "long" for r in got) == 900
    assert splitting.pieces(big.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c.", " ", "\n", "\n\n", "x;", "\u3000", "\u00a0", "}", "word "]), max_size=120), st.integers(1, 40), st.integers(0, 50))
def test_cut_properties(parts, most, over):
    text = "".join(parts)
    spans = [m.span() for m in re.finditer(f"[^{splitting.WHITE_SPACE}]+", text)]
    pieces = _walk(text, most, over)
    room, back = max(1, most * 10 // 13), over * 10 // 13
    seen, before = set(), None
    for s, e, n in pieces:
        inside = [k for k, (a, b) in enumerate(spans) if a >= s and b <= e]
        assert len(inside) == n <= room
        if before is not None:
            assert len(before & set(inside)) <= back and inside[0] <= max(before) + 1 and max(inside) > max(before)
        before = set(inside)
        seen |= before
    assert seen == set(range(len(spans)))


def test_tokens_count_unicode_blanks(spark):
    rows = [("a b\u00a0c\u3000d", 6), ("", 0), ("  ", 0), (None, None), ("one", 2), ("a\u2028b", 3), ("a\u001fb", 2)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", splitting.count_tokens(F.col("t")))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


# --- 8 ---


def test_bpe_equals_public_encoder(spark, sf):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = tokenizer.Bpe(open(tokenizer.VOCABULARY, "rb").read())
    rnd = random.Random(3)
    texts = ["", "a", "<|endoftext|>", "naïve — 索引 👩‍👧", "x" * 5000, "\n\n  \t", "".join(rnd.choice("abcdé ") for _ in range(3000))]
    for t in texts:
        ids = bpe.encode(t)
        assert ids == want.encode_ordinary(t) and bpe.decode(ids) == t
    assert bpe.encode(None) == []
    for r in queries.p8_ids(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        assert r.ids == want.encode_ordinary(r.text or "")


# --- 9 ---


def test_leak_words():
    w = leakage.words
    assert w("It can&#39;t &lt;b&gt; Stra\u00dfe\u200bn") == ["it", "can", "t", "b", "strassen"]
    assert w("re-\n// ached foo_bar") == ["reached", "foo", "bar"] and w("re\u00ad\n  ached") == ["reached"]
    assert w("\uff34\uff45st \ufb01n") == ["test", "fin"] and w(None) == [] == w("")
    assert w('{"p": "a.\\nThe"}') == ["p", "a", "the"]


def test_leaks_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("item_id", F.lit(0))
    items = spark.read.parquet(f"{sf}/eval_items.parquet")
    win = defaultdict(set)
    for r in items.collect():
        w = leakage.words(r.text)
        for k in range(len(w) - 11):
            win[tuple(w[k : k + 12])].add(r.item_id)
    want = set()
    for r in docs.collect():
        w = leakage.words(r.text)
        want |= {(r.doc_id, i) for k in range(len(w) - 11) for i in win.get(tuple(w[k : k + 12]), ())}
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert leakage.leaks(docs, items.limit(0)).count() == 0


def test_leak_across_blocks(spark):
    long = " ".join(f"w{i}" for i in range(1000))
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(240, 275))), (2, "too short"), (3, long), (None, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, None), (3, "w249 w250 w251 w252 w253 w254 w255 w256 w257 w258 w259 x w260")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.passages, r.first_word) for r in leakage.leaks(docs, items).collect()}
    assert got == {(1, 1): (24, 240), (1, 3): (989, 0)}


def test_near_leaks_hold_the_exact_ones(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    swapped = item.replace("w3 w4", "w4 w3").replace("w15 w16", "w16 w15")
    docs = spark.createDataFrame([(1, item), (2, swapped), (3, " ".join(f"w{i}" for i in range(0, 20, 2)) + " w0 w2"), (4, None)], "doc_id long, text string")
    assert {r.doc_id for r in leakage.leaks(docs, items).collect()} == {1}
    near = {r.doc_id: r.share for r in leakage.near_leaks(docs, items).collect()}
    assert near[1] == 1.0 and near[2] == 1.0 and 3 not in near
    assert leakage.near_leaks(docs, items.limit(0)).count() == 0


def test_near_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    names = [f"w{i}" for i in range(60)]
    held = {i: [rnd.choice(names) for _ in range(rnd.randint(12, 30))] for i in range(12)} | {90: ["la"] * 12, 91: ["la", "li"] * 6}
    texts = {0: " ".join(f"u{i}" for i in range(30)), 1: None, 2: "la", 3: "li x la"}
    for n in range(10, 90):
        w = list(held[rnd.randrange(12)])
        for _ in range(rnd.randint(0, 5)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = [rnd.choice(["foreign", "strange", *names])]
        if n % 4 == 0:
            rnd.shuffle(w)
        head = [rnd.choice(["x", "y", *names[:20]]) for _ in range(rnd.choice([0, 3, 245, 255, 500]))]
        texts[n] = " ".join([*head, *w, *head[:5]])
    want = {}
    for n, t in texts.items():
        w = leakage.words(t)
        spans = [set(w[s : s + 20]) for s in range(max(1, len(w) - 19))]
        for i, h in held.items():
            parts = [len(d & s) / len(d) for d in (set(h[k : k + 12]) for k in range(len(h) - 11)) for s in spans]
            if max(parts) >= 0.8:
                want[n, i] = max(parts)
    items = spark.createDataFrame([(i, " ".join(h)) for i, h in held.items()], "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [((r.doc_id, r.item_id), r.share) for r in leakage.near_leaks(docs, items).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want and len(want) > 50


def test_near_leaks_with_foreign_words(spark):
    item = [f"w{i}" for i in range(12)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = [(k, " ".join([*item[:k], "foreign", *item[k + 1 :]])) for k in range(12)] + [(20 + k, " ".join([*item[:k], "foreign", *item[k:]])) for k in range(12)]
    docs += [(50, " ".join([*item[:4], "a", "b", "c", *item[7:]]))]
    near = {r.doc_id: r.share for r in leakage.near_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert near == {k: 11 / 12 for k in range(12)} | {20 + k: 1.0 for k in range(12)}


def test_held_out_items_in_blocks(spark, sf, monkeypatch):
    """More windows than one broadcast takes: the same rows, block by block, also for one item of several blocks."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet").filter("item_id % 6 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    exact, near = rows(leakage.leaks(docs, items)), rows(leakage.near_leaks(docs, items))
    blocks = sum(1 for _ in leakage._windows(items, 12))
    monkeypatch.setattr(leakage, "MAX_WINDOWS", 700)
    assert sum(1 for _ in leakage._windows(items, 12)) > 2 > blocks
    assert rows(leakage.leaks(docs, items)) == exact and rows(leakage.near_leaks(docs, items)) == near and near


# --- 10 ---

RESIDUE = [
    "You need to enable JavaScript to run this app.", "this site won't load unless you allow scripts. [Help]", "503 Service Unavailable\n\nRequest ID: 4ed9d117800e4bd4", '{"message": "Not Found", "status": 404, "request_id": "42d304aa68503935"}',
    "Heading 1\nYour text goes here", "## {{version}}\n\n- It works.", "Setting it to @@COUNT@@ helps the queue.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed.", "bla bla bla bla bla bla bla", "Good text here.\n\nbranch temporarily unavailable, check back soon\n\nMore good text.",
    "HTTP/1.1 410 Gone\r\nServer: x/1.2\r\nContent-Length: 0", "Veuillez activer JavaScript pour afficher cette page.",
]
CLEAN = [
    None, "", " \n ", 'Tests feed it with "lorem ipsum dolor" so that it has no content.', "The web view works without JavaScript; only the gate needs it, and we say so in a note.", "The renderer replaces `{{ key }}` with the value.",
    "A name in double braces such as {{page}} is looked up in the index, then printed.", "```html\n<h1>{{ x }}</h1>\n```\n\nDone here.", "| status | meaning |\n| 404 | the page is gone |", "When the key is missing, the handler answers 404 and the client retries 3 times.",
    'We drop pages that say "enable JavaScript" or "access denied" before they reach the index.', "  trace(`node ${shard}`);\n", "Log of the smoke test: `GET /x` gave 503 twice, then 200.", "Before 404 the counter wraps, and the plan turns raw.",
]


def test_residue_and_what_only_shows_it(spark):
    rows = [(i, t) for i, t in enumerate(RESIDUE + CLEAN)] + [(None, RESIDUE[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    assert sorted(r.doc_id for r in residue.residue(docs).collect()) == list(range(len(RESIDUE)))
    assert residue.residue(docs.limit(0)).count() == 0


OWN_RESIDUE = [
    "405 Method Not Allowed", "418 I'm a teapot", "Este sitio requiere JavaScript para funcionar.", "Please allow scripts in your browser settings to view the reader.", "Our servers are overloaded right now. Come back in an hour.",
    "Dear [Name], thank you for your interest in [Company].", "This content can't be displayed because JavaScript is off.", "Access to this resource is restricted. Log in to proceed.", "We are performing scheduled maintenance, please try again in a few hours.",
    "Diese Seite ist derzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.", "Le serveur est surchargé. Réessayez dans quelques minutes.", "El enlace ha caducado.", "Add your description here.", "text text text text text text text",
    "Sorry.\nThis page\nis\nno longer available.\nIt was moved.\nPlease\ntry again\nlater.",
]
OWN_CLEAN = [
    "In Jinja you write {{ customer_name }} to print a value.", "The parser handles 404 responses by retrying.", "JavaScript is the language of the client; scripts live in tools/.", "We require scripts to be idempotent.", "The session expired handling was moved to auth.",
    "Fix: show a message when the server is down for maintenance", "Errors are logged and the request is retried later.", "The link to the page was moved to the footer.", "Please open an issue if the build does not work.", "It took 503 ms to rebuild 404 nodes.",
]


def _found(texts, items):
    """Places of the texts with residue, as `residue.residue` finds them."""
    scan, freq = residue.Scan(frozenset(t for e in items for t in e.terms)), defaultdict(int)
    terms = [scan.terms(t) if t else set() for t in texts]
    for s in terms:
        for t in s:
            freq[t] += 1
    index = residue.Index(items, freq, sum(1 for t in texts if t and t.strip()))
    return {i for i, t in enumerate(texts) if residue.find(t, index, scan)}, index


def _documents(sf):
    big = sf.replace("sf0.001", "sf0.01")
    return [r[0] for r in compare.connect(big if os.path.isdir(big) else sf).execute("select text from documents order by doc_id").fetchall()]


def test_residue_in_other_words(sf):
    texts = _documents(sf)
    own = OWN_RESIDUE + OWN_CLEAN
    found, index = _found(texts + own, residue.exemplars())
    assert [own[i - len(texts)] for i in sorted(found) if i >= len(texts)] == OWN_RESIDUE
    for i, e in enumerate(index.items):  # no exemplar is out of reach of its key terms
        out = sum(index.weight[t] for t in e.terms if i not in index.postings.get(t, []))
        assert e.contained == 0 or out < e.contained * index.mass[i]


def test_residue_with_half_of_the_exemplars(sf):
    texts = _documents(sf)
    items = residue.exemplars()
    whole, _ = _found(texts, items)
    for odd in (0, 1):
        half, _ = _found(texts, [e for i, e in enumerate(items) if i % 2 == odd or e.label in residue.LEGAL])
        assert len(half & whole) >= 0.9 * len(whole)


def test_residue_scan_holds_all_terms_of_passages(sf):
    scan = residue.Scan(frozenset(t for e in residue.exemplars() for t in e.terms))
    for t in [*_documents(sf), *RESIDUE, *OWN_RESIDUE, *OWN_CLEAN]:
        if t:
            assert {x for par in residue.paragraphs(t) for s in residue.passages(par) for x in residue.terms(s)} & scan.vocabulary <= scan.terms(t), t


def test_split_sql(spark, sf):
    got, want = compare.bags(queries.queries()["p6_found"](spark, sf), compare.connect(sf), queries.oracle_sql()["p6_found"])
    assert got == want
