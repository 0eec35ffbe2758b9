"""The index end to end on a small code base, and the single operators' defined edge cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graphmill.engine import Engine, SearchOptions, effective_mode
from graphmill.functions import classify as C
from graphmill.functions import text as T
from graphmill.operators import binding as B
from graphmill.operators import budget as U
from graphmill.operators import graph as G
from graphmill.operators import merkle as M
from graphmill.operators import retrieval as R
from graphmill.operators.diffs import Diff
from graphmill.operators.storage import TableStore, upsert
from graphmill.plans import match
from graphmill.sources import files as FS
from graphmill.sources import parsers as P
from graphmill.sources import queue as SQ
from graphmill.sources.shadow import ShadowFiles, TooLarge
from graphmill.streaming import live

CODE = {
    "src/auth.py": '"""Doc."""\nimport api\n\nclass AuthenticationService(Base):\n    """Signs in."""\n    def login(self, user):\n        return request_api(user)\n\n    def __init__(self):\n        pass\n',
    "src/api.py": "def request_api(user):\n    return send(user)\n\ndef send(x):\n    return x\n",
    "src/main.rs": "/// Runs it.\npub fn run_server(c: &Config) -> u8 {\n    start(c)\n}\nstruct Config { a: u8 }\nfn start(c: &Config) -> u8 { 1 }\n",
    "src/App.vue": "<template>\n  <UserCard/><my-list/>\n</template>\n<script lang=\"ts\">\nexport function load() {\n  return fetchAll();\n}\n</script>\n",
    "node_modules/x/y.js": "function hidden() { }\n",
    "src/view.ts": "import { a } from './a';\nexport class View extends Panel {\n  get title() {\n    return this.t;\n  }\n  draw(x: number): void {\n    paint(x);\n  }\n}\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for p, t in CODE.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / ".gitignore").write_text("*.log\nskip/\n")
    (root / "skip").mkdir()
    (root / "skip" / "a.py").write_text("x = 1\n")
    return Engine.reindex(spark, str(root))


def test_discovery_and_parsing(engine):
    assert {r.path for r in engine.files.collect()} == {p for p in CODE if not p.startswith("node_modules")}
    got = {(r.file_path, r.name): r for r in engine.symbols.collect()}
    assert got["src/auth.py", "login"].kind == "Method" and got["src/auth.py", "__init__"].kind == "Constructor"
    assert got["src/auth.py", "login"].qualified_name == "AuthenticationService::login" and got["src/main.rs", "run_server"].docstring == "Runs it."
    assert got["src/App.vue", "load"].start_line == 5 and got["src/view.ts", "title"].kind == "Getter" and got["src/view.ts", "draw"].kind == "Method"
    edges = {(r.src.split("#")[-1].split(":")[0], r.dst, r.edge_type) for r in engine.edges.collect()}
    assert {("login", "request_api", "Calls"), ("AuthenticationService", "Base", "Inherits"), ("App", "UserCard", "References"), ("load", "fetchAll", "Calls"), ("View", "Panel", "Inherits"), ("run_server", "start", "Calls")} <= edges


def test_navigation(engine):
    login = next(r.id for r in engine.symbols.collect() if r.name == "login")
    req = next(r.id for r in engine.symbols.collect() if r.name == "request_api")
    assert engine.get_definition("request_api", login).first().id == req
    assert [r.src for r in engine.get_callers(req).collect()] == [login] and [r.dst for r in engine.get_callees(login).collect()] == [req]
    assert engine.graph_query("MATCH (a)-[:Calls]->(b) WHERE b.name = 'x' RETURN a").count() == 0
    assert login in {r.id for r in engine.expand_context(req, 1).collect()}
    assert {r.id for r in engine.predict_context([req]).collect()} >= {login}
    kept, _ = engine.prune_context([req], 64)
    assert req in {r.id for r in kept.collect()}
    assert {r.id for r in engine.taint_trace(login, depth=1).collect()} >= {login, req}
    rep = engine.impact_analysis([req]).first()
    assert rep.callers == 1 and rep.files == ["src/auth.py"]


def test_search_and_bundle(engine):
    got = engine.search_code(["code where authentication service calls api", "run server"], "lexical", 3).collect()
    names = {r.id: r.name for r in engine.symbols.collect()}
    first = {q: [names[r.id] for r in sorted((x for x in got if x.qid == q), key=lambda x: x.position)] for q in (0, 1)}
    assert first[1][0] == "run_server" and {"login", "AuthenticationService", "request_api"} & set(first[0])
    b = engine.get_context_bundle("run server", "hybrid", 128).collect()
    assert b and sum(r.tokens for r in b) <= 128
    assert effective_mode("hybrid", SearchOptions(semantic=False)) == "lexical" and effective_mode("lexical", SearchOptions(lexical=False)) == "semantic"
    with pytest.raises(ValueError):
        effective_mode("hybrid", SearchOptions(lexical=False, semantic=False))


def test_reports_and_files(engine, spark, tmp_path):
    assert {r.name: r.n for r in engine.get_stats().collect()}["files"] == 5
    assert [r.path for r in engine.find_files("auth py").collect()] == ["src/auth.py"]
    assert engine.list_files(1, 2).count() == 2
    with pytest.raises(ValueError):
        engine.list_files(99)
    assert [r.line_no for r in engine.fetch_file("src/api.py", 2, 3).collect()] == [2, 3]
    assert [r.depth for r in engine.get_ast_outline("./src/auth.py").collect()] == [0, 1, 1]
    assert engine.get_file_skeleton("src/api.py", 64).count() == 2 and engine.repo_map(64).agg(F.sum("cost")).first()[0] <= 64
    assert engine.semantic_diff("src/api.py", "src/auth.py").count() > 0
    over = engine.get_architecture_overview()
    assert {r.key for r in over["languages"].collect()} == {"Python", "Rust", "TypeScript", "Vue"}
    nodes, edges = engine.get_graph_snapshot(3)
    assert nodes.count() == 3 and edges.count() <= 9
    store = TableStore(spark, str(tmp_path / "store"))
    engine.save(store)
    assert Engine.load(spark, store).symbols.count() == engine.symbols.count()
    files = engine.files.filter("path <> 'src/main.rs'").withColumn("content", F.when(F.col("path") == "src/api.py", F.concat("content", F.lit("def more():\n    pass\n"))).otherwise(F.col("content")))
    new, changes = engine.refresh(files)
    assert {r.path: r.change for r in changes.collect() if r.change != "unchanged"} == {"src/api.py": "modified", "src/main.rs": "deleted"}
    assert {"more", "send"} <= {r.name for r in new.symbols.collect()} and "run_server" not in {r.name for r in new.symbols.collect()}


def test_match_grammar():
    q = match.parse("match (a)-[r:contains]->(b) where a.name = 'x\\'y' and b.path ends with \"z\" return a, b limit 5")
    assert (q.edge_type, q.limit, q.conditions[0].value, q.conditions[1].column) == ("Contains", 5, "x'y", "file_path")
    for bad in ("MATCH (a)-[]->(b) RETURN a x", "MATCH (a)-[]->(b) RETURN a LIMIT 0", "MATCH (a)-[]->(b) RETURN a LIMIT 10001", "MATCH (a)-[]->(b) WHERE a.name = 'x RETURN a", "MATCH (a)-[]->(a) RETURN a", "MATCH (a)-[]->(b) RETURN c", "MATCH (a)-[r:Calls]->(b) WHERE r.name = 'x' RETURN a", "MATCH (a)-[:Nope]->(b) RETURN a", ""):
        with pytest.raises(match.MatchError):
            match.parse(bad)


def test_intent(spark):
    rows = [("code where authentication service calls api",), ("auth service invokes endpoint",), (None,), ("",)]
    a = spark.createDataFrame(rows, "q string").select(T.analyze_query(F.col("q")).alias("a")).collect()
    one, two = a[0].a, a[1].a
    assert one.relation == "Calls" and "authentication" in one.subject and "api" in one.object and {"oauth", "endpoint"} <= set(one.expanded)
    assert one.canonical.split("|")[:3] == two.canonical.split("|")[:3]


def test_fusion_rerank_mmr(spark):
    legs = spark.createDataFrame([("q", l, i, r) for l, ids in (("lex", "abc"), ("vec", "bda")) for r, i in enumerate(ids, 1)], "qid string, leg string, id string, rank long")
    assert [r.id for r in R.top_k(R.rrf(legs), 2, ["qid"]).orderBy("rank").collect()] == ["b", "a"]
    c = spark.createDataFrame([("q", "a", 1.0, "load_user Function fn", "f", 1, 5), ("q", "b", 0.99, "load_user Function fn", "f", 2, 4), ("q", "c", 0.8, "validate_token Function fn", "g", 1, 5)], "qid string, id string, score double, text string, file_path string, start_line int, end_line int")
    assert [r.id for r in R.mmr(c, 2, 0.6).orderBy("position").collect()] == ["a", "c"]
    r = R.overlap_rerank(spark.createDataFrame([(1.0, "Read File", "fn read_file")], "score double, query string, text string")).first()
    assert abs(r.score - 1.0) < 1e-9
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.6, 0.8]), ("z", [0.0, 0.0]), ("n", None)], "id string, vec array<float>")
    got = R.vector_topk(v, v.filter("id = 'x'").withColumnRenamed("id", "qid"), 2).collect()
    assert {(r.id, round(r.score, 3)) for r in got} == {("x", 1.0), ("y", 0.6)}


def test_pagerank_and_walks(spark):
    n = spark.createDataFrame([(x, x, "f", "py", None) for x in "ABC"], "id string, name string, file_path string, language string, parent_id string")
    e = spark.createDataFrame([("A", "B", "Calls"), ("B", "C", "Calls"), ("C", "gone", "Calls")], "src string, dst string, edge_type string")
    pr = {r.id: r.score for r in G.pagerank(n, e).collect()}
    assert pr["C"] > pr["B"] > pr["A"] and abs(sum(pr.values()) - 1) < 1e-9
    star = spark.createDataFrame([("hub", f"l{i}", "Calls") for i in range(20)] + [("z", "z", "Calls")], "src string, dst string, edge_type string")
    assert G.propagate_labels(star, spark.createDataFrame([("hub", "x")], "id string, label string"), 2, fanout=5).count() == 6
    comp = {r.id: r.component for r in G.components(star.unionByName(e)).collect()}
    assert comp["l7"] == "hub" and comp["z"] == "z" and comp["gone"] == "A"
    steps = spark.createDataFrame([("t", 0, "A"), ("t", 1, "?"), ("t", 2, "B"), ("t", 3, "C")], "trace_id string, pos int, node string")
    assert [(r.src, r.dst, r.tags) for r in G.trace_edges(steps, n).collect()] == [("B", "C", ["execution-trace", "trace:t"])]
    assert G.pagerank(n.limit(0), e).count() == 0


def test_connected_first(spark):
    n = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("D", "E")], "src string, dst string")
    nodes, links = G.connected_first(n, e, 3)
    assert {r.id for r in nodes.collect()} == {"A", "B", "C"} and links.count() == 2
    nodes, links = G.connected_first(n, e.limit(0), 2)
    assert {r.id for r in nodes.collect()} == {"A", "B"} and links.count() == 0


def test_budget_and_chunks(spark):
    c = spark.createDataFrame([("q", "a", 3.0, 5), ("q", "b", 2.0, 20), ("q", "c", 1.0, 3), ("q", "d", 1.0, None)], "qid string, id string, score double, cost long")
    assert {r.id for r in U.greedy_fill(c, ["qid"], [("score", True)], "id", "cost", 8).collect()} == {"a", "c", "d"}
    text = "\n".join(f"let value_{i} = compute(a, b, c);" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "")], "k long, t string")
    got = U.chunk_texts(docs, "k", "t", 64).orderBy("k", "chunk_index").collect()
    one = [r for r in got if r.k == 1]
    assert one[0].start_line == 1 and one[-1].end_line == 200 and all(a.end_line + 1 == b.start_line for a, b in zip(one, one[1:])) and max(r.token_count for r in one) <= 64 + 8
    assert [r.end_line for r in got if r.k == 2] == [1]


def test_ranges(spark):
    r = spark.createDataFrame([("f", "outer", 1, 100), ("f", "inner", 10, 20), ("f", "same", 10, 20), ("g", "x", 5, 3)], "file string, id string, start long, end long")
    p = spark.createDataFrame([(1, "f", 15), (2, "f", 50), (3, "f", 500), (4, "g", 4)], "pid long, file string, line long")
    assert {x.pid: x.owner for x in B.narrowest_range(p, r, "file", "line", 8).collect()} == {1: "inner", 2: "outer", 3: "f", 4: "g"}
    par = {x.id: x.parent for x in B.containment_parent(r.filter("file = 'f'"), "file", 8).collect()}
    assert par == {"outer": None, "inner": "outer", "same": "inner"}


def test_merkle(spark):
    a = spark.createDataFrame([("src/a.rs", "1"), ("src/deleted.rs", "2"), ("b.rs", "3")], "path string, hash string")
    b = spark.createDataFrame([("src/a.rs", "9"), ("src/new.rs", "2"), ("b.rs", "3")], "path string, hash string")
    ta, tb = M.merkle_build(a), M.merkle_build(b)
    assert {(r.path, r.change) for r in M.merkle_diff(ta, tb).collect()} == {("src/a.rs", "changed"), ("src/deleted.rs", "deleted"), ("src/new.rs", "added")}
    assert M.visited_nodes(ta, ta).first()[0] == 1 and M.merkle_build(a.limit(0)).count() == 0


def test_tree_diff():
    d = Diff("let x = 1", "let x = 2")
    assert [c[0] for c in d.changes] == ["update"] and Diff("a", "a").changes == []
    many = [f"def f{i}():\n    return {i}\n" for i in range(1000)]
    d = Diff("".join(many), "".join(many[:500] + ["def g():\n    return 1\n"] + many[501:]), "python")
    assert 0 < len(d.changes) < 10 and d.distance > 0


def test_classify(spark):
    rows = [("a/ui/b.tsx", "TypeScript", "ui"), ("x/test/y.py", "Python", "tests"), ("Makefile", "Other", "core"), ("a/models/m.h", "C", "domain")]
    df = spark.createDataFrame(rows, "p string, lang string, layer string")
    assert all(r.lang == r.a and r.layer == r.b for r in df.select("*", C.language_of(F.col("p")).alias("a"), C.layer_of(F.col("p")).alias("b")).collect())


def test_shadow_and_settings(tmp_path):
    v = ShadowFiles(2, 20)
    assert v.put("./a.py", "x = 1")[0] == 1 and v.put("b\\..\\b.py", "y")[1] == []
    v.get("a.py")
    assert v.put("c.py", "z")[1] == ["b.py"] and v.entries() == ["a.py", "c.py"]
    with pytest.raises(TooLarge):
        v.put("d.py", "x" * 21)
    assert v.compile("a.py")[0] == 1
    w = ShadowFiles(1, 20)
    w.restore(v.snapshot())
    assert w.entries() == ["c.py"]
    p = str(tmp_path / "s.json")
    assert SQ.Settings.load(p).retrieval.budget == 2048
    s = SQ.Settings()
    s.retrieval.budget = 10**9
    s.save(p)
    assert SQ.Settings.load(p).retrieval.budget == 32768


def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert sorted((r.k, r.v) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    store = TableStore(spark, str(tmp_path / "store"))

    def run():
        live.maintain(live.watch(spark, str(folder), "k long, v string"), store, "t", ["k"], str(tmp_path / "cp")).awaitTermination()

    run()
    (folder / "2.json").write_text('{"k": 2, "v": "z"}\n')
    run()
    run()
    assert sorted((r.k, r.v) for r in store.read("t").collect()) == [(1, "a"), (2, "z")]


def test_task_states(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    ev = [("a", "create", 0), ("a", "complete", 5), ("b", "create", 0), ("b", "cancel", 1), ("b", "complete", 2), ("c", "create", 0), ("d", "complete", 3)]
    folder = tmp_path / "ev"
    folder.mkdir()
    df = spark.createDataFrame([(k, e, t0 + timedelta(seconds=s)) for k, e, s in ev], "task_id string, event string, at timestamp")
    df.coalesce(1).write.parquet(str(folder / "x"))
    src = spark.readStream.schema("task_id string, event string, at timestamp").parquet(str(folder / "x"))
    q = live.task_states(src).writeStream.format("memory").queryName("tasks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.task_id: r.status for r in spark.table("tasks").collect()}
    assert got["a"] == "completed" and got["b"] == "cancelled" and got["c"] in ("working", "cancelled")
    batch = {r.task_id: r.status for r in live.task_outcomes(df).collect()}
    assert batch == {"a": "completed", "b": "cancelled", "c": "cancelled"}


def test_cancel_by_tag(spark):
    import threading
    import time

    job = live.Cancellable(spark, "to-cancel")
    timer = threading.Timer(2, job.cancel)
    timer.start()
    began = time.time()
    with pytest.raises(Exception), job:
        spark.range(0, 10**13, 1, 2).selectExpr("sum(hash(id) * 1L)").collect()
    assert time.time() - began < 60 and spark.range(5).count() == 5


def test_queue_drops_what_is_no_json(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id": "a", "n": 1}\nnot json\n{"id": "b", "n": 2}\n')
    q = SQ.read_queue(spark, str(p), "id string, n long")
    assert {r.id for r in q.collect()} == {"a", "b"}
    assert [r.id for r in SQ.next_upload(q, q.filter("id = 'a'"), "n").collect()] == ["b"]


def test_parse_nothing():
    assert P.rows_of("a.py", None) == ([], []) and P.rows_of("a.unknown", "x") == ([], []) and P.rows_of("a.py", "def (") == ([], [])
    assert FS._rule_regex("*.log").endswith("(/|$)")
