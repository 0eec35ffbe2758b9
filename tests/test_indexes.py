"""Derived indexes, cache, plug-ins and views."""

import pytest
from pyspark.sql import functions as F

from graphmill.functions.text import code_tokens
from graphmill.operators import indexes as I
from graphmill.operators import retrieval as R
from graphmill.operators.storage import TableStore


class Lengths:
    fingerprint, dimension = "lengths-2", 2

    def embed_batch(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_embed_and_delta(spark):
    docs = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "y")], "id string, text string")
    got = {r.id: list(r.vec) for r in I.embed(docs, Lengths(), batch=2).collect()}
    assert got == {"a": [2.0, 1.0], "b": [0.0, 1.0], "c": [1.0, 1.0]}
    vec = I.embed(docs, I.HashEmbedder(8))
    assert I.vectors_of(vec, "sha256-8").count() == 3 and I.vectors_of(vec, "other").count() == 0
    new = I.update_index(vec, docs.filter("id = 'a'"), I.embed(spark.createDataFrame([("c", "z"), ("d", "w")], "id string, text string"), I.HashEmbedder(8)))
    assert sorted(r.id for r in new.collect()) == ["b", "c", "d"]


def test_lazy_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "readFile twice"), ("b", "write file")], "id string, text string")
    store, built = TableStore(spark, str(tmp_path)), []

    def build(d):
        built.append(1)
        return R.postings(d, {"body": code_tokens(F.col("text"))})

    I.ensure_index(store, "post", docs, build)
    idx = I.ensure_index(store, "post", docs, build)
    assert len(built) == 1 and {r.term for r in idx.collect()} == {"read", "file", "twice", "write"}
    I.ensure_index(store, "post", docs.unionByName(spark.createDataFrame([("c", "more")], "id string, text string")), build)
    assert len(built) == 2


def test_cache():
    c = I.QueryCache(entries=2, total=1_000)
    assert c.put("a", [1]) and c.put("b", [2]) and c.get("a") == [1] and c.put("c", [3])
    assert c.get("b") is None and c.get("a") == [1] and not c.put("d", ["x" * (5 << 20)])
    old = I.QueryCache(seconds=-1)
    old.put("a", [1])
    assert old.get("a") is None


def test_rerank_and_views(spark):
    c = spark.createDataFrame([("q", "a", 1.0, "x", "one"), ("q", "b", 0.5, "x", "two words")], "qid string, id string, score double, query string, text string")
    got = {r.id: r.score for r in I.rerank(c, lambda q, texts: [float(len(t)) for t in texts]).collect()}
    assert got["a"] > 0.9 and got["b"] > 0.8
    nodes = spark.createDataFrame([("1", "run", "Function", "a.py"), ("2", "walk", "Function", "b.py"), ("3", "stop", "Class", "c.py")], "id string, name string, kind string, file_path string")
    edges = spark.createDataFrame([("1", "2", "Calls", 0.9), ("2", "3", "Calls", 0.5), ("3", "1", "Imports", 1.0)], "src string, dst string, edge_type string, confidence double")
    n, e = I.graph_view(edges, nodes, ["Calls"], focus="RUN")
    assert {r.id for r in n.collect()} == {"1", "2"} and e.count() == 1
    assert I.render(nodes.filter("id = '1'"), "compact").first().line == "1\trun\tFunction\ta.py"
    assert I.render(nodes.filter("id = '1'"), "text").first().line.startswith("id=1, name=run") and I.render(nodes).first().line.startswith("{")
    with pytest.raises(ValueError):
        I.render(nodes, "other")
