"""One index as an object: the parameterised operations over its tables.

An index is five DataFrames: files (path, hash, size, content), symbols, edges,
chunks and documents' postings derived from chunks. Every operation returns a
DataFrame and stays lazy except where it says so; operations on ids take lists
and answer for all of them in one plan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import classify as C
from graphmill.functions import text as T
from graphmill.functions.paths import module_key, path_depth, plain_path
from graphmill.functions.vectors import hash_embedding
from graphmill.operators import binding as B
from graphmill.operators import budget as U
from graphmill.operators import diffs
from graphmill.operators import graph as G
from graphmill.operators import hierarchy as H
from graphmill.operators import indexes as X
from graphmill.operators import merkle as M
from graphmill.operators import retrieval as R
from graphmill.operators import storage as S
from graphmill.plans import match
from graphmill.session import durable
from graphmill.sources import files as FS
from graphmill.sources import parsers as P
from graphmill.sources.queue import Settings
from graphmill.sources.shadow import ShadowFiles

#: Bounds of the operations' arguments.
SEARCH_MOST, DEPTH_MOST, PAGE, PAGE_MOST, FIND_MOST, SNAPSHOT_MOST = 100, 8, 500, 5_000, 500, 10_000
BUDGET_LEAST, BUDGET_MOST, BUNDLE_LEAST, BUNDLE_MOST = 64, 32_768, 128, 32_768
STAGE_MOST, EXPAND_SEEDS, RELATION_BONUS = 200, 5, 1.18


def _clamp(x: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, x))


@dataclass
class SearchOptions:
    lexical: bool = True
    semantic: bool = True
    rerank: bool = True
    graph_hops: int = 1
    candidates: int = 32
    mmr_lambda: float = 0.75


def effective_mode(mode: str, options: SearchOptions) -> str:
    """lexical, semantic or hybrid as far as the legs are enabled; unknown modes and no leg at all are errors."""
    if mode not in ("lexical", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if not (options.lexical or options.semantic):
        raise ValueError("both legs are disabled")
    if not options.semantic:
        return "lexical"
    return mode if options.lexical else "semantic"


class Engine:
    def __init__(self, spark: SparkSession, files: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, settings: Settings | None = None):
        self.spark, self.files, self.symbols, self.edges, self.chunks = spark, files, symbols, edges, chunks
        self.settings = settings or Settings()
        self.shadow = ShadowFiles()
        self.cache = X.QueryCache()
        self._derived: dict[str, DataFrame] = {}  # bound edges, postings and vectors, each made once when first asked for
        self._version = uuid.uuid4().hex

    # --- building and maintaining ---

    @staticmethod
    def index(spark: SparkSession, files: DataFrame) -> Engine:
        """Parse files (path, content) into symbols, edges and chunks; every table is written once."""
        files = durable(files)
        symbols = durable(P.extract_symbols(files))
        edges = durable(P.extract_edges(files).dropDuplicates(["src", "dst", "edge_type"]))
        body = symbols.select("id", F.col("file_path").alias("path"), "start_line", "end_line").join(files.select("path", "content"), "path")
        body = body.select("id", T.body_slice(F.col("content"), F.col("start_line").cast("int"), F.col("end_line").cast("int")).alias("text"))
        parts = U.chunk_bodies(U.chunk_texts(body, "id", "text"), body, "id", "text")
        cid = F.when(F.col("chunk_index") == 0, F.col("id")).otherwise(F.concat_ws("::chunk:", "id", F.col("chunk_index").cast("string")))
        chunks = durable(parts.select(cid.alias("id"), F.col("id").alias("parent_symbol_id"), "chunk_index", "start_line", "end_line", F.col("body").alias("text"), "token_count"))
        return Engine(spark, files, symbols, edges, chunks)

    @staticmethod
    def reindex(spark: SparkSession, root: str) -> Engine:
        return Engine.index(spark, FS.discover(spark, root))

    def refresh(self, files: DataFrame) -> tuple[Engine, DataFrame]:
        """(new index, changes per path): only new and modified files are parsed, deleted ones cascade."""
        digest = lambda f: f.select("path", F.sha2("content", 256).alias("h"))
        changes = durable(B.change_class(digest(self.files), digest(files), "path", "h"))
        gone = changes.filter("change <> 'unchanged' and change <> 'new'").select("path")
        kept = S.cascade_delete(self.files, self.symbols, self.chunks, self.edges, gone)
        inbound = self.edges.join(self.symbols.join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("dst")), "dst", "left_semi")
        inbound = inbound.join(kept["symbols"].select(F.col("id").alias("src")), "src", "left_semi")
        fresh = Engine.index(self.spark, files.join(changes.filter("change in ('new', 'modified')").select("path"), "path", "left_semi"))
        back = inbound.join(fresh.symbols.select(F.col("id").alias("dst")), "dst", "left_semi")  # ends that are defined again
        new = Engine(
            self.spark,
            durable(kept["files"].select(*fresh.files.columns).unionByName(fresh.files)),
            durable(kept["symbols"].unionByName(fresh.symbols)),
            durable(kept["edges"].unionByName(fresh.edges).unionByName(back.select(*fresh.edges.columns)).dropDuplicates(["src", "dst", "edge_type"])),
            durable(kept["chunks"].unionByName(fresh.chunks)),
            self.settings,
        )
        return new, changes

    def save(self, store: S.TableStore) -> None:
        """All tables, those derived from them included, in one commit."""
        tables = {n: getattr(self, n) for n in ("files", "symbols", "edges", "chunks")}
        tables |= {"bound": self.bound_edges(), "postings": self.postings(), "vectors": self.vectors()}
        store.commit(tables, {"format": 4})

    @staticmethod
    def load(spark: SparkSession, store: S.TableStore) -> Engine:
        if store.metadata("format") != 4:
            raise ValueError("no index of this format")
        engine = Engine(spark, *[store.read(n) for n in ("files", "symbols", "edges", "chunks")])
        engine._derived = {n: store.read(n) for n in ("bound", "postings", "vectors")}
        return engine

    def _replace_edges(self, new: DataFrame) -> None:
        """Upsert edges; what was derived from them, and results of searches, no longer hold."""
        self.edges = durable(S.upsert(self.edges, new, ["src", "dst", "edge_type"]))
        self._derived.pop("bound", None)
        self._version = uuid.uuid4().hex

    # --- definitions, callers, references ---

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = durable(build())
        return self._derived[name]

    def bound_edges(self) -> DataFrame:
        """Edges whose ends are symbol ids: names bound by locality, with confidence and evidence; bound once and kept."""

        def build() -> DataFrame:
            e = self.edges.select("src", F.col("dst").alias("dst_name"), "edge_type", F.col("tags"))
            traced = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.startswith("trace:"))
            e = durable(e.groupBy("src", "dst_name", "edge_type").agg(F.max(F.element_at(F.concat(traced, F.array(F.lit(None).cast("string"))), 1)).alias("trace"), F.max(F.coalesce(F.array_contains("tags", "stack-graph"), F.lit(False))).alias("stacked")))
            found = B.bind_locality(e.select("src", "dst_name"), self.symbols)
            exact = F.col("evidence") == "exact_id"
            traced_id = F.concat(F.lit("execution_trace:"), F.substring("trace", 7, 1 << 20))
            evidence = F.when(exact & F.col("trace").isNotNull(), traced_id).when(exact & F.col("stacked"), "stack_graph").otherwise(F.col("evidence"))
            confidence = F.when(exact & F.col("trace").isNull() & F.col("stacked"), 0.99).otherwise(F.col("confidence"))
            return e.join(found, ["src", "dst_name"]).select("src", F.col("target").alias("dst"), "edge_type", confidence.alias("confidence"), evidence.alias("evidence"))

        return self._once("bound", build)

    def _documents(self) -> DataFrame:
        docs = self.chunks.join(self.symbols.select(F.col("id").alias("parent_symbol_id"), "name", "signature"), "parent_symbol_id")
        return docs.select("id", "parent_symbol_id", "name", "signature", "text")

    def postings(self) -> DataFrame:
        """The lexical index of all chunks, made once and kept."""
        return self._once("postings", lambda: R.postings(self._documents(), R.document_fields(F.col("name"), F.coalesce("text", F.lit("")))))

    def vectors(self) -> DataFrame:
        """The vectors of all chunks, made once and kept."""
        return self._once("vectors", lambda: self._documents().select("id", hash_embedding(F.coalesce("text", F.lit(""))).alias("vec")))

    def get_definition(self, symbol: str, context: str = "") -> DataFrame:
        """The definition that a name means at a symbol, or anywhere for no context."""
        by_id = self.symbols.filter(F.col("id") == symbol)
        if context:
            ref = self.spark.createDataFrame([(context, symbol)], "src string, dst_name string")
            hit = B.bind_ranked(ref, self.symbols).select(F.col("target").alias("id"))
        else:
            hit = self.symbols.filter(F.col("name") == T.leaf_name(F.lit(symbol))).orderBy("id").limit(1).select("id")
        return by_id.unionByName(self.symbols.join(hit, "id", "left_semi").select(*self.symbols.columns)).dropDuplicates(["id"]).orderBy("id").limit(1)

    def _incoming(self, ids: list[str], kinds: list[str]) -> DataFrame:
        return self.bound_edges().filter(F.col("edge_type").isin(kinds) & F.col("dst").isin(ids)).select("src", "dst", "edge_type").distinct()

    def get_references(self, symbol_id: str) -> DataFrame:
        return self._incoming([symbol_id], ["Calls", "References"])

    def get_callers(self, symbol_id: str) -> DataFrame:
        return self._incoming([symbol_id], ["Calls"])

    def get_callees(self, symbol_id: str) -> DataFrame:
        return self.bound_edges().filter((F.col("edge_type") == "Calls") & (F.col("src") == symbol_id)).select("src", "dst", "edge_type").distinct()

    def graph_query(self, query: str) -> DataFrame:
        return match.run(query, self.symbols, self.edges)

    # --- walks ---

    def _seeds(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([("q", i) for i in ids], "qid string, id string")

    def expand_context(self, symbol_id: str, depth: int = 1) -> DataFrame:
        return G.expand(self.bound_edges(), self._seeds([symbol_id]), _clamp(depth, 1, DEPTH_MOST)).filter("hop > 0")

    def predict_context(self, symbol_ids: list[str], depth: int = 2, limit: int = 20) -> DataFrame:
        if not self.settings.structural_prefetch:
            raise PermissionError("structural prefetch is switched off")
        got = G.predict_context(self.symbols, self.bound_edges(), self._seeds(symbol_ids), _clamp(depth, 1, DEPTH_MOST))
        return got.orderBy(F.desc("score"), "id").limit(_clamp(limit, 1, SEARCH_MOST))

    def prune_context(self, symbol_ids: list[str], token_budget: int = 2_048) -> tuple[DataFrame, DataFrame]:
        costs = U.token_cost(self.symbols, self.chunks)
        return U.prune_context(self.symbols, self.bound_edges(), self._seeds(symbol_ids), costs, _clamp(token_budget, BUDGET_LEAST, BUDGET_MOST))

    def taint_trace(self, source: str, label: str = "user-input", depth: int = 3, pin: bool = False) -> DataFrame:
        """Labelled nodes; with pin, the carried edges get the label as a tag in the index."""
        seeds = self.spark.createDataFrame([(source, label)], "id string, label string")
        kinds = ["Calls", "References", "Contains", "Imports"]
        found = G.propagate_labels(self.bound_edges(), seeds, _clamp(depth, 1, 16), kinds)
        if pin:
            if not self.settings.execution_trace_pinning:
                raise PermissionError("pinning is switched off")
            tagged = G.carried_edges(self.edges, found)
            self._replace_edges(tagged)
        return found

    def pin_execution_trace(self, trace_id: str, symbol_ids: list[str]) -> DataFrame:
        """Write the steps of a trace as reference edges; returns them."""
        if len(symbol_ids) < 2:
            raise ValueError("a trace has at least two steps")
        steps = self.spark.createDataFrame([(trace_id, i, s) for i, s in enumerate(symbol_ids)], "trace_id string, pos int, node string")
        new = durable(G.trace_edges(steps, self.symbols).select("src", "dst", "edge_type", "tags"))
        self._replace_edges(new)
        return new

    # --- search ---

    def search_code(self, queries: list[str], mode: str = "hybrid", limit: int = 10, options: SearchOptions | None = None) -> DataFrame:
        """(qid, id, position) for many queries at once; qid is the query's place in the list.

        Lexical legs: raw and expanded terms over names, trigrams and bodies;
        semantic leg: deterministic hash vectors. Fused by reciprocal rank,
        collapsed to symbols, reranked by overlap, widened by the graph and
        boosted by evidence of the asked relation, then picked for diversity.
        """
        o = options or SearchOptions()
        mode = effective_mode(mode, o)
        limit = _clamp(limit, 1, SEARCH_MOST)
        width = _clamp(max(limit, o.candidates) if o.rerank else limit, 1, STAGE_MOST)
        q = self.spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
        q = durable(q.withColumn("a", T.analyze_query(F.col("query"))))
        key = self.cache.key(self._version, mode, limit, width, o, *[" ".join(x.split()) for x in queries])
        known = self.cache.get(key)
        if known is not None:
            return self.spark.createDataFrame(known, "qid long, id string, position long")
        out = self._search(q, mode, limit, width, o)
        if len(queries) <= SEARCH_MOST:  # at most that many lists of at most SEARCH_MOST rows
            rows = [tuple(r) for r in out.collect()]
            self.cache.put(key, rows)
            return self.spark.createDataFrame(rows, "qid long, id string, position long")
        return out

    def _search(self, q: DataFrame, mode: str, limit: int, width: int, o: SearchOptions) -> DataFrame:
        legs = []
        if mode in ("lexical", "hybrid"):
            idx = self.postings()
            grams = lambda c: F.array_union(c, F.flatten(F.transform(c, T.trigrams)))
            legs.append(R.ranked(R.bm25(idx, q.select("qid", grams(T.code_tokens(F.col("query"))).alias("terms"))), "raw", width))
            legs.append(R.ranked(R.bm25(idx, q.select("qid", grams(F.col("a.expanded")).alias("terms"))), "expanded", width))
        if mode in ("semantic", "hybrid"):
            legs.append(R.vector_topk(self.vectors(), q.select("qid", hash_embedding(F.col("query")).alias("vec")), width).transform(lambda x: R.top_k(x, width, ["qid"])).select("qid", F.lit("vector").alias("leg"), "id", "rank"))
        all_legs = legs[0]
        for leg in legs[1:]:
            all_legs = all_legs.unionByName(leg)
        fused = R.top_k(R.rrf(all_legs), width, ["qid"]).drop("rank")
        sym = fused.join(self.chunks.select("id", "parent_symbol_id"), "id").groupBy("qid", F.col("parent_symbol_id").alias("id")).agg(F.max("score").alias("score"))
        cols = self.symbols.select("id", "name", "kind", "signature", "file_path", "start_line", "end_line", F.concat_ws(" ", "name", "qualified_name", "kind", "signature", "file_path", "docstring").alias("hay"))
        c = sym.join(cols, "id").join(q, "qid")
        if o.rerank:
            c = R.overlap_rerank(c.withColumn("text", F.concat_ws(" ", "signature", "name")))
        c = durable(c.select("qid", "id", "score"))
        if o.graph_hops:
            bound = self.bound_edges()
            seeds = R.top_k(c, EXPAND_SEEDS, ["qid"]).select(F.concat_ws("\u0001", F.col("qid").cast("string"), "id").alias("key"), "qid", "id", "score")
            ask = q.select("qid", "a.relation", "a.subject", "a.object", "a.expanded")
            near = G.ranked_expansion(bound, seeds.select(F.col("key").alias("qid"), "id"), o.graph_hops).withColumnRenamed("qid", "key")
            near = near.join(seeds.select("key", F.col("qid").alias("q"), F.col("id").alias("root"), F.col("score").alias("s")), "key")
            # a neighbour over an edge of the relation that the query asks for counts more
            asked = bound.select("edge_type", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e"))
            asked = asked.join(ask.select(F.col("qid").alias("q"), F.col("relation").alias("edge_type")).filter("edge_type is not null"), "edge_type").select("q", F.col("e.a").alias("root"), F.col("e.b").alias("id"), F.lit(RELATION_BONUS).alias("bonus")).distinct()
            near = near.join(asked, ["q", "root", "id"], "left")
            grown = near.select(F.col("q").alias("qid"), "id", (F.col("s") * F.col("score") * F.coalesce("bonus", F.lit(1.0))).alias("score"))
            c = c.unionByName(grown).groupBy("qid", "id").agg(F.max("score").alias("score"))
            c = self._boost(c.join(cols.select("id", "hay"), "id").join(ask, "qid"), bound, cols)
        c = R.top_k(c, width, ["qid"]).select("qid", "id", "score").join(cols, "id")
        c = c.select("qid", "id", "score", F.concat_ws(" ", "name", "kind", "signature").alias("text"), "file_path", "start_line", "end_line")
        return R.mmr(c, limit, o.mmr_lambda)

    @staticmethod
    def _match(terms, hay):
        return F.greatest(T.text_match_score(terms, hay), 0.8 * T.text_match_score(T.expand_terms(terms), hay))

    def _boost(self, c: DataFrame, bound: DataFrame, cols: DataFrame) -> DataFrame:
        """score * (1 + evidence) with the evidence of edges of the asked relation, at most 0.72."""
        out = bound.select(F.col("src").alias("id"), "dst", "edge_type", "evidence").join(cols.select(F.col("id").alias("dst"), F.col("hay").alias("t_hay")), "dst")
        ev = c.join(out, "id").filter(F.col("edge_type") == F.col("relation"))
        ev = ev.select("qid", "id", (0.24 * self._match(F.col("subject"), F.col("hay")) + 0.34 * self._match(F.col("object"), F.col("t_hay")) + F.when(F.col("evidence").startswith("execution_trace"), 0.14).when(F.col("evidence") == "stack_graph", 0.10).otherwise(0.04)).alias("e"))
        back = c.join(bound.select(F.col("dst").alias("id"), "edge_type"), "id").filter(F.col("edge_type") == F.col("relation"))
        back = back.select("qid", "id", (0.18 * self._match(F.col("object"), F.col("hay"))).alias("e"))
        best = ev.unionByName(back).groupBy("qid", "id").agg(F.least(F.max("e"), F.lit(0.72)).alias("e"))
        plain = F.when(F.col("relation").isNull(), 0.08 * T.text_match_score(F.col("expanded"), F.col("hay"))).otherwise(0.0)
        return c.join(best, ["qid", "id"], "left").select("qid", "id", (F.col("score") * (1 + F.coalesce(F.when(F.col("relation").isNotNull(), F.col("e")), plain))).alias("score"))

    def get_context_bundle(self, query: str, mode: str = "hybrid", token_budget: int = 2_048) -> DataFrame:
        """(id, tokens, reason) that fit the budget: search results and what they predict, best first."""
        budget = _clamp(token_budget, BUNDLE_LEAST, BUNDLE_MOST)
        hits = durable(self.search_code([query], mode, 40))
        seeds = [r.id for r in hits.orderBy("position").limit(5).collect()]
        pred = G.predict_context(self.symbols, self.bound_edges(), self._seeds(seeds)).select("id", F.col("score").alias("p")) if seeds else None
        c = hits.select("id", (1 / (F.col("position") + 1)).alias("s"))
        if pred is not None:
            c = c.join(pred, "id", "full_outer")
        else:
            c = c.withColumn("p", F.lit(None).cast("double"))
        c = c.select("id", F.when(F.col("s").isNull(), 0.9 * F.col("p")).otherwise(F.greatest("s", F.coalesce("p", "s"))).alias("score"), F.when(F.col("s").isNull(), "structural locality").otherwise(F.lit(f"{mode} retrieval anchor")).alias("reason"))
        c = durable(R.top_k(c.withColumn("qid", F.lit("q")), STAGE_MOST, ["qid"]).join(U.token_cost(self.symbols, self.chunks), "id"))
        kept = U.greedy_fill(c, ["qid"], [("score", True)], "id", "cost", budget)
        return c.join(kept.select("id"), "id", "left_semi").select("id", F.col("cost").alias("tokens"), "reason", "score").orderBy(F.desc("score"), "id")

    fetch_context = get_context_bundle

    # --- files ---

    def list_files(self, offset: int = 0, limit: int = PAGE) -> DataFrame:
        if offset > self.files.count():
            raise ValueError("offset is beyond the last file")
        return self.files.select("path").orderBy("path").offset(offset).limit(_clamp(limit, 1, PAGE_MOST))

    def find_files(self, query: str, limit: int = 50) -> DataFrame:
        """Paths that hold all code tokens of the query, shallow first."""
        hit = F.forall(T.code_tokens(F.lit(query)), lambda t: F.contains(F.lower("path"), t)) & (F.size(T.code_tokens(F.lit(query))) > 0)
        raw = (F.size(T.code_tokens(F.lit(query))) == 0) & F.lower("path").contains(query.lower())
        return self.files.filter(hit | raw).select("path").orderBy(path_depth(F.col("path")), "path").limit(_clamp(limit, 1, FIND_MOST))

    def fetch_file(self, path: str, start_line: int = 1, end_line: int | None = None, token_budget: int = 4_096) -> DataFrame:
        end = start_line + 399 if end_line is None else min(end_line, start_line + 1_999)
        return FS.line_range(self.files, path, start_line, end, _clamp(token_budget, BUDGET_LEAST, BUDGET_MOST)).orderBy("line_no")

    def get_ast_outline(self, path: str) -> DataFrame:
        """(id, depth, path) of one file's symbols in source order."""
        syms = self.symbols.filter(plain_path(F.col("file_path")) == plain_path(F.lit(path)))
        links = syms.select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))
        placed = H.heavy_paths(links, names=syms.select(F.col("id").alias("node"), "name"))
        return placed.select(F.col("node").alias("id"), "depth", "path").join(syms.select("id", "kind", "start_line", "start_col"), "id").orderBy("start_line", "start_col", "id")

    def _skeleton(self, scored: DataFrame, budget: int) -> DataFrame:
        sig = T.elided_signature(F.col("kind"), F.col("signature"))
        c = scored.join(self.symbols.select("id", "kind", "signature", "file_path", "start_line"), "id").select("id", "file_path", "start_line", sig.alias("line"), "score", F.lit("q").alias("qid"))
        c = R.top_k(c.withColumn("cost", T.count_tokens(F.col("line"))), 10_000, ["qid"])
        kept = U.greedy_fill(c, ["qid"], [("score", True)], "id", "cost", _clamp(budget, BUDGET_LEAST, BUDGET_MOST))
        return c.join(kept.select("id"), "id", "left_semi").select("file_path", "start_line", "line", "cost").orderBy("file_path", "start_line", "line")

    def get_file_skeleton(self, path: str, token_budget: int = 1_024) -> DataFrame:
        syms = self.symbols.filter(F.col("file_path") == path).select("id", (-F.col("start_line")).cast("double").alias("score"))
        return self._skeleton(syms, token_budget)

    def repo_map(self, token_budget: int = 1_024, focal_symbols: list[str] = (), focal_files: list[str] = ()) -> DataFrame:
        """Signatures of the best-ranked symbols that fit the budget, by file and line."""
        w = G.personal_weight(self.symbols, list(focal_symbols), list(focal_files))
        fan = B.bind_fanout(self.edges.select("src", F.col("dst").alias("dst_name")), self.symbols)
        exact = self.edges.select("src", "dst").join(self.symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        return self._skeleton(G.pagerank(self.symbols, fan.unionByName(exact).distinct(), w), token_budget)

    def semantic_diff(self, file_a: str, file_b: str) -> DataFrame:
        ext = file_a.rsplit(".", 1)[-1]
        if ext != file_b.rsplit(".", 1)[-1]:
            raise ValueError("the files differ in language")
        one = lambda p, n: self.files.filter(F.col("path") == p).select(F.col("content").alias(n), F.lit(1).alias("k"))
        pair = one(file_a, "a").join(one(file_b, "b"), "k").withColumn("lang", F.lit(P.LANGUAGE.get(ext, "text")))
        return diffs.diff_pairs(pair, "k", "a", "b", "lang").drop("k")

    def merkle(self) -> DataFrame:
        return M.merkle_build(self.files.select("path", F.sha2("content", 256).alias("hash")))

    # --- reports ---

    def get_stats(self) -> DataFrame:
        out = None
        for n in ("files", "symbols", "edges", "chunks"):
            c = getattr(self, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
            out = c if out is None else out.unionByName(c)
        return out

    def impact_analysis(self, symbol_ids: list[str]) -> DataFrame:
        """(id, degree, in_degree, callers, refs, files, risk, god) of each symbol, on bound edges."""
        e = durable(self.bound_edges().select("src", "dst", "edge_type").distinct())
        deg = G.degrees(e).filter(F.col("id").isin(symbol_ids))
        use = e.filter(F.col("dst").isin(symbol_ids) & F.col("edge_type").isin("Calls", "References")).join(self.symbols.select(F.col("id").alias("src"), "file_path"), "src")
        agg = use.groupBy(F.col("dst").alias("id")).agg(
            F.countDistinct(F.when(F.col("edge_type") == "Calls", F.col("src"))).alias("callers"), F.countDistinct("src").alias("refs"), F.array_sort(F.collect_set("file_path")).alias("files")
        )
        return deg.join(agg, "id", "left").select("id", "degree", "in_degree", "callers", "refs", "files", C.risk_score(F.col("degree"), F.col("in_degree")).alias("risk"), ((F.col("degree") >= 20) | (F.col("in_degree") >= 12)).alias("god"))

    def get_graph_snapshot(self, limit: int = 1_000) -> tuple[DataFrame, DataFrame]:
        """(nodes with degree and category, bound edges among them): best-connected first."""
        e = durable(self.bound_edges().select("src", "dst", "edge_type", "confidence"))
        n, links = G.connected_first(self.symbols, e, _clamp(limit, 1, SNAPSHOT_MOST))
        n = n.select("id", "name", "kind", "file_path", "degree", C.node_category(F.col("degree"), F.col("kind"), F.col("file_path")).alias("category"))
        return n, e.join(links, ["src", "dst"], "left_semi")

    def get_architecture_overview(self) -> dict[str, DataFrame]:
        """languages, layers, kinds, modules, communities, hubs, entrypoints and contracts, each a DataFrame of its own."""
        e = durable(self.bound_edges().select("src", "dst", "edge_type").distinct())
        s = self.symbols
        comp = G.components(e)
        members = comp.join(s.select("id", "kind", "file_path"), "id").groupBy("component").agg(F.count("*").alias("members"), F.countDistinct("file_path").alias("files")).filter("members > 1")
        count = lambda df, k: df.groupBy(k.alias("key")).agg(F.count("*").alias("n"))
        mods = s.groupBy(module_key(F.col("file_path")).alias("module")).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"))
        return {
            "languages": count(self.files, C.language_of(F.col("path"))),
            "layers": count(self.files, C.layer_of(F.concat(F.lit("/"), F.col("path")))),
            "kinds": count(s, F.col("kind")),
            "modules": mods.orderBy(F.desc("symbols"), "module").limit(64),
            "communities": members.orderBy(F.desc("members"), "component").limit(32),
            "hubs": G.degrees(e).orderBy(F.desc("degree"), "id").limit(32),
            "entrypoints": s.filter(C.is_entrypoint(F.col("name"), F.col("file_path"))).select("id").orderBy("id").limit(32),
            "contracts": s.filter(C.is_contract(F.col("kind"))).select("id").orderBy("id").limit(64),
        }

    # --- shadow files and settings ---

    def vfs_update(self, path: str, content: str | None = None, delete: bool = False) -> dict:
        if not self.settings.vfs_shadowing:
            raise PermissionError("shadow files are switched off")
        if delete:
            return {"path": path, "removed": self.shadow.remove(path)}
        version, gone = self.shadow.put(path, content or "")
        return {"path": path, "version": version, "evicted": gone}

    def micro_compile(self, path: str) -> dict:
        version, digest, symbols, edges = self.shadow.compile(path)
        return {"version": version, "hash": digest, "symbols": symbols, "edges": edges}

    def get_settings(self) -> Settings:
        return self.settings

    def set_setting(self, key: str, value) -> Settings:
        owner = self.settings.retrieval if hasattr(self.settings.retrieval, key) else self.settings
        if not hasattr(owner, key):
            raise KeyError(key)
        setattr(owner, key, value)
        return self.settings.normalised()
