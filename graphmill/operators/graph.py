"""Iterative graph operators: level-synchronous loops over written tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphmill.functions.classify import edge_priority, prefetch_weight
from graphmill.functions.text import is_well_named
from graphmill.operators.retrieval import top_k
from graphmill.operators.skew import lead_by_blocks
from graphmill.session import durable, release

#: Damping and number of power iterations.
DAMPING, ITERATIONS = 0.85, 20


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree) of every end of an edge; one aggregation over both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").cast("long").alias("out_degree"), F.sum("e.i").cast("long").alias("in_degree"), F.count("*").alias("degree"))


def personal_weight(nodes: DataFrame, mentioned: list[str], focal_files: list[str], well_named: bool = True) -> Column:
    """Teleport weight: times 10 for a mentioned id or name, times 50 for a file in focus, times 10 for a telling name."""
    low = [m.lower() for m in mentioned]
    hit = F.lower("id").isin(low) | F.lower("name").isin(low) if low else F.lit(False)
    focus = F.lit(False)
    for f in focal_files:
        focus = focus | (F.col("file_path") == f) | F.col("file_path").endswith(f)
    w = F.when(hit, 10.0).otherwise(1.0) * F.when(focus, 50.0).otherwise(1.0)
    return w * F.when(is_well_named(F.col("name")), 10.0).otherwise(1.0) if well_named else w


def pagerank(nodes: DataFrame, edges: DataFrame, weight: Column | None = None, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(id, score) after exactly `iterations` power iterations from the teleport vector; scores sum to one.

    Parallel edges count once; edges with an unknown end are dropped; the mass
    of nodes without out-edges is spread by the teleport vector. The links are
    partitioned and sorted by src once and kept, over a written table from which
    a lost part is made again; a round shuffles ranks and partial sums, not
    links, and tells the mass of the dead ends as it is written.
    """
    n = nodes.select("id", (weight if weight is not None else F.lit(1.0)).alias("w"))
    n = durable(n)
    total = n.agg(F.sum("w")).first()[0]
    if not total:
        return nodes.select("id", F.lit(0.0).alias("score")).filter("false")
    ids = n.select("id")
    links = edges.select("src", "dst").distinct()
    links = links.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = durable(links)
    out = links.groupBy("src").agg(F.count("*").alias("fan"))
    base = durable(n.select("id", (F.col("w") / F.lit(total)).alias("tele")).join(out.withColumnRenamed("src", "id"), "id", "left"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = links.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    dead = F.coalesce(F.sum(F.when(F.col("fan").isNull(), F.col("score"))), F.lit(0.0)).alias("lost")
    rank = base.select("id", "tele", "fan", F.col("tele").alias("score"))
    lost = rank.agg(dead).first()[0]
    try:
        for _ in range(iterations):
            given = rank.filter("fan is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("fan")).alias("share"))
            got = kept.join(given, "src").groupBy("dst").agg(F.sum("share").alias("in"))
            new = base.join(got.withColumnRenamed("dst", "id"), "id", "left").select(
                "id", "tele", "fan", ((1 - damping) * F.col("tele") + damping * (F.coalesce("in", F.lit(0.0)) + F.lit(lost) * F.col("tele"))).alias("score")
            )
            seen = Observation()
            new = durable(new.observe(seen, dead))
            lost = seen.get["lost"]
            release(rank)
            rank = new
    finally:
        kept.unpersist()
    return rank.select("id", "score")


def strongest(adj: DataFrame, fanout: int, weight: str | None = None) -> DataFrame:
    """The first `fanout` rows (a, b) of each a by weight, greatest first, ties by b; a hot node is cut in parts first."""
    ranked = adj if weight else adj.withColumn("_w", F.lit(0.0))
    return top_k(ranked, fanout, ["a"], weight or "_w", "b").drop("rank", "_w")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions without loops."""
    e = edges.select("src", "dst").filter("src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst"), F.col("src"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(qid, id, hop) of every node within `hops` undirected steps of the seeds (qid, id); hop is the least."""
    adj = durable(undirected(edges))
    seen = seeds.select("qid", "id").distinct().withColumn("hop", F.lit(0).cast("long"))
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(adj.withColumnRenamed("a", "id"), "id").select("qid", F.col("b").alias("id")).distinct()
        front = durable(nxt.join(seen, ["qid", "id"], "left_anti").withColumn("hop", F.lit(h).cast("long")))
        seen = seen.unionByName(front)
    return seen


def propagate_labels(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None, fanout: int | None = None) -> DataFrame:
    """(id, label, hop): labels carried over undirected edges of the given kinds for at most `hops` steps; hop is the least.

    seeds: (id, label). With `fanout`, each node passes labels over its first so
    many edges only, ordered by neighbour and kind, a bounded walk by choice.
    """
    e = edges.filter(F.col("edge_type").isin(kinds)) if kinds else edges
    adj = undirected(e)
    if fanout:
        adj = strongest(adj, fanout)
    adj = durable(adj)
    seen = seeds.select("id", "label").distinct().withColumn("hop", F.lit(0).cast("long"))
    front = seen
    for h in range(1, hops + 1):
        nxt = front.join(adj.withColumnRenamed("a", "id"), "id").select(F.col("b").alias("id"), "label").distinct()
        front = durable(nxt.join(seen, ["id", "label"], "left_anti").withColumn("hop", F.lit(h).cast("long")))
        seen = seen.unionByName(front)
        if not front.limit(1).count():
            break
    return seen


def carried_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends share a label, with tags extended by ``taint:{label}`` for each label of both ends, in order."""
    a = labels.select(F.col("id").alias("src"), "label")
    b = labels.select(F.col("id").alias("dst"), "label")
    shared = edges.select("src", "dst", "edge_type").join(a, "src").join(b, ["dst", "label"])
    tags = shared.groupBy("src", "dst", "edge_type").agg(F.array_sort(F.collect_set(F.concat(F.lit("taint:"), "label"))).alias("more"))
    have = "tags" in edges.columns
    out = edges.join(tags, ["src", "dst", "edge_type"])
    old = F.coalesce("tags", F.array().cast("array<string>")) if have else F.array().cast("array<string>")
    return out.withColumn("tags", F.array_union(old, "more")).drop("more")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge: component is the least id that it is connected to.

    Alternating large-star and small-star rounds: the number of rounds is
    logarithmic in the diameter, and no neighbourhood is collected; each round
    takes minima by partial aggregation.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    loops = edges.select("src").union(edges.select("dst")).distinct().toDF("id")
    state, before = durable(pairs), None
    while True:
        both = state.union(state.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = durable(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small)
        release(state)
        release(large)
        state = new
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return loops.join(state.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def ranked_expansion(edges: DataFrame, roots: DataFrame, depth: int = 1, fanout: int = 96, decay: float = 0.72) -> DataFrame:
    """(qid, id, score, hop): neighbours of the roots (qid, id) with the best score on any path of at most `depth` steps.

    A step multiplies by decay, the edge's priority and the neighbour's degree
    penalty; a node walks its strongest `fanout` edges (ties: neighbour, kind).
    """
    tags = F.col("tags") if "tags" in edges.columns else F.lit(None).cast("array<string>")
    trace = F.col("trace_id") if "trace_id" in edges.columns else F.lit(None).cast("string")
    deg = degrees(edges).select("id", "degree")
    w = edges.select("src", "dst", "edge_type", edge_priority(F.col("edge_type"), tags, trace).alias("w"))
    adj = w.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type", "w").union(w.select("dst", "src", "edge_type", "w")).filter("a <> b")
    adj = strongest(adj, fanout, "w")
    adj = adj.groupBy("a", "b").agg(F.max("w").alias("w")).join(deg.withColumnRenamed("id", "b"), "b")
    adj = durable(adj.select("a", "b", (decay * F.col("w") / (1 + 0.14 * F.log1p("degree"))).alias("f")))
    best = roots.select("qid", "id").distinct().withColumn("score", F.lit(1.0)).withColumn("hop", F.lit(0).cast("long"))
    front = best
    for h in range(1, depth + 1):
        nxt = front.join(adj.withColumnRenamed("a", "id"), "id").select("qid", F.col("b").alias("id"), (F.col("score") * F.col("f")).alias("score"))
        front = durable(nxt.groupBy("qid", "id").agg(F.max("score").alias("score")).withColumn("hop", F.lit(h).cast("long")))
        best = best.unionByName(front)
    top = best.groupBy("qid", "id").agg(F.max(F.struct("score", (-F.col("hop")).alias("h"))).alias("t")).select("qid", "id", "t.score", (-F.col("t.h")).alias("hop"))
    return top.filter("hop > 0")


def predict_context(
    nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.7, reverse: float = 0.85, same_file: float = 0.15, fanout: int = 256
) -> DataFrame:
    """(qid, id, score, hop): likely next context of the seeds (qid, id), the seeds themselves left out.

    Scores merge as 1 - product(1 - contribution), contributions clamped to
    0.99. Level by level: a node passes on the score of the level on which it
    was first reached, times the edge's weight, the reverse discount against
    the direction, and decay. Nodes of a seed's file get `same_file` once and
    are not walked further.
    """
    w = edges.select("src", "dst", prefetch_weight(F.col("edge_type")).alias("w"))
    adj = w.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(w.select("dst", "src", F.col("w") * reverse)).filter("a <> b")
    adj = durable(strongest(adj, fanout, "w"))
    seeds = seeds.select("qid", "id").distinct()
    at = seeds.join(nodes.select("id", "file_path"), "id")
    mates = at.select("qid", F.col("id").alias("seed"), "file_path").join(nodes.select("id", "file_path"), "file_path").filter("id <> seed")
    gains = mates.select("qid", "id", F.lit(same_file).alias("c"), F.lit(1).cast("long").alias("hop"))
    seen = seeds.withColumn("hop", F.lit(0).cast("long"))
    front = seeds.withColumn("score", F.lit(1.0))
    for h in range(1, hops + 1):
        step = front.join(adj.withColumnRenamed("a", "id"), "id").select("qid", F.col("b").alias("id"), F.least(F.lit(0.99), F.col("score") * F.col("w") * decay).alias("c"))
        step = durable(step.withColumn("hop", F.lit(h).cast("long")))
        gains = gains.unionByName(step)
        if h < hops:
            new = step.groupBy("qid", "id").agg((1 - F.product(1 - F.col("c"))).alias("score")).join(seen, ["qid", "id"], "left_anti")
            front = durable(new)
            seen = seen.unionByName(front.select("qid", "id", F.lit(h).cast("long").alias("hop")))
    out = gains.groupBy("qid", "id").agg((1 - F.product(1 - F.col("c"))).alias("score"), F.min("hop").alias("hop"))
    return out.join(seeds, ["qid", "id"], "left_anti")


def trace_edges(steps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_type, tags, trace_id) of consecutive known steps (trace_id, pos, node), an edge once with all its traces.

    A step whose node is unknown breaks the pair on both sides and is never
    bridged; a step to itself is kept. trace_id is the greatest of the traces.
    """
    s = steps
    if known is not None:
        k = known.select(F.col("id").alias("node"), F.lit(True).alias("known"))
        s = steps.join(k, "node", "left")
    else:
        s = steps.withColumn("known", F.lit(True))
    s = lead_by_blocks(s, "trace_id", "pos", ["node", "known"])
    pairs = s.filter("known and next_known and next_node is not null").select(F.col("node").alias("src"), F.col("next_node").alias("dst"), "trace_id")
    marks = F.array_sort(F.collect_set(F.concat(F.lit("trace:"), F.col("trace_id").cast("string"))))
    out = pairs.groupBy("src", "dst").agg(F.max("trace_id").cast("string").alias("trace_id"), marks.alias("t"))
    return out.select("src", "dst", F.lit("References").alias("edge_type"), F.concat(F.array(F.lit("execution-trace")), "t").alias("tags"), "trace_id")


#: Most nodes of a snapshot, links per node and links in all.
SNAPSHOT_NODES, LINKS_PER_NODE, LINKS = 10_000, 8, 50_000


def connected_first(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, links) of a snapshot of at most `limit` nodes.

    Edges are walked by the sum of their ends' degrees, greatest first (ties:
    src, dst), and both ends are taken while they fit; the rest is filled by
    degree, ties by id. Links among the nodes follow in the same order, at most
    min(8 per node, 50,000). The walk streams sorted edges to the driver and
    stops when the snapshot is full: what it keeps is at most 10,000 ids.
    """
    limit = max(1, min(limit, SNAPSHOT_NODES))
    known = nodes.select("id")
    e = edges.select("src", "dst").distinct().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = durable(e)
    deg = durable(degrees(e).select("id", "degree"))
    ranked = e.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    ranked = durable(ranked.select("src", "dst", (F.col("ds") + F.col("dd")).alias("w")))
    kept: dict[str, None] = {}
    for r in ranked.orderBy(F.desc("w"), "src", "dst").toLocalIterator():
        new = [x for x in dict.fromkeys((r[0], r[1])) if x not in kept]
        if len(kept) + len(new) <= limit:
            kept.update(dict.fromkeys(new))
        if len(kept) >= limit:
            break
    spark = nodes.sparkSession
    chosen = spark.createDataFrame([(k,) for k in kept], "id string")
    allnodes = nodes.join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rest = allnodes.join(chosen, "id", "left_anti").orderBy(F.desc("degree"), "id").limit(limit - len(kept))
    out = durable(allnodes.join(chosen, "id", "left_semi").unionByName(rest))
    ids = out.select("id")
    links = ranked.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out, links.orderBy(F.desc("w"), "src", "dst").limit(min(LINKS_PER_NODE * limit, LINKS)).select("src", "dst")
