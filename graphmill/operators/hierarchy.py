"""Parent-child rows to full hierarchies: cycles, paths, depth, root, descendants.

Every loop below is pointer doubling over one row per node, so the number of
rounds grows with the logarithm of the depth, not with the depth, and no group
(a tree, a chain, the children of one parent) is ever collected into one task.

Stages

1. ``cycle_nodes`` separates the nodes on cycles. Jumps of length 2^k are
   squared and restricted to their own image; when the image stops shrinking
   the jump is a bijection on it, which is true of the nodes on cycles only.
2. ``heavy_paths`` cuts the links of cycle nodes (each then heads what hangs
   below it) and decomposes the forest: subtree sizes by doubling, the heavy
   child of each node, chain head, position in the chain, and the chain's
   path segment. Path and pre-order number of a node are those of its chain's
   head plus its own segment and position; a root path crosses at most
   log2(n) chains, and the chain tree is doubled as well.
3. ``descendants`` lists pairs: a node's ancestors are prefixes of at most
   log2(n) chains, so pairs come from an equi-join on the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmill.functions.paths import plain_ref
from graphmill.operators.skew import skew_join
from graphmill.session import durable, release

#: Siblings are numbered in this many blocks, so that no window holds all children of one parent.
SIBLING_BLOCKS = 64


def current_rows(df: DataFrame, key: str, version: str, cols: list[str]) -> DataFrame:
    """One row per key: the one with the greatest `version`; ties go to the greatest values of `cols`.

    Rows with a null key are dropped; a null version is older than any other.
    Partial aggregation keeps one candidate per key before the shuffle.
    """
    best = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in cols])).alias("_b")
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(best)
    return out.select(key, F.col("_b._v").alias(version), *[F.col(f"_b.{c}").alias(c) for c in cols])


def parent_links(
    rows: DataFrame,
    node: str = "id",
    parent: str = "parent_id",
    children: str = "children",
    plain=plain_ref,
) -> DataFrame:
    """(node, parent) of one row per node; parent null where there is none.

    The parent is `parent` where it is not null or blank, else the node whose
    `children` lists this one (the least such node where several do). A link to
    a node without a row is no link. Null and blank entries of children are
    ignored. An empty table gives no rows.
    """
    own = rows.select(F.col(node).alias("node"), F.nullif(plain(F.col(parent)), F.lit("")).alias("named"))
    listed = (
        rows.select(F.col(node).alias("lister"), F.explode(F.col(children)).alias("c"))
        .select("lister", F.nullif(plain(F.col("c")), F.lit("")).alias("node"))
        .filter("node is not null")
        .groupBy("node")
        .agg(F.min("lister").alias("lister"))
    )
    wanted = durable(own.join(listed, "node", "left").select("node", F.coalesce("named", "lister").alias("parent")))  # read for its hot keys, too
    known = own.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    return skew_join(wanted, known, "parent").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"))


def _next(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next round's table in place of the old one."""
    table = durable(new)
    release(old)
    return table


def cycle_nodes(links: DataFrame) -> DataFrame:
    """(node, cycle_id) of every node on a cycle of (node, parent); cycle_id is the least node of the cycle.

    A node that is its own parent is a cycle of one. Nodes that hang below a
    cycle are not on it. Null parents are no links; no rows give no rows. A row
    stays while some row jumps to it and its own target stays; a round in which
    none leaves is the last.
    """
    first = durable(links.filter("parent is not null").select("node", F.col("parent").alias("jump")))
    # most nodes have no children and leave at once
    state = durable(first.join(first.select(F.col("jump").alias("node")).distinct(), "node", "left_semi"))
    before = state.count()
    while before:
        # restrict the jumps to their image, and square them
        image = state.select(F.col("jump").alias("node")).distinct()
        on = state.join(image, "node", "left_semi")
        new = durable(skew_join(on, state.select(F.col("node").alias("jump"), F.col("jump").alias("far")), "jump", "inner").select("node", F.col("far").alias("jump")))
        release(state)
        state, now = new, new.count()
        if now == before:  # nothing left the table: the jump is a bijection on it
            break
        before = now
    ring = first.join(state.select("node"), "node", "left_semi").withColumn("cycle_id", F.least("node", "jump"))
    ring = durable(ring)
    while True:
        far = ring.select(F.col("node").alias("jump"), F.col("jump").alias("far"), F.col("cycle_id").alias("seen"))
        nxt = ring.join(far, "jump").select(
            "node",
            F.col("far").alias("jump"),
            F.least("cycle_id", "seen").alias("cycle_id"),
            (F.col("seen") < F.col("cycle_id")).alias("less"),
        )
        ring = _next(ring, nxt)
        if not ring.filter("less").limit(1).count():
            return ring.select("node", "cycle_id")


def _double(state: DataFrame, up: str, carry: dict[str, Column], extra=None) -> DataFrame:
    """Square the pointer `up` of a one-row-per-node table until it is null everywhere.

    carry: column -> expression over this row's columns and the far row's, which are prefixed ``far_``.
    """
    cols = [c for c in state.columns if c not in ("node", up)]
    keep = [carry.get(c, F.col(c)).alias(c) for c in cols]
    state = durable(state)
    if extra is not None:  # every row may change in every round
        while state.filter(F.col(up).isNotNull()).limit(1).count():
            far = state.select(F.col("node").alias(up), F.col(up).alias("far_up"), *[F.col(c).alias(f"far_{c}") for c in cols])
            state = _next(state, skew_join(extra(state), far, up).select("node", F.col("far_up").alias(up), *keep))
        return state
    # finished rows are written once and only looked up from then on
    done = state.filter(F.col(up).isNull())
    active = state.filter(F.col(up).isNotNull())
    while active.limit(1).count():
        every = done.unionByName(active)
        far = every.select(F.col("node").alias(up), F.col(up).alias("far_up"), *[F.col(c).alias(f"far_{c}") for c in cols])
        step = durable(skew_join(active, far, up).select("node", F.col("far_up").alias(up), *keep))
        done, active = done.unionByName(step.filter(F.col(up).isNull())), step.filter(F.col(up).isNotNull())
    return done


def heavy_paths(links: DataFrame, cycles: DataFrame | None = None, names: DataFrame | None = None, sep: str = " > ") -> DataFrame:
    """One row per node of the forest with its place in it.

    Columns: node, parent (null at a root and on a cycle), root, depth (0 at a
    root), path (names from the root down, joined by `sep`), chain (its head),
    chain_pos, chain_up (the head's parent), subtree_size, pre (0 at the root;
    the descendants of a node are those of its root with pre in
    (pre, pre + subtree_size)), cycle_id (null unless the node lies on a cycle)
    and root_cycle_id (that of its root: not null for what hangs below a cycle).

    A node on a cycle counts as a root; the cycle itself is told by cycle_id.
    names: (node, name); the node itself where there is none.
    """
    cycles = cycle_nodes(links) if cycles is None else cycles
    on = cycles.select("node", "cycle_id")
    base = links.select("node", "parent").join(on, "node", "left")
    base = base.withColumn("parent", F.when(F.col("cycle_id").isNull(), F.col("parent")))
    if names is None:
        base = base.withColumn("name", F.col("node"))
    else:
        base = base.join(names.select("node", "name"), "node", "left").withColumn("name", F.coalesce("name", "node"))
    base = durable(base)

    def with_size(s: DataFrame) -> DataFrame:
        below = s.filter("up is not null").groupBy("up").agg(F.sum("size").alias("more"))
        out = s.join(below.withColumnRenamed("up", "node"), "node", "left")
        return out.withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")

    first = base.select(
        "node",
        F.col("parent").alias("up"),
        F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),
        F.coalesce("parent", "node").alias("root"),
        F.lit(1).cast("long").alias("size"),
    )
    placed = _double(
        first,
        "up",
        {
            "depth": F.col("depth") + F.coalesce("far_depth", F.lit(0)),
            "root": F.coalesce("far_root", "root"),
        },
        with_size,
    )
    sized = durable(base.join(placed.select("node", "depth", "root", "size"), "node"))

    heavy = (
        sized.filter("parent is not null")
        .groupBy("parent")
        .agg(F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("h"))
        .select(F.col("h.node").alias("node"), F.lit(True).alias("is_heavy"), (-F.col("h.s")).alias("heavy_size"))
    )
    sized = durable(sized.join(heavy, "node", "left").withColumn("is_heavy", F.coalesce("is_heavy", F.lit(False))))
    chains = _double(
        sized.select(
            "node",
            F.when(F.col("is_heavy"), F.col("parent")).alias("up"),
            F.col("node").alias("chain"),
            F.lit(1).cast("long").alias("pos"),
            F.col("name").alias("seg"),
        ),
        "up",
        {
            "chain": F.coalesce("far_chain", "chain"),
            "pos": F.col("pos") + F.coalesce("far_pos", F.lit(0)),
            "seg": F.concat(F.coalesce(F.concat("far_seg", F.lit(sep)), F.lit("")), F.col("seg")),
        },
    ).withColumn("pos", F.col("pos") - 1)
    nodes = durable(sized.join(chains.drop("up"), "node"))

    # light children of one parent: each starts after the heavy subtree and the light ones before it
    light = nodes.filter("parent is not null and not is_heavy").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BLOCKS))
    )
    inside = F.sum("size").over(W.partitionBy("parent", "block").orderBy("node").rowsBetween(W.unboundedPreceding, -1))
    per_block = light.groupBy("parent", "block").agg(F.sum("size").alias("total"))
    ahead = F.sum("total").over(W.partitionBy("parent").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    per_block = per_block.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("total")
    heads = light.withColumn("inside", F.coalesce(inside, F.lit(0))).join(per_block, ["parent", "block"])
    of_parent = nodes.select(F.col("node").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("p_pos"), F.col("seg").alias("p_seg"))
    of_heavy = nodes.filter("is_heavy").select("parent", F.col("size").alias("h_size"))
    heads = skew_join(skew_join(heads, of_parent, "parent", "inner"), of_heavy, "parent")
    heads = heads.select(
        "node",
        "up",
        (F.col("p_pos") + 1 + F.coalesce("h_size", F.lit(0)) + F.col("ahead") + F.col("inside")).alias("start"),
        F.col("p_seg").alias("lead"),
        F.col("parent").alias("chain_up"),
    )
    tops = nodes.filter("parent is null").select(
        "node", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("lead"), F.lit(None).cast("string").alias("chain_up")
    )
    joined = F.when(F.col("far_lead").isNull(), F.col("lead")).otherwise(F.concat("far_lead", F.lit(sep), "lead"))
    heads = _double(heads.unionByName(tops), "up", {"start": F.col("start") + F.coalesce("far_start", F.lit(0)), "lead": joined})
    out = skew_join(nodes, heads.drop("up").withColumnRenamed("node", "chain"), "chain", "inner")
    marks = on.select(F.col("node").alias("root"), F.col("cycle_id").alias("root_cycle_id"))
    out = out.select(
        "node",
        "parent",
        "root",
        "depth",
        F.concat(F.coalesce(F.concat("lead", F.lit(sep)), F.lit("")), F.col("seg")).alias("path"),
        "chain",
        F.col("pos").alias("chain_pos"),
        "chain_up",
        F.col("size").alias("subtree_size"),
        (F.col("start") + F.col("pos")).alias("pre"),
        "cycle_id",
    )
    return skew_join(out, marks, "root")


def descendants(placed: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every node and each node below it, from `heavy_paths`.

    The size of the result is the sum of all depths. Ancestors in one chain are
    a prefix of it, so pairs are made by an equi-join on the chain with a bound
    on the position.
    """
    placed = durable(placed.select("node", "depth", "chain", "chain_pos", "chain_up"))
    seat = placed.select(F.col("node").alias("chain_up"), F.col("chain").alias("on_chain"), F.col("chain_pos").alias("upto"))
    tops = placed.filter("chain_pos = 0").select("chain", "chain_up")
    step = durable(skew_join(tops.filter("chain_up is not null"), seat, "chain_up", "inner").select("chain", "on_chain", "upto"))
    above, front = step, step
    while True:
        far = step.select(F.col("chain").alias("on_chain"), F.col("on_chain").alias("next"), F.col("upto").alias("upto2"))
        front = durable(skew_join(front, far, "on_chain", "inner").select("chain", F.col("next").alias("on_chain"), F.col("upto2").alias("upto")))
        if not front.limit(1).count():
            break
        above = above.unionByName(front)
    lower = placed.select(F.col("node").alias("descendant"), F.col("depth").alias("d"), "chain", "chain_pos")
    own = lower.select("descendant", "d", F.col("chain").alias("on_chain"), (F.col("chain_pos") - 1).alias("upto"))
    other = lower.join(above, "chain").select("descendant", "d", "on_chain", "upto")
    upper = placed.select("node", "depth", F.col("chain").alias("on_chain"), "chain_pos")
    pairs = own.filter("upto >= 0").unionByName(other).join(upper, "on_chain").filter("chain_pos <= upto")
    return pairs.select("node", "descendant", (F.col("d") - F.col("depth")).alias("distance"))
