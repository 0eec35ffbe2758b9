"""Hierarchies, snapshot changes and orphan references against brute force and defined edge cases."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import compare
from graphmill.functions.paths import plain_ref
from graphmill.operators import hierarchy as H
from graphmill.operators import orphans as O
from graphmill.operators import snapshots as S
from graphmill.operators.skew import lead_by_blocks, skew_join
from graphmill.plans import problems


def test_plain_ref(spark):
    rows = [(" a/./b/../c#x/./y:L1C1\n", "a/c#x/./y:L1C1"), ("../a//b#z", "../a/b#z"), ("/a/../../b", "/b"), ("a\\b\\c", "a/b/c"), ("", ""), (None, None), ("a", "a")]
    df = spark.createDataFrame(rows, "p string, want string").withColumn("got", plain_ref(F.col("p")))
    assert [(r.want, r.got) for r in df.collect() if r.want != r.got] == []


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, v long")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, w long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a = sorted(map(str, skew_join(left, right, "k", how).collect()))
        assert a == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError):
        skew_join(left, right, "k", "full")


def test_lead_by_blocks(spark):
    rnd = random.Random(1)
    rows = [(k, p, f"{k}{p}" if rnd.random() > 0.2 else None) for k in "ab" for p in rnd.sample(range(60), 25)]
    got = {(r.k, r.p): r.next_v for r in lead_by_blocks(spark.createDataFrame(rows, "k string, p long, v string"), "k", "p", ["v"], 7).collect()}
    want = {}
    for k in "ab":
        mine = sorted(((p, v) for q, p, v in rows if q == k), key=lambda t: t[0])
        want |= {(k, p): v for (p, _), (_, v) in zip(mine, [*mine[1:], (None, None)])}
    assert got == want


def _brute_cycles(par):
    out = {}
    for v in par:
        seen, x = [], v
        while x is not None and x not in seen:
            seen.append(x)
            x = par.get(x)
        if x == v:
            out[v] = min(seen)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_walks(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:03d}" for i in range(60)]
    par = {v: (rnd.choice(names[: max(1, i)]) if i and rnd.random() > 0.1 else None) for i, v in enumerate(names)}
    par["n007"] = "n007"
    par["n020"], par["n021"], par["n022"] = "n022", "n020", "n021"
    for i in range(40, 60):
        par[names[i]] = names[i - 1]
    links = spark.createDataFrame(list(par.items()), "node string, parent string")
    cyc = H.cycle_nodes(links)
    want = _brute_cycles(par)
    assert {r.node: r.cycle_id for r in cyc.collect()} == want
    placed = H.heavy_paths(links, cyc)
    rows = {r.node: r for r in placed.collect()}
    cut = {v: (None if v in want else p) for v, p in par.items()}
    pairs = set()
    for v in names:
        walk = [v]
        while cut[walk[-1]] is not None:
            walk.append(cut[walk[-1]])
        r = rows[v]
        assert (r.depth, r.root, r.path) == (len(walk) - 1, walk[-1], " > ".join(reversed(walk)))
        assert r.root_cycle_id == want.get(walk[-1])
        pairs |= {(a, v, k) for k, a in enumerate(walk) if k}
    assert {(r.node, r.descendant, r.distance) for r in H.descendants(placed).collect()} == pairs
    inside = {(a, v) for a in names for v in names if rows[a].root == rows[v].root and rows[a].pre < rows[v].pre < rows[a].pre + rows[a].subtree_size}
    assert inside == {(a, v) for a, v, _ in pairs}


def test_parent_links_rules(spark):
    rows = spark.createDataFrame(
        [("b", None, ["c", " x ", None, ""]), ("c", "  ", None), ("d", "gone", []), ("e", "./b", None), ("a", None, ["c"])],
        "id string, parent_id string, children array<string>",
    )
    assert {r.node: r.parent for r in H.parent_links(rows).collect()} == {"a": None, "b": None, "c": "a", "d": None, "e": "b"}


def test_hierarchy_of_nothing(spark):
    links = spark.createDataFrame([], "node string, parent string")
    assert H.cycle_nodes(links).count() == 0
    placed = H.heavy_paths(links)
    assert placed.count() == 0 and H.descendants(placed).count() == 0


def _t(h):
    return datetime(2024, 1, 1, h)


def test_snapshot_changes(spark):
    runs = spark.createDataFrame(
        [
            (1, "r", _t(1), "completed", "AA"), (2, "r", _t(2), "failed", "AA"), (3, "r", _t(3), "completed", "algo:aa"),
            (4, "r", _t(4), "completed", "bb"), (5, "r", _t(5), "completed", None), (6, "r", _t(6), "completed", "cc"), (7, "q", _t(1), "completed", "cc"),
        ],
        "run_id long, repo string, started_at timestamp_ntz, status string, merkle_root string",
    )
    rows = spark.createDataFrame(
        [
            (1, "a", "H1", "f( x )", _t(1)), (1, "a", "zz", "f(x)", _t(0)), (1, "b", None, "g (x)", _t(1)), (1, "c", "h3", None, _t(1)), (1, None, "h", "s", _t(1)),
            (4, "a", " algo:h1", "other", _t(4)), (4, "b", "h9", "g(x)", _t(4)), (4, "d", "", None, _t(4)), (4, "d", "", None, _t(4)),
        ],
        "run_id long, id string, ast_hash string, signature string, loaded_at timestamp_ntz",
    )
    pairs = S.run_pairs(runs, rows)
    # run 3 repeats run 1; run 5 has no root and no rows, so it is empty, and run 6 is empty as well
    assert {(r.run_id, r.cur_run, r.prev_run) for r in pairs.collect()} == {(4, 4, 1), (5, None, 4)}
    got = {(r.run_id, r.id, r.change) for r in S.snapshot_changes(rows, pairs).collect()}
    assert got == {(4, "c", "removed"), (4, "d", "added"), (5, "a", "removed"), (5, "b", "removed"), (5, "d", "removed")}


def test_orphans_by_mask(spark):
    refs = spark.createDataFrame(
        [(1, "p", "x", _t(5)), (2, "p", None, _t(5)), (3, "q", None, _t(5)), (4, None, None, _t(5)), (5, "p", "y", _t(1)), (6, "p", "z", _t(9)), (7, "p", "no", None), (8, None, "x", _t(5))],
        "n long, a string, b string, at timestamp_ntz",
    )
    rows = spark.createDataFrame([("p", "x", _t(2), None), ("p", "y", _t(3), None), ("p", "z", _t(1), None), ("p", "z", _t(2), _t(8))], "a string, b string, v timestamp_ntz, d timestamp_ntz")
    targets = {(True, True): O.target_life(rows, ["a", "b"], "v", "d"), (True, False): O.target_life(rows, ["a"])}

    refs = refs.withColumn("k", F.lit("clash")).withColumn("born", F.lit("clash"))

    def run(match):
        return {(r.n, r.reason) for r in O.orphan_references(refs, ["a", "b"], targets, "at", match).collect()}

    full = {(5, "late"), (6, "deleted"), (7, "missing")}
    assert run("simple") == full
    assert run("partial") == full | {(3, "missing")}
    assert run("full") == full | {(2, "missing"), (3, "missing"), (8, "missing")}
    with pytest.raises(ValueError):
        run("other")


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p4_changes_per_run", "p7_found", "p7_per_month"])
def test_against_sql(spark, sf, name):
    got, want = compare.bags(problems.queries()[name](spark, sf), compare.connect(sf), problems.oracle_sql()[name])
    assert got == want
