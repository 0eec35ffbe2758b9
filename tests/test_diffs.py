"""Bounds of tree differences are told."""

from graphmill.operators import diffs


def test_bounds_are_told(spark):
    lines = lambda mark, n: "\n".join(f"{mark}{i}" for i in range(n))
    rows = [(1, lines("a", 2_100), ""), (2, lines("a", 600), lines("b", 600)), (3, "x\ny", "x\nz"), (4, lines("a", diffs.MAX_CHANGES), "")]
    got = diffs.diff_pairs(spark.createDataFrame(rows, "id long, old string, new string"), "id", "old", "new").collect()
    flags = {i: {(r.bounded, r.truncated) for r in got if r.id == i} for i in (1, 2, 3, 4)}
    assert flags == {1: {(False, True)}, 2: {(True, False)}, 3: {(False, False)}, 4: {(False, False)}}
    assert sum(r.id == 1 for r in got) == diffs.MAX_CHANGES
