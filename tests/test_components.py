"""The registered components query against union-find."""

from graphmill.plans import fixtures as X
from graphmill.plans import q_graph


def test_components_of_all_edges(spark, sf):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in X.edges(spark, sf).collect():
        a, b = sorted((root(e.src), root(e.dst)))
        up[b] = a  # the least id is the root
    got = [(r.id, r.component) for r in q_graph.queries()["components_full"](spark, sf).collect()]
    assert len(got) == len(up) and dict(got) == {x: root(x) for x in up}
    assert {i[0] for i in up} >= set("cnops")
