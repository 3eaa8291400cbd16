"""Strong components, rings and cycles against a search in Python."""

import random

from corpusmill.operators import graph


def reach(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for s, d in edges:
                if s == todo[-1] and d not in seen:
                    break
            else:
                todo.pop()
                continue
            seen.add(d)
            todo.append(d)
        out[a] = seen
    return out


def components(edges):
    r = reach([e for e in edges if e[0] != e[1]])
    return {(a, max(b for b in r[a] if a in r[b])) for a in r if a in r[a]}


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(3)


def test_components_equal_a_search(spark):
    rng = random.Random(12)
    edges = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(24)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("y", "x"), ("y", "a")]
    got = {(r.node, r.component) for r in graph.strong_components(table(spark, edges + edges[:3])).collect()}
    assert got == components(edges) and len({c for _, c in got}) >= 3


def test_a_ring_of_fifty_and_what_hangs_on_it(spark):
    names = [f"r{(i * 17) % 50:02}" for i in range(50)]
    edges = list(zip(names, names[1:] + names[:1], strict=True)) + [("in", "r03"), ("r04", "out"), ("p", "q"), ("q", "p"), ("q", "z"), ("z", "q")]
    at = names.index("r00")
    ring = graph.rings(table(spark, edges)).collect()
    assert [(r.length, r.cycle) for r in ring] == [(50, " -> ".join(names[at:] + names[:at]))]
    sizes = {tuple(r) for r in graph.component_sizes(table(spark, edges)).collect()}
    assert sizes == {("r49", 50, 50, True), ("z", 3, 4, False)}
    for exact in (False, True):
        assert {r.cycle for r in graph.cycles(table(spark, edges), exact=exact).collect()} == {"p -> q", "q -> z"}


def test_no_cycles(spark):
    for edges in ([("a", "b"), ("b", "c")], [("a", "a")]):
        assert graph.strong_components(table(spark, edges)).collect() == [] and graph.rings(table(spark, edges)).collect() == []
    assert [r.cycle for r in graph.cycles(table(spark, [("a", "a"), ("a", "b")])).collect()] == ["a"]
