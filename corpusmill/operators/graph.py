"""Graphs as edge tables (src, dst): neighbours, cycles, reach, summaries, and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import kept

# How languages name what they import.
IMPORTS = (r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import", r"""(?:from|require\()\s*['"]([^'"]+)['"]""", r'href="([^"]+)"')


def extracted(files: DataFrame) -> DataFrame:
    """(src, dst) from each file to what it imports or links to."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in IMPORTS]))
    return files.select(F.col("path").alias("src"), F.explode(found).alias("dst"))


def callers(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src").distinct()


def callees(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst").distinct()


def hot_paths(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("callers")).orderBy(F.desc("callers"), "dst").limit(n)


def _wide(df: DataFrame) -> DataFrame:
    """A side of a join in a loop: never broadcast, as each round would send it to the driver once more."""
    return df.hint("merge")


def trimmed(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Edges without nodes that nothing enters or leaves, taken off some rounds long: no cycle loses an edge."""
    now = kept(edges.select("src", "dst").distinct(), "edges")
    n = now.count()
    for _ in range(rounds):
        less = now.join(_wide(now.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_wide(now.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        now = kept(less.select("src", "dst"), "edges")
        m = now.count()
        if m == n:
            break
        n = m
    return now


def _highest(edges: DataFrame) -> DataFrame:
    """(node, top): the largest node from which each node can be reached, itself included.

    Each round takes the largest top of the nodes before, and that of an ancestor twice as far as in the round before; so a long chain takes
    as many rounds as its length has binary digits.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    before = edges.groupBy(F.col("dst").alias("node")).agg(F.max("src").alias("far"))
    now = kept(nodes.join(_wide(before), "node", "left").select("node", F.col("node").alias("top"), F.coalesce("far", "node").alias("far"), F.lit(True).alias("moved")), "tops")
    while not now.where("moved").isEmpty():
        near = edges.join(_wide(now.select(F.col("node").alias("src"), "top")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("top").alias("near"))
        jump = now.select(F.col("node").alias("far"), F.col("top").alias("far_top"), F.col("far").alias("farther"))
        top = F.greatest("top", "near", "far_top")  # nulls are passed over
        now = kept(now.join(_wide(near), "node", "left").join(_wide(jump), "far").select("node", top.alias("top"), F.col("farther").alias("far"), (top != F.col("top")).alias("moved")), "tops")
    return now.select("node", "top")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that lie on a cycle of two nodes or more; component is its largest node.

    Forward and backward colouring: nodes with the same largest ancestor form a class, components never cross classes, and those nodes of a class that reach
    that ancestor are its component. What is left of each class goes into the next round, without nodes that nothing enters or leaves.
    """
    rest, out = trimmed(edges.where("src <> dst")), None
    while not rest.isEmpty():
        colour = kept(_highest(rest), "colours")
        side = lambda c: _wide(colour.select(F.col("node").alias(c), F.col("top").alias(f"{c}_top")))
        inside = kept(rest.join(side("src"), "src").join(side("dst"), "dst").where("src_top = dst_top").select("src", "dst"), "classes")
        back = _highest(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = kept(colour.join(_wide(back.withColumnRenamed("top", "low")), "node").where("top = low").select("node", F.col("top").alias("component")), "components")
        found = found.join(_wide(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "component", "left_semi").select("node", "component")
        out = found if out is None else out.union(found)
        left = lambda df, c: df.join(_wide(found.select(F.col("node").alias(c))), c, "left_anti")
        rest = trimmed(left(left(inside, "src"), "dst").select("src", "dst"))
    return out if out is not None else edges.where("false").select(F.col("src").alias("node"), F.col("src").alias("component"))


def _within(edges: DataFrame) -> DataFrame:
    """(component, src, dst): the edges inside strong components."""
    c = strong_components(edges)
    side = lambda n: _wide(c.select(F.col("node").alias(n), F.col("component").alias(f"{n}_c")))
    e = edges.where("src <> dst").select("src", "dst").distinct()
    return kept(e.join(side("src"), "src").join(side("dst"), "dst").where("src_c = dst_c").select(F.col("src_c").alias("component"), "src", "dst"), "inside")


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, nodes, edges, ring) of the strong components of two nodes or more; a ring has as many edges as nodes and is one cycle."""
    out = _within(edges).groupBy("component").agg(F.countDistinct("src").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return out.withColumn("ring", F.col("nodes") == F.col("edges"))


def _simple_rings(edges: DataFrame) -> DataFrame:
    """(node, component, steps) of trimmed edges: the nodes of rings that no other edge enters or leaves, with the ring's smallest node and the steps to it.

    Each round joins what a node knows of the nodes ahead of it with what the node behind those knows, twice as far ahead. A node from which one comes to a
    fork or a join is in no such ring. A round that changes nothing is the last one, as the distances to the smallest node, or to a fork, are all numbers up to the largest.
    """
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("to")).union(edges.select("dst", F.lit(0), F.lit(1), F.lit(None).cast("string")))
    nodes = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("to").alias("ahead")).where("o = 1 and i = 1")
    now = kept(nodes.select("node", "ahead", F.col("node").alias("low"), F.lit(0).alias("steps"), F.lit(True).alias("moved")), "rings")
    reach, n, m = 1, -1, now.count()
    while m and (m < n or not now.where("moved").isEmpty()):
        n = m
        far = now.select(F.col("node").alias("ahead"), F.col("ahead").alias("farther"), F.col("low").alias("far_low"), (F.col("steps") + reach).alias("far_steps"))
        lower = F.col("far_low") < F.col("low")
        step = now.join(_wide(far), "ahead").select("node", F.col("farther").alias("ahead"), F.when(lower, F.col("far_low")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("far_steps")).otherwise(F.col("steps")).alias("steps"), lower.alias("moved"))
        now, reach = kept(step, "rings"), 2 * reach
        m = now.count()
    return now.select("node", F.col("low").alias("component"), "steps")


def rings(edges: DataFrame) -> DataFrame:
    """(length, cycle) of the components that are one cycle, of any length, written from its smallest node on.

    Rings that stand alone once the graph is trimmed are found first; the rest goes through its strong components. A node's place is found by
    doubling: each round adds up the steps to a node twice as far ahead.
    """
    some = trimmed(edges.where("src <> dst"))
    alone = _simple_rings(some)
    rest = kept(some.join(_wide(alone.select(F.col("node").alias("src"))), "src", "left_anti").select("src", "dst"), "rest")
    places = alone if rest.isEmpty() else alone.union(_tangled_rings(rest))
    at = F.struct((F.when(F.col("steps") > 0, -F.col("steps")).otherwise(F.lit(-(2**31) + 1))).alias("place"), "node")  # from the smallest node on, then the one farthest from it
    out = places.groupBy("component").agg(F.array_sort(F.collect_list(at)).alias("nodes"))  # one row a cycle, as long as the cycle
    return out.select(F.size("nodes").alias("length"), F.array_join(F.col("nodes.node"), " -> ").alias("cycle"))


def _tangled_rings(edges: DataFrame) -> DataFrame:
    """(node, component, steps) as `_simple_rings`, of the strong components that are one cycle."""
    inside = _within(edges)
    sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("src").alias("n")).where("m = n")
    return _simple_rings(kept(inside.join(_wide(sizes.select("component")), "component").select("src", "dst"), "rings"))


def cycles(edges: DataFrame, longest: int = 4, exact: bool = False) -> DataFrame:
    """(length, cycle) of all simple cycles of up to `longest` nodes, each written from its smallest node on; see `rings` for cycles of any length.

    `exact`: follow paths inside strong components only, which pays where `longest` is large; else the graph is only trimmed.
    """
    out = edges.where("src = dst").select("src").distinct().select(F.lit(1).alias("length"), F.array("src").alias("nodes"))
    e = _within(edges).select("src", "dst") if exact else trimmed(edges)
    paths = e.where("src < dst").select(F.array("src", "dst").alias("nodes"))
    for length in range(2, longest + 1):
        first, last = F.get("nodes", F.lit(0)), F.element_at("nodes", -1)
        closing = paths.select("nodes", last.alias("src"), first.alias("dst")).join(e, ["src", "dst"])
        out = out.union(closing.select(F.lit(length).alias("length"), "nodes"))
        if length < longest:
            longer = paths.select("nodes", last.alias("src")).join(e, "src").where((F.col("dst") > first) & ~F.array_contains("nodes", F.col("dst")))
            paths = kept(longer.select(F.concat("nodes", F.array("dst")).alias("nodes")), "paths")
    return out.select("length", F.array_join("nodes", " -> ").alias("cycle"))


def reaching(edges: DataFrame, node: str, deepest: int = 10) -> DataFrame:
    """(node, depth) of all nodes from which `node` can be reached in at most `deepest` steps."""
    e = edges.select("src", "dst").distinct()
    seen = kept(e.sparkSession.createDataFrame([(node, 0)], "node string, depth int"), "reach")
    front = seen
    for depth in range(1, deepest + 1):
        new = e.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = kept(new.select("node", F.lit(depth).alias("depth")), "reach")
        if front.isEmpty():
            break
        seen = kept(seen.union(front), "reach")
    return seen.where("depth > 0")


def unused(defined: DataFrame, edges: DataFrame) -> DataFrame:
    """Definitions (kind, name) that no edge refers to."""
    return defined.join(edges.select(F.col("dst").alias("name")).distinct(), "name", "left_anti").select("kind", "name")


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, sources that nothing enters, sinks that nothing leaves, self-loops."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("i") == 0).alias("sources"), F.count_if(F.col("o") == 0).alias("sinks"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops")))


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """Edges of lines like `a -> b`: from the first part to the last, spaces as underscores."""
    rows = texts.select(F.explode(F.split(text, "\n")).alias("line")).where(F.contains("line", F.lit("->")))
    end = lambda i: F.replace(F.trim(F.element_at(F.split("line", "->"), i)), F.lit(" "), F.lit("_"))
    return rows.select(end(1).alias("src"), end(-1).alias("dst"))


def _chart(lines: Column, none: str) -> Column:
    return F.concat(F.lit("flowchart LR\n"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(f"  {none}")))


def mermaid(edges: DataFrame, by: str | None = None) -> DataFrame:
    """A flow chart of all edges in order, one row or one for each value of `by`. A chart is one string; large graphs want a column to part them by."""
    keys = [by] if by else []
    lines = F.array_sort(F.collect_list(F.concat(F.lit("  "), F.col("src"), F.lit(" --> "), F.col("dst"))))
    return edges.select(*keys, "src", "dst").distinct().groupBy(*keys).agg(_chart(lines, "no_data[No dependency data to graph]").alias("mermaid"))


def mermaid_cycles(found: DataFrame, n: int = 5) -> DataFrame:
    """One row with a chart of the first `n` of the cycles that `cycles` gives, a coloured subgraph each; nodes carry the cycle's number."""
    first = found.where("length > 1").orderBy("length", "cycle").limit(n).withColumn("i", F.row_number().over(Window.orderBy("length", "cycle")) - 1)
    name = lambda x: F.concat(x, F.lit("_"), F.col("i").cast("string"))
    nodes = F.split("cycle", " -> ")
    steps = F.zip_with(nodes, F.concat(F.slice(nodes, 2, F.size(nodes)), F.slice(nodes, 1, 1)), lambda a, b: F.concat(F.lit("  "), name(a), F.lit(" --> "), name(b)))
    i = F.col("i").cast("string")
    part = F.concat_ws("\n", F.concat(F.lit("subgraph C"), i, F.lit(" [Cycle "), (F.col("i") + 1).cast("string"), F.lit("]")), F.array_join(steps, "\n"), F.lit("end"), F.concat(F.lit("style C"), i, F.lit(" fill:#ffcccc,stroke:#ff0000")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("part")))), lambda x: x["part"])
    return first.agg(_chart(parts, "no_cycles[No cycles detected]").alias("mermaid"))


def mermaid_summary(edges: DataFrame) -> DataFrame:
    """One row with a chart of the graph's figures."""
    s = summary(edges)
    return s.select(F.concat(F.lit("flowchart LR\n"), F.concat_ws("\n", *[F.concat(F.lit(f"  graph --> {c}["), F.col(c).cast("string"), F.lit(f" {c}]")) for c in ("nodes", "edges", "sources", "sinks", "loops")])).alias("mermaid"))


def tests_for(symbols: DataFrame, lines: DataFrame, n: int = 10) -> DataFrame:
    """(symbol, path, line_no): the first lines of test files that name a symbol; an equality join on the lines' words."""
    words = lines.where(F.col("path").rlike(r"(^|/)tests?/|test_|_test\.")).select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\w+"), 0))).alias("symbol"))
    hits = words.join(symbols.select("symbol").distinct(), "symbol")
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("path", "line_no"))).where(F.col("n") <= n).drop("n")


def cycle_text(nodes: Column) -> Column:
    return F.array_join(F.concat(nodes, F.slice(nodes, 1, 1)), " --> ")
