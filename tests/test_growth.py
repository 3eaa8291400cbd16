"""Steps whose work grew faster than their input, or was done more than once."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import deduce, diff, findings, graph, search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_rule_is_deduced_once(spark):
    rows = [("a", "t", "x.tsx", "P0", "", "y = eval (z)"), ("b", "", "x", "P2", "c", "12 34"), ("c", "t", "x.py", "P3", "", "")]
    df = spark.createDataFrame(rows, "id string, title string, file string, severity string, category string, e string").withColumn("evidence", F.concat("e", F.lit("")))
    got = {r.id: tuple(r)[1:] for r in deduce.bulk(df).collect()}
    assert got == {"a": ("t", "P1", "security", r"\beval\s*\(", "typescript", "**/*.{ts,tsx}"), "b": ("12 34", "P2", "c", r"12\ 34", "", "")}
    text = plan(deduce.bulk(df))
    assert text.count(r"(?i)\beval") == 1 and text.count("(?i)execSync") == 1 and text.count(r"\.([^./]+)$") == 1


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(3)


def test_rings_that_stand_alone_need_no_components(spark, monkeypatch):
    names = [f"r{(i * 29) % 37:02}" for i in range(37)]
    long = list(zip(names, names[1:] + names[:1], strict=True))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    at = names.index("r00")
    want = {(37, " -> ".join(names[at:] + names[:at])), (2, "p -> q"), (3, "x -> z -> y")}
    edges = long + [("p", "q"), ("q", "p"), ("q", "q"), ("x", "z"), ("z", "y"), ("y", "x"), ("in", "x"), ("y", "out")]
    with monkeypatch.context() as m:
        m.setattr(graph, "strong_components", lambda edges: pytest.fail("not needed"))
        assert {tuple(r) for r in graph.rings(table(spark, edges)).collect()} == want
    # rings joined by a long chain of nodes with one way in and out, and one with a chord
    more = edges + [("p", "c0"), *chain, ("c9", "r05"), *((f"k{i}", f"k{(i + 1) % 6}") for i in range(6)), ("k0", "k3")]
    assert {tuple(r) for r in graph.rings(table(spark, more)).collect()} == want


def test_no_side_is_broadcast_in_the_rounds(spark, monkeypatch):
    plans = []
    kept = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: plans.append(plan(df)) or kept(df, name))
    assert graph.strong_components(table(spark, [("a", "b"), ("b", "a"), ("b", "c")])).count() == 2
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_entries_are_worked_out_once(spark, monkeypatch):
    plans = []
    kept = diff.kept
    monkeypatch.setattr(diff, "kept", lambda df, name: plans.append(plan(df)) or kept(df, name))
    old = spark.createDataFrame([(1, '{"a":{"b":{}},"n":1,"x":{}}'), (2, "no")], "report_id int, report string")
    new = spark.createDataFrame([(1, '{"a":{"b":{},"c":"1"},"n":1.0,"x":[]}'), (3, '{"y":null}')], "report_id int, report string")
    got = {tuple(r) for r in diff.nested_diff(old, new).collect()}
    assert got == {(1, "a.c", "added", None, '"1"'), (1, "x", "changed", "{}", "[]"), (3, "y", "added", None, "null")}
    assert len(plans) == 3 and all(p.count("StructsToJsonEvaluator") == 2 for p in plans)  # one for each side


def test_known_titles_are_not_gathered_in_a_hash_table(spark):
    had = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "session_id int, title string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (2, "b"), (3, "a")], "session_id int, title string")
    out = findings.new_titles(new, had, limit=1)
    assert sorted(map(tuple, out.collect())) == [(1, "b"), (2, "a"), (3, "a")]
    assert "Aggregate" not in plan(out)


def test_only_the_rarest_shingles_of_a_set_are_counted_and_joined(spark, monkeypatch):
    common = " ".join(f"c{i}" for i in range(12))
    texts = [f"{common} {' '.join(f'd{n}x{i}' for i in range(40))}" for n in range(30)]
    docs = [(n, t) for n, t in enumerate(texts)] + [(100 + n, t + " end") for n, t in enumerate(texts[:5])] + [(200, texts[0]), (0, texts[0]), (300, "two words"), (301, " Two  WORDS"), (302, " "), (303, None)]
    sets = {}
    for k, t in docs:
        w = (t or "").lower().split()
        if w:
            sets.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))), k)
    want = {(min(a, b), max(a, b), round(len(x & y) / len(x | y), 9)) for x, a in sets.items() for y, b in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)}
    df = spark.createDataFrame(docs, "id int, text string").repartition(3)
    for counters, parts in ((search.COUNTERS, search.PARTS), (4, 2)):  # few counters cost time, not pairs
        monkeypatch.setattr(search, "COUNTERS", counters)
        monkeypatch.setattr(search, "PARTS", parts)
        out = search.near_duplicates(df, F.col("text"))
        got = [(r.a, r.b, round(r.similarity, 9)) for r in out.collect()]
        assert set(got) == want and len(got) == len(want) == 5
        assert "Window" not in plan(out)
    assert search.near_duplicates(df.limit(0), F.col("text")).collect() == []


def test_an_index_takes_texts_apart_once_and_reads_few_buckets(spark, monkeypatch):
    name, text = f"index_{uuid.uuid4().hex}", F.col("summary")
    rows = [(i, " ".join(f"w{(i * k) % 23} Tax" for k in range(i % 9))) for i in range(60)] + [(7, "tax twice"), (8, None), (9, "a b")]
    docs = spark.createDataFrame(rows, "id int, summary string").repartition(3)
    expected = {r.id: round(r.score, 9) for r in search.searched(docs, text, "tax w3 w3 nope").collect()}
    wanted = {tuple(r) for r in search.term_table(docs.where("id <> 7"), text).collect()}
    calls, tokens = [], search.tokens
    try:
        with monkeypatch.context() as m:
            m.setattr(search, "tokens", lambda c: calls.append(c) or tokens(c))
            search.index_documents(docs.where("id % 3 > 0"), text, name, buckets=8)
            search.index_documents(docs.where("id % 3 = 0"), text, name)
            search.index_documents(docs.where("id < 0"), text, name)
        assert len(calls) == 3  # once a call
        table = spark.table(f"{name}_terms")
        assert len(table.inputFiles()) <= 16 and {tuple(r) for r in table.where("id <> 7").collect()} == wanted
        assert [tuple(r) for r in spark.table(f"{name}_stats").groupBy().sum("n", "terms").collect()] == [tuple(search.corpus_stats(docs, text).select("n", "terms").first())]
        found = search.index_searched(spark, name, "tax w3 w3 nope")
        assert {r.id: round(r.score, 9) for r in found.collect()} == expected and len(expected) > 40
        assert "SelectedBucketsCount: 3 out of 8" in found._jdf.queryExecution().toString() or "SelectedBucketsCount: 2 out of 8" in found._jdf.queryExecution().toString()
    finally:
        for part in ("terms", "stats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def test_an_index_of_no_documents(spark):
    name, text = f"index_{uuid.uuid4().hex}", F.col("summary")
    try:
        search.index_documents(spark.createDataFrame([], "id int, summary string"), text, name)
        assert search.index_searched(spark, name, "tax").collect() == [] and spark.table(f"{name}_stats").collect() == [(0, 0)]
    finally:
        for part in ("terms", "stats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def test_words_of_texts_meet_messages_without_a_shuffle(spark, monkeypatch):
    import random

    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["an", "der", "é", "th", "ou", "x" * 9]) for _ in range(draw.randint(1, 5)))
    texts = [(i * 7 % 500, " ".join(word() for _ in range(draw.choice([0, 3, 20, 90])))) for i in range(500)] + [(900, None)]
    asked = [(i, " ".join(word() for _ in range(draw.choice([1, 6, 25])))) for i in range(60)]
    plans, kept = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df, name: plans.append(plan(df)) or kept(df, name))
    monkeypatch.setattr(search, "FIRST", 16, raising=False)
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = search.relevance(spark.createDataFrame(asked, "m int, text string"), docs, "m", F.col("text"))
    want = set()
    for m, text in asked:
        words = {w for w in text.split() if len(w) > 2 and w not in search.STOP_WORDS}
        best = sorted((-sum(w in t for w in words), i) for i, t in texts if t is not None)
        want |= {(m, i, -k, rank) for rank, (k, i) in enumerate(best[:3], 1) if k}
    assert {tuple(r) for r in got.collect()} == want
    lines = [line for p in [*plans, plan(got)] for line in p.splitlines() if "held" in line]
    assert lines and not [line for line in lines if "Join " in line or "Aggregate " in line]
