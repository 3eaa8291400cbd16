"""Real files: source trees, YAML lists, a search index that is kept, a long marker catalogue, and rules that change under a stream."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import scan, search, stack
from corpusmill.sources import files
from corpusmill.streaming import events

RULES = """
- id: A1
  severity: high
  scan_query: "eval\\\\("
  languages: [python]
  title: first
- id: A2
  severity: nonsense
  scan_query: x
- just text
- id: A3
  severity: low
  languages: python
  scan_query: y
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "shop"
    for path, text in {
        "app.py": "import os\npassword = 'abcdefghijkl'\n",
        "src/deep/er/page.tsx": "eval(x)\n",
        "node_modules/lib/index.js": "eval(y)",
        "src/node_modules/x.js": "eval(z)",
        ".git/config": "eval(",
        "docs/README": "no extension",
        "empty.py": "",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "latin.txt").write_bytes(b"caf\xe9\n")
    (root / "blob.bin").write_bytes(b"\x00\x01" * 2000)
    return root


def test_walk_reads_a_tree_without_ignored_folders(spark, tree):
    got = {r.path: r for r in files.walk(spark, str(tree)).collect()}
    assert set(got) == {"app.py", "src/deep/er/page.tsx", "docs/README", "empty.py", "latin.txt", "blob.bin"}
    page = got["src/deep/er/page.tsx"]
    assert (page.project, page.ext, page.size, page.content) == ("shop", "tsx", 8, "eval(x)\n") and got["docs/README"].ext == ""
    assert got["latin.txt"].content == "caf�\n"
    some = files.walk(spark, str(tree), globs=("*.{py,tsx}",), most=20)
    assert {r.path for r in some.collect()} == {"src/deep/er/page.tsx", "empty.py"}
    assert {r.path for r in files.walk(spark, str(tree), ignored=(), globs=("**/*.js",)).collect()} == {"node_modules/lib/index.js", "src/node_modules/x.js"}


def test_a_tree_is_scanned(spark, tree):
    hits = scan.batch(scan.lines(files.walk(spark, str(tree))), [scan.Rule("E", "eval", "P1", "security", "grep", r"eval\(")])
    assert [(r.file, r.line) for r in hits.collect()] == [("src/deep/er/page.tsx", 1)]
    assert [r.path for r in scan.secrets(files.walk(spark, str(tree))).collect()] == ["app.py"]


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.walk(spark, str(tmp_path / "none")).collect() == [] and files.rules(spark, str(tmp_path / "none")).collect() == []


def test_rule_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    root = tmp_path / "rules"
    (root / "sub").mkdir(parents=True)
    (root / "a.yaml").write_text(RULES)
    (root / "sub" / "b.yml").write_text("rules:\n- {id: A1, severity: critical, scan_query: z, title: last}\n- {id: 7, severity: info, scan_query: q, confidence: high, cwe: CWE-9}\n")
    (root / "broken.yaml").write_text("- id: [oops\n")
    (root / "scalar.yaml").write_text("42")
    (root / "empty.yml").write_text("")
    (root / "c.json").write_text('[{"id": "J", "severity": "low", "scan_query": "j"}]')
    (root / "notes.txt").write_text("- id: no")
    many = [{"id": f"G{i:03}", "severity": "low", "scan_query": f"known_{i}", "languages": ["go"]} for i in range(500)]
    (root / "z.yaml").write_text(yaml.safe_dump(many))
    rows = {(r.file, r.pos): r for r in files.rule_files(spark, str(root)).where("file <> 'z.yaml'").collect()}
    assert {k: r.reason for k, r in rows.items() if r.reason} == {
        ("a.yaml", 1): "bad severity",
        ("a.yaml", 2): "not a mapping",
        ("a.yaml", 3): "a value of the wrong type",
        ("broken.yaml", None): rows["broken.yaml", None].reason,
        ("scalar.yaml", None): "not a list",
    }
    assert rows["broken.yaml", None].reason.startswith("not readable") and ("empty.yml", 0) not in rows
    good = {r.id: (r.title, r.severity, r.languages) for r in files.rules(spark, str(root)).collect()}
    assert len(good) == 503 and good["A1"] == ("last", "critical", []) and good["7"][1] == "info" and good["J"][1] == "low" and good["G499"][2] == ["go"]


def test_marker_and_advisory_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "next.yaml").write_text("- tech: next\n  category: frontend\n  markers:\n  - {glob: next.config.js, confidence: high}\n  - {glob: '**/*.tsx', search: next/link}\n- tech: bad\n  category: nope\n  markers: [{glob: x}]\n")
    loaded = stack.load_markers(files.marker_files(spark, str(tmp_path / "m")))
    assert sorted(map(tuple, loaded.collect())) == [("next", "frontend", "**/*.tsx", "next/link", "medium"), ("next", "frontend", "next.config.js", "", "high")]
    (tmp_path / "v.json").write_text('[{"package": "lodash", "ecosystem": "npm", "vulnerable_versions": ["<4.17.21", ">=5.0,<5.1"], "severity": "high"}, {"ecosystem": "npm"}]')
    assert sorted(r.range for r in files.advisory_files(spark, str(tmp_path)).collect()) == ["<4.17.21", ">=5.0,<5.1"]


def docs(spark, seed, lo, hi):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices(["tax", "law", "the", "cat", "sat", "on", "mat", f"w{i % 7}"], k=rng.randrange(0, 30)))) for i in range(lo, hi)], "id int, summary string")


def test_stored_index_scores_alike_before_and_after_documents_are_added(spark):
    name = f"index_{uuid.uuid4().hex}"
    old, new, text = docs(spark, 1, 0, 80), docs(spark, 2, 80, 130), F.col("summary")
    rows = lambda df: {r.id: round(r.score, 9) for r in df.collect()}
    try:
        search.index_documents(old, text, name, buckets=4)
        assert rows(search.index_searched(spark, name, "the tax LAW w3 nope")) == rows(search.searched(old, text, "the tax LAW w3 nope"))
        search.index_documents(new, text, name)
        both = old.union(new)
        found = search.index_searched(spark, name, "the tax LAW w3 nope")
        assert rows(found) == rows(search.searched(both, text, "the tax LAW w3 nope")) and len(rows(found)) > 100
        plan = search.document_frequency(spark.table(f"{name}_terms").join(F.broadcast(search.query_terms(spark, "the tax").select("term")), "term"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "Exchange hashpartitioning(term#" not in plan.split("BroadcastExchange")[0] and "Bucketed: true" in plan
        assert search.index_searched(spark, name, "nope").collect() == []
    finally:
        for table in ("terms", "stats"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")


def test_markers_of_a_long_catalogue_hit_what_each_glob_hits(spark):
    globs = ["next.config.js", "*.py", "**/*.{ts,tsx}", "src/*", "Dockerfile", "**/*.config.js", "a.{py,js}", "*", "**/x?.py", "deep/**", ".env"]
    markers = [(f"t{i}", "other", g, "known" if i % 3 == 0 else "", "high" if i % 2 else "low") for i, g in enumerate(globs)] + [(f"none{i}", "other", f"lib{i}.lock", "", "low") for i in range(450)]
    paths = ["next.config.js", "a.py", "src/b.tsx", "src/x1.py", "Dockerfile", "deep/er/my.config.js", "c.js", "a.js", ".env", "README", "deep/Dockerfile", "x.y.ts"]
    table = spark.createDataFrame([(f"p{i % 2}", p, "is known" if i % 4 else None) for i, p in enumerate(paths)], "project string, path string, content string")
    got = {(r.project, r.name): (r.n_evidence, r.first_evidence, r.confidence) for r in stack.detected(table, markers).collect()}
    want = {}
    for name, _, glob, text, confidence in markers[: len(globs)]:
        fits = table.where(F.col("path").rlike(scan.glob_regex(glob)) & (F.contains("content", F.lit(text)) if text else F.lit(True)))
        for r in fits.groupBy("project").agg(F.count("*").alias("n"), F.min("path").alias("first")).collect():
            want[r.project, name] = (r.n, r.first, confidence)
    assert got == want and len(got) > 12
    assert stack.detected(table, []).collect() == []


def test_a_rule_that_comes_between_two_batches_hits_only_in_the_second(spark, tmp_path):
    schema = "project string, path string, ext string, content string"
    source, at = str(tmp_path / "in"), str(tmp_path / "kept")
    table = str(tmp_path / "rules")
    rule = lambda i, q: scan.Rule(i, i, "P1", "other", "grep", q)
    spark.createDataFrame([("R1", "alpha")], "id string, q string").write.parquet(table)
    current = lambda: [rule(r.id, r.q) for r in spark.read.parquet(table).collect()]

    def run(name):
        spark.createDataFrame([("p", name, "py", "alpha\nbeta")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = events.stream(spark, source, spark.createDataFrame([], schema).schema, "*.parquet", per_batch=1)
        return {(r.pattern_id, r.file, r.line, r.batch) for r in events.scan_changing(stream, current, at=at).collect()}

    assert run("one.py") == {("R1", "one.py", 1, 0)}
    spark.createDataFrame([("R2", "beta")], "id string, q string").write.mode("append").parquet(table)
    assert run("two.py") == {("R1", "one.py", 1, 0), ("R1", "two.py", 1, 1), ("R2", "two.py", 2, 1)}


def test_each_file_of_entries_leaves_the_task_on_its_own():
    import pandas as pd
    from corpusmill.sources import files

    batch = pd.DataFrame({"path": ["a", "b", "c"], "content": ['[{"id": "x"}, 3]', "{", '{"k": [{"id": "y"}]}']})
    got = list(files._entries(iter([batch])))
    assert [len(f) for f in got] == [2, 1, 1]
    assert [r is None or r.split(":")[0] for f in got for r in f["reason"].astype(object).where(f["reason"].notna(), None)] == [True, "not a mapping", "not readable", True]
