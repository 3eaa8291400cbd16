"""Nested reports against a recursive comparison in Python."""

import json
import random

from corpusmill.operators import diff

SHOWN = ("tool", "path", "depth", "symbol")


def differ(x, y):
    """As JSON: true isn't 1, but 1.0 is."""
    return x != y or json.dumps(x, sort_keys=True).replace("1.0", "1") != json.dumps(y, sort_keys=True).replace("1.0", "1")


def compared(a, b, prefix):
    out = []
    for k in {*a, *b}:
        name = f"{prefix}.{k}" if prefix else k
        if k not in a:
            out.append((name, "added", None, b[k]))
        elif k not in b:
            out.append((name, "removed", a[k], None))
        elif isinstance(a[k], dict) and isinstance(b[k], dict):
            out += compared(a[k], b[k], name)
        elif differ(a[k], b[k]):
            out.append((name, "changed", a[k], b[k]))
    return out


def naive(a, b):
    a, b = (x if isinstance(x, dict) else {} for x in (a, b))
    out = [(k, "changed" if differ(a.get(k), b.get(k)) else "unchanged", a.get(k), b.get(k)) for k in SHOWN if k in a or k in b]
    for name, keys in (("summary", ("summary",)), ("findings", ("findings", "sections")), ("layers", ("layers",))):
        sides = [next((x[k] for k in keys if isinstance(x.get(k), dict) and x[k]), {}) for x in (a, b)]
        out += compared(*sides, name)
    rest = [{k: v for k, v in x.items() if k not in (*SHOWN, "summary", "findings", "sections", "layers")} for x in (a, b)]
    return out + compared(*rest, "")


def random_report(rng, depth=0):
    value = lambda: rng.choice([1, 2, 1.5, "x", "y", None, True, [1, {"k": 2}], [], {}])
    names = ["tool", "depth", "summary", "findings", "sections", "layers", "other", "more"] if depth == 0 else ["a", "b", "c d", "e.f"]
    out = {}
    for k in rng.sample(names, rng.randrange(len(names) + 1)):
        nested = k in ("summary", "findings", "sections", "layers") and depth == 0
        out[k] = random_report(rng, depth + 1) if nested or (depth < 5 and k not in SHOWN and rng.random() < 0.6) else value()
    return out


def plain(v):
    return None if v is None else json.loads(v)


def test_nested_diff_equals_a_recursive_one(spark):
    rng = random.Random(11)
    old, new = ([random_report(rng) for _ in range(120)] for _ in range(2))
    rows = lambda reports: spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(reports)], "report_id int, report string")
    got = diff.nested_diff(rows(old), rows(new)).collect()
    line = lambda *x: json.dumps(x, sort_keys=True)
    mine = {line(r.report_id, r.key, r.status, plain(r.old), plain(r.new)) for r in got}
    assert mine == {line(i, *x) for i, (a, b) in enumerate(zip(old, new, strict=True)) for x in naive(a, b)}
    assert {r.status for r in got} == {"added", "removed", "changed", "unchanged"} and max(r.key.count(".") for r in got) >= 4


def test_missing_broken_and_empty_reports(spark):
    table = lambda rows: spark.createDataFrame(rows, "report_id int, report string")
    got = diff.nested_diff(table([(1, '{"x":1.0,"tool":"t"}'), (2, "{broken"), (3, None), (5, "[1]")]), table([(1, '{"x":1,"tool":null}'), (2, '{"y":{"z":2}}'), (4, '{"w":3}')]))
    assert sorted((r.report_id, r.key, r.status, r.old, r.new) for r in got.collect()) == [(1, "tool", "changed", '"t"', None), (2, "y", "added", None, '{"z":2}'), (4, "w", "added", None, "3")]
    assert diff.nested_diff(table([]), table([])).collect() == []


def test_snapshots_of_one_url_meet_their_own_baseline(spark):
    table = lambda rows: spark.createDataFrame(rows, "page_id int, url string, title string, elements int, text string")
    now = table([(1, "u", "a", 1, "x"), (2, "u", "b", 1, "x"), (3, "u", "c", 1, "x")])
    before = table([(1, "u", "a", 1, "x"), (2, "u", "z", 1, "x")])
    got = diff.baseline_diff(before, now, by=["page_id"]).select("page_id", "state", "title_changed").collect()
    assert sorted(tuple(r) for r in got) == [(1, "same", False), (2, "changed", True), (3, "new", False)]
