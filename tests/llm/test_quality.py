"""The line field: marginals against enumeration, held-out accuracy, edge cases."""

import itertools
import random

import numpy as np
from corpusmill.llm import quality_crf as q


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 3, 5])
    u, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    good, pairs, z = q.forward_backward(u, lengths, trans)
    for r, n in enumerate(lengths):
        total, marg, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[r, i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            total += w
            marg += w * np.array(y)
            for a, b in itertools.pairwise(y):
                both[a, b] += w
        assert np.allclose(good[r, :n], marg / total) and np.allclose(pairs[r], both / total) and np.isclose(z[r], np.log(total))


def make(rng, bad):
    words = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(30)]
    lines = []
    for _ in range(rng.randrange(2, 8)):
        n = rng.randrange(5, 20)
        lines.append(" ".join(rng.choice(words) + ("%%%" if bad else "") for _ in range(n)) + ("" if bad else "."))
    if bad and rng.random() < 0.5:
        lines.insert(0, "a plain first line.")
    return "\n".join(lines)


def test_accuracy_on_held_out_rows_and_edges(spark):
    rng = random.Random(6)
    rows = [(i, make(rng, i % 3 == 0), int(i % 3 != 0)) for i in range(400)]
    extra = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x" * 200_000), (None, rows[1][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(i, t, 9.0) for i, t in extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (2, 0), (2, 1), (7, 1)], "doc_id long, quality int")
    got = q.judged(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) + len(extra) and len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 and r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert q.judged(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in q.judged(docs.limit(5), labels.limit(0)).collect()} <= {0, 1}


def test_good_lines(spark):
    model = {"w": np.eye(1, 3 * q.WIDTH, 7)[0], "trans": np.zeros((2, 2))}
    df = spark.createDataFrame([("a\n\nb",), (None,)], "text string")
    got = df.select(q.good_lines(df.text, model).alias("g")).collect()
    assert [[x.line for x in r.g] for r in got] == [["a", "b"], []]
