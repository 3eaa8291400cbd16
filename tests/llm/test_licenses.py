"""License scans on the corpus's own notices, on prose, and on edge cases."""

import random
import re

from corpusmill.llm import licenses
from pyspark.sql import functions as F


def test_families_and_edges(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["the", "tree", "runs", "over", "green", "hills", "of", "work", "and", "file"]) for _ in range(rng.randrange(3, 30))) for _ in range(200)]
    notes = {
        1: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        2: ("Released under the MIT License.", "MIT"),
        3: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        5: ("All rights reserved.", "proprietary"),
        6: ("word " * 500 + "Licensed under the Apache License, Version 2.0. " + "word " * 500, "Apache-2.0"),
        7: ("Released under the mit license.\nAll rights reserved.", "MIT,proprietary"),
    }
    rows = [(k, "some words first\n" + t, "x") for k, (t, _) in notes.items()] + [(100 + i, t, "x") for i, t in enumerate(prose)] + [(500, None, "x"), (501, "", "x"), (None, "a b", "x"), (1, "Licensed under the Apache License, Version 2.0.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    model = licenses.trained(df)
    got = {r.doc_id: r.families for r in licenses.by_document(df, licenses.scanned(df, model)).collect()}
    assert {k: got[k] for k in notes} == {k: f for k, (_, f) in notes.items()}
    assert all(f == "" for k, f in got.items() if k not in notes)
    assert len(got) == len(notes) + len(prose) + 3
    none = df.limit(0)
    assert licenses.by_document(none, licenses.scanned(none, licenses.trained(none))).count() == 0


def test_several_notices_in_a_line_and_wrapped_notices(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["the", "tree", "runs", "over", "green", "hills", "of", "work", "and", "file"]) for _ in range(n))
    apache, mit, gpl = licenses.TEMPLATES["Apache-2.0"][1], licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["GPL-3.0"][1]
    lines = lambda t, n: "\n".join(" * " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(1, f"{apache} {prose(200)} {mit}"), (2, lines(mit, 6)), (3, prose(9) + "\n\n" + lines(gpl, 7) + "\n\n" + prose(9)), (4, lines(apache, 5) + "\n" + mit), (5, prose(30) + "\n" + prose(30))]
    df = spark.createDataFrame(rows + [(100 + i, prose(rng.randrange(3, 90))) for i in range(200)], "doc_id long, text string")
    hits = licenses.scanned(df, licenses.trained(df))
    confirmed = {(r.doc_id, r.paragraph, r.family) for r in hits.collect() if r.confirmed}
    assert confirmed == {(1, 0, "Apache-2.0"), (1, 0, "MIT"), (2, 0, "MIT"), (3, 2, "GPL-3.0"), (4, 0, "Apache-2.0"), (4, len(apache.split()) // 5 + (len(apache.split()) % 5 > 0), "MIT")}
    got = {r.doc_id: (r.n_paragraphs, r.n_confirmed) for r in licenses.by_document(df, hits).collect()}
    assert got[1] == (1, 1) and got[5] == (0, 0)


def test_texts_that_a_template_confirms_pass_the_test_of_words(spark):
    rng = random.Random(3)
    rows = []
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        words = re.findall(r"[a-z0-9]+", t.lower())
        for _ in range(12):
            at, keep = rng.randrange(len(words)), rng.random()
            rows.append((["so"] + words[at:] + ["it"] + words[:at] if keep < 0.3 else [w for w in words if rng.random() < keep] + ["end"],))
    df = spark.createDataFrame(rows, "w array<string>")
    known = sorted({w for ws, _ in licenses._bounds(licenses.TEMPLATES, licenses.CONFIRM) for w in ws})
    shares = F.greatest(*[s for ts in licenses.TEMPLATES.values() for s in licenses._shares(licenses._pairs(F.col("w")), ts)])
    out = df.withColumn("known", F.array_intersect("w", F.lit(known))).select((shares >= licenses.CONFIRM).alias("confirmed"), licenses._may_confirm(F.col("known"), licenses.TEMPLATES, licenses.CONFIRM).alias("may")).collect()
    assert sum(r.confirmed for r in out) > 50 and not all(r.may for r in out)
    assert all(r.may for r in out if r.confirmed)


def brute(model, docs, hashed, confirm=licenses.CONFIRM):
    """The rows of `scanned` in plain Python: every window of every line and of every block of lines, scored with the model's coefficients."""
    import math

    matrix, intercept = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    half, size = licenses.MAX_WORDS // 2, licenses.MAX_WORDS
    words_of = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
    starts = lambda n: [0] if n <= size else range(0, n - half, half)

    def judge(words):
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        at = sorted({hashed(g) for g in words + pairs})
        s = matrix[:, at].sum(axis=1) + intercept
        p = 1 / (1 + math.exp(-(model.slope * (s[1:].max() - s[0]) + model.offset)))
        family = model.families[1 + int(s[1:].argmax())]
        own = set(pairs or words)
        return p, family, max(len(own & set(licenses._template_pairs(t))) / len(licenses._template_pairs(t)) for t in licenses.TEMPLATES[family])

    out = set()
    for doc_id, text in docs:
        blocks, now = [], []
        for no, line in enumerate((text or "").split("\n")):
            if not line.strip(" \t\r\f\x0b"):
                blocks.append(now)
                now = []
            elif words_of(line):
                now.append((no, words_of(line)))
        for block in [*blocks, now]:
            windows = [(no, no, w[s : s + size]) for no, w in block for s in starts(len(w))]
            if len(block) > 1:
                flat = [(no, x) for no, w in block for x in w]
                joined = [flat[s : s + size] for s in starts(len(flat))]
                windows += [(x[0][0], x[-1][0], [w for _, w in x]) for x in joined if x[0][0] < x[-1][0]]
            best = {}
            for first, last, words in windows:
                p, family, similarity = judge(words)
                if p >= 0.5:
                    old = best.get((family, first, last), (0, 0))
                    best[family, first, last] = (max(old[0], p), max(old[1], similarity))
            for family in {k[0] for k in best}:
                mine = sorted((first, last, *v) for (f, first, last), v in best.items() if f == family)
                lone = [x for x in mine if x[0] == x[1]]
                some = [x for x in mine if x[0] < x[1] and x[3] >= confirm and not any(o[3] >= confirm and x[0] <= o[0] <= x[1] for o in lone)]
                some = [x for i, x in enumerate(some) if i == 0 or some[i - 1][1] < x[0]]
                for x in [o for o in lone if o[3] >= confirm or not any(s[0] <= o[0] <= s[1] for s in some)] + some:
                    out.add((doc_id, x[0], family, round(x[2], 6), round(x[3], 6), family if x[3] >= confirm else licenses.UNKNOWN))
    return out


def test_scans_equal_a_scan_in_plain_python(spark):
    from functools import cache

    from pyspark.ml.feature import HashingTF

    rng = random.Random(8)
    vocabulary = ["the", "tree", "runs", "license", "permission", "copyright", "granted", "work", "and", "file", "Größe", "rights"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    wrap = lambda t, n: "\n".join("# " + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    docs = [(0, None), (1, ""), (2, "\n \n\t\n"), (3, prose(300) + " " + notices[0] + " " + prose(130))]
    for i in range(4, 44):
        t = rng.choice(notices)
        some = " ".join(w for w in t.split() if rng.random() < rng.choice([1, 0.8, 0.5]))
        docs.append((i, rng.choice(["\n", "\n\n"]).join([prose(rng.randrange(1, 40)), wrap(some, rng.choice([5, 9, 500])), rng.choice([prose(9), rng.choice(notices), " "])])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = licenses.trained(df)
    tf = HashingTF(numFeatures=licenses.FEATURES, binary=True)
    got = {(r.doc_id, r.paragraph, r.predicted, round(r.probability, 6), round(r.similarity, 6), r.family) for r in licenses.scanned(df, model).collect()}
    assert got == brute(model, docs, cache(tf.indexOf)) and len(got) > 30 and {r[5] for r in got} >= {licenses.UNKNOWN, "MIT"}
