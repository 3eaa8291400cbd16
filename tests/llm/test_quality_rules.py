import random
import re
import zlib
from fractions import Fraction
from math import comb

import numpy as np

from corpusmill.llm import quality_rules as rules

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int"


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines))


def test_counts_equal_a_naive_count():
    rng = random.Random(5)
    texts = [None, "", " \t\r\n", "a", "a a a a", "a b c\na b c\n\n \n\n", "é ü x y # * |", "x\x0by\x0cz", "a b c d a b c d e a b", "\n".join(["same"] * 5)]
    texts += ["".join(rng.choices(["a ", "b ", "cé", "\n", " ", "&", "d\t"], k=rng.randrange(120))) for _ in range(300)]
    for t in texts:
        assert rules.counts(t) == naive(t), t


def test_repeats_with_many_different_words():
    words = [b"%d" % i for i in range((1 << 20) + 5)]
    assert rules.repeated(words) == 0
    assert rules.repeated(words + words[10:14]) == 8


def test_binomial_tail_is_exact():
    for n, x, p in ((50, 1, 0.1), (400, 3, 0.02), (1000, 0, 0.0125), (90, 8, 0.2)):
        exact = sum(comb(n, k) * Fraction(p) ** k * (1 - Fraction(p)) ** (n - k) for k in range(x + 1))
        assert abs(rules.at_most(x, n, p) - float(exact)) < 1e-12
        u = rules.upper_bound(x, n, 0.01)
        tail = sum(comb(n, k) * Fraction(u) ** k * (1 - Fraction(u)) ** (n - k) for k in range(x + 1))
        assert abs(float(tail) - 0.01) < 1e-9
    assert rules.at_most(60, 100, 0.5) == 1.0 and rules.upper_bound(0, 0, 0.01) == 1.0


def test_risk_is_kept_as_often_as_promised():
    """Good documents whose levels are drawn anew: the true rate of false rejection is over the limit in at most `error` of the draws."""
    rng = np.random.default_rng(3)
    chance = np.array([0.9] + [0.1 / 100] * 100)
    over = 0
    for _ in range(300):
        good = rng.multinomial(700, chance)
        got = rules.chosen(good, np.full(101, 1000), 0.05, 0.1)
        over += got is not None and chance[got[0] + 1 :].sum() > 0.05
    assert over <= 0.1 * 300 + 16


def test_few_labels_certify_nothing_and_gains_decide():
    few, bad = np.zeros(101, int), np.zeros(101, int)
    few[0], bad[40] = 20, 30
    assert rules.chosen(few, bad, 0.05, 0.01) is None
    many = few * 100
    assert rules.chosen(many, bad, 0.05, 0.01) == (39, 0, 30)  # the laxest cutoff that rejects them
    assert rules.chosen(many, np.zeros(101, int), 0.05, 0.01) is None


def make(seed=1, n=1500):
    """Good and bad texts in two languages; bad ones hold symbols."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [f"w{rng.randrange(9000)}" + ("#*$" if bad else "") for _ in range(60)]
        docs.append((i, " ".join(words), rng.choice(["en", "en", "en", "fr"])))
        labels.append((i, int(not bad)))
    return docs, labels


def brute(docs, labels, steps=rules.STEPS):
    known = {}
    for i, q in labels:
        if q is not None and i is not None:
            known.setdefault(i, set()).add(q)
    seen = {i: next(iter(q)) for i, q in known.items() if len(q) == 1 and zlib.crc32(str(i).encode()) % 3 != 1}
    rows = [(i, lang or "", dict(zip(rules.COUNTS, naive(t), strict=True))) for i, t, lang in docs]
    failed = lambda c: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    over = lambda c, r, k: c[r.part] * steps > k * max(c[r.whole], 1)
    held = [(lang, seen[i], c) for i, lang, c in rows if i in seen and not failed(c)]
    strata = {lang for lang, _, _ in held}
    cut = {}
    for r in rules.RULES:
        for s in strata:
            good = [c for lang, y, c in held if lang == s and y == 1]
            bad = [c for lang, y, c in held if lang == s and y == 0 and not any((s, o.name) in cut and over(c, o, cut[s, o.name]) for o in rules.RULES)]
            best = 0
            for k in range(steps, -1, -1):
                lost, caught = sum(over(c, r, k) for c in good), sum(over(c, r, k) for c in bad)
                tail = sum(comb(len(good), j) * (rules.RISK / 4) ** j * (1 - rules.RISK / 4) ** (len(good) - j) for j in range(lost + 1)) if good else 1
                if tail > rules.ERROR / 4 / len(strata):
                    break
                if caught - lost > best:
                    best, cut[s, r.name] = caught - lost, k
    kept = [not failed(c) and not any((lang, r.name) in cut and over(c, r, cut[lang, r.name]) for r in rules.RULES) for _, lang, c in rows]
    return [(i, failed(c), k) for (i, _, c), k in zip(rows, kept, strict=True)], cut


def test_equals_brute_force_and_the_limit_holds_on_other_labels(spark):
    docs, labels = make()
    docs += [(None, "x " * 5, "en"), (5000, None, None), docs[3], (6000, " ".join(f"v{i}#$%" for i in range(80)), "en"), (6001, "word " * 4000, "fr")]
    labels += [(7, None), (8, 0), (8, 1), (None, 1), (77_777, 0)]
    want, cut = brute(docs, labels)
    got = rules.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(((r.doc_id, r.base_failed, r.kept) for r in got.collect()), key=str) == sorted(want, key=str)
    assert ("en", "symbols") in cut and ("fr", "symbols") not in cut  # too few labels of fr
    others = [(r.lang, r.kept) for r in got.join(spark.createDataFrame(labels[:1500], LABELS), "doc_id").where("quality = 1 and not base_failed and crc32(cast(doc_id as string)) % 3 = 1").collect()]
    lost = [k for lang, k in others if lang == "en"].count(False)
    assert lost <= rules.RISK * len(others)


def test_edges(spark):
    docs, labels = make(2, 60)
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert rules.judged(frame.limit(0), known).collect() == []
    assert {r.kept for r in rules.judged(frame, known.limit(0)).collect()} == {True}
    odd = frame.selectExpr("*", "'mine' AS stratum", "1 AS id", "2 AS row", "3 AS c", "4 AS step_0", "5 AS label", "6 AS kept", "7 AS `a.b`")
    got = rules.judged(odd, known)
    assert got.count() == 60 and {(r.stratum, r.id, r["row"], r.c, r.step_0, r.label, r["a.b"]) for r in got.collect()} == {("mine", 1, 2, 3, 4, 5, 7)}
    kept = rules.accepted(odd, known)
    assert kept.columns == odd.columns and {r.kept for r in kept.collect()} == {6}
