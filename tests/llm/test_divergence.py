import random
import re
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    docs = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        df[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def share(count, total):
            return 1 + 1_000_000_000 * (count + 2) // (total + 2 * v)

        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, each in (("pair", pairs), ("term", terms)):
                each.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(each, 1) if part == "pair" or i <= top]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def rows_of(seed, n=150):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Ça", "ab-", "zé", "q") for b in ("x", "yy", "ü", "7k")]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "fr", None, "es"]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "Ü"])
        text = None if rng.random() < 0.05 else " ".join(rng.choices(words, weights=[1 + (hash_of(w, source) % 5) ** 2 for w in words], k=rng.randrange(0, 30)))
        rows.append((i, text, lang, source))
    return rows + rows[:7] + [(999, "", "xx", "alone"), (None, "1 2 3", "yy", "a"), (None, None, "yy", "b")]


def hash_of(word, source):
    return sum(map(ord, word)) * 31 + sum(map(ord, source or ""))


@pytest.mark.parametrize("cells", [divergence.CELLS, 3])  # 3: written out again and again
def test_equals_brute_force(spark, cells):
    rows = rows_of(4)
    got = found(divergence.divergences(spark.createDataFrame(rows, SCHEMA).repartition(5), cells=cells))
    assert got == brute(rows) and {r[2] for r in got} == {"pair", "term"}
    assert ("yy", "a", "pair", "b", 0, 1) in got  # no kept terms
    assert not [r for r in got if r[1] == "alone"]


def test_ties_go_by_bytes(spark):
    rows = [(i, "zb za zé Zc", "en", "s1") for i in range(12)] + [(i, "other", "en", "s2") for i in range(12)]
    got = found(divergence.divergences(spark.createDataFrame(rows, SCHEMA), top=3))
    assert got == brute(rows, top=3)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("s1", "term")] == ["za", "zb", "zc"]


def test_numbers_beyond_63_bits():
    """A count of 10^13 times the unit doesn't fit a long."""
    import pyarrow as pa

    n = 10**13
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"]), pa.array([b"t"]), pa.array([["a"]], pa.list_(pa.string())), pa.array([[n]], pa.list_(pa.int64())), pa.array([1]), pa.array([["a", "b"]], pa.list_(pa.string())), pa.array([[n, 5]], pa.list_(pa.int64()))],
        names=["lang", "term", "sources", "counts", "n_terms", "all_sources", "totals"],
    )
    rows = [r for b in divergence._emitted(10, 100)(iter([batch])) for r in b.to_pylist()]
    p, zero = 1 + 10**9 * (n + 2) // (n + 2), 1 + 2 * 10**9 // 7
    assert [r["value"] for r in rows if r["part"] == "pair"] == [(p - zero) ** 2 // (p + zero)]


def test_edges(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = rows_of(5, 40) + [(77, "long " * 60_000, "en", "s1")]
    odd = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", term string, df int, value int")
    assert found(divergence.divergences(odd, least=3)) == brute(rows, least=3)
