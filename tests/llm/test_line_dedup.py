"""Line dedup against a comparison of all lines with all earlier ones."""

import random

import pytest
from corpusmill.llm import line_dedup


def corpus(seed):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"W{rng.randrange(60)}"
            lines.append(" ".join(words))
        docs.append((i * 3, "\n".join(lines)))
    long = " ".join(f"v{k}" for k in range(20))
    docs += [(500 + k, f"{long} x{k}\n\n  \nonly{k}") for k in range(60)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("lead", [1, 16])
def test_removed_lines_match_brute_force(spark, monkeypatch, lead):
    monkeypatch.setattr(line_dedup, "LEAD", lead)
    monkeypatch.setattr(line_dedup, "LONG", 3 * lead)
    docs = corpus(lead)
    got = {}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in line_dedup.removed_lines(df).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == line_dedup.brute_force(docs)


def test_deduplicated_edges(spark):
    rows = [(1, "a b c\nA  b c\n\nz", 9), (2, None, 9), (3, "", 9), (4, "c b a a", 9), (5, "p q", 9), (5, "p q", 9), (None, "z\ny", 9), (6, "k\n" * 3000 + "m", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = line_dedup.deduplicated(df)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(1, "a b c\n\nz", 4, 1), (2, None, 0, 0), (3, "", 0, 0), (4, "", 1, 1), (5, "p q", 1, 0), (5, "p q", 1, 0), (None, "y", 2, 1), (6, "k\n" + "m", 3001, 2999)], key=str)
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_hot_words_and_long_lists(spark, monkeypatch):
    """Every line shares a word, and large groups of near copies and of unlike lines meet in one list."""
    monkeypatch.setattr(line_dedup, "HOT", 20)
    monkeypatch.setattr(line_dedup, "LONG", 12)
    monkeypatch.setattr(line_dedup, "LEAD", 2)
    rng = random.Random(5)
    few = [f"w{k}" for k in range(9)]
    docs = [(k, "\n".join(["hot " + " ".join(rng.sample(few, rng.randrange(3, 7))), f"hot a b c d e f g h i{k}"])) for k in range(150)]
    got = {}
    for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in got.items()} == line_dedup.brute_force(docs)


def test_repeated_ids_are_documents_of_their_own_and_ids_may_be_text(spark):
    rows = [("5", "dup line here\nkeep me"), ("5", "unique text alone\nsecond thing"), ("7", "dup line here"), (None, "keep me"), (None, "nothing else")]
    out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([("5", rows[0][1]), ("5", rows[1][1]), ("7", ""), (None, ""), (None, "nothing else")], key=str)


def test_very_long_lines_and_many_lines():
    import pyarrow as pa

    texts = [" ".join(f"t{k}" for k in range(70_000)), "x\n" * 70_000 + "y x y", "", None]
    sets = line_dedup.sets_of(pa.array(texts))
    assert sets.n.tolist() == [70_000] + [1] * 70_000 + [2]
    assert sets.no.tolist() == [0, *range(70_001)] and sets.text.tolist() == [0] + [1] * 70_001
    assert len(set(sets.id.tolist())) == 3


def test_many_lines_of_common_words(spark, monkeypatch):
    """Lines that share hot words and match nothing meet under tuples of words; the result is that of comparing all."""
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    line = lambda: " ".join(rng.sample(words, rng.choice([4, 5, 6, 6, 6, 9, 12])))
    docs = [(d, "\n".join(line() for _ in range(40))) for d in range(30)]
    want = {i: n for i, n in line_dedup.brute_force(docs).items() if n}
    for name, value in (("PAIRS", 10), ("LONG", 4), ("LEAD", 2)):
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(line_dedup, "_pairer", _low_limit(line_dedup._pairer))
    used, inner = [], line_dedup._in_tuples
    monkeypatch.setattr(line_dedup, "_in_tuples", lambda *a: used.append(1) or inner(*a))
    got = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r.line_no)
    assert {i: sorted(n) for i, n in found.items()} == want and sum(map(len, want.values())) > 20 and used


def _low_limit(pairer):
    """Workers import the module anew: the limit goes with the function."""

    def made(num, den):
        pair = pairer(num, den)

        def low(batches):
            line_dedup.LONG = 4
            yield from pair(batches)

        return low

    return made
