import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusmill.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, tokens = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            tokens[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if paths[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], tokens[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def rows_of(seed, n=60):
    rng = random.Random(seed)
    texts = ["a b", "", " \t", "c", None, "d e f", "é x"]
    rows = []
    for c in range(n):
        base = rng.choice([0, 0, 3])
        for t in range(rng.randrange(1, 11)):
            rows.append((c * 3 + base % 2, rng.choice([t, t, t, None, 2]), rng.choice(["u", "u", "u", None]), texts[rng.randrange(2)] if rng.random() < 0.8 else rng.choice(texts)))
    return rows + rng.sample(rows, 15) + [(None, 1, "u", "lost")]


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_brute_force(spark, rebuild):
    rows = rows_of(1)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), rebuild=rebuild)
    assert found(got) == brute(rows, rebuild)


@pytest.mark.parametrize("block", [1, 3])
def test_block_size_changes_nothing(spark, block):
    rows = rows_of(2, 30)
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuild=True, block=block)) == brute(rows, True)


def test_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 2)
    rows = [(1, t, "u", f"w {t % 3}") for t in range(60)] + [(2, t, "u", f"w {t % 3}") for t in range(45)] + [(3, t, "u", f"w {t % 3}" if t < 30 else "z") for t in range(50)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_copies_whose_ids_fill_several_chunks(spark):
    rows = [(100_000 + c, 0, "u", "same") for c in range(12_000)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows, False)


def test_snapshots_of_one_conversation(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(12) for t in range(c)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_turnless_conversations_are_members_of_the_root(spark):
    bare = next(c for c in range(1, 500) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(bare, 0, "u", "only")]  # its first turn isn't its own, and the base is missing
    got = found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuild=True))
    assert got == brute(rows, True) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


def test_empty_and_extra_columns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = rows_of(3, 10)
    odd = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", pos int, n int, conv int, depth int")
    assert found(trie.prefix_trie(odd, rebuild=True)) == brute(rows, True)
    turns = {(r.depth, r.text) for r in trie.with_turns(trie.prefix_trie(odd.limit(1)), odd.limit(1)).collect()}
    assert (0, None) in turns and len(turns) == 2
