"""The prefix trie of conversations, by digests of blocks of turns.

A turn's element is a hash of its place, role and text, and a sequence of turns is known by the XOR of its elements, so the digest of any
prefix is that of the blocks before it and of some turns of its own block. Conversations are cut into blocks of `block` turns. Conversations
with the same block after the same prefix are one group, found by one aggregation on digests; the level of a block is part of its key,
so all levels are grouped at once. Only where a prefix is followed by more than one block are the turns inside these blocks compared:
there, and nowhere else, turn boundaries are refined by a second aggregation. Both work on groups, not on conversations.

What a node says about its subtree needs no walk over the tree. A conversation owns the nodes of which it is the smallest member; these are the
last ones of its path. A subtree's distinct turns are then what its members own, corrected for its own smallest member, and sums over
members come from the aggregation that groups them, whatever the depth.

Order, prefixes and lists of ids are made over ranges or pieces of a conversation or group, so a single one may hold any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved

BLOCK = 4  #: turns of a block
PIECE = 4096  #: blocks over which a conversation's prefixes run in one window
CHUNK = 1 << 16  #: characters of a piece of a list of ids
GROUP, HEADS = 20, 4
NONE = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> tuple[Column, Column]:
    """120 bits of SHA-256 as two longs."""
    h = F.sha2(F.concat(*parts), 256)
    return tuple(F.conv(F.substring(h, at, 15), 16, 10).cast("long") for at in (1, 16))


def digested(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, d1, d2, words) for each turn: its place from 1, digest and number of words.

    Turns are ordered by `turn`, null first, then role and text. Null roles and texts are empty. Rows without a conv_id belong to no conversation
    and are left out; ids are whole numbers; repeated rows are turns of their own.
    """
    plain = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    by = ["conv_id", "turn", "role", "text"]
    d1, d2 = _digest(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = plain.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", F.monotonically_increasing_id().alias("at"), d1.alias("d1"), d2.alias("d2"), words.alias("words"))
    rows = saved(rows, "turns").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    dense = rows.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("at") - F.shiftleft("part", 33))
    first = dense.groupBy("conv_id").agg(F.min("at").alias("first"))
    return dense.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first") + 1).alias("pos"), "d1", "d2", "words")


def branched(turns: DataFrame, ids: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The turns of conversations c rebuilt: the first h turns of conversation c - c % group, then c's own after its first h; h is crc32 of c as text, modulo `heads`.

    A conversation that is shorter than h, or missing, gives what it has. `ids`: all conversations (conv_id).
    """
    c = F.col("conv_id")
    begin = turns.where((c % group == 0) & (F.col("pos") < heads)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "d1", "d2", "words"))).alias("head"))  # heads - 1 turns at most
    plan = ids.select("conv_id", (c - c % group).alias("base"), (F.crc32(c.cast("string")) % heads).alias("h")).join(begin, "base", "left")
    plan = plan.withColumn("head", F.expr("filter(head, t -> t.pos <= h)")).withColumn("k", F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.size("head")))
    own = turns.join(plan.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "d1", "d2", "words")
    return own.union(plan.select("conv_id", F.inline("head")).select(own.columns))


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, turns, b1, b2, bw, p1, p2, pw): block k's turns, digest and words, and digest and words of the blocks before it."""
    each = turns.select("conv_id", "pos", F.xxhash64("pos", "d1", "d2").alias("e1"), F.xxhash64("d2", "d1", "pos").alias("e2"), "words")
    parts = each.groupBy("conv_id", F.expr(f"(pos - 1) div {block}").alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "e1", "e2", "words"))).alias("turns"), F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("words").alias("bw")
    )  # `block` turns at most
    parts = saved(parts.withColumn("piece", F.expr(f"k div {PIECE}")), "blocks")
    sums = lambda w: (F.coalesce(F.bit_xor("b1").over(w), F.lit(0)).alias("p1"), F.coalesce(F.bit_xor("b2").over(w), F.lit(0)).alias("p2"), F.coalesce(F.sum("bw").over(w), F.lit(0)).alias("pw"))
    near = parts.select("*", *sums(Window.partitionBy("conv_id", "piece").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    long = parts.where("piece > 0").select("conv_id").distinct()
    pieces = parts.join(long, "conv_id", "left_semi").groupBy("conv_id", "piece").agg(F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("bw").alias("bw"))
    far = pieces.select("conv_id", "piece", *sums(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).toDF("conv_id", "piece", "f1", "f2", "fw")
    out = near.join(far, ["conv_id", "piece"], "left")
    return out.select("conv_id", "k", "turns", "b1", "b2", "bw", *[(F.col(p).bitwiseXOR(F.coalesce(f, F.lit(0)))).alias(p) for p, f in (("p1", "f1"), ("p2", "f2"))], (F.col("pw") + F.coalesce("fw", F.lit(0))).alias("pw"))


_KEY = ["k", "p1", "p2", "b1", "b2"]
_NODE = ["depth", "q1", "q2", "pq1", "pq2", "words", "before"]
_INSIDE = "inline(transform(sequence(1, size(turns)), i -> named_struct('depth', turns[i - 1].pos, " + ", ".join(
    [f"'{q}{s}', aggregate(slice(turns, 1, {i}), p{s}, (a, t) -> a ^ t.e{s})" for q, i in (("q", "i"), ("pq", "i - 1")) for s in (1, 2)]
    + ["'words', turns[i - 1].words", "'before', aggregate(slice(turns, 1, i - 1), pw, (a, t) -> a + t.words)"]
) + ")))"


def _refined(groups: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes from groups of blocks: depth, digests of the node (q) and of its parent (pq), words of its last turn and before it, members and smallest member."""
    alone = groups.groupBy("k", "p1", "p2").agg(F.count(F.lit(1)).alias("n_blocks"), F.min("b1").alias("b1"), F.min("b2").alias("b2")).where("n_blocks = 1").select(*_KEY, F.lit(True).alias("alone"))
    rows = groups.join(alone, _KEY, "left").selectExpr("alone", "n", "conv", *sums, _INSIDE)
    same = rows.where("alone").select(*_NODE, "n", "conv", *sums)
    apart = rows.where("alone is null").groupBy(*_NODE).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), *[F.sum(s).alias(s) for s in sums])
    return same.union(apart)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (depth, q1, q2, conv_id): the ids of each group, joined by commas, in chunks."""
    names = ["depth", "q1", "q2", "first", "ids"]
    out: list[tuple] = []
    now, ids, size = None, [], 0

    def written(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        for *key, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != now or size >= CHUNK:
                if ids:
                    out.append((*now, int(ids[0]), ",".join(ids)))
                now, ids, size = key, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield written(out)
            out = []
    if ids:
        yield written([(*now, int(ids[0]), ",".join(ids))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted chunks: the SHA-256 of each group's whole list, holding one chunk at a time."""
    now, sha = None, None
    rows: list[tuple] = []
    names = ["depth", "q1", "q2", "ends_sha256"]

    def written() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        for *key, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != now:
                if sha:
                    rows.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield written()
        rows = []
    if sha:
        rows.append((*now, sha.hexdigest()))
    yield written()


def _ends(paths: DataFrame) -> DataFrame:
    """(depth, q1, q2, ends_sha256) of the conversations that end at a node."""
    by = ["depth", "q1", "q2", "conv_id"]
    chunks = paths.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_listed, "depth long, q1 long, q2 long, first long, ids string")
    return chunks.repartition(*by[:3]).sortWithinPartitions(*by[:3], "first").mapInArrow(_hashed, "depth long, q1 long, q2 long, ends_sha256 string")


def trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations (conv_id, pos, d1, d2, words); `ids` names all conversations, those without turns too.

    conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves, saved_tokens (words that
    members need not process again, over the subtree), ends_sha256 (over the ids of the members that end here). The root is at depth 0.
    Equal conversations are members of the same nodes. Without conversations there is no row.
    """
    blocks = saved(_blocks(turns, block), "prefixes")
    groups = saved(blocks.groupBy(*_KEY, "pw", "turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")), "groups")
    paths = blocks.groupBy("conv_id").agg(F.sum(F.size("turns")).cast("long").alias("depth"), F.bit_xor("b1").alias("q1"), F.bit_xor("b2").alias("q2"), F.sum("bw").alias("path_words"))
    paths = ids.join(paths, "conv_id", "left").na.fill(0, ["depth", "q1", "q2", "path_words"])

    nodes = saved(_refined(groups, []).select("depth", "q1", "q2", "pq1", "pq2", "words", "conv"), "members")
    children = saved(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pq1").alias("q1"), F.col("pq2").alias("q2")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    at = ["depth", "q1", "q2"]
    owned = nodes.join(children, at, "left").groupBy(F.col("conv").alias("conv_id")).agg(F.sum("words").alias("own"), F.count_if(F.col("n_children").isNull()).alias("leaf"))
    paths = saved(paths.join(owned, "conv_id", "left").na.fill(0, ["own", "leaf"]), "paths")

    sums = ["path_words", "own", "leaf"]
    summed = blocks.select("conv_id", *_KEY).join(paths.select("conv_id", *sums), "conv_id").groupBy(*_KEY).agg(*[F.sum(s).alias(s) for s in sums])
    full = _refined(groups.join(summed, _KEY), sums)
    start = paths.select(F.col("conv_id").alias("conv"), (F.col("path_words") - F.col("own")).alias("start"))  # words before the first node that a conversation owns
    full = full.join(start, "conv").join(children, at, "left").join(_ends(paths.where("depth > 0")), at, "left")
    tokens = F.col("path_words") - F.col("n") * F.col("before") - (F.col("own") + F.col("start") - F.col("before"))
    found = saved(full.select(*at, "pq1", "pq2", "conv", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaf").alias("n_leaves"), tokens.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")), "nodes")

    zero = lambda: [F.lit(0).cast("long").alias(c) for c in at]
    tops = children.where("depth = 0").select("n_children")
    empty = _ends(paths.where("depth = 0")).select("ends_sha256")
    root = paths.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum("leaf").alias("leaf"), (F.sum("path_words") - F.sum("own")).alias("saved_tokens")).where("n > 0")
    root = root.join(F.broadcast(tops), how="left").join(F.broadcast(empty), how="left").na.fill(0, ["n_children"]).na.fill(NONE, ["ends_sha256"])  # one row beside one row or none
    root = saved(root.select(*zero(), F.lit(None).cast("long").alias("parent_conv_id"), "conv", "n", "n_children", F.greatest("leaf", F.lit(1)).alias("n_leaves"), "saved_tokens", "ends_sha256"), "root")

    parents = found.select(*at, "conv", "n_children").union(root.select(*at, "conv", "n_children")).where("n_children > 0")
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("pq1"), F.col("q2").alias("pq2"), F.col("conv").alias("parent_conv_id"), "n_children")
    much = max(1, found.count() // 1000)  # fewer than 1001 parents have more children
    key = ["depth", "pq1", "pq2"]
    wide = F.broadcast(parents.where(F.col("n_children") > much).drop("n_children"))
    narrow = parents.where(F.col("n_children") <= much).drop("n_children")
    below = found.join(wide, key).unionByName(found.join(wide, key, "left_anti").join(narrow, key))
    return root.unionByName(below.drop("pq1", "pq2")).select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, *, rebuild: bool = False, group: int = GROUP, heads: int = HEADS, block: int = BLOCK, **columns) -> DataFrame:
    """The trie of conversations, one row a turn. With `rebuild`, of those that `branched` makes. `columns`: names as in `digested`. Other columns aren't read."""
    turns = saved(digested(conversations, **columns), "digests")
    ids = turns.select("conv_id").distinct()
    return trie(branched(turns, ids, group, heads) if rebuild else turns, ids, block)


def with_turns(nodes: DataFrame, conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of conversations that weren't rebuilt, with role and text of each node's last turn (null for the root)."""
    place = F.row_number().over(Window.partitionBy(conv_id).orderBy(turn, F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    turns = conversations.select(F.col(conv_id).alias("conv_id"), place.cast("long").alias("depth"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return nodes.join(turns, ["conv_id", "depth"], "left")
