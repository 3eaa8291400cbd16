"""SimHash near-duplicates: deletion-variant signatures, equality joins and components.

Fingerprints that differ in at most k bits are cut into k // 2 + 1 segments; one of these then differs in at most one
bit, so with that bit masked (a one-wildcard variant) it is equal in both. Every distinct fingerprint is filed
under all variants of all its segments, and only fingerprints that meet under a key are compared.

A key under which more than `pair_limit` fingerprints meet is not paired out. There, for k = 2, fingerprints that
also agree in a one-wildcard variant of the other segment, or that agree in the whole segment and in a two-wildcard
variant of the other one, differ in two bits at most and are linked to the smallest of them; together these are
exactly the links of that key, so the components are the same and the work is in proportion to the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import LOWER, UPPER, free, saved, tidied
from .components import components

_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
SEED = 42
CHUNK = 50_000


def _spread(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits, each 1 if set in over half the hashes of the n-word shingles; without words 0. Long texts go in chunks."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOW).split() if text else []  # bytes.split parts at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), 0
    last = max(1, len(words) - n + 1)
    for at in range(0, last, CHUNK):
        to = min(at + CHUNK, last)
        run = words[at : to + n - 1]
        shingles = zip(*(run[i : len(run) - n + 1 + i] for i in range(n)), strict=True) if len(words) >= n else [words]
        hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], dtype=np.uint64)
        total += _spread(hashes)
        count += len(hashes)
    return sum(1 << int(b) for b in np.flatnonzero(2 * total > count))


@F.arrow_udf(T.LongType())
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:  # one text at a time is a Python string
        yield pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))
    tidied()


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long. Null and empty texts have 0."""
    return _fingerprints(text)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment for fingerprints within `bits` bits."""
    m = bits // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(first: int, width: int, wild: int) -> list[int]:
    """Masks that keep a segment's bits but for `wild` of them."""
    segment = ((1 << width) - 1) << first
    spots = [1 << (first + i) for i in range(width)]
    if wild == 1:
        return [_signed(segment & ~x) for x in spots]
    return [_signed(segment & ~x & ~y) for k, x in enumerate(spots) for y in spots[:k]]


def _filed(fps: DataFrame, bits: int) -> DataFrame:
    """(key, fp) for each variant of each segment. The mask's number is part of the key, so variants never mix."""
    masks = [m for first, width in _segments(bits) for m in _masks(first, width, 1)]
    return fps.select("fp", F.posexplode(_masked(masks)).alias("slot", "part"))


def _masked(masks: list[int]) -> Column:
    """The column fp under each of the masks, as an array."""
    return F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(m))


def links(fps: DataFrame, bits: int = 2, pair_limit: int = 64) -> DataFrame:
    """Edges (a, b) over distinct fingerprints `fp`, with the components of all pairs within `bits` bits.

    Up to `pair_limit` fingerprints under a key are compared in pairs; beyond it (only for bits = 2) stars are exact.
    """
    if bits != 2:
        pair_limit = 1 << 60
    here = Window.partitionBy("slot", "part")  # nearly all keys differ, so counting first and joining back only shuffles all of them twice
    met = saved(_filed(fps, bits).withColumn("n", F.count(F.lit(1)).over(here)).where("n > 1"), "met")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    lone = met.where("n = 2").groupBy("slot", "part").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where(near).select("a", "b")
    some = met.where(F.col("n").between(3, pair_limit)).select("slot", "part", "fp")
    pairs = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), ["slot", "part"]).where("a < b").where(near).select("a", "b")
    out = lone.union(pairs)
    if bits == 2:
        many = met.where(F.col("n") > pair_limit)
        for s, (first, width) in enumerate(_segments(2)):
            other_first, other_width = _segments(2)[1 - s]
            here = many.where(F.col("slot").between(s * 32, s * 32 + 31))
            one = here.select("slot", "part", "fp", F.posexplode(_masked(_masks(other_first, other_width, 1))).alias("slot2", "part2"))
            star = one.groupBy("slot", "part", "slot2", "part2").agg(F.min("fp").alias("a"))
            back = one.join(star, ["slot", "part", "slot2", "part2"]).select("a", F.col("fp").alias("b"))
            same = F.col("fp").bitwiseAND(F.lit(_signed(((1 << width) - 1) << first))).alias("whole")
            two = here.select("fp", same).distinct().select("whole", "fp", F.posexplode(_masked(_masks(other_first, other_width, 2))).alias("slot2", "part2"))
            star2 = two.groupBy("whole", "slot2", "part2").agg(F.min("fp").alias("a"))
            back2 = two.join(star2, ["whole", "slot2", "part2"]).select("a", F.col("fp").alias("b"))
            out = out.union(back).union(back2)
    return out.where("a <> b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """One row per row of `docs`: the id, `fingerprint` (16 hex digits) and `component_id`.

    component_id is the smallest id reachable over links of at most `bits` differing bits, the row's own included.
    Null and empty texts have fingerprint zero and link like any other; rows that repeat an id are each returned;
    a null id never names a component unless all ids in it are null; an empty table gives an empty one.
    """
    fp = saved(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")), "fingerprints")
    groups = saved(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    roots = saved(components(links(groups.select("fp"), bits)), "roots")
    named = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "root").select("fp", "component_id")
    return fp.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """One document of each component: that with the smallest id, null ids last; of rows that repeat an id, that whose text has the smallest hash.

    Rows that repeat both id and text are copies of one document and stay or go together. Columns are those of `docs`.
    """
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("version"))
    found = near_duplicates(docs.select(key.alias("key"), F.col(text).alias("text")), doc_id="key", text="text", bits=bits)
    i, v = free(docs, "gone_id", "gone_version")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id.id").alias(i), F.col("doc_id.version").alias(v)).distinct()
    return docs.join(gone, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(v)), "left_anti")


def brute_force(rows: list[tuple[int, str | None]], bits: int = 2) -> list[tuple[int, str, int]]:
    """The rows of `near_duplicates`, by comparing all pairs; for tests."""
    fps = [fingerprint(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= bits:
                    label[i], changed = label[j], True
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, label, strict=True)]
