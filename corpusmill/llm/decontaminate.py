"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words. Words are the symbols: a block is two of them (one in windows of one word).
A shift table over hashed blocks says how far the search may move on, buckets by the hash of a window's last block
hold the windows that may end here, and a direct comparison of all words confirms them. All documents of an Arrow
batch are searched in lockstep, each with its own cursor, so each step is a few NumPy calls.

The windows are broadcast in blocks of at most `max_words` words, each block being one scan of the documents, so what
a task holds is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import alnum_words, ascii_lower, free, named, saved, tidied

TABLE_BITS = 18
SEGMENT = 512
GROUP = 1024
PART = 100_000  #: words of an item that are taken together


class WindowIndex:
    """The windows of some items, by length: shift table, buckets by suffix hash, and the words of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
        self.names: list[str] = []
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            m = min(size, len(coded))
            windows = by_length.setdefault(m, {})
            for at in range(len(coded) - m + 1):
                owners = windows.setdefault(tuple(coded[at : at + m]), [])
                if not owners or owners[-1] != item:
                    owners.append(item)
        self.groups = [self._group(m, windows) for m, windows in sorted(by_length.items())]

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
        """Of the block that ends at each position `at`."""
        h = ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if block == 2:
            h ^= ids[at - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _group(self, m: int, windows: dict[tuple[int, ...], list[int]]) -> tuple:
        block = min(2, m)
        words = np.array(list(windows), dtype=np.int64).reshape(-1, m)
        shift = np.full(1 << TABLE_BITS, m - block + 1, dtype=np.int64)
        flat = words.ravel()
        for end in range(block - 1, m):
            np.minimum.at(shift, self._hash(flat, np.arange(len(words)) * m + end, block), m - 1 - end)
        buckets: dict[int, list[int]] = {}
        for k, h in enumerate(self._hash(flat, np.arange(len(words)) * m + m - 1, block).tolist()):
            buckets.setdefault(h, []).append(k)
        return m, block, shift, buckets, list(windows), list(windows.values())

    def search(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(position, length, items) of each occurrence in `ids`; documents begin at `starts` and are parted by zeros."""
        for m, block, shift, buckets, windows, owners in self.groups:
            ends = np.append(starts[1:], len(ids))
            cut = [np.arange(a, b, SEGMENT) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            begin = np.concatenate(cut) if cut else np.zeros(0, np.int64)
            until = np.minimum(begin + SEGMENT + m - 1, np.repeat(ends, [len(c) for c in cut]))
            cursor = begin + m - 1
            while True:
                going = cursor < until
                cursor, until = cursor[going], until[going]
                if not len(cursor):
                    break
                hashed = self._hash(ids, cursor, block)
                step = shift[hashed]
                for at, h in zip(cursor[step == 0].tolist(), hashed[step == 0].tolist(), strict=True):
                    here = tuple(ids[at - m + 1 : at + 1].tolist())
                    for k in buckets.get(h, ()):
                        if windows[k] == here:
                            yield at - m + 1, m, owners[k]
                cursor = cursor + np.maximum(step, 1)


def scan(index: WindowIndex, texts: list[str | None]) -> list[tuple[int, set[int], set[str]]]:
    """(number of words, positions of the hit words, items) of each text."""
    get, counts, coded = index.ids.get, [], []
    for text in texts:
        words = alnum_words(text)
        counts.append(len(words))
        coded.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        coded.append(np.zeros(1, np.int64))  # parts the documents
    ids = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64) + 1)[:-1]]).astype(np.int64) if counts else np.zeros(0, np.int64)
    hit: dict[int, set[int]] = {}
    items: dict[int, set[str]] = {}
    for at, m, owners in index.search(ids, starts):
        doc = int(np.searchsorted(starts, at, side="right")) - 1
        hit.setdefault(doc, set()).update(range(at - int(starts[doc]), at - int(starts[doc]) + m))
        items.setdefault(doc, set()).update(index.names[i] for i in owners)
    return [(n, hit.get(k, set()), items.get(k, set())) for k, n in enumerate(counts)]


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _searcher(items: Broadcast, size: int):
    """A UDF that searches texts for the windows of broadcast items; the index is built once a task."""

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = WindowIndex(items.value, size)
        for s in batches:
            got = [scan(index, s.iloc[i : i + GROUP].tolist()) for i in range(0, len(s), GROUP)]
            yield pd.DataFrame([(n, sorted(h), sorted(i)) for part in got for n, h, i in part], columns=["n_words", "hits", "items"])
        tidied()

    return F.pandas_udf(found, _FOUND)


def find_windows(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, max_words: int = 500_000, found: str = "found") -> DataFrame:
    """`docs` with a column (`found`, or of that name): struct of `n_words`, `hits` (sorted positions of hit words), `items` (sorted ids as strings).

    A window is `size` consecutive words of an item, or all words of an item with fewer. A null or empty text has no
    words and no hits; an empty benchmark hits nothing; equal windows of several items count for each of them; items
    whose id is null are ignored, and items that share an id count as one. A column of `docs` with the name of the new one is replaced.
    """
    known = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("id"), _words(F.col(item_text)).alias("w"))
    cuts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)), F.lit(PART))
    known = known.select("id", F.explode(F.transform(cuts, lambda at: F.array_join(F.slice("w", at, PART + size - 1), " "))).alias("t"))  # long items in overlapping parts
    total = known.agg(F.sum(F.length("t") - F.length(F.replace(F.col("t"), F.lit(" "), F.lit(""))) + 1)).first()[0] or 0
    blocks = max(1, -(-total // max_words))
    if blocks == 1:
        return docs.withColumn(found, _searcher(_items(docs, known), size)(F.col(text)))
    (row,) = free(docs, "row_number")
    base = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    out = None
    for b in range(blocks):  # one pass each, so that a task holds the windows of one block only
        rows = known.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b)
        part = saved(base.select(F.col(row).alias("row"), _searcher(_items(docs, rows), size)(F.col(text)).alias("part")), "found")
        hit = part.select("row", "part.n_words", "part.hits", "part.items")
        if b:
            hit = hit.where(F.size("items") > 0)
        out = hit if out is None else out.union(hit)
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = out.groupBy(F.col("row").alias(row)).agg(F.struct(F.max("n_words").alias("n_words"), merge("hits").alias("hits"), merge("items").alias("items")).alias(found))
    return base.drop(found).join(merged, row).select(*named([c for c in docs.columns if c != found]), found)


def _items(docs: DataFrame, rows: DataFrame) -> Broadcast:
    """The words of a block of items, to be broadcast; some `max_words`."""
    got = rows.collect()
    return docs.sparkSession.sparkContext.broadcast([(r["id"], alnum_words(r["t"])) for r in sorted(got, key=lambda r: (r["id"], r["t"] or ""))])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def judged(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated: some word is hit, and at least one in `share`."""
    (found,) = free(docs, "found")
    f = find_windows(docs, benchmark, found=found, **options)
    n_words, n_hit = F.col(f"{found}.n_words"), F.size(f"{found}.hits").cast("long")
    return f.withColumns(
        {
            "n_words": n_words,
            "n_hit": n_hit,
            "n_items": F.size(f"{found}.items").cast("long"),
            "items_sha256": F.sha2(F.array_join(f"{found}.items", ","), 256),
            "contaminated": (n_hit > 0) & (share * n_hit >= n_words),
        }
    ).drop(found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with the columns of `docs`."""
    (found,) = free(docs, "found")
    f = find_windows(docs, benchmark, found=found, **options)
    n_hit = F.size(f"{found}.hits")
    return f.where(~((n_hit > 0) & (share * n_hit >= F.col(f"{found}.n_words")))).select(*named(docs.columns))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], size: int = 13, share: int = 20) -> list[tuple]:
    """The rows that `judged` gives, found by comparing every window with every position; for tests."""
    rows = []
    for doc_id, text in docs:
        words, hit, names = alnum_words(text), set(), set()
        for name, t in items:
            w = alnum_words(t)
            m = min(size, len(w))
            for a in range(len(w) - m + 1) if m and name is not None else ():
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == w[a : a + m]:
                        hit.update(range(at, at + m))
                        names.add(str(name))
        rows.append((doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and share * len(hit) >= len(words)))
    return rows
