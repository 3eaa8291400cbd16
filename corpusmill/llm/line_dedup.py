"""Line dedup by an exact set-similarity join.

A line is the set of its words (lower-cased A-Z, parted by white space). Two lines match if the Jaccard similarity of their
sets is at least `num / den`. A line is removed if some earlier line matches it, earlier by document id and then by
line number; what happens to that earlier line doesn't matter.

Texts are taken apart once; the sets are saved as packed word hashes. Lines with equal sets are settled by grouping. Between
different sets, each line files its rarest words: with n words it can only match a line that shares one of its first
n - ceil(t n) + 1 words in order of rarity. Lines that meet under a word are paired if their lengths and the word's places in
both allow a match (length and positional filter) and the parities of their words' bits don't differ too often (each word
that only one has flips one bit at most); the sets of each pair are compared in full.

Rarity is counted over all lines in 2**22 hashed counters, which have one fixed size however large the corpus is. Any order that
all lines share gives the same result; a rarer-first order only makes the lists short. Words seen in one line only can't be
shared and aren't filed.

Words whose counter is above HOT aren't sent to the task of their word, but dealt out evenly; their lists, and all others of more
than LONG lines, are joined by Spark, whose skew join parts the large ones. There the first LEAD lines are compared with the rest, and
only lines that are still unmatched are then compared with the earlier lines of the list that are of like length. So a large
group of near copies costs work in proportion to its size, and no task holds a list. Where that would be more than PAIRS pairs
(many lines of common words that match nothing), lines meet only if they share two or three of their rarest words.

Words are known by 48-bit and sets by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import deleted, free, saved, tidied
from .words import BLANK, LOWERED as _LOW, between, cut, hashes, runs

COUNTERS = 22
CHUNK = 16  #: counters go to the driver in chunks of 2**16
TOP = 65535  #: a counter, a set's size and a word's place stop here
MAP_BITS = 25
LEAD = 16
LONG = 256
HOT = 20_000
PAIRS = 1_000_000  #: pairs of a list beyond which lines meet under tuples of words
BUCKET = 250_000  #: filed words that are sorted together
TEXT_BYTES = 4 << 20  #: texts that are taken apart at a time
_WORD = np.uint64((1 << 48) - 1)


@dataclass
class Sets:
    """The word sets of the lines of some texts; lines without words are left out. `line` says whose word each of `words` is."""

    text: np.ndarray
    no: np.ndarray
    n: np.ndarray
    id: np.ndarray
    line: np.ndarray
    words: np.ndarray


def sets_of(texts: pa.Array) -> Sets:
    b, at, start, end, text = cut(texts, BLANK)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Sets(none, none, none, none, none, none.astype(np.uint64))
    breaks = np.flatnonzero(b == 10)
    line_at = between(breaks, start)  # line feeds before the word
    row = line_at + text  # grows from line to line over all texts
    key = hashes(b, start, end) & _WORD
    new = np.append(True, row[1:] != row[:-1])
    head = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    text = text[head]
    no = line_at[head] - np.searchsorted(breaks, at[text])
    key |= (line & 0xFFFF).astype(np.uint64) << np.uint64(48)
    for first in range(0, len(head), 1 << 16):  # sorted by line, then by word
        key[head[first] : head[first + (1 << 16)] if first + (1 << 16) < len(head) else len(key)].sort()
    once = np.append(True, key[1:] != key[:-1])
    words, line = key[once] & _WORD, line[once]
    n = np.bincount(line)
    head = np.cumsum(n) - n
    ids = words * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(0x94D049BB133111EB)
    return Sets(text, no, n, np.add.reduceat(ids, head).view(np.int64), line, words)


def _counter(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48 - COUNTERS)).astype(np.int64)


def _firsts(ids: np.ndarray) -> np.ndarray:
    """Marks one line of each set."""
    out = np.zeros(len(ids), bool)
    out[np.unique(ids, return_index=True)[1]] = True
    return out


def _binary(size: np.ndarray, data: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Binary values of `size` bytes each, one after another in `data`; null where not `there`."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    mask = None if there is None else pa.array(there).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(size), [mask, pa.py_buffer(offsets), pa.py_buffer(data)])


def _packed(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, words) of a column of packed sets without nulls."""
    size, data = _bytes(column)
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return size // 6, wide.view("<u8").ravel()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _scanner(id_type: pa.DataType):
    """A row for each line, with the set's words where it is the first of its chunk; at the end of a task its word counters, in chunks."""
    schema = pa.schema([("doc_id", id_type), ("version", pa.int64()), ("line_no", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("words", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.uint32)
        for rows in runs(batches, 2, TEXT_BYTES):
            sets = sets_of(rows.column(2))
            first = _firsts(sets.id)
            words = sets.words[first[sets.line]]
            at = np.sort(_counter(words))
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            counts[at[head]] += np.diff(np.append(head, len(at))).astype(np.uint32)
            n, text = len(sets.id), pa.array(sets.text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(text), rows.column(1).take(text), pa.array(sets.no.astype(np.int32)), pa.array(sets.n.astype(np.int32)), pa.array(sets.id), _binary(np.where(first, 6 * sets.n, 0), _packed(words), first), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=schema,
            )
        for chunk in range(1 << (COUNTERS - CHUNK)):
            part = counts[chunk << CHUNK : (chunk + 1) << CHUNK]
            if part.any():
                none = [pa.nulls(1, schema.types[i]) for i in range(6)]
                yield pa.RecordBatch.from_arrays([*none, pa.array([chunk], pa.int32()), pa.array([np.minimum(part, TOP).astype("<u2").tobytes()], pa.binary())], schema=schema)
        tidied()

    return lines


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of each chunk; a counter stops at TOP."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(blob, "<u2").astype(np.uint32)
            sums[chunk] = np.minimum(sums[chunk] + part, TOP) if chunk in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<u2").tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])


#: A filed word: 32 bits of it (words that share them only make a list longer), the set's size, the word's place, parities and the set.
FILED = np.dtype([("tok", "<u4"), ("n", "<u2"), ("pos", "<u2"), ("sig", "<u8"), ("id", "<i8")])


def _filer(rarity: Broadcast, buckets: int, num: int, den: int):
    """Files each set under the rarest words it may share with a set that matches: FILED records, packed by bucket of words. Hot words have buckets
    below zero, dealt by set."""
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def filed(ids: np.ndarray, n: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.cumsum(n) - n
        sig = np.bitwise_xor.reduceat(np.uint64(1) << (words & np.uint64(63)), head)
        line = np.repeat(np.arange(len(n)), n)
        key = (line.astype(np.uint64) << np.uint64(48)) | (counts[_counter(words)].astype(np.uint64) << np.uint64(32)) | (words & np.uint64(0xFFFFFFFF))
        key.sort()  # lines keep their places
        pos = np.arange(len(key)) - head[line]
        size = n[line]
        count = (key >> np.uint64(32)) & np.uint64(TOP)
        take = (pos < size - (num * size + den - 1) // den + 1) & (count > 1) & np.append(True, key[1:] != key[:-1])
        out = np.empty(take.sum(), FILED)
        at = line[take]
        out["tok"], out["n"], out["pos"] = key[take] & np.uint64(0xFFFFFFFF), np.minimum(size[take], TOP), np.minimum(pos[take], TOP)
        out["sig"], out["id"] = sig[at], ids[at]
        bucket = ((out["tok"].astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        return np.where(count[take] > HOT, -1 - (out["id"] & 0xFFFFF), bucket), out

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(bucket[head].astype(np.int32)), _binary(np.diff(np.append(head, len(rows))) * FILED.itemsize, rows.view(np.uint8))], schema=schema)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        held, many = [], 0
        for rows in runs(batches, 1, TEXT_BYTES):
            n, words = _unpacked(rows.column(1))
            able = ((den - num) * n >= num) & (n > 0)  # smaller sets only match equal ones
            words, n, ids = words[np.repeat(able, n)], n[able], np.asarray(rows.column(0))[able]
            for at in range(0, len(n), 1 << 16):
                part = slice(at, at + (1 << 16))
                a, b = n[:at].sum(), n[: at + (1 << 16)].sum()
                found = filed(ids[part], n[part], words[a:b], counts)
                if len(found[0]):
                    held.append(found)
                    many += len(found[0])
            if many >= BUCKET:
                yield packed(held)
                held, many = [], 0
        if held:
            yield packed(held)
        tidied()

    return file


_MET = "a long, b long, tok long, id long, n int, pos int, sig long"


def _pairer(num: int, den: int):
    """Blocks come sorted by bucket. Gives the pairs of lists up to LONG that pass the filters, and the rows of longer lists and of hot words."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tok", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("sig", pa.int64())])

    def longer(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(rows["tok"].astype(np.int64)), pa.array(rows["id"].copy()), pa.array(rows["n"].astype(np.int32)), pa.array(rows["pos"].astype(np.int32)), pa.array(rows["sig"].copy().view(np.int64))], schema=schema)

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.argsort((rows["tok"].astype(np.uint64) << np.uint64(32)) | (rows["id"].view(np.uint64) & np.uint64(0xFFFFFFFF)))]
        same = (rows["tok"][1:] == rows["tok"][:-1]) & (rows["id"][1:] == rows["id"][:-1]) & (rows["pos"][1:] == rows["pos"][:-1])
        rows = rows[np.append(True, ~same)]  # a set that came from several tasks is one
        tok, ids, sig, n, pos = rows["tok"], rows["id"], rows["sig"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
        head = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        size = np.diff(np.append(head, len(rows)))
        left = np.repeat(head + size, size) - np.arange(len(rows)) - 1  # rows after this one in its list
        long = np.repeat(size > LONG, size)
        at = np.flatnonzero(~long & (left > 0))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        d = 1
        while len(at):
            to = at + d
            x, y = n[at], n[to]
            fits = (den * x >= num * y) & (den * y >= num * x) & (np.minimum(x - pos[at], y - pos[to]) * (num + den) >= num * (x + y))
            fits[fits] = (num + den) * np.bitwise_count(sig[at[fits]] ^ sig[to[fits]]).astype(np.int64) <= (den - num) * (x + y)[fits]
            fits |= (x == TOP) | (y == TOP)
            fits &= ids[at] != ids[to]
            a.append(ids[at[fits]])
            b.append(ids[to[fits]])
            d += 1
            at = at[left[at] >= d]
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), *[pa.nulls(len(both), t) for t in schema.types[2:]]], schema=schema)
        if long.any():
            yield longer(rows[long])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, last = 0, None
        for batch in runs(batches, 1, BUCKET * FILED.itemsize):
            bucket = np.asarray(batch.column(0))
            size, data = _bytes(batch.column(1))
            rows, bucket = data.view(FILED) if data.flags.aligned else np.frombuffer(data.tobytes(), FILED), np.repeat(bucket, size // FILED.itemsize)
            if (bucket < 0).any():
                yield longer(rows[bucket < 0])
                rows, bucket = rows[bucket >= 0], bucket[bucket >= 0]
            if not len(rows):
                continue
            if count >= BUCKET and bucket[0] != last:
                yield from settle(np.concatenate(held))
                held, count = [], 0
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut and count + cut >= BUCKET:
                yield from settle(np.concatenate([*held, rows[:cut]]))
                held, count, rows = [], 0, rows[cut:]
            held.append(rows)
            count += len(rows)
            last = bucket[-1]
        if count:
            yield from settle(np.concatenate(held))
        tidied()

    return pair


_SIGS = [f"sig{k}" for k in range(4)]


def _fetcher(wanted: Broadcast):
    """The sets whose name's bit is set in the map, all that are wanted and a few more, with their sizes and the parities of their words in 4 x 64 bits."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for rows in batches:
            slot = np.asarray(rows.column(0)) & (8 * len(bits) - 1)
            rows = rows.filter(pa.array(((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)))
            n, words = _unpacked(rows.column(1))
            bit = np.uint64(1) << (words & np.uint64(63))
            part = (words >> np.uint64(6)) & np.uint64(3)
            sigs = [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), np.cumsum(n) - n).view(np.int64) if len(n) else np.zeros(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n.astype(np.int32)), *[pa.array(x) for x in sigs]], names=["id", "words", "n", *_SIGS])
        tidied()

    return fetch


def _alike(num: int, den: int):
    """The `late` ids of rows (late, words, words) whose sets have a Jaccard similarity of at least num / den."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 1, TEXT_BYTES):
            x, y = _unpacked(rows.column(1)), _unpacked(rows.column(2))
            shared = np.zeros(len(x[0]), np.int64)
            for at in range(0, len(shared), 1 << 16):
                part = slice(at, at + (1 << 16))
                keys = [words[n[:at].sum() : n[: at + (1 << 16)].sum()] | (np.repeat(np.arange(len(n[part])), n[part]).astype(np.uint64) << np.uint64(48)) for n, words in (x, y)]
                key = np.sort(np.concatenate(keys))
                same = key[1:][key[1:] == key[:-1]]
                shared[part] = np.bincount((same >> np.uint64(48)).astype(np.int64), minlength=len(shared[part]))
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(den * shared >= num * (x[0] + y[0] - shared)))], names=["id"])
        tidied()

    return compare


def _later(pairs: DataFrame, sets: DataFrame, firsts: DataFrame, num: int, den: int) -> DataFrame:
    """The ids of the later set of each pair (a, b) with a Jaccard similarity of at least num / den.

    Each set is first compared with its earliest partner, and only where that fails with the others. A map of MAP_BITS bits says which sets to fetch.
    """
    names = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    slot = F.col("id").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    on = names.groupBy(F.shiftright(slot, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast((id & {(1 << MAP_BITS) - 1}) & 7 as int))")).alias("bits")).toArrow()  # 2**22 rows at most
    wanted = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    wanted[np.asarray(on["byte"])] = np.asarray(on["bits"]).astype(np.uint8)
    handle = pairs.sparkSession.sparkContext.broadcast(wanted)
    fetched = sets.mapInArrow(_fetcher(handle), "id long, words binary, n int, " + ", ".join(f"{x} long" for x in _SIGS))
    known = saved(fetched.join(names.distinct(), "id", "left_semi").dropDuplicates(["id"]).join(firsts.select("id", "first"), "id"), "known")
    side = lambda s: known.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("first", "n", *_SIGS)])
    unlike = sum((F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in _SIGS), F.lit(0))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(unlike * (num + den) <= (den - num) * (F.col("a_n") + F.col("b_n")))
    a_first = F.col("a_first") < F.col("b_first")
    both = saved(both.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("late"), F.least("a_first", "b_first").alias("first")), "ordered")

    def matched(some: DataFrame) -> DataFrame:
        rows = some.join(known.select(F.col("id").alias("early"), F.col("words").alias("a")), "early").join(known.select(F.col("id").alias("late"), F.col("words").alias("b")), "late")
        return saved(rows.select("late", "a", "b").mapInArrow(_alike(num, den), "id long").distinct(), "gone")

    earliest = both.groupBy("late").agg(F.min_by("early", "first").alias("early"))
    gone = matched(earliest)
    rest = both.join(gone.select(F.col("id").alias("late")), "late", "left_anti").join(earliest, ["late", "early"], "left_anti")
    more = matched(rest.select("late", "early"))
    deleted(known)
    deleted(both)
    return gone.union(more)


def _paired(left: DataFrame, right: DataFrame, num: int, den: int, on: tuple[str, ...] = ("tok",)) -> DataFrame:
    """Pairs (a, b) that share a filed word and pass the length, positional and parity filters, the first one from `left` and earlier."""
    x = left.select(*on, *[F.col(c).alias(f"x_{c}") for c in left.columns if c not in on])
    y = right.select(*on, *[F.col(c).alias(f"y_{c}") for c in right.columns if c not in on])
    total = F.col("x_n") + F.col("y_n")
    room = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    fits = (den * F.col("x_n") >= num * F.col("y_n")) & (den * F.col("y_n") >= num * F.col("x_n")) & (room * (num + den) >= num * total)
    fits &= F.bit_count(F.col("x_sig").bitwiseXOR(F.col("y_sig"))) * (num + den) <= (den - num) * total
    fits |= (F.col("x_n") == TOP) | (F.col("y_n") == TOP)
    return x.join(y, list(on)).where((F.col("x_first") < F.col("y_first")) & fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def _tuple_size(kind: int, num: int, den: int) -> int:
    """How many shared words are looked up together among sets of some (den / num) ** kind words: three for short sets, else two, and never more than a match must share."""
    least = -(-num // (den - num))
    return max(1, min(3 if (den / num) ** kind <= 32 else 2, -(-num * least // den)))


def _tupler(rarity: Broadcast, num: int, den: int):
    """Sets (id, kind, toks, n, sig, words) filed under tuples of their rarest words, the first of which is one of `toks`."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            ids, kinds, tuples = [], [], []
            size, words = _unpacked(batch.column(5))
            end = np.cumsum(size)
            order = (counts[_counter(words)].astype(np.uint64) << np.uint64(32)) | (words & np.uint64(0xFFFFFFFF))
            for row, (kind, toks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                k, n, wanted = _tuple_size(kind, num, den), int(size[row]), set(toks)
                first = n - -(-num * n // den) + 1  # where the first shared word may stand
                low = (np.sort(order[end[row] - n : end[row]])[: first + k - 1] & np.uint64(0xFFFFFFFF)).tolist()
                mine = {hash((low[i], *rest)) for i in range(min(first, len(low))) if low[i] in wanted for rest in combinations(low[i + 1 :], k - 1)}
                ids += [row] * len(mine)
                kinds += [kind] * len(mine)
                tuples += mine
            taken = batch.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(tuples, pa.int64()), pa.array(kinds, pa.int32()), *(taken.column(c) for c in (0, 3, 4))], names=["tuple", "kind", "id", "n", "sig"])

    return file


def _in_tuples(rest: DataFrame, open_: DataFrame, sets: DataFrame, rarity: Broadcast, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the sets of crowded lists, of `rest` with `open_`: only sets that share two or three of their rarest words meet.

    Sets that match share at least ceil(t n) words, so the first k that they share stand among the first n - ceil(t n) + k of either.
    """
    words = sets.join(rest.select("id").union(open_.select("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])

    def filed(some: DataFrame) -> DataFrame:
        each = some.groupBy("id", "kind").agg(F.collect_set("tok").alias("toks"), F.first("n").alias("n"), F.first("sig").alias("sig"))  # a set's filed words
        return each.join(words, "id").select("id", "kind", "toks", "n", "sig", "words").mapInArrow(_tupler(rarity, num, den), "tuple long, kind int, id long, n int, sig long")

    x, y = (filed(some).select("tuple", "kind", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "n", "sig")]) for some, s in ((rest, "x"), (open_, "y")))
    total = F.col("x_n") + F.col("y_n")
    fits = (den * F.col("x_n") >= num * F.col("y_n")) & (den * F.col("y_n") >= num * F.col("x_n")) & (F.bit_count(F.col("x_sig").bitwiseXOR(F.col("y_sig"))) * (num + den) <= (den - num) * total)
    fits |= (F.col("x_n") == TOP) | (F.col("y_n") == TOP)
    return x.join(y, ["tuple", "kind"]).where((F.col("x_id") != F.col("y_id")) & fits).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def _matched(sets: DataFrame, firsts: DataFrame, rarity: Broadcast, words: int, num: int, den: int) -> DataFrame:
    """The ids of the sets that match a set seen earlier."""
    spark = sets.sparkSession
    buckets = min(1 << 30, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), words * (den - num) // den // BUCKET))
    filed = sets.mapInArrow(_filer(rarity, buckets, num, den), "bucket int, rows binary")
    met = saved(filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairer(num, den), _MET), "met")
    short = met.where("a is not null").select("a", "b")
    longer = met.where("a is null").select("tok", "id", "n", "pos", "sig")
    if longer.isEmpty():
        return _later(saved(short.distinct(), "pairs"), sets, firsts, num, den)
    longer = saved(longer.distinct().join(firsts.select("id", "first"), "id"), "longer")
    lead = longer.withColumn("rank", F.row_number().over(Window.partitionBy("tok").orderBy("first", "id"))).where(F.col("rank") <= LEAD).drop("rank")
    gone = _later(saved(short.union(_paired(lead, longer, num, den)).distinct(), "pairs"), sets, firsts, num, den)
    # sets of like size are in the same or in neighbouring classes
    kind = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
    rest = longer.withColumn("kind", kind)
    open_ = rest.join(gone, "id", "left_anti").withColumn("kind", F.explode(F.array(kind - 1, kind, kind + 1)))
    on = ["tok", "kind"]
    both = rest.groupBy(*on).agg(F.count(F.lit(1)).alias("x")).join(open_.groupBy(*on).agg(F.count(F.lit(1)).alias("y")), on)
    crowded = saved(both.where(F.col("x").cast("double") * F.col("y") > PAIRS).select(*on), "crowded")
    two = _paired(rest, open_, num, den, ("tok", "kind"))
    if not crowded.isEmpty():
        two = _paired(rest.join(crowded, on, "left_anti"), open_, num, den, ("tok", "kind")).union(_in_tuples(rest.join(crowded, on), open_.join(crowded, on), sets, rarity, num, den))
    two = saved(two.distinct(), "pairs")
    deleted(longer)
    return gone if two.isEmpty() else saved(gone.union(_later(two, sets, firsts, num, den)).distinct(), "gone")


def removed_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, version, line_no): the lines with an earlier match, numbered from 0. version is the text's hash, which tells rows of one id apart."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("version long, line_no int, n int, id long, words binary, chunk int, counts binary").fields])
    scan = saved(docs.mapInArrow(_scanner(_arrow(id_type)), shape), "lines")
    lines = scan.where("id is not null").select("doc_id", "version", "line_no", "id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "line_no")
    firsts = saved(lines.groupBy("id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    chunks = scan.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_added, "chunk int, counts binary").collect()  # 2**22 counters of two bytes
    counts = np.zeros(1 << COUNTERS, np.uint16)
    for r in chunks:
        counts[r["chunk"] << CHUNK : (r["chunk"] + 1) << CHUNK] = np.frombuffer(r["counts"], "<u2")
    words = scan.where("words is not null").agg(F.sum("n")).first()[0] or 0
    gone = _matched(scan.where("words is not null").select("id", "words"), firsts, spark.sparkContext.broadcast(counts), words, num, den)
    settled = firsts.join(gone.withColumn("matched", F.lit(True)), "id", "left").where("matched or copies > 1")
    out = saved(lines.join(settled, "id").where(F.col("matched").isNotNull() | (order > F.col("first"))).select("doc_id", "version", "line_no"), "removed")
    deleted(scan)
    deleted(firsts)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def rest(t, numbers):
        drop = set(numbers.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

    return pd.Series([t if g is None or t is None else rest(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the removed lines taken out of `text`, and n_lines and n_removed added (columns of these names are replaced).

    Lines are what "\n" parts; null and empty texts have none and stay as they are. Lines without words are never removed. Ids
    may be of any type that sorts, a null id comes last. Rows that repeat an id are documents of their own, in the order of their texts' hashes;
    rows that repeat id and text are copies of one document: a line isn't earlier than itself in the other copy, and all copies lose the
    same lines. An empty table gives an empty one.
    """
    gone = removed_lines(docs, doc_id=doc_id, text=text, **options).groupBy("doc_id", "version").agg(F.collect_set("line_no").alias("gone"))
    i, v, numbers = free(docs, "gone_id", "gone_version", "gone")
    gone = gone.select(F.col("doc_id").alias(i), F.col("version").alias(v), F.col("gone").alias(numbers))
    out = docs.join(gone, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(v)), "left")
    n = F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    out = out.withColumns({"n_lines": n.cast("long"), "n_removed": F.when(F.col(numbers).isNull(), 0).otherwise(F.size(numbers)).cast("long")})
    return out.withColumn(text, _without(F.col(text), F.col(numbers))).drop(i, v, numbers)


def brute_force(docs: list[tuple[int, str | None]], num: int = 4, den: int = 5) -> dict[int, list[int]]:
    """The removed line numbers of each document, by comparing all lines with all earlier ones; for tests."""
    lines = [(i, no, s) for i, t in sorted(docs, key=lambda r: r[0]) for no, x in enumerate((t or "").split("\n")) if (s := set(x.encode().translate(_LOW).split()))]
    out: dict[int, list[int]] = {}
    for k, (i, no, s) in enumerate(lines):
        if any(den * len(s & o) >= num * len(s | o) for j, m, o in lines[:k] if (j, m) != (i, no)):
            out.setdefault(i, []).append(no)
    return out
