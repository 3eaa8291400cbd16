"""How the sources of a language differ in their words: in-mapper stripes, merged by key, that emit divergences.

Each partition folds whole documents into stripes, term -> (document frequency, occurrences by source), in hash tables that are
written out (spilled) whenever they hold `CELLS` numbers. Sorted by language and term, the partial stripes of a term meet and are
added up one after the other; a frequent term comes once for each spill, never once for each document. A merged stripe, with its
language's totals beside it, gives its part of every divergence: of each pair of sources, added up in the same way as the stripes, and
of each source against its language, of which a partition keeps the largest.

The stripe of the empty term, which no text has, counts documents: so groups without terms are known too.

With N occurrences of kept terms in a group and V kept terms, a term's smoothed share is p = 1 + floor(UNIT * (count + 2) / (N + 2 V)),
and shares p and q diverge by floor((p - q)^2 / (p + q)). All of it is integers: Python's where a product may pass 63 bits, NumPy's elsewhere.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

UNIT = 1_000_000_000
CELLS = 1_000_000  #: numbers that a task's stripes, or its pairs of sources, may hold before they are written out
ROWS = 20_000  #: rows of an output batch

#: For bytes.translate: A-Z to a-z, other ASCII but letters to a space; bytes of non-ASCII characters stay.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STRIPES = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """The terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def _stripes(lang: list[str] | pa.Array, term: pa.Array, df: np.ndarray, group: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """A batch of stripes from their cells: `group` (ascending) says whose stripe a cell (source, count) belongs to."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(df)))])
    listed = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), term, pa.array(df, pa.int64()), listed(sources), listed(pa.array(counts, pa.int64()))], schema=_STRIPES)


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _spilled(df: dict[str, Counter], counts: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
    """A hash table as stripes, language by language."""
    for lang, docs in df.items():
        place = dict(zip(docs, range(len(docs)), strict=True))
        mine = [(source, c) for (of, source), c in counts.items() if of == lang]
        group = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in mine])
        n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in mine])
        who = np.repeat(np.arange(len(mine)), [len(c) for _, c in mine])
        order = np.argsort(group, kind="stable")
        names = pa.array([source for source, _ in mine], pa.string()).take(pa.array(who[order]))
        yield from _sliced(_stripes([lang] * len(docs), pa.array(list(docs), pa.binary()), np.fromiter(docs.values(), np.int64, len(docs)), group[order], names, n[order]))


def _folded(cells: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[str, Counter] = {}
        counts: dict[tuple[str, str], Counter] = {}
        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = terms(text.as_py())
                words.append(b"")
                docs, occurrences = df.setdefault(lang, Counter()), counts.setdefault((lang, source), Counter())
                held -= len(docs) + len(occurrences)
                docs.update(set(words))
                occurrences.update(words)
                held += len(docs) + len(occurrences)
                if held >= cells:
                    yield from _spilled(df, counts)
                    df, counts, held = {}, {}, 0
        yield from _spilled(df, counts)

    return fold


def _merged(least: int):
    """Adds up neighbouring stripes of one term, which come sorted; those of fewer than `least` documents go, but for the empty term's."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last term's stripe so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            new = np.ones(batch.num_rows, bool)
            lang, term = (pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            new[1:] = lang | term
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from _sliced(_summed(batch.slice(0, last), new[:last], least))
            rest = _summed(batch.slice(last), new[last:], 0)
        if rest is not None:
            yield _summed(rest, np.ones(1, bool), least)

    return merge


def _summed(rows: pa.RecordBatch, new: np.ndarray, least: int) -> pa.RecordBatch:
    """One stripe for each run of rows; `new` marks where runs begin."""
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    df = np.add.reduceat(rows.column(2).to_numpy(), start)
    empty = pc.equal(pc.binary_length(rows.column(1).take(pa.array(start))), 0).to_numpy(zero_copy_only=False)
    kept = (df >= least) | empty
    run = np.cumsum(kept)[run] - 1  # as numbered among the kept
    some = np.repeat(kept, np.diff(np.append(start, rows.num_rows)))
    run, inside = run[some], rows.filter(pa.array(some))
    cell = np.repeat(run, pc.list_value_length(inside.column(3)).to_numpy(zero_copy_only=False))
    named = inside.column(3).flatten().dictionary_encode()
    width = max(1, len(named.dictionary))
    key = cell * width + named.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    counts = np.add.reduceat(inside.column(4).flatten().to_numpy(zero_copy_only=False)[order], first) if len(first) else np.zeros(0, np.int64)
    heads = pa.array(start[kept])
    return _stripes(rows.column(0).take(heads), rows.column(1).take(heads), df[kept], key[first] // width, named.dictionary.take(pa.array(key[first] % width)), counts)


def stripes(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 1, cells: int = CELLS) -> DataFrame:
    """(lang, term, df, sources, counts): a merged stripe for every term of at least `least` of a language's documents; the empty term's counts documents. Nulls are empty strings."""
    plain = docs.select(F.col(text).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
    kind = "lang string, term binary, df long, sources array<string>, counts array<long>"
    parts = plain.mapInArrow(_folded(cells), kind)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merged(least), kind)


def _emitted(top: int, cells: int):
    """From stripes with their language's totals: (lang, source, part, item, value), partial sums for pairs and the largest terms of each group."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, tuple[dict[str, int], list[int], int]] = {}  # places of the sources, their wholes N + 2 V, the language's
        pairs: dict[tuple[str, int], np.ndarray] = {}  # sums of source i with all later ones
        best: dict[tuple[str, str], list[tuple[int, tuple[int, ...], bytes]]] = {}
        held = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for (lang, i), sums in pairs.items():
                names = list(langs[lang][0])
                yield _part("pair", lang, names[i], names[i + 1 :], sums)
            for (lang, source), heap in best.items():
                yield _part("term", lang, source, [t.decode("utf-8", "surrogatepass") for _, _, t in heap], [v for v, _, _ in heap])
            pairs.clear()
            best.clear()

        def added(lang: str, rows: list[list[int]]) -> Iterator[pa.RecordBatch]:
            """Adds the divergences of some terms (rows of shares) to those of all pairs of sources (columns)."""
            nonlocal held
            p = np.array(rows, np.int64).reshape(-1, len(langs[lang][0]))
            for i in range(p.shape[1] - 1):
                d = p[:, i : i + 1] - p[:, i + 1 :]
                value = (d * d // (p[:, i : i + 1] + p[:, i + 1 :])).sum(axis=0)
                if (lang, i) in pairs:
                    pairs[lang, i] += value
                else:
                    pairs[lang, i] = value
                    held += len(value)
                    if held >= cells:
                        yield from summed()
                        held = 0

        for batch in batches:
            waiting: dict[str, list[list[int]]] = {}
            for row, (lang, term, names, counts) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if lang not in langs:
                    v, sources, totals = (batch.column(k)[row].as_py() for k in (4, 5, 6))
                    langs[lang] = ({s: i for i, s in enumerate(sources)}, [n + 2 * v for n in totals], sum(totals) + 2 * v)
                    yield from added(lang, [])
                if not term:  # counts documents
                    continue
                place, wholes, whole = langs[lang]
                p = [1 + 2 * UNIT // w for w in wholes]
                q = 1 + UNIT * (sum(counts) + 2) // whole
                for source, n in zip(names, counts, strict=True):
                    i = place[source]
                    p[i] = share = 1 + UNIT * (n + 2) // wholes[i]
                    if share > q:
                        if (lang, source) not in best:
                            best[lang, source] = []
                            held += top
                        _push(best[lang, source], (share - q) * (share - q) // (share + q), term, top)
                some = waiting.setdefault(lang, [])
                some.append(p)
                if len(some) * len(p) >= 1 << 19:
                    yield from added(lang, waiting.pop(lang))
            for lang, some in waiting.items():
                yield from added(lang, some)
        yield from summed()

    return emit


def _part(part: str, lang: str, source: str, items: list[str], values) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_PARTS)


def _push(heap: list, value: int, term: bytes, top: int) -> None:
    """Keeps the `top` largest values; of equal ones those whose term's bytes come first."""
    if len(heap) == top and value < heap[0][0]:
        return
    item = (value, tuple(-b for b in term) + (1,), term)  # a larger tuple is an earlier term
    if len(heap) < top:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def divergences(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part "pair": for each (lang, source) every other source of the language as item, and the divergence over all kept terms (those in at least
    `least` of the language's documents). Part "term": the kept terms of the source whose share is above the language's, the first `top` by divergence. Ranks go from 1 by value
    descending and item ascending by its bytes. Null text, lang and source are empty strings; rows that repeat count again; a group without terms has
    pairs; a source that is alone in its language has none; an empty table gives an empty one; other columns of `docs` aren't read.
    """
    kept = saved(stripes(docs, text=text, lang=lang, source=source, least=least, cells=cells), "stripes")
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("s"))
    groups = each.groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum(F.when(F.col("term") != F.lit(b""), F.col("s.counts")).otherwise(0)).alias("n"))
    v = kept.groupBy("lang").agg((F.count(F.lit(1)) - 1).alias("n_terms"))
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))
    totals = saved(v.join(by_lang, "lang").select("lang", "n_terms", F.col("g.source").alias("all_sources"), F.col("g.n").alias("totals")), "totals")
    beside = kept.join(totals, "lang").select("lang", "term", "sources", "counts", "n_terms", "all_sources", "totals")
    parts = saved(beside.mapInArrow(_emitted(top, cells), "lang string, source string, part string, item string, value long"), "divergences")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(pairs.select("lang", F.col("item").alias("source"), F.lit("pair").alias("part"), F.col("source").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    terms_ = parts.where("part = 'term'").select(*both.columns)
    return both.withColumn("rank", place).union(terms_.withColumn("rank", place).where(F.col("rank") <= top))
