"""Exact BM25 top-k search: an inverted index per shard, pruning by pivot and block maxima, and an exact merge.

Block-max WAND moves a cursor for each term from document to document, with a pivot found anew at each. Cursors that step in Python took far longer than
scoring everything, so its two bounds are used on whole lists here, in NumPy: a pivot once for each query and shard (as in MaxScore), and block maxima for each candidate.

Each task takes its documents in shards of about `SHARD_POSTINGS` postings, and holds one shard's inverted index at a time: for
each term the documents, their term weights and the largest one, and for frequent terms the largest weight of each block of
BLOCK documents. The queries come in broadcast blocks of at most QUERY_TERMS terms; no document is shuffled.
A query's threshold is the worst score that is still in its top k. It comes first from one document in `SAMPLE` (the k-th best
score of some documents is never above that of all, so nothing is lost), then also from the task's earlier shards. The pivot parts a query's
terms: frequent ones whose largest weights can't reach the threshold together make no candidates, and the documents of the others are scored by these;
a candidate is passed over if the largest weights of its block, for the terms before the pivot, don't lift it to the threshold, and scored fully otherwise.
idf and average length come from all documents, so scores of different shards compare, and the k best of the shards'
k best are the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import saved
from .words import NOT_ALNUM, cut, hashes

SHARD_POSTINGS = 2_000_000
QUERY_TERMS = 2_000_000
BLOCK = 32
SAMPLE = 16  #: one document in so many gives the first thresholds
FREQUENT = 8  #: terms that one document of a shard in so many has are frequent
LEFT = 0.5  #: terms that add at most this share of the threshold make no candidates
K1, B = 1.2, 0.75
DIGITS = 6

ROWS = 1000  #: texts whose words are counted at a time


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            b, _, first, last, text = cut(rows.column(1), NOT_ALNUM)
            h = hashes(b, first, last)
            order = np.argsort((text << 40) | (h >> np.uint64(24)).astype(np.int64), kind="stable")
            h, owner = h[order], text[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            head = np.flatnonzero(new)
            tf = np.diff(np.append(head, len(h))).astype(np.int32)
            offsets = np.append(0, np.cumsum(np.bincount(owner[head], minlength=rows.num_rows))).astype(np.int32)
            lens = np.bincount(text, minlength=rows.num_rows).astype(np.int64)
            terms = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[head].view(np.int64)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lens), terms, pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf))], names=["id", "len", "terms", "tfs"])


def term_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, len, terms, tfs): words, 64-bit hashes of the distinct ones, and how often each occurs; null and empty texts have none."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(_counted, "id long, len long, terms array<long>, tfs array<int>")


class Shard:
    """The inverted index of some documents: posting lists by term, and the largest weight of each list. Terms that one in `FREQUENT` documents
    has are kept as rows of a table besides (so it has at most FREQUENT cells a posting), with the largest weight of each block of documents."""

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, mean: float, k1: float, b: float):
        self.docs = docs
        order = np.argsort(terms, kind="stable")  # within a term by document
        terms = terms[order]
        self.doc = doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        weight = tfs[order].astype(np.float64)
        del order
        weight /= weight + (k1 * (1 - b + b * lengths / mean))[doc]
        weight *= k1 + 1
        self.weight = weight
        new = np.empty(len(terms), bool)
        new[:1] = True
        np.not_equal(terms[1:], terms[:-1], out=new[1:])
        self.terms = terms[new]
        self.first = np.append(np.flatnonzero(new), len(terms))  # a term's first posting
        self.best = np.maximum.reduceat(weight, self.first[:-1]) if len(terms) else np.zeros(0)
        counts = np.diff(self.first)
        frequent = np.flatnonzero(counts * FREQUENT >= len(docs))
        self.row = np.full(len(self.terms), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.table = np.zeros((len(frequent), len(docs)))
        post = _ranges(self.first[frequent], self.first[frequent + 1])
        self.table[np.repeat(np.arange(len(frequent)), counts[frequent]), doc[post]] = weight[post]
        self.tops = np.maximum.reduceat(self.table, np.arange(0, len(docs), BLOCK), axis=1) if len(docs) else self.table

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document ids, scores) of the k best of those given and of the shard's documents with a score above 0; ties after rounding go to the
        smaller id. Documents whose scores are below `least`, or below the worst of k given ones, are passed over."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        have = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, idf = at[have], idf[have]
        least = max(least, scores[k - 1] if len(scores) >= k else 0.0) - 2 * 10.0**-DIGITS  # equal after rounding counts as equal
        # the pivot: frequent terms that can't reach the threshold together make no candidates
        bound = np.where(self.row[at] >= 0, self.best[at] * idf, np.inf)
        order = np.argsort(bound, kind="stable")
        at, idf = at[order], idf[order]
        reach = np.cumsum(bound[order])
        n = int(np.searchsorted(reach, LEFT * least)) if least > 0 else 0
        left = reach[n - 1] if n else 0.0
        a, b = self.first[at[n:]], self.first[at[n:] + 1]
        post = _ranges(a, b)
        total = np.bincount(self.doc[post], weights=self.weight[post] * np.repeat(idf[n:], b - a), minlength=len(self.docs))
        found = np.flatnonzero((total > 0) & (total >= least - left))
        total = total[found]
        if n and len(found):
            row = self.row[at[:n]]
            keep = total + (idf[:n] @ self.tops[row])[found // BLOCK] >= least  # what their largest weights in a block can add
            found, total = found[keep], total[keep]
            total = total + idf[:n] @ self.table[row[:, None], found]
            keep = total >= least
            found, total = found[keep], total[keep]
        ids = np.concatenate([ids, self.docs[found]])
        scores = np.concatenate([scores, np.round(total, DIGITS)])
        if len(scores) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep = scores >= edge
            ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All of a[0]..b[0]-1, then a[1]..b[1]-1, and so on."""
    n = b - a
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())


_HITS = "query_id long, asked long, doc_id long, score double"


def _searcher(queries: Broadcast, least: Broadcast, k: int, mean: float, k1: float, b: float):
    schema = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, offsets, q_terms, idfs = queries.value
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

        def answer(rows: list[pa.RecordBatch]) -> None:
            docs, lengths, terms, tfs = (pa.chunked_array([r.column(i) for r in rows]).combine_chunks() for i in range(4))
            shard = Shard(np.asarray(docs), np.asarray(lengths).astype(np.float64), np.asarray(terms.flatten()), np.asarray(tfs.flatten()), np.asarray(terms.value_lengths()), mean, k1, b)
            for i in range(len(ids)):
                best[i] = shard.search(q_terms[offsets[i] : offsets[i + 1]], idfs[offsets[i] : offsets[i + 1]], k, least.value[i], *best[i])

        held, postings = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                held.append(rows)
                postings += len(rows.column(2).flatten())
                if postings >= SHARD_POSTINGS:
                    answer(held)
                    held, postings = [], 0
        if held:
            answer(held)
        n = [len(found) for found, _ in best]
        columns = (np.repeat(ids, n), np.repeat(asked, n), np.concatenate([f for f, _ in best]), np.concatenate([x for _, x in best]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return search


def _block(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, asked, offsets, terms, idfs) of some queries."""
    rows = rows.combine_chunks()
    terms = rows["terms"].combine_chunks()
    offsets = np.append(0, np.cumsum(np.asarray(terms.value_lengths()))).astype(np.int64)
    return np.asarray(rows["id"]), np.asarray(rows["asked"]), offsets, np.asarray(terms.flatten()), np.asarray(rows["idfs"].combine_chunks().flatten())


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query row the k best documents with a score above 0.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a query's repeated words count once. The score is
    BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), N and the mean length over documents with words, rounded to six digits;
    ties go to the smaller id. Null and empty texts are never found and find nothing; rows with a null id are left out on
    either side; documents that repeat an id are documents of their own. Queries with equal id and text are asked once. Ids may be of any type that sorts; those that aren't whole numbers are numbered first.
    """
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df, c in ((docs, doc_id), (queries, query_id))):
        d, q = _keys(docs, doc_id), _keys(queries, query_id)
        mine = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(d, "id")
        theirs = queries.select(F.col(query_id).alias("id"), F.col(query_text).alias("text")).join(q, "id")
        found = top_k(mine, theirs, k=k, doc_id="key", text="text", query_id="key", query_text="text", k1=k1, b=b)
        named = lambda keys, c: keys.select(F.col("id").alias(f"{c}_named"), F.col("key").alias(c))
        found = found.join(named(d, "doc_id"), "doc_id").join(named(q, "query_id"), "query_id")
        return found.select(F.col("query_id_named").alias("query_id"), "rank", F.col("doc_id_named").alias("doc_id"), "score")
    index = saved(term_counts(docs.where(F.col(doc_id).isNotNull()), doc_id, text).where("len > 0"), "index")
    n, words = index.agg(F.count(F.lit(1)), F.sum("len")).first()
    asked = term_counts(queries.where(F.col(query_id).isNotNull()), query_id, query_text).select("id", "terms", F.xxhash64("id", F.array_sort("terms")).alias("asked"))
    asked = saved(asked.where(F.size("terms") > 0).dropDuplicates(["asked"]), "asked")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = index.select(F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.select("id", "asked", F.explode("terms").alias("term")).join(df, "term").groupBy("id", "asked").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("t"))
    weighed = saved(weighed.withColumn("t", F.array_sort("t")).select("id", "asked", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs")), "weighed")
    total = weighed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // QUERY_TERMS)
    spark = docs.sparkSession
    hits = spark.createDataFrame([], _HITS)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "doc_id"))
    some_docs = index.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    first = saved(some_docs.coalesce(max(1, index.rdd.getNumPartitions() // SAMPLE)), "first") if blocks else None
    for i in range(blocks):
        rows = weighed.where(F.pmod(F.hash("asked"), F.lit(blocks)) == i).toArrow()  # about QUERY_TERMS terms
        if not rows.num_rows:
            continue
        asked_block = _block(rows)
        handle = spark.sparkContext.broadcast(asked_block)

        def searched(some: DataFrame, least: np.ndarray) -> DataFrame:
            floor = spark.sparkContext.broadcast(least)
            out = saved(some.mapInArrow(_searcher(handle, floor, k, words / n, k1, b), _HITS), "hits")
            floor.destroy()
            return out

        worst = searched(first, np.zeros(rows.num_rows)).withColumn("rank", rank).where(F.col("rank") == k).select("asked", "score").toArrow()  # a row a query of the block
        hits = hits.union(searched(index, _floors(asked_block[1], worst)))
        handle.destroy()
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _keys(df: DataFrame, c: str) -> DataFrame:
    """(id, key): a long for each id that isn't one, in the order of ids."""
    ids = df.select(F.col(c).alias("id")).where(F.col("id").isNotNull()).distinct()
    return saved(ids.repartitionByRange("id").sortWithinPartitions("id").select("id", F.monotonically_increasing_id().alias("key")), "keys")


def _floors(asked: np.ndarray, worst: pa.Table) -> np.ndarray:
    """The k-th best score known of each query, 0 where fewer documents are known."""
    keys, scores = worst["asked"].to_numpy(), worst["score"].to_numpy()
    order = np.argsort(keys)
    least = np.zeros(len(asked))
    if len(keys):
        at = np.searchsorted(keys, asked, sorter=order)
        at[at == len(keys)] = 0
        known = keys[order[at]] == asked
        least[known] = scores[order[at]][known]
    return least
