"""Document quality from a linear-chain conditional random field over lines.

Each line that isn't blank is good or bad. Its features are its own and those of the lines before and after it; a
transition weight for each pair of labels ties neighbours together. Marginals from forward-backward, weighted by the
lines' lengths, give the document's quality. The field is fitted on documents whose label holds for all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import tidied

SAMPLE = 3000  #: labelled documents the field is fitted on, at most
SAMPLE_LINES = 256  #: lines of each of these, from a place chosen by the text's length
ROUNDS = 120
GROUP = 256  #: texts scored at a time
_KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"#$%&*@^~=+<>{}[]\\_/",
    b"|",
    b"!?",
    b".,;:",
    b" \t\r\x0b\x0c",
)
WIDTH = 16


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()] if text else []


def features(lines: list[str]) -> np.ndarray:
    """One row of WIDTH numbers from 0 to 1 for each line."""
    out = np.zeros((len(lines), WIDTH), np.float32)
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    for k, x in enumerate(lines):
        raw = x.encode("utf-8", "surrogatepass")
        n = len(raw)
        words = x.split()
        w = len(words)
        out[k, :7] = [(n - len(raw.translate(None, kind))) / n for kind in _KINDS]
        out[k, 7:] = (
            1.0,
            min(1.0, n / 500),
            min(1.0, w / 60),
            min(1.0, n / w / 20),
            len(set(words)) / w,
            sum(map(eq, words, words[1:])) / w,
            seen[x] > 1,
            x[-1] in ".!?:;\"'”»)",
            not raw.isascii(),
        )
    return out


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and the line after (zeros at the ends)."""
    none = np.zeros((1, own.shape[1]), own.dtype)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def _padded(logits: list[np.ndarray], cells: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of chains of like length: (which, logits padded to one length, lengths)."""
    order = np.argsort([len(x) for x in logits], kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(logits[order[to]]) <= cells:
            to += 1
        which = order[at:to]
        lengths = np.array([len(logits[i]) for i in which])
        pad = np.zeros((len(which), max(1, int(lengths.max()))))
        for row, i in enumerate(which):
            pad[row, : len(logits[i])] = logits[i]
        yield which, pad, lengths
        at = to


def forward_backward(u: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) by chain and place, expected counts of label pairs by chain, log of the partition sum).

    u: the weight of label good over bad at each place; trans[a, b]: weight of b after a.
    """
    n, t = u.shape
    inside = np.arange(t)[None, :] < lengths[:, None]
    a0, a1 = np.zeros((t, n)), np.zeros((t, n))
    a1[0] = u[:, 0]
    for i in range(1, t):
        x = np.logaddexp(a0[i - 1] + trans[0, 0], a1[i - 1] + trans[1, 0])
        y = np.logaddexp(a0[i - 1] + trans[0, 1], a1[i - 1] + trans[1, 1]) + u[:, i]
        on = inside[:, i]
        a0[i], a1[i] = np.where(on, x, a0[i - 1]), np.where(on, y, a1[i - 1])
    z = np.logaddexp(a0[-1], a1[-1])
    good = np.zeros((n, t))
    pairs = np.zeros((n, 2, 2))
    b0, b1 = np.zeros(n), np.zeros(n)
    for i in range(t - 1, -1, -1):
        good[:, i] = np.where(inside[:, i], np.exp(np.minimum(a1[i] + b1 - z, 0)), 0)
        if i:
            on = inside[:, i]
            n0, n1 = b0, b1 + u[:, i]
            for a, alpha in ((0, a0[i - 1]), (1, a1[i - 1])):
                for b, beta in ((0, n0), (1, n1)):
                    pairs[:, a, b] += np.where(on, np.exp(np.minimum(alpha + trans[a, b] + beta - z, 0)), 0)
            c0 = np.logaddexp(trans[0, 0] + n0, trans[0, 1] + n1)
            c1 = np.logaddexp(trans[1, 0] + n0, trans[1, 1] + n1)
            b0, b1 = np.where(on, c0, b0), np.where(on, c1, b1)
    return good, pairs, z


def fit(chains: list[np.ndarray], labels: list[int], rounds: int = ROUNDS, ridge: float = 1e-3) -> dict:
    """Weights by gradient ascent (Adam) on the mean log-likelihood of the chains, each labelled alike all along.

    A chain's lines together count as much as those of any other chain.
    """
    width = 3 * WIDTH
    w, trans = np.zeros(width), np.zeros((2, 2))
    kept = [(with_neighbours(c), y) for c, y in zip(chains, labels, strict=True) if len(c)]
    if not kept or len({y for _, y in kept}) < 2:
        only = kept[0][1] if kept else 1
        w[7] = 2.0 if only else -2.0  # the constant feature
        return {"w": w, "trans": trans}
    x = [c.astype(np.float64) for c, _ in kept]
    y = np.array([v for _, v in kept])
    groups = [(which, lengths, np.concatenate([x[i] for i in which]), np.repeat(np.arange(len(which)), lengths), np.concatenate([np.arange(n) for n in lengths])) for which, _, lengths in _padded([c[:, 0] for c in x], 60_000)]
    first, second = np.zeros(width + 4), np.zeros(width + 4)
    for r in range(1, rounds + 1):
        gw, gt = np.zeros(width), np.zeros((2, 2))
        for which, lengths, rows, chain, place in groups:
            u = np.zeros((len(which), int(lengths.max())))
            u[chain, place] = rows @ w
            good, pairs, _ = forward_backward(u, lengths, trans)
            share = 1 / lengths
            gw += ((y[which][chain] - good[chain, place]) * share[chain]) @ rows
            seen = np.zeros((len(which), 2, 2))
            seen[np.arange(len(which)), y[which], y[which]] = lengths - 1
            gt += ((seen - pairs) * share[:, None, None]).sum(axis=0)
        g = np.append(gw / len(x) - ridge * w, (gt / len(x) - ridge * trans).ravel())
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.2 * (first / (1 - 0.9**r)) / (np.sqrt(second / (1 - 0.99**r)) + 1e-8)
        w, trans = w + step[:width], trans + step[width:].reshape(2, 2)
    return {"w": w, "trans": trans}


def line_marginals(model: dict, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """The lines that aren't blank and P(good) of each, for every text."""
    lines = [lines_of(t) for t in texts]
    logits = [with_neighbours(features(x)).astype(np.float64) @ model["w"] if x else np.zeros(0) for x in lines]
    out: list[tuple[list[str], np.ndarray]] = [(x, np.zeros(0)) for x in lines]
    for which, u, lengths in _padded(logits):
        good, _, _ = forward_backward(u, lengths, model["trans"])
        for row, i in enumerate(which):
            out[i] = (lines[i], good[row, : lengths[row]])
    return out


def scores(model: dict, texts: list[str | None]) -> list[float]:
    out = []
    for lines, good in line_marginals(model, texts):
        n = np.array([len(x) for x in lines], dtype=np.float64)
        out.append(float(np.clip((n * good).sum() / n.sum(), 0, 1)) if len(lines) else 0.0)
    return out


def quality(text: Column, model: dict) -> Column:
    """The quality of each text from 0 to 1. A null, empty or blank text has no good line and scores 0."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([v for i in range(0, len(s), GROUP) for v in scores(model, s.iloc[i : i + GROUP].tolist())], dtype="float64")
        tidied()

    return F.pandas_udf(scored, T.DoubleType())(text)


def good_lines(text: Column, model: dict) -> Column:
    """array<struct<line, good>> of the lines that aren't blank, with each line's marginal."""
    kind = T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("good", T.DoubleType())]))

    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"line": x, "good": float(g)} for x, g in zip(lines, good.tolist(), strict=True)] for lines, good in line_marginals(model, s.tolist())], dtype=object)

    return F.pandas_udf(marked, kind)(text)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _sample_features(s: pd.Series) -> pd.Series:
    out = []
    for t in s:
        lines = lines_of(t)
        start = len(t or "") % max(1, len(lines) - SAMPLE_LINES + 1)
        out.append(features(lines)[start : start + SAMPLE_LINES].ravel())
    return pd.Series(out, dtype=object)


def trained(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The field, fitted on at most `sample` labelled documents, those with the least hash of their id.

    Ids with a null label or with different labels are left out. Only `sample` ids and the line features of these documents
    (SAMPLE_LINES of each at most) come to the driver. With documents of one label only, or none, all lines get that label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other")
    known = known.join(docs.select(F.col(doc_id).alias("__id")), "__id", "left_semi")
    chosen = [(r["__id"], int(r["y"])) for r in known.orderBy(F.xxhash64("__id"), "__id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("y", T.IntegerType())]))
    got = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids), "id").select("id", "y", F.xxhash64("t").alias("h"), _sample_features("t").alias("f"))
    got = got.groupBy("id").agg(F.min("y").alias("y"), F.min_by("f", "h").alias("f")).collect()  # of rows that repeat an id, one
    rows = sorted(((r["id"], r["y"], r["f"]) for r in got), key=lambda r: r[0])
    return fit([np.array(f, np.float32).reshape(-1, WIDTH) for _, _, f in rows], [y for _, y, _ in rows])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with held_out, score and predicted; columns of these names are replaced, and every row stays."""
    model = trained(docs.select(doc_id, text), labels.where(~held_out(F.col(doc_id))), doc_id=doc_id, text=text, **options)
    out = docs.withColumns({"held_out": held_out(F.col(doc_id)), "score": quality(F.col(text), model)})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are predicted good, with the columns of `docs`."""
    known = labels.where(~held_out(F.col(doc_id)))
    model = trained(docs.select(doc_id, text), known, doc_id=doc_id, text=text, **options)
    return docs.where(quality(F.col(text), model) >= 0.5)
