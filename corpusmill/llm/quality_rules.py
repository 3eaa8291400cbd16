"""Quality rules whose cutoffs limit how many good documents they reject, with a stated confidence, in every stratum.

A rule is a share of two counts, from 0 to 1, and rejects documents over its cutoff. Cutoffs come from a grid fixed beforehand. In
each stratum (a language, say) the good documents of a labelled holdout that pass the base rule are counted by the cutoffs that would
reject them. A cutoff is certified if the exact binomial (Clopper-Pearson) upper bound of its rate of false rejection is at most the
rule's part of `risk`; for each rule and stratum the cutoffs are tested from the laxest on, each only after all laxer ones were certified
(fixed-sequence testing, which needs no correction of its own), and `error` is divided by the number of rules and strata (Bonferroni).
So with probability 1 - error, in all strata together, the rules reject at most `risk` of the good documents.

Of the certified cutoffs a rule takes the one with the most bad documents that no earlier rule rejects, less the good documents lost;
the laxest of equal ones. A rule without any gain, or with too few labels for a certificate, has no cutoff there and rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved

STEPS = 100  #: cutoffs are 0, 1/STEPS, ... 1
RISK = 0.05  #: of the good documents of a stratum, the share that all rules together may reject
ERROR = 0.05  #: probability that this fails in any stratum
SYMBOLS = b"#*$%&|<>"
_NO_FIRST = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # what isn't the first byte of a character of a word


@dataclass(frozen=True)
class Rule:
    """Rejects documents where part / whole is over a cutoff; both are names of counts, and part is never over whole."""

    name: str
    part: str
    whole: str


RULES = (
    Rule("symbols", "n_symbols", "word_chars"),
    Rule("repeated words", "n_repeat_words", "n_words"),
    Rule("repeated lines", "n_dup_lines", "n_lines"),
    Rule("short words", "n_words", "word_chars"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated(words: list[bytes]) -> int:
    """How many words stand in a window of three words that is found twice or more, its first place included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = dict.fromkeys(words)
    if len(known) == len(words):
        return 0
    known = dict(zip(known, range(len(known))))
    n = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    pairs = n[:-1] * len(known) + n[1:]
    if len(known) > 1 << 20:  # three numbers wouldn't fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + n[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = order[np.append(same, False) | np.append(False, same)]
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[twice + k] = True
    return int(np.count_nonzero(hit))


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS for one text; a null text has none of anything."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(raw.translate(None, _NO_FIRST)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
    )


def counted(text: Column) -> Column:
    """Struct of COUNTS for whole texts."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([counts(t) for t in s], columns=list(COUNTS), dtype="int64")

    return F.pandas_udf(count, ", ".join(f"{c} long" for c in COUNTS))(text)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def level(rule: Rule, steps: int = STEPS) -> Column:
    """The number of cutoffs 0, 1/steps, ... that a document's share is over: it is rejected at cutoff k / steps if this is over k."""
    return F.expr(f"least({steps}L, ({rule.part} * {steps} + greatest({rule.whole}, 1L) - 1) div greatest({rule.whole}, 1L))").cast("int")


def at_most(x: int, n: int, p: float) -> float:
    """P(X <= x) of a binomial X with n trials of chance p, for x below the mean; at or above the mean only some value over 0.4."""
    if x >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))
    total = 0.0
    for k in range(x, -1, -1):
        total += term
        term *= k / (n - k + 1) * (1 - p) / p
        if term < total * 1e-17:
            break
    return total


def upper_bound(x: int, n: int, error: float) -> float:
    """The Clopper-Pearson bound: the largest chance under which x or fewer of n has probability `error` or more."""
    low, high = (x / n if n else 0.0), 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if n == 0 or x >= n or at_most(x, n, mid) > error else (low, mid)
    return high


def chosen(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> tuple[int, int, int] | None:
    """(cutoff, good documents rejected, bad documents rejected) from the numbers of good and of not yet rejected bad documents at each level; None if no cutoff is certified and gains."""
    n, steps = int(good.sum()), len(good) - 1
    best = None
    for k in range(steps, -1, -1):  # from the laxest
        lost, caught = int(good[k + 1 :].sum()), int(bad[k + 1 :].sum())
        if n == 0 or at_most(lost, n, risk) > error:
            break
        if caught - lost > (best[2] - best[1] if best else 0):
            best = (k, lost, caught)
    return best


def _chooser(name: str, steps: int, risk: float, error: float):
    """From one stratum's (label, level, n): a row with its cutoff, or none."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(rows.level[rows.label == y], rows.n[rows.label == y], steps + 1).astype(np.int64) for y in (1, 0))
        got, n = chosen(good, bad, risk, error), int(good.sum())
        each = [(rows.stratum.iloc[0], name, got[0] / steps, got[0], n, got[1], upper_bound(got[1], n, error))] if got else []
        return pd.DataFrame(each, columns=["stratum", "rule", "cutoff", "step", "n_good", "n_lost", "bound"])

    return choose


def cutoffs(known: DataFrame, rules: Sequence[Rule] = RULES, *, steps: int = STEPS, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_lost, bound) from labelled documents (stratum, label 1 or 0, COUNTS) that pass the base rule.

    Each rule takes one aggregation to (stratum, label, level), and a stratum's few numbers are looked at in one group; nothing else is gathered.
    """
    held = saved(known.select("stratum", F.col("label").cast("int").alias("label"), *[level(r, steps).alias(f"level_{i}") for i, r in enumerate(rules)]), "holdout")
    n_strata = max(1, held.select("stratum").distinct().count())
    risk, error = risk / len(rules), error / len(rules) / n_strata
    found = []
    for i, rule in enumerate(rules):
        hist = held.groupBy("stratum", "label", F.col(f"level_{i}").alias("level")).agg(F.count(F.lit(1)).alias("n"))
        took = saved(hist.groupBy("stratum").applyInPandas(_chooser(rule.name, steps, risk, error), "stratum string, rule string, cutoff double, step int, n_good long, n_lost long, bound double"), "cutoffs")
        found.append(took)
        if i + 1 < len(rules):  # bad documents that this rule rejects are no gain for the next ones
            held = held.join(took.select("stratum", "step"), "stratum", "left").where((F.col("label") == 1) | F.col("step").isNull() | (F.col(f"level_{i}") <= F.col("step"))).drop("step")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def learnt_from(doc_id: Column) -> Column:
    """Rows whose labels cutoffs are chosen by: crc32 of the id as text, modulo 3, isn't 1. The others are left to judge the cutoffs by."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def judged(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality",
    rules: Sequence[Rule] = RULES, steps: int = STEPS, risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """`docs` with the counts, `base_failed`, `kept` and `rejected_by` (the first rule over its cutoff, or "base", else null).

    Columns of these names are replaced; other columns may have any name, and every row stays, repeated and null ids too. A null text has no words
    and fails the base rule; a null stratum is the stratum "". Labels that are null, that differ for an id, or whose id is no document's
    teach nothing; without labels only the base rule rejects. An empty table gives an empty one.
    """
    new = {*COUNTS, "base_failed", "kept", "rejected_by"}
    others = F.struct(F.lit(True).alias("carried"), *[F.col(f"`{c}`") for c in docs.columns if c not in new])
    named = docs.select(others.alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), counted(F.col(text)).alias("c"))
    base = saved(named.select("row", "id", "stratum", "c.*").withColumn("base_failed", base_failed()), "counts")
    said = labels.where(F.col(label).isNotNull() & learnt_from(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    known = base.where("not base_failed").select("id", "stratum", *COUNTS).join(said.select("id", "label"), "id")
    found = cutoffs(known, rules, steps=steps, risk=risk, error=error)
    limits = found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("step"))).alias(f"step_{i}") for i, r in enumerate(rules)])
    over = F.coalesce(*[F.when(level(r, steps) > F.col(f"step_{i}"), F.lit(r.name)) for i, r in enumerate(rules)])
    out = base.join(limits, "stratum", "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(over))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *COUNTS, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(options.get("doc_id", "doc_id")).alias("doc_id"), F.col(options.get("text", "text")).alias("text"), F.col(options.get("stratum", "lang")).alias("lang"))
    ids = labels.withColumnRenamed(options.pop("doc_id", "doc_id"), "doc_id")
    options = {k: v for k, v in options.items() if k not in ("text", "stratum")}
    return judged(whole, ids, **options).where("kept").select("whole.*")
