"""Literals that a regular expression can't match without, and the index of patterns by them.

Every match of a pattern holds one of a few literals, if its parse tree says so: the longest run of plain characters in sequence, the union
over alternatives, what must be repeated at least once. Texts are searched once for the literals of all patterns, by one automaton over
their characters, and only patterns whose literal was found are tried. A pattern without such a literal is tried on every text.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from itertools import product
from re import _constants as C, _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MOST = 16  #: alternatives of a literal
COMMON = " .,'\"-_"


def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case ASCII literals of which every match of the pattern holds one, whatever its case; None if none are long or rare enough.

    A pattern that this parser reads in another way than Spark's regular expressions, or can't read, has none.
    """
    if re.search(r"\(\?[a-zA-Z]*[xuU]|\[[^\]]*(&&|\[)|\\[QE]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError, Warning):
        return None
    found = _of_sequence(tree)[1]
    return found if found and all(len(x) > 1 or x not in COMMON and not x.isalnum() for x in found) else None


def _worth(found: frozenset[str] | None) -> tuple[int, int]:
    return (min(map(len, found)), -len(found)) if found else (0, 0)


def _of_sequence(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(all texts that it matches, if these are a few literals; the best literals that a match must hold)."""
    run, whole, best = frozenset({""}), True, None
    for op, value in items:
        exact, inside = _of_item(op, value)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        whole = False
        best = max((best, run - {""} if "" not in run else None, inside), key=_worth)
        run = exact if exact is not None and len(exact) <= MOST else frozenset({""})
    best = max((best, run if "" not in run else None), key=_worth)
    return (run if whole else None), best


def _of_item(op, value) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    if op is C.LITERAL:
        return (frozenset({chr(value).lower()}) if value < 128 else None), None
    if op is C.IN and len(value) <= 4 and all(o is C.LITERAL and v < 128 for o, v in value):
        return frozenset(chr(v).lower() for _, v in value), None
    if op is C.AT:
        return frozenset({""}), None
    if op is C.SUBPATTERN:
        return _of_sequence(value[-1])
    if op is C.ATOMIC_GROUP:
        return _of_sequence(value)
    if op is C.BRANCH:
        parts = [_of_sequence(x) for x in value[1]]
        exact = [e for e, _ in parts]
        inside = [b for _, b in parts]
        union = lambda sets: frozenset().union(*sets) if all(s is not None for s in sets) else None
        return union(exact), union(inside)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, items = value
        exact, inside = _of_sequence(items)
        if least == most == 1:
            return exact, inside
        if least == 0 and most == 1 and exact is not None:
            return exact | {""}, None
        return None, inside if least else None
    return None, None


def holds(lowered: Column, literals: frozenset[str]) -> Column:
    """Whether a lower-case text holds one of the literals."""
    out = F.lit(False)
    for x in sorted(literals):
        out = out | F.contains(lowered, F.lit(x))
    return out


def matched(rows: DataFrame, patterns: Sequence[str], column: str = "line", name: str = "which") -> DataFrame:
    """`rows` once for each of the patterns that its text matches, with the pattern's place in `name`. Keeps no state, so it works on streams.

    The search for literals costs the same for any number of patterns; a text then meets the patterns whose literal it holds.
    """
    literals = [needed(p) for p in patterns]
    index: dict[str, list[int]] = {}
    for i, found in enumerate(literals):
        for x in found or ():
            index.setdefault(x, []).append(i)
    free = [i for i, found in enumerate(literals) if found is None]
    out = []
    if index:
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` int"
        tried = rows.mapInArrow(_finder(index, rows.columns.index(column), name), kind)
        out.append(tried.where(F.rlike(F.col(column), F.element_at(F.lit(list(patterns)), F.col(name) + 1))))
    if free or not index:
        some = rows.where(F.col(column).rlike("|".join(f"(?:{patterns[i]})" for i in free)) if free else F.lit(False))
        each = F.array(*[F.when(F.col(column).rlike(patterns[i]), F.lit(i)) for i in free]) if free else F.array().cast("array<int>")
        out.append(some.select("*", F.explode(F.array_compact(each)).alias(name)))
    return out[0].union(out[1]) if len(out) > 1 else out[0]


def _finder(index: dict[str, list[int]], column: int, name: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, which in index.items():
            automaton.add_word(literal, tuple(which))
        automaton.make_automaton()
        for batch in batches:
            rows: list[int] = []
            found: list[int] = []
            for row, text in enumerate(batch.column(column)):
                text = text.as_py()
                if text:
                    here = {i for _, which in automaton.iter(text.lower()) for i in which}
                    rows += [row] * len(here)
                    found += sorted(here)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, name])

    return find
