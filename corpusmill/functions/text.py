"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TRAVERSAL = r"(?i)(?:^|/|\\)\.{2,}(?:/|\\)|%2e%2e"


def path_reason(path: Column) -> Column:
    """Why a path isn't safe to open; null if it is."""
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "empty")
        .when(F.length(path) > 4096, "too long")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control characters")
        .when(path.rlike(TRAVERSAL), "traversal")
    )


def ascii_folded(c: Column) -> Column:
    """Lower case with accents taken off and what isn't ASCII left out."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def tokens(c: Column) -> Column:
    """Words of letters (German included) and digits, lower-cased, of two characters at least."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-zäöüß0-9]+"), 0), lambda w: F.length(w) > 1)


def normal_tag(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-"))
