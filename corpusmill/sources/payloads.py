"""Tool payloads: JSON texts of findings, errors and markers, and texts nested in responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.rules import map_severity

EVIDENCE = 200
_ITEM = "array<struct<file string, line int, evidence string, description string, match string, content string, severity string>>"


def payload_findings(payloads: DataFrame, *keys: str, payload: str = "payload") -> DataFrame:
    """A finding for each entry of a payload's findings, errors and matches (or data); keys that a tool names otherwise fall back."""
    j = F.from_json(payload, f"findings {_ITEM}, errors {_ITEM}, matches {_ITEM}, data {_ITEM}")
    read = payloads.select(*keys, j.alias("j"))
    parts = []
    for kind, items, texts, severity in (
        ("security", F.col("j.findings"), ("evidence", "description"), map_severity(F.coalesce("e.severity", F.lit("P3")))),
        ("error", F.coalesce("j.errors", "j.data"), ("evidence", "match"), F.lit("P2")),
        ("todo", F.col("j.matches"), ("match", "content"), F.lit("P3")),
    ):
        each = read.select(*keys, F.explode(items).alias("e"))
        said = F.substring(F.coalesce(*[F.col(f"e.{t}") for t in texts], F.lit("")), 1, EVIDENCE)
        parts.append(each.select(*keys, F.lit(kind).alias("kind"), F.coalesce("e.file", F.lit("")).alias("file"), F.coalesce("e.line", F.lit(0)).alias("line"), said.alias("evidence"), severity.alias("severity")))
    return parts[0].union(parts[1]).union(parts[2])


def response_text(response: Column) -> Column:
    """The texts of a response's content, else its text, else its result, else nothing."""
    j = F.from_json(response, "content array<struct<text string>>, text string, result string")
    content = F.array_join(F.transform(j["content"], lambda c: F.coalesce(c["text"], F.lit(""))), "\n")
    return F.coalesce(content, j["text"], j["result"], F.lit(""))
