"""What messages ask for: keyword and pattern scores, gates, last messages, and argument summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ascii_folded

# Weights of the domains.
DOMAIN_WEIGHTS = {"bug": 10, "research": 8, "framework": 7, "db": 6, "debug": 5, "web": 4, "code": 2}
ARGUMENTS = ("path", "query", "sql", "url", "pattern", "symbol", "name")


def last_user_message(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """The last message of the user in each conversation."""
    return messages.where("role = 'user'").groupBy(key).agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def weighted(text: Column, keywords: Mapping[str, Sequence[str]], weights: Mapping[str, int] = DOMAIN_WEIGHTS) -> Column:
    """The domain of the largest weight of which a keyword is in the text; null if there is none."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for domain in sorted(keywords, key=lambda d: weights.get(d, 1)):  # the heaviest is tried first
        hit = F.lit(False)
        for k in keywords[domain]:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, F.lit(domain)).otherwise(out)
    return out


def scored(messages: DataFrame, patterns: Sequence[tuple[str, Sequence[str]]], key: str, text: str = "text") -> DataFrame:
    """(key, intent, score): the intent of which most patterns match the folded text, the first in order on a tie; none: no row."""
    folded = messages.withColumn("__t", ascii_folded(F.col(text)))
    counts = F.array(*[F.struct(sum((F.col("__t").rlike(p).cast("int") for p in ps), F.lit(0)).alias("score"), F.lit(-i).alias("pos"), F.lit(name).alias("intent")) for i, (name, ps) in enumerate(patterns)])
    best = F.array_max(counts)
    return folded.select(key, best.alias("b")).where("b.score > 0").select(key, "b.intent", "b.score")


def gate(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the (folded) keywords is in the folded text."""
    return F.coalesce(ascii_folded(text).rlike("|".join(words)), F.lit(False))


def argument_summary(args: Column, keys: Sequence[str] = ARGUMENTS) -> Column:
    """The first three arguments that are set, as key=value, values cut at 80 characters."""
    m = F.from_json(args, "map<string,string>")
    one = lambda k: F.when(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.when(F.length(F.try_element_at(m, F.lit(k))) > 80, F.concat(F.substring(F.try_element_at(m, F.lit(k)), 1, 77), F.lit("..."))).otherwise(F.try_element_at(m, F.lit(k)))))
    return F.array_join(F.slice(F.filter(F.array(*[one(k) for k in keys]), lambda x: x.isNotNull()), 1, 3), ", ")


def tool_domain(tool: Column, prefixes: Mapping[str, str]) -> Column:
    """The domain of a tool by its name's prefix; other if none fits."""
    out = F.lit("other")
    for prefix, domain in prefixes.items():
        out = F.when(tool.startswith(prefix), F.lit(domain)).otherwise(out)
    return out
