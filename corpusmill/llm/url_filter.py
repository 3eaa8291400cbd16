"""URL filters: pattern rules found by their rarest literal token.

A rule is a pattern over host and path: `||` starts at the host or at any subdomain's dot, `|` at the very start or end,
`*` is any run and `^` a separator. Its literal tokens are the runs of letters and digits that can't be longer in a
matching URL; of a run that goes on in a `*` its first BEGIN letters count. The rule is filed under the one token of them that fewest URLs have. The tokens of each
distinct URL fetch rules by an equality join, and only for these pairs is the rule's regular expression run.
Only rules without any token are filed under the empty token, which every URL then has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, free

_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"
_TOKEN = r"[A-Za-z0-9]+"
BEGIN = 4  #: letters by which tokens that go on are looked up


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str = "block"
    name: str | None = None  #: what results call it; None for rules of the general list


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """For a host with its subdomains, and paths that begin with `path`."""
    return Rule(f"||{host}{path}", verdict, host + path)


#: The general list: block what is an advert or a tracker by its path.
GENERAL = (
    Rule("/adserver/"),
    Rule("/popunder/"),
    Rule("/banner/ads/"),
    Rule("||doubleclick.*^"),
    Rule("||casino*^"),
    Rule("/tracking/pixel^"),
)


def regex(pattern: str) -> str:
    """A Java regular expression that is searched in host + path."""
    start = end = ""
    if pattern.startswith("||"):
        start, pattern = r"\A(?:[^/]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        start, pattern = r"\A", pattern[1:]
    if pattern.endswith("|"):
        end, pattern = r"\z", pattern[:-1]
    return "(?s)" + start + "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.sub(r"([^A-Za-z0-9])", r"\\\1", c) if c.isascii() else c for c in pattern) + end


def tokens(pattern: str) -> list[str]:
    """Runs of letters and digits with a literal other character, a separator or an anchor on both sides; of those that go on in a `*`, how they begin."""
    anchored = pattern.startswith("|")
    body = pattern.lstrip("|") if anchored else pattern
    last = body.endswith("|")
    body = body.removesuffix("|")
    found = []
    for m in re.finditer(_TOKEN, body):
        left = m.start() == 0 and anchored or m.start() > 0 and body[m.start() - 1] != "*"
        right = m.end() == len(body) and last or m.end() < len(body) and body[m.end()] != "*"
        if left and right:
            found.append(m[0])
        elif left and len(m[0]) >= BEGIN and m.end() < len(body):
            found.append(f"{m[0][:BEGIN]}*")
    return list(dict.fromkeys(found))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or without `://`: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filtered(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", general: Sequence[Rule] = GENERAL, default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; columns of these names are replaced.

    Of the named rules that match, the longest decides, the smaller name on a tie. Else the longest matching rule of `general`
    decides, with rule null, and else `default`. Null URLs and those without `://` match no rule. Repeated URLs are judged once and
    joined back; every row stays. Whether the rule table is broadcast is left to Spark, which looks at its size.
    """
    spark = pages.sparkSession
    listed = [(k, r.name, r.verdict, len(r.pattern), regex(r.pattern), tokens(r.pattern), r.name is not None) for k, r in enumerate([*rules, *general])]
    table = spark.createDataFrame(listed, "id int, name string, verdict string, length int, regex string, tokens array<string>, named boolean")
    rest = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    target = F.concat("host", "path")
    urls = rest.select(target.alias("target")).where("target <> ''").distinct()
    found = F.regexp_extract_all("target", F.lit(_TOKEN), 0)
    keys = [found]
    if any(t.endswith("*") for *_, asked, _ in listed for t in asked):
        keys.append(F.transform(F.filter(found, lambda t: F.length(t) >= BEGIN), lambda t: F.concat(F.substring(t, 1, BEGIN), F.lit("*"))))
    if not all(asked for *_, asked, _ in listed):
        keys.append(F.array(F.lit("")))
    met = urls.select("target", F.explode(F.array_distinct(F.concat(*keys))).alias("token"))
    asked = table.select("id", F.explode("tokens").alias("token"))
    often = met.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = asked.join(often, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    filed = table.join(rarest, "id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    fits = met.join(filed, "token").where(F.expr("target rlike regex"))
    best = fits.groupBy("target").agg(F.min_by(F.struct("name", F.col("verdict").alias("v")), F.struct(~F.col("named"), -F.col("length"), "name", "verdict")).alias("best"))
    at, found = free(rest, "target", "best")
    out = rest.withColumn(at, target).join(best.select(F.col("target").alias(at), F.col("best").alias(found)), at, "left")
    return out.withColumns({"rule": F.col(f"{found}.name"), "verdict": F.coalesce(f"{found}.v", F.lit(default))}).drop(at, found)
