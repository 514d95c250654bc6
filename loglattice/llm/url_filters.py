"""URL filters: pattern rules fetched by their rarest literal token.

Each rule carries one token, the rarest of its literals among all rules.  The distinct urls are
broken into tokens, an equality join fetches the rules whose token occurs, and only those run
their regular expression.  Everything is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.llm import common as c
from loglattice.llm.registry import query

TOKEN = "[A-Za-z0-9_]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host followed by path.  Every token in ``literals`` must be a whole
    token of any address the pattern fits.  Named rules come before patterns without a name,
    longer before shorter."""

    pattern: str
    literals: tuple[str, ...]
    verdict: str
    name: str | None = None


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path."""
    whole = re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?![A-Za-z0-9_]|$)", path)
    return Rule(rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), verdict, host + path)


def word_rule(verdict: str, pattern: str, *literals: str) -> Rule:
    """A regular expression without a name; it decides where no named rule fits."""
    return Rule(pattern, literals, verdict)


# fixed values: the rules of the registered query
SITE_RULES = [
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
]
WORD_RULES = [
    word_rule("block", r"^([^/]*[.-])?spam[.-]", "spam"),
    word_rule("block", r"^([^/]*[.-])?cheap-[a-z]+\.", "cheap"),
    word_rule("block", r"^([^/]*[.-])?casino[.-]", "casino"),
]


def indexed(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule under its rarest literal; a rule without literals is refused, because
    nothing would ever fetch it."""
    if bare := [r.pattern for r in rules if not r.literals]:
        raise ValueError(f"rules without a literal token: {bare}")
    seen = Counter(token for r in rules for token in set(r.literals))
    rows = [
        (min(r.literals, key=lambda t: (seen[t], -len(t), t)), r.pattern, r.verdict, r.name, len(r.name or ""))
        for r in rules
    ]
    return spark.createDataFrame(rows, "_token string, _pattern string, verdict string, rule string, _long int")


def host_of(url: Column) -> Column:
    return c.ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The verdict is that of the longest named rule that fits, else of any nameless pattern that
    fits (block before allow), else ``default``.  A null url, or one without ``://``, has an
    empty host and path and gets ``default``.  Repeated rows stay repeated; of own columns named
    host, path, rule or verdict the input's are dropped.  An empty table gives an empty one.

    The verdict depends on the url alone, so it is worked out once per distinct url; the rules
    are a list on the driver, hence small, and are left to the planner to send or shuffle.
    """
    base = pages.drop("host", "path", "rule", "verdict", "_best")
    best = (
        base.select("url").where(F.col("url").isNotNull()).distinct()
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("url", F.concat("host", "path").alias("_address"))
        .select("url", "_address", F.explode(F.array_distinct(F.regexp_extract_all("_address", F.lit(f"({TOKEN})"), 1))).alias("_token"))
        .join(indexed(pages.sparkSession, rules), "_token")
        .where(F.regexp_like("_address", F.col("_pattern")))
        .groupBy("url")
        .agg(F.max(F.struct(F.col("rule").isNotNull(), "_long", F.col("verdict") == "block", "rule", "verdict")).alias("_best"))
    )
    return base.join(best, "url", "left").select(
        *base.columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


_WORDS = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in WORD_RULES)
_RULES = ", ".join(
    f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in SITE_RULES
)
SQL = rf"""
WITH rules(name, rhost, rpath, rverdict) AS (VALUES {_RULES}),
cut AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{c.A_Z}', '{c.a_z}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
best AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(rverdict, length(name)) AS rverdict
  FROM parts, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(rverdict, CASE WHEN {_WORDS} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""


@query("op2_url_filters", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pages = c.table(spark, folder, "pages").select("page_id", "url")
    return judged(pages, SITE_RULES + WORD_RULES).select("page_id", "host", "path", "rule", "verdict")
