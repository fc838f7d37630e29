"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an action and a regular expression over `host + path`, with the literal tokens that every
matching URL must hold as whole tokens. The index files each rule under the one of its tokens that the
fewest rules share. The tokens of a URL fetch candidate rules, and only those
run their expressions. Of the matching rules the one of highest priority decides (for path rules: the
longest), ties by the rule's text.

Only DataFrame functions. Up to `INLINE` rules the index is a literal map in the plan, looked up row by row without a
shuffle; up to `BROADCAST_RULES` it is a broadcast table, and beyond that one joined by shuffle, on tokens that are rare by
construction. The number of rules decides only how they are fetched. A rule without tokens is refused.
Null URLs, and URLs without `://`, have an empty host and path and match nothing. URLs of any length are read whole. Rows are
judged one by one: repeated rows, repeated page ids and null ids get equal results; an empty table gives no rows;
columns other than page_id and url play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE, BROADCAST_RULES = 1_000, 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates tokens of a URL; rules and URLs are cut alike.
CUT = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    action: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int
    name: str | None


def path_rule(action: str, text: str) -> Rule:
    """`host/path`: fits the host and its subdomains where the URL's path starts with the rule's."""
    host, _, path = text.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}"
    # the last token of a path can go on in the URL, unless a separator follows it; URLs are lower-cased before they are cut
    lower = re.sub(r"[a-zA-Z0-9]+$", "", path).translate(str.maketrans(UPPER, LOWER))
    whole = [t for t in re.split(CUT, host) if t] + [t for t in re.split(CUT, lower) if t]
    return Rule(action, pattern, tuple(whole), 1_000_000 + len(text), text)


#: The method's own judgement where no path rule fits: words that name a host's business, by kind.
BUSINESS = {
    "adult": "adult adults porn porno xxx sex sexcam escort escorts nude hentai milf",
    "gambling": "casino casinos bet bets betting poker slots roulette lottery jackpot gambling",
    "pharmacy": "pills pharmacy viagra cialis",
    "adverts": "ads adserver adtrack adtracker tracking clickbait popunder",
    "harm": "spam spammer phish phishing malware spyware ransomware botnet warez keygen",
}


def host_rule(action: str, word: str) -> Rule:
    """`word` as a whole token of the host."""
    return Rule(action, rf"^(?:[^/]*[.-])?{word}(?:[.-][^/]*)?(?:/|$)", (word,), 1, None)


PATTERNS = tuple(host_rule("block", word) for words in BUSINESS.values() for word in words.split())


def entries(rules: list[Rule]) -> list[tuple[str, str, str, int, str | None]]:
    """token, action, pattern, priority, name: each rule under its rarest token."""
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a literal token")
    shared = Counter(t for r in rules for t in set(r.tokens))
    return [(min(r.tokens, key=lambda t: (shared[t], -len(t), t)), r.action, r.pattern, r.priority, r.name) for r in rules]


def index(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The entries as a table."""
    found = spark.createDataFrame(entries(rules), "token string, action string, pattern string, priority int, name string")
    return F.broadcast(found) if len(rules) <= BROADCAST_RULES else found


def inline(rules: list[Rule]) -> tuple[Column, Column]:
    """The tokens of the index, and a map from each to its rules, as literals."""
    of: dict[str, list[Column]] = {}
    for token, action, pattern, priority, name in entries(rules):
        rule = F.struct(F.lit(priority).alias("priority"), F.lit(name).cast("string").alias("name"), F.lit(action).alias("action"), F.lit(pattern).alias("pattern"))
        of.setdefault(token, []).append(rule)
    return F.array(*[F.lit(t) for t in of]), F.create_map(*[c for t, found in of.items() for c in (F.lit(t), F.array(*found))])


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (name of the deciding rule or null), verdict."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    address = F.concat("host", "path")
    if rules and len(rules) <= INLINE:
        known, rules_of = inline(rules)
        tokens = F.array_intersect(F.split(F.translate(address, UPPER, LOWER), CUT), known)
        fetched = parts.select("*", F.flatten(F.transform(tokens, lambda t: F.element_at(rules_of, t))).alias("rules"))
        hits = fetched.select("page_id", "host", "path", F.expr("filter(rules, r -> concat(host, path) rlike r.pattern)").alias("rules"))
        best = hits.select("page_id", "host", "path", F.expr("array_max(transform(rules, r -> struct(r.priority, r.name, r.action)))").alias("best"))
        return best.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
    # what counts of a URL is its host and path: equal ones are judged once
    urls = parts.select("host", "path").distinct()
    tokens = F.array_distinct(F.split(F.translate(address, UPPER, LOWER), CUT))
    fetched = urls.select("host", "path", F.explode(tokens).alias("token")).join(index(pages.sparkSession, rules), "token")
    hits = fetched.where(F.expr("concat(host, path) rlike pattern"))
    order = F.struct("priority", F.col("name"), "action")
    best = hits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
