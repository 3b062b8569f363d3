"""URL filters: pattern rules found through their rarest literal token.

A rule is compiled to a regular expression and filed under one literal token that every URL it fits must
hold; of a rule's tokens that is the one which the fewest rules share. A URL is cut into tokens, the tokens
fetch the rules filed under them, and only those run their expression. The index is a constant hash table
(an array of buckets), so a page needs no shuffle and no join.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no host rule, and gets the
default verdict unless a pattern without tokens fits. Repeated rows are each judged. Further columns of the
input are kept unless they clash with a column made here, which replaces them. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are configuration, held in the plan itself; more than these belong in a table of their own.
MOST_RULES = 20_000


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``. The longest fitting one wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"\A(?:[^/]*\.)?{_quoted(self.host + self.path)}"

    @property
    def tokens(self) -> list[str]:
        # the path may go on behind the rule, so a token that ends the rule may be longer in the URL
        return [m[0] for m in re.finditer("[A-Za-z0-9]+", self.name) if m.end() < len(self.name)]


@dataclass(frozen=True)
class Pattern:
    """Fits where ``glob`` (``*``: anything) occurs in host and path. It decides where no host rule fits."""

    glob: str
    verdict: str = "block"

    @property
    def name(self) -> str:
        return self.glob

    @property
    def regex(self) -> str:
        return ".*".join(_quoted(x) for x in self.glob.split("*")).join(("(?s)", ""))

    @property
    def tokens(self) -> list[str]:
        # whole tokens only: both ends must be literal separators inside the pattern
        return [m[1] for m in re.finditer("(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", self.glob)]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


#: The production rules.
HOST_RULES = (
    HostRule("allow", "com"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERNS = (Pattern("cheap-pills."), Pattern("spam-farm."), Pattern("/login/"), Pattern("*casino*"))


def index(rules: list[HostRule | Pattern]) -> tuple[list[list[tuple]], list[tuple]]:
    """Buckets of (token, name, regex, verdict, rank, is a host rule), and the rules that have no token."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; an index in the plan holds {MOST_RULES} at most")
    shared = Counter(t for r in rules for t in set(r.tokens))
    buckets: list[list[tuple]] = [[] for _ in range(1 << max(4, (2 * len(rules)).bit_length()))]
    loose = []
    for r in rules:
        row = (r.name, r.regex, r.verdict, len(r.name), isinstance(r, HostRule))
        if r.tokens:
            token = min(set(r.tokens), key=lambda t: (shared[t], t))
            buckets[zlib.crc32(token.encode()) % len(buckets)].append((token, *row))
        else:
            loose.append(("", *row))
    return buckets, loose


FIELDS = ("token", "name", "regex", "verdict", "size", "host_rule")
KIND = "array<struct<token:string,name:string,regex:string,verdict:string,size:int,host_rule:boolean>>"


def _rows(rows: list[tuple]) -> Column:
    made = [F.struct(*(F.lit(v).alias(f) for f, v in zip(FIELDS, r, strict=True))) for r in rows]
    return F.array(*made).cast(KIND)


def judge(pages: DataFrame, rules=(*HOST_RULES, *PATTERNS), url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (of the longest fitting host rule, or null), pattern (that fits, or null), verdict."""
    buckets, loose = index(list(rules))
    found = F.coalesce(F.col(url), F.lit(""))
    whole = "(?s)://([^/?#]*)([^?#]*)"
    df = pages.withColumns({"host": F.translate(F.regexp_extract(found, whole, 1), UPPER, LOWER), "path": F.regexp_extract(found, whole, 2)})
    subject = F.concat("host", "path")
    tokens = F.array_distinct(F.split(subject, "[^A-Za-z0-9]+"))
    table = F.array(*(_rows(b) for b in buckets))

    def fetch(token: Column) -> Column:
        return F.filter(F.get(table, F.pmod(F.crc32(token), F.lit(len(buckets))).cast("int")), lambda r: r["token"] == token)

    candidates = F.concat(F.flatten(F.transform(tokens, fetch)), _rows(loose))
    df = df.withColumn("_fit", F.filter(candidates, lambda r: F.call_function("regexp_like", F.concat("host", "path"), r["regex"])))
    # the longest first; of equal ones that with the smaller name
    best = F.get(F.array_sort(F.transform(F.filter("_fit", lambda r: r["host_rule"]), lambda r: F.struct((-r["size"]).alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict")))), F.lit(0))
    other = F.get(F.array_sort(F.transform(F.filter("_fit", lambda r: ~r["host_rule"]), lambda r: F.struct((r["verdict"] != "block").alias("late"), r["name"].alias("name"), r["verdict"].alias("verdict")))), F.lit(0))
    df = df.withColumns({"_best": best, "_other": other}).withColumns({"rule": F.col("_best.name"), "pattern": F.col("_other.name"), "verdict": F.coalesce("_best.verdict", "_other.verdict", F.lit(default))})
    return df.drop("_fit", "_best", "_other")
