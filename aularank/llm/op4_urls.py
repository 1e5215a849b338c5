"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

Every pattern rule names the literal tokens that a URL must hold for it to match.  How often each of these tokens
occurs is counted over all URLs; a rule is filed under its rarest one, a URL's tokens fetch the rules filed under
them, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"

#: Host and path rules with their verdicts.
PATH_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-cased URL, the whole tokens it needs, and its verdict."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: Patterns of spam, betting, adult and advertising hosts or paths.
PATTERNS = (
    Pattern(r"://([^/?#]*[.\-])?spam[.\-]farm[.\-/]", ("spam", "farm")),
    Pattern(r"://([^/?#]*[.\-])?cheap[.\-]pills[.\-/]", ("cheap", "pills")),
    Pattern(r"://([^/?#]*[.\-])?free[.\-]bets[.\-/]", ("free", "bets")),
    Pattern(r"://([^/?#]*[.\-])?casino[.\-]win[.\-/]", ("casino", "win")),
    Pattern(r"://([^/?#]*[.\-])?adult[.\-]x[.\-/]", ("adult", "x")),
    Pattern(r"://([^/?#]*[.\-])?ads[.\-]track[.\-/]", ("ads", "track")),
    Pattern(r"[/=]doubleclick[./]", ("doubleclick",)),
    Pattern(r"/wp[.\-]admin/", ("wp", "admin")),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return _lower(host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(s: str) -> str:
    return s.translate(_LOWER)


class RuleIndex:
    """Path rules by host, patterns by their rarest token."""

    def __init__(self, paths: tuple, patterns: tuple, counts: dict[str, int]):
        self.hosts: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in paths:
            host, slash, path = rule.partition("/")
            self.hosts.setdefault(host, []).append((slash + path, rule, verdict))
        self.filed: dict[str, list[tuple[int, re.Pattern, str]]] = {}
        for at, (regex, tokens, verdict) in enumerate(patterns):
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
            self.filed.setdefault(rarest, []).append((at, re.compile(regex), verdict))
        self.token = re.compile(TOKEN)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting path rule and its verdict; equal lengths go by the rule's text."""
        best = None
        at = host
        while at:
            for start, rule, verdict in self.hosts.get(at, ()):
                if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = (rule, verdict)
            at = at.partition(".")[2]
        return best

    def pattern(self, url: str) -> str | None:
        """The verdict of the first pattern that matches, of those that the URL's tokens fetch."""
        low = _lower(url)
        fetched = sorted((r for t in set(self.token.findall(low)) for r in self.filed.get(t, ())), key=lambda r: r[0])
        return next((verdict for _, regex, verdict in fetched if regex.search(low)), None)


def token_counts(pages: DataFrame, tokens: list[str], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all rows; a row for each token of the rules at most."""
    found = pages.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{url}`), '{TOKEN}', 0)"))).alias("t")).where(F.col("t").isin(tokens))
    return {r["t"]: r["n"] for r in found.groupBy("t").agg(F.count("*").alias("n")).collect()}


def judge(pages: DataFrame, paths=PATH_RULES, patterns=PATTERNS, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A path rule decides if one fits, else the first matching pattern, else ``allow``.  Null URLs and URLs without
    ``://`` have an empty host and path, so no path rule fits; a null URL is allowed.  Repeated rows are judged one
    by one, long URLs whole; no other column is read; an empty table gives an empty one.
    """
    plain = tuple((p.regex, p.tokens, p.verdict) for p in patterns)
    counts = token_counts(pages, sorted({t for _, tokens, _ in plain for t in tokens}), url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(paths, plain, counts)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for u in batch.column(1).to_pylist():
                host, path = host_and_path(u)
                rule, verdict = index.rule(host, path) or (None, None)
                for column, x in zip(out, (host, path, rule, verdict or index.pattern(u or "") or "allow")):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out)], ["page_id", "host", "path", "rule", "verdict"])

    source = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    return source.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
