"""URL filter: rules by host and path, then a weighted vocabulary found by Aho-Corasick.

A url is judged by the longest rule that fits its host (or a domain above it) and the
beginning of its path. Where no rule fits, one pass of an Aho-Corasick automaton over the
url finds every term of the vocabulary, a hit counts only between two characters that are
neither letters nor digits of ASCII, and the weights of the distinct terms are added up: a
strict term reaches the limit alone, soft terms only together.

Each url is judged by itself: one pass over the table, no shuffle, however often a host
comes. The rules and the vocabulary are parameters and travel with the function.

Odd input: a null url, or one without ``://``, has an empty host and path and fits no rule;
terms are still sought in its text. Empty urls are allowed. Repeated rows are judged each;
a null page_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Sum of weights from which a url is blocked.
LIMIT = 2
STRICT = ("adult", "casino", "cheap-pills", "free-bets", "gambling", "porn", "spam-farm", "viagra", "xxx")
SOFT = ("ads", "bets", "bonus", "cheap", "click", "farm", "free", "pills", "poker", "promo", "spam", "track", "tracking", "win")
VOCABULARY: dict[str, int] = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_INSIDE = frozenset(string.ascii_lowercase + string.digits)


class Rules:
    """The longest rule for a host and a path."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, rest = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + rest, rule, verdict))
        self.longest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict); of rules of one length, that of the longer host."""
        best: tuple[int, int, str, str] | None = None
        at = 0 if len(host) <= self.longest else host.find(".", len(host) - self.longest - 1) + 1
        while at or len(host) <= self.longest:  # domains above the host that a rule can have
            domain = host[at:]
            for start, rule, verdict in self.by_host.get(domain, ()):
                if path.startswith(start) and (best is None or (len(rule), len(domain)) > best[:2]):
                    best = (len(rule), len(domain), rule, verdict)
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        return best[2:] if best else None


class Vocabulary:
    """Distinct terms of a text, as (sum of weights, strict terms, soft terms)."""

    def __init__(self, weights: Mapping[str, int], limit: int) -> None:
        import ahocorasick

        self.weights, self.limit = {t.translate(_LOWER): w for t, w in weights.items() if t}, limit
        self.automaton = ahocorasick.Automaton() if self.weights else None
        for term in self.weights:
            self.automaton.add_word(term, term)
        if self.automaton is not None:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, int, int]:
        text = text.translate(_LOWER)
        found = set()
        for end, term in self.automaton.iter(text) if self.automaton is not None else ():
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in _INSIDE) and (end + 1 == len(text) or text[end + 1] not in _INSIDE):
                found.add(term)
        strict = sum(self.weights[t] >= self.limit for t in found)
        return sum(self.weights[t] for t in found), strict, len(found) - strict


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    return (rest[:end].translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:end])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, vocabulary: Mapping[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight, strict_terms, soft_terms), a row for each row of ``pages``."""
    weights = dict(VOCABULARY if vocabulary is None else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host, terms = Rules(rules), Vocabulary(weights, limit)
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                fits = of_host.find(host, path)
                weight, strict, soft = terms.hits(url or "")
                rows.append((host, path, fits[0] if fits else None, fits[1] if fits else "block" if weight >= limit else "allow", weight, strict, soft))
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, [pa.string()] * 4 + [pa.int64()] * 3, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["page_id", "host", "path", "rule", "verdict", "weight", "strict_terms", "soft_terms"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, weight long, strict_terms long, soft_terms long")


def judge_sql(rules: Sequence[tuple[str, str]] = RULES, vocabulary: Mapping[str, int] | None = None, limit: int = LIMIT) -> str:
    """The same in SQL, for DuckDB: a pattern for each term."""
    weights = VOCABULARY if vocabulary is None else vocabulary
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"))):
        host, slash, rest = rule.partition("/")
        fits.append((f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '{slash + rest}')", rule, verdict))
    hit = {t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT" for t in weights}
    total = lambda of: " + ".join(f"{w} * {hit[t]}" for t, w in of) or "0"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parted AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM cut
), counted AS (
  SELECT page_id, host, path, {total(weights.items())} AS weight,
         {total([(t, 1) for t, w in weights.items() if w >= limit])} AS strict_terms,
         {total([(t, 1) for t, w in weights.items() if w < limit])} AS soft_terms,
         CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
         CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)} END AS ruled FROM parted
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict,
       weight::BIGINT AS weight, strict_terms::BIGINT AS strict_terms, soft_terms::BIGINT AS soft_terms FROM counted"""
