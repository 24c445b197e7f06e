"""URL filter: host and path rules first, then a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: (host, path, verdict); a rule fits its host, all subdomains, and paths that begin with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Weight of each term: a strict one rejects alone, soft ones only when several different ones are found.
STRICT, SOFT = 2, 1
VOCABULARY: Mapping[str, int] = {
    **dict.fromkeys(("adult", "casino", "escort", "hentai", "porn", "spam", "viagra", "xxx"), STRICT),
    **dict.fromkeys(("ads", "bet", "bets", "cam", "cheap", "farm", "free", "loan", "pills", "poker",
                     "sex", "slots", "track", "win"), SOFT)}
#: Different soft terms that reject.
SEVERAL = 2

HITS = T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType())])


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, int], ...]):
    auto = ahocorasick.Automaton()
    for term, weight in terms:
        auto.add_word(term, (term, weight))
    if terms:
        auto.make_automaton()
    return auto


def _sign(c: str) -> bool:
    """A character that bounds a term: not an ASCII letter or digit."""
    return not (c.isascii() and c.isalnum())


def count_terms(url: str, terms: tuple[tuple[str, int], ...]) -> tuple[int, int]:
    """Numbers of different strict and soft terms that stand in the
    (lower-case) url between boundaries."""
    found = set()
    if terms:
        for end, (term, weight) in _automaton(terms).iter(url):
            begin = end - len(term) + 1
            if (begin == 0 or _sign(url[begin - 1])) and (end + 1 == len(url) or _sign(url[end + 1])):
                found.add((term, weight))
    strict = sum(w >= STRICT for _, w in found)
    return strict, len(found) - strict


def term_hits(url: Column, vocabulary: Mapping[str, int]) -> Column:
    """Struct (strict, soft) of the numbers of different terms in the url."""
    terms = tuple(sorted(vocabulary.items()))

    @F.pandas_udf(HITS)
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count_terms(u or "", terms) for u in urls], columns=["strict", "soft"], dtype="int32")
    return hits(ascii_lower(F.coalesce(url, F.lit(""))))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def _fits(host: Column, path: Column, h: str, p: str) -> Column:
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY,
          several: int = SEVERAL) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the term
    counts of every page.  The longest rule that fits decides (of equal ones
    the first listed); else one strict or ``several`` different soft terms
    block.  A null url is empty and allowed; repeated rows repeat.  Only
    columns page_id and url are read."""
    host, path = parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), term_hits(F.col("url"), vocabulary).alias("hits"))
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):      # stable: first listed first
        fits = _fits(F.col("host"), F.col("path"), h, p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    own = F.when((F.col("hits.strict") >= 1) | (F.col("hits.soft") >= several), "block").otherwise("allow")
    return base.select("page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
                       (own if verdict is None else verdict.otherwise(own)).alias("verdict"),
                       F.col("hits.strict").alias("n_strict"), F.col("hits.soft").alias("n_soft"))


def _sql() -> str:
    """The same in SQL (DuckDB) for the pages table, rules and vocabulary above."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def count(weight: int) -> str:
        return " + ".join(rf"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT"
                          for t, w in VOCABULARY.items() if w == weight)
    whens = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
             for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in whens)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in whens)
    return rf"""
WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
counted AS (SELECT *, ({count(STRICT)})::INT AS n_strict, ({count(SOFT)})::INT AS n_soft FROM named)
SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {verdict} WHEN n_strict >= 1 OR n_soft >= {SEVERAL} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM counted
"""


URL_SQL = _sql()
