"""URL filtering: host and path rules, and a weighted vocabulary counted by Aho-Corasick.

A rule names a host and the beginning of a path. It fits that host and its subdomains when the
url's path begins with the rule's; the longest fitting rule decides. Where no rule fits, one
automaton pass over the lower-cased url (A-Z) finds all terms of the vocabulary. A hit counts
only between boundaries: the characters next to it are not ASCII letters or digits. A url is
blocked on one strict hit or on ``soft_limit`` distinct soft terms; forms of one term ("loan" and
"loans") are one.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged on the terms in it (none for null: allowed). Rows map one to one, so ties,
repeated rows, empty tables and extra columns are harmless; very long urls are scanned whole,
in one linear pass.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.base import query, table

#: (host, path beginning, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# The vocabulary, by subject. A strict term says by itself what a site is about, whatever stands next to it; a soft
# term has harmless uses and counts once, in whichever of its forms and however often it occurs. Words of links
# themselves (tracking parameters, feeds, references, offers) say nothing about a page and are not terms.
STRICT = (
    "porn", "porno", "xxx", "hentai", "escort", "escorts", "nude", "nudes",  # adult
    "casino", "casinos",  # gambling
    "viagra", "cialis",  # drugs sold by mail
    "warez",  # copied software
    "gore",  # violence
)
SOFT = (
    ("adult", "adults"), ("dating",), ("erotic", "erotica"), ("naked",), ("sex", "sexy"),  # adult
    ("bet", "bets", "betting"), ("jackpot", "jackpots"), ("poker",), ("roulette",), ("slot", "slots"),  # gambling
    ("pharmacy", "pharmacies"), ("pill", "pills"),  # drugs sold by mail
    ("crack", "cracked", "cracks"), ("keygen", "keygens"), ("torrent", "torrents"),  # copied software
    ("loan", "loans"), ("payday",),  # credit
    ("cheap",), ("spam",),  # bulk offers
)
SOFT_LIMIT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(_LOWER + "0123456789")


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, ...], ...], soft_limit: int):
    """The automaton of both lists; a strict term weighs as much as the limit, a soft one 1. Forms name their first."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for forms in soft:
        for form in forms:
            machine.add_word(form, (form, forms[0], 1, False))
    for term in strict:
        machine.add_word(term, (term, term, soft_limit, True))
    if len(machine):
        machine.make_automaton()
    return machine


def hits(
    url: str | None, strict: tuple[str, ...], soft: tuple[tuple[str, ...], ...], soft_limit: int
) -> tuple[int, int, int]:
    """(strict hits, distinct soft terms, weight of the distinct terms) of one url."""
    machine = automaton(strict, soft, soft_limit)
    if not url or not len(machine):
        return 0, 0, 0
    url = url.translate(_FOLD)
    n_strict, found = 0, {}
    for end, (form, term, weight, is_strict) in machine.iter(url):
        begin = end - len(form) + 1
        if (begin and url[begin - 1] in _WORD) or (end + 1 < len(url) and url[end + 1] in _WORD):
            continue
        found[is_strict, term] = weight
        n_strict += is_strict
    return n_strict, sum(not is_strict for is_strict, _ in found), sum(found.values())


_FOLD = str.maketrans(_UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[tuple[str, ...], ...] = SOFT,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, n_strict and n_soft of every url."""

    @F.arrow_udf("n_strict long, n_soft long, weight long")
    def count_terms(url: pa.Array) -> pa.Array:
        found = [hits(u.as_py(), strict, soft, soft_limit) for u in url]
        kind = pa.struct([(n, pa.int64()) for n in ("n_strict", "n_soft", "weight")])
        return pa.array([dict(zip(("n_strict", "n_soft", "weight"), f)) for f in found], type=kind)

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.withColumns({"host": host, "path": path, "_hits": count_terms(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule is tried first.
    for domain, begin, decision in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(begin)
        rule = F.when(fits, F.lit(domain + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    judged = F.when(F.col("_hits.weight") >= soft_limit, "block").otherwise("allow")
    return parts.withColumns(
        {
            "rule": rule,
            "verdict": F.coalesce(verdict, judged),
            "n_strict": F.col("_hits.n_strict"),
            "n_soft": F.col("_hits.n_soft"),
        }
    ).drop("_hits")


def _oracle() -> str:
    url = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    edge = "(^|[^a-z0-9]){}([^a-z0-9]|$)"
    strict = "|".join(sorted(STRICT))
    distinct = " + ".join(f"regexp_matches({url}, '{edge.format("(" + "|".join(t) + ")")}')::INT" for t in SOFT)
    cases_rule, cases_verdict = [], []
    for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0]) - len(r[1])):
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN"
        cases_rule.append(f"{fits} '{host}{path}'")
        cases_verdict.append(f"{fits} '{verdict}'")
    return f"""
    WITH parts AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
             regexp_matches({url}, '{edge.format("(" + strict + ")")}') AS strict_hit,
             ({distinct})::BIGINT AS n_soft
      FROM pages)
    SELECT page_id, host, path, CASE {" ".join(cases_rule)} END AS rule,
           CASE {" ".join(cases_verdict)} WHEN strict_hit OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
           n_soft
    FROM parts"""


@query("op5_url_filter", _oracle())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_soft")
