"""URL rules and vocabulary."""

from tsforge.llm.urlfilter import SOFT_LIMIT, filter_urls

DDL = "page_id long, url string, host string, _hits string"


def judge(make, urls):
    out = filter_urls(make([(i, u, "x", "y") for i, u in enumerate(urls)], DDL)).collect()
    return [r for _, r in sorted((r["page_id"], r) for r in out)]


def test_parts_and_rules(make):
    cases = {
        "http://EXAMPLE.org/es/x?a#b": ("example.org", "/es/x", "example.org/es/", "block"),
        "https://a.b.example.org/en/12": ("a.b.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://x.com/fr/1#://y.org/": ("x.com", "/fr/1", "com/fr/", "allow"),
        "//x.com/de/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://x.com?u=http://y.org/es/": ("x.com", "", None, "allow"),
        "http://x.net/porn\n.html": ("x.net", "/porn\n.html", None, "block"),
    }
    for (url, want), got in zip(cases.items(), judge(make, list(cases))):
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == want, url
    assert judge(make, [None])[0]["verdict"] == "allow"


def test_vocabulary_boundaries_and_limits(make):
    assert SOFT_LIMIT == 2
    cases = {
        "http://x.net/casino": ("block", 1, 0),
        "http://x.net/CASINO-1": ("block", 1, 0),
        "http://x.net/acasino/casinoa": ("allow", 0, 0),
        "http://x.net/poker/poker": ("allow", 0, 1),
        "http://x.net/cheap-poker": ("block", 0, 2),
        "http://x.net/cheappoker": ("allow", 0, 0),
        "http://x.net/loan/loans": ("allow", 0, 1),
        "http://x.net/payday/loans/loan": ("block", 0, 2),
        "http://x.net/xxx/xxx_porn": ("block", 3, 0),
        "casino": ("block", 1, 0),
        "http://x.net/" + "a" * 100_000 + "/bet": ("allow", 0, 1),
    }
    for (url, want), got in zip(cases.items(), judge(make, list(cases))):
        assert (got["verdict"], got["n_strict"], got["n_soft"]) == want, url[:40]


def test_empty_table_and_empty_lists(make):
    assert filter_urls(make([], DDL)).count() == 0
    out = filter_urls(make([(1, "http://x.net/casino", "", "")], DDL), rules=(), strict=(), soft=()).first()
    assert out["verdict"] == "allow" and out["rule"] is None


CLEAN = """
http://x.net/?utm_source=feed&utm_medium=email
http://x.net/free-feed
http://x.net/a?ref=promo&source=free
http://x.net/free-shipping/promo/ref/source
http://essex.net/middlesex/adulthood
http://x.net/students/loans-and-loan-relief
http://x.net/crackers/slotted-spoon/betty
http://x.net/news/2024/05/12/city-council-votes.html
http://x.net/health/pharmacy/opening-hours
http://x.net/wiki/Poker_(disambiguation)
http://x.net/escorted-tours/gored-ox
http://x.net/shop/cheap-flights?page=2&ref=x#top
http://x.net/adult-education/courses
http://x.net/download/linux.iso.torrent
""".split()
REJECTED = """
http://x.net/porn
http://best-casino.x.net/
http://x.net/sexy-dating
http://x.net/online-betting/poker
http://cheap-pills.x.net/
http://x.net/keygen-and-crack
http://x.net/?q=adult&sort=naked
""".split()


def test_clean_urls_stay_and_others_go(make):
    assert [u for u, r in zip(CLEAN, judge(make, CLEAN)) if r["verdict"] != "allow"] == []
    assert [u for u, r in zip(REJECTED, judge(make, REJECTED)) if r["verdict"] != "block"] == []


def test_repeated_rows(make):
    rows = filter_urls(make([(1, "http://x.net/casino", "", "")] * 3 + [(1, "http://x.net/", "", "")], DDL)).collect()
    assert sorted(r["verdict"] for r in rows) == ["allow", "block", "block", "block"]
