import re

from aularank.llm import op4_urls as U


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(r), r, v) for r, v in U.PATH_RULES for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    low = re.sub("[A-Z]", lambda m: m.group().lower(), url or "")
    return host, path, None, next((p.verdict for p in U.PATTERNS if re.search(p.regex, low)), "allow")


URLS = ["http://A.Example.NET/en/x", "http://example.net/", "http://example.net", "https://notexample.net/a", "http://net/", "http://x.example.com/de/1?q=/en/", "http://org/fr/", "http://a.org/fr",
        "http://www.spam-farm.example.org/en/1", "http://cheap.pills.example.org/", "http://xspam-farm.org/", "ftp://casino-win.example.com", "no host", "", None, "://", "http://?x", "http://a#b/c?d",
        "http://h.org/en/wp-admin/x", "http://h.org/p?u=doubleclick.", "http://exämple.net/Ü", "http://h.org/" + "a" * 100_000]


def test_rows(spark):
    df = spark.createDataFrame([(i, u, "html", "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, html string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}
    assert U.judge(df.limit(0)).count() == 0


def test_patterns_are_filed_under_their_rarest_token():
    plain = tuple((p.regex, p.tokens, p.verdict) for p in U.PATTERNS)
    index = U.RuleIndex(U.PATH_RULES, plain, {"spam": 100, "farm": 3})
    assert "farm" in index.filed and "spam" not in index.filed
