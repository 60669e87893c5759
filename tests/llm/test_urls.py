"""URL rules and classes of aliases against a plain walk over links found by Python's own HTML parser."""

import random
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import duckdb
import pytest

from tidejoin.llm import oracles
from tidejoin.llm import queries as Q
from tidejoin.llm import url_rules as U

RULES = U.parsed(Q.RULES)


class Links(HTMLParser):
    def __init__(self, url):
        super().__init__(convert_charrefs=True)
        self.base, self.out = url, []

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and a.get("href"):
            self.out.append(urljoin(self.base, a["href"].strip()))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "=" in a.get("content", ""):
            self.out.append(urljoin(self.base, a["content"].partition("=")[2].strip(" '")))


def split(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.partition("://")[2]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:].partition("#")[0]
    path, mark, query = tail.partition("?")
    return host, path, host + (path or "/") + mark + query


def rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def plain(pages, redirects=()):
    next_to = defaultdict(set)
    for _, url, html in pages:
        if url and "://" in url and html:
            parser = Links(url)
            parser.feed(html)
            for t in parser.out:
                if "://" in t:
                    a, b = split(url)[2], split(t)[2]
                    next_to[a].add(b)
                    next_to[b].add(a)
    for a, b in redirects:
        next_to[split(a)[2]].add(split(b)[2])
        next_to[split(b)[2]].add(split(a)[2])
    bad = [n for n in next_to if (r := rule(*split("x://" + n)[:2])) and r.verdict == "block"]
    seen, good = set(bad), {n for n in next_to if (r := rule(*split("x://" + n)[:2])) and r.verdict == "allow"}
    while bad:
        bad = [m for n in bad for m in next_to[n] if m not in seen and not seen.add(m)]
    out = []
    for k, url, _ in pages:
        host, path, node = split(url)
        r = rule(host, path)
        out.append((k, host, path, r and r.text, r.verdict if r else "block" if node in seen - good else "allow"))
    return sorted(out, key=repr)


def made(seed, n):
    """Random sites whose pages link to one another in all ways of writing; one hub has a third of all links."""
    r = random.Random(seed)
    hosts = ["a.net", "b.net", "www.c.io", "Blog.Example.org", "x.com", "example.org"]
    paths = ["", "/", "/es/1", "/en/17", "/de/a", "/fr/", "/q/r", "/q/r?x=1", "/q/r/../s", "/en/2#top"]
    url = lambda: r.choice(["http://", "https://"]) + r.choice(hosts) + r.choice(paths) + r.choice(["", "", f"/{r.randrange(40)}"])
    pages = []
    for k in range(n):
        t = r.choice(["http://hub.net/", url(), "../s", "/de/b", "//x.com/k?m=1&amp;n=2", "?y=2", "mailto:me@x.com", "#here", ""])
        tag = r.choice([f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' rel=canonical />", f'<meta http-equiv="refresh" content="3; url={t}">', f"<!-- <link rel=canonical href='{t}'> -->", f"<script>'<link rel=canonical href={t}>'</script>", f'<link rel="next" href="{t}">', f'<link title=">" rel="x CANONICAL y" href="{t}">'])
        pages.append((k, r.choice([url(), url(), url(), None, "no address"]), r.choice(["<head>", ""]) + tag + "<p>text</p>"))
    return pages


def judged(spark, pages, **more):
    df = U.judged(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), RULES, **more)
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


@pytest.mark.parametrize("seed", [2])
def test_brute_force(spark, seed):
    pages = made(seed, 150)
    want = plain(pages)
    assert judged(spark, pages) == want
    assert len({v[3:] for v in want}) >= 5 and any(v[3] is None and v[4] == "block" for v in want)


def test_many_blocked_aliases_are_joined_not_broadcast(spark, monkeypatch):
    pages = made(3, 60)
    monkeypatch.setattr(U, "bounded", lambda df, most: df)
    assert judged(spark, pages) == plain(pages)


def test_redirect_table(spark):
    pages = [(1, "http://a.net/1", ""), (2, "http://a.net/2", None), (3, "http://x.org/3", "")]
    moved = [("http://a.net/1", "https://b.net/"), ("https://b.net/", "http://www.x.com/de/9"), ("http://x.org/3", "http://b.net")]
    got = judged(spark, pages, redirects=spark.createDataFrame(moved, "source string, target string"))
    assert got == plain(pages, moved)
    assert [r[4] for r in got] == ["block", "allow", "allow"]


def test_references_in_targets(spark):
    html = '<base href="https://&#x62;.net/v/w"><link rel="canonical" href="&#104;i&amp;lt;&#8364;/./a/..">'
    rows = U.page_links(spark.createDataFrame([("http://a.net/", html)], "url string, html string")).collect()
    assert [(r.target, r.kind) for r in rows] == [("https://b.net/v/hi&lt;€/", "canonical")]


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, key int")
    out = U.judged(empty, RULES)
    assert out.count() == 0 and out.columns == ["page_id", "url", "html", "key", "host", "path", "rule", "verdict", "reason"]
    rows = [(None, None, None, "h", 1), (1, "", "", "h", 2), (1, "", "", "h", 2), (2, "http://a.net/" + "x" * 100_000, "<link rel=canonical " * 50_000, "h", 3)]
    found = U.judged(spark.createDataFrame(rows, empty.schema), RULES).collect()
    assert sorted(r.key for r in found) == [1, 2, 2, 3] and {r.verdict for r in found} == {"allow"}
    assert U.judged(spark.createDataFrame(rows, empty.schema), []).count() == 4


def test_sql_walks_links(spark, tmp_path):
    """The SQL knows links in double quotes to whole addresses; there both agree."""
    pages = [p for p in made(5, 200) if 'rel="canonical" href="http' in p[2] or "url=http" in p[2]]
    pages = [(k, u, h) for k, u, h in pages if "<!--" not in h and "<script" not in h and "/../" not in h]
    pages += [(900, "http://zz.net/1", '<link rel="canonical" href="https://yy.net/2?a=b">'), (901, "http://yy.net/2?a=b#c", '<meta http-equiv="refresh" content="0; url=https://www.x.com/de/7">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/p")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    want = sorted((tuple(r) for r in con.sql(oracles.OP13).fetchall()), key=repr)
    assert judged(spark, pages) == want == plain(pages)
    assert any(v[3] is None and v[4] == "block" for v in want)
