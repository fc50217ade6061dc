import html
import html.entities
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from lexisweave.functions import html as H
from lexisweave.operators import crawl as C

PAGES = [
    "<html><title>A &amp; B\n</title><style>x{}</style><body>Hi<script>var a='</p>';</script> <b>there</b><!-- no\n--> &copy; &lt;b&gt; &eacute;&#233;&hellip;&nbsp;end</body></html>",
    "<TITLE lang=x> One </TITLE><title>two</title>plain &quot;q&quot; &middot; &amp;lt;", "no tags", "", None, "<title></title>x", "a b c \x1c d", "<script>never closed <p>x",
]
URLS = [
    "http://Example.COM", " HTTPS://a.b/C?q=1#f ", "ftp://x/y", "mailto:a@b", "", None, "http://u:p@Host.example.com:8080/x.JPG?y", "https://h/.hidden", "https://h/a.b/c", "https://h/p.tar.gz#z", "http://h?x", "//h/x", "http://notexample.com/", "rel/path.css",
]


def rows(spark, values, f):
    return [r.x for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_text(t):
    import re

    if t is None:
        return None
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!--.*?-->", r"(?is)<[^>]+>"):
        t = re.sub(p, " ", t)
    return re.sub(r"\s+", " ", html.unescape(t)).strip()


def test_text_and_title(spark):
    assert rows(spark, PAGES, H.html_to_text) == [plain_text(p) for p in PAGES]
    assert rows(spark, PAGES, H.html_title) == ["A & B", "One", None, None, None, "", None, None]


def plain_norm(u):
    p = urlsplit((u or "").strip())
    return urlunsplit((p.scheme, p.netloc.lower(), p.path or "/", p.query, "")) if p.scheme in ("http", "https") else None


def test_urls(spark):
    assert rows(spark, URLS, H.normalize_url) == [plain_norm(u) for u in URLS]
    assert rows(spark, ["http://a/b?c#d", "http://a/b#d?c", "http://a/b"], H.strip_query) == ["http://a/b"] * 3
    allowed = rows(spark, URLS, lambda u: H.domain_allowed(u, ["EXAMPLE.com "]))
    assert [bool(x) for x in allowed] == [True, False, False, False, False, False, True] + [False] * 7
    assert [bool(x) for x in rows(spark, URLS, H.page_like)][6:11] == [False, True, True, False, True]
    assert rows(spark, ["a b: (c) é-ñ_", "x" * 200], H.safe_name) == ["a_b_c_é-ñ_", "x" * 120]


@pytest.mark.parametrize("base", ["http://H.example.com/a/b?q#f", "https://h"])
def test_links(spark, base):
    page = """<a href="/x"> <a HREF = 'y/z'> <a href=../w> <a href="#top"><a href="javascript:f()"> <a href="http://O.org/../p#f"><a href="?q=2"> <a href=" mailto:a@b "><a href="//other/x"> <a href="/x"> <a href="/a/../b">"""
    got = [r.link for r in C.page_links(spark.createDataFrame([(1, base, page)], "page_id int, url string, html string")).collect()]
    targets = ["/x", "y/z", "../w", "http://O.org/../p#f", "?q=2", "mailto:a@b", "//other/x", "/x", "/a/../b"]
    assert got == [x for x in (plain_norm(urljoin(base, t)) for t in targets) if x]


def test_fresh_and_upsert(spark):
    got = spark.createDataFrame([(1, 100), (2, 95), (3, 90), (4, 0), (5, None)], "i int, t long").select(C.fresh(F.col("t"), 100, 10).alias("x"), C.fresh(F.col("t"), 100, 0).alias("y")).collect()
    assert [r.x for r in got] == [True, True, False, False, False] and not any(r.y for r in got)
    schema = "url string, raw_sha256 string, title string, fetched_at long, checked_at long"
    old = spark.createDataFrame([("a", "1", "A", 1, 1), ("b", "2", None, 1, 1), ("c", "3", "C", 1, 1)], schema)
    new = spark.createDataFrame([("a", "1", "ignored", 9, 9), ("b", "x", "B", 9, 9), ("d", "4", None, 8, 8), ("d", "5", "D", 9, 9)], schema)
    want = [("a", "1", "A", 1, 9), ("b", "x", "B", 9, 9), ("c", "3", "C", 1, 1), ("d", "5", "D", 9, 9)]
    assert sorted(map(tuple, C.upsert(old, new).collect())) == want
    assert sorted(r.url for r in C.import_new(old, new.dropDuplicates(["url"])).collect()) == ["d"]


def test_crawl(spark):
    pages = spark.createDataFrame([
        (1, "http://a.com/1", '<title>one</title><a href="/2"><a href="/x.jpg"><a href="http://b.com/3">'), (2, "http://a.com/2", '<a href="/1"><a href="/4">two'), (3, "http://b.com/3", "three"), (4, "http://a.com/4", "four"),
    ], "page_id int, url string, html string")
    source = C.Source(["a.com"], doc_url_regex="/[124]$")
    stored = spark.createDataFrame([("http://a.com/2", 95)], "url string, fetched_at long")
    frontier, visited, saved = spark.createDataFrame([("http://a.com/1",)], "url string"), spark.createDataFrame([], "url string"), []
    for _ in range(4):
        frontier, visited, docs = C.crawl_step(frontier, visited, pages, source, stored, 100, 10)
        saved += [(r.url, r.title, r.parsed_text) for r in docs.collect()]
    assert sorted(saved) == [("http://a.com/1", "one", "one"), ("http://a.com/4", None, "four")]  # 2 is fresh, 3 another domain
    assert sorted(r.url for r in visited.collect()) == ["http://a.com/1", "http://a.com/2", "http://a.com/4"]


def queue_crawl(pages, source, existing, now, ttl):
    """Saved documents (url: (source, sha, title, fetched_at, checked_at)) after visiting a queue page by page."""
    import hashlib
    import re

    by_url = {plain_norm(u): h for _, u, h in pages}
    queue, visited, held, saved = [plain_norm(s) for s in source.seeds], set(), dict(existing), 0
    while queue:
        if source.max_articles and saved >= source.max_articles:
            break
        url = queue.pop(0)
        if url in visited:
            continue
        visited.add(url)
        name = urlsplit(url).netloc
        if not any(name == d or name.endswith("." + d) for d in source.allowed_domains) or urlsplit(url).path.endswith(".jpg"):
            continue
        is_doc = bool(re.search(source.doc_url_regex, url))
        if source.follow_url_regex and not re.search(source.follow_url_regex, url) and not is_doc or url not in by_url:
            continue
        page = by_url[url]
        queue += [x for x in (plain_norm(urljoin(url, h)) for h in re.findall('href="([^"]+)"', page)) if x]
        if is_doc:
            doc, sha = url.split("?")[0], hashlib.sha256(page.encode()).hexdigest()
            old = held.get(doc)
            if old and ttl > 0 and now - old[3] < ttl:
                continue
            if old and old[1] == sha:
                held[doc] = (*old[:4], now)
            else:
                title = re.search("<title>(.*?)</title>", page)
                held[doc] = (source.name, sha, title[1] if title else doc, now, now)
                saved += 1
    return held


@pytest.mark.parametrize(("most", "follow"), [(0, "/f"), (7, "")])
def test_crawl_equals_a_queue(spark, most, follow):
    import hashlib
    import random

    rnd = random.Random(most)
    urls = [f"http://{rnd.choice(['a.com', 'b.a.com', 'other.org'])}/{rnd.choice('fd')}{i}{rnd.choice(['', '', '.jpg'])}" for i in range(40)]
    urls += [f"{u}?q={k}" for u in urls[::3] for k in range(2)]
    pages = [(i, u, "".join(f'<a href="{rnd.choice(urls)}#x">' for _ in range(3)) + (f"<title>t{i}</title>" if i % 3 else "")) for i, u in enumerate(urls)]
    source = C.Source(["a.com"], "/d", follow, [urls[0], urls[1], urls[4], urls[7], urls[40]], most, "s")
    held = {}
    for i, u, page in pages[::4]:
        held.setdefault(u.split("?")[0], ("old", hashlib.sha256(page.encode()).hexdigest() if i % 8 else "x", "T", 60 if i % 12 else 95, 1))
    existing = spark.createDataFrame([(u, s, "", sha, "", t, f, c, "web") for u, (s, sha, t, f, c) in held.items()], ", ".join(f"{c} {'long' if c.endswith('_at') else 'string'}" for c in C.RECORD))
    got = C.crawl(spark.createDataFrame(pages, "page_id int, url string, html string"), source, existing, 100, 20)
    want = queue_crawl(pages, source, held, 100, 20)
    assert {r.url: (r.source, r.raw_sha256, r.title, r.fetched_at, r.checked_at) for r in got.collect()} == want
    assert most or sum(v[3] == 100 for v in want.values()) > 3


def test_crawl_sources(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.com/1", "one"), (2, "http://b.com/1", "two")], "page_id int, url string, html string")
    none = spark.createDataFrame([], ", ".join(f"{c} {'long' if c.endswith('_at') else 'string'}" for c in C.RECORD))
    sources = [{"name": n, "seeds": [f"http://{n}.com/1"], "allowed_domains": [f"{n}.com"]} for n in "ab"] + ["junk", {"name": "w", "method": "wikipedia"}]
    found = C.crawl_sources(pages, {"sources": sources, "crawler": {"cache_ttl_s": 9}}, none, 100)
    assert sorted((r.url, r.source, r.title) for r in found.collect()) == [("http://a.com/1", "a", "http://a.com/1"), ("http://b.com/1", "b", "http://b.com/1")]
    assert [r.source for r in C.crawl_sources(pages, {"sources": sources}, none, 100, only="b").collect()] == ["b"]
    C.write_collection(found, f"{tmp_path}/c")
    assert [r.url for r in C.collection_between(spark, f"{tmp_path}/c", ["b"], 100, 101).collect()] == ["http://b.com/1"]
    plan = C.collection_between(spark, f"{tmp_path}/c", ["b"], 100, 101)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan or "PartitionFilters: [(source" in plan or "source#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(fetched_at,100)" in plan


def test_unescape_equals_the_library(spark):
    import random

    rnd = random.Random(5)
    fixed = ["&amp;lt;", "&notit;", "&notin;", "&not", "&amp", "&ampamp;", "&#65;&#x41;&#X41", "&#0;&#128;&#x9f;&#x81;", "&#xD800;&#x110000;&#99999999999999999999999;", "&#11;&#12;&#13;&#127;", "&#xFFFE;&#xFDD0;&#x1F600;", "&&amp;&#;&#x;& x", "&eacute&eacute;é", "&CounterClockwiseContourIntegral;", "&unknown; &unknown", "&#00065;", "&#x000000041;"]
    bits = ["&", "#", "x", "41", ";", "amp", "lt", "not", "in", "é", " ", "eacute", "copy", "<", "0"]
    texts = fixed + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    assert rows(spark, texts, H.unescaped) == [html.unescape(t) for t in texts]


def test_links_equal_the_library(spark):
    import random

    rnd = random.Random(6)
    bits = ["/", "/", "..", ".", "a", "b.c", "?q", "#f", "http:", "https:", "//", "h.org", "mailto:x", ";p", "é", "g:"]
    refs = ["", "//x//y//", "/a//b", "a//b/../c", "../../../..", "./", "..", "http:c", "HTTPS://H/x/../y", "//[::1]/x", "//[x/y", "a b", "\t/x\n/y"] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(500)]
    for base in ("http://h.com/a/b/c?d#e", "https://H.com", "http://h.com/a/b/"):
        def plain(r, base=base):
            try:
                return plain_norm(urljoin(base, r))
            except ValueError:
                return None
        got = rows(spark, refs, lambda h, base=base: H.links(F.lit(base), h))
        assert [(r, g) for r, g in zip(refs, got)] == [(r, plain(r)) for r in refs]


def test_pages_stay_in_the_jvm(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "<a href='x'>&eacute;")], "page_id int, url string, html string")
    for found in (C.page_links(pages), pages.select(H.html_to_text(F.col("html")), H.html_title(F.col("html")))):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


CUT = ["<title>a&&amp;&amp</title>x", "<title>&quot;a&quot</title>&copy;&middot", "<title>&am</title>&#65;&#65 &notit; &x;&eacute;&eacute", "<title>&amp;copy; &amp&amp;</title>"]


def cut_pages(spark, folder):
    spark.createDataFrame([(i, f"http://example.com/{i}", p) for i, p in enumerate(CUT)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_closed_references(spark):
    import re
    import random

    rnd = random.Random(8)
    bits = ["&", "#", "x", "41", ";", "amp", "lt", "not", "in", "é", " ", "eacute", "copy", "<", "0"]
    texts = CUT + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(400)]

    def closed(found):
        return html.unescape(found[0]) if found[1].startswith("#") or found[1] in html.entities.html5 else found[0]

    pattern = r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[^\t\n\f <&#;]{1,32};)"
    assert rows(spark, texts, lambda t: H.unescaped(t, closed=True)) == [re.sub(pattern, closed, t) for t in texts]


def test_title_query_of_cut_references(spark, tmp_path):
    from lexisweave.plans.catalogue import QUERIES

    got = QUERIES["html_title"](spark, cut_pages(spark, tmp_path)).orderBy("page_id").collect()
    assert [r.title for r in got] == ["a&&&amp", '"a&quot', "&am", "&copy; &amp&"]


def test_text_query_of_cut_references(spark, tmp_path):
    from lexisweave.plans.catalogue import QUERIES

    got = QUERIES["html_to_text"](spark, cut_pages(spark, tmp_path)).orderBy("page_id").collect()
    assert [r.text for r in got][:2] == ["a&&&amp x", '"a&quot ©&middot']


def test_crawled_cut_references(spark, tmp_path):
    from lexisweave.plans.catalogue import QUERIES

    got = QUERIES["crawl_docs"](spark, cut_pages(spark, tmp_path)).orderBy("url").collect()
    assert [(r.title, r.parsed_text) for r in got][:2] == [("a&&&amp", "a&&&amp x"), ('"a&quot', '"a&quot ©&middot')]


def test_collected_cut_references(spark, tmp_path):
    from lexisweave.plans.catalogue import QUERIES

    got = QUERIES["crawl_collection"](spark, cut_pages(spark, tmp_path)).orderBy("url").collect()
    assert [r.title for r in got][:1] == ["a&&&amp"]  # the one whose stored content had changed


def test_pages_of_one_url(spark, tmp_path):
    import hashlib

    from lexisweave.plans.catalogue import QUERIES

    pages = [(i + 8 * k, f"http://example.com/{i}", f"<title>{i} {k}</title>") for i in range(1, 8) for k in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = {u: (t[7:-8], hashlib.sha256(t.encode()).hexdigest()) for _, u, t in reversed(sorted(pages))}
    assert {r.url: (r.title, r.raw_sha256) for r in QUERIES["crawl_docs"](spark, str(tmp_path)).collect()} == want
    got = QUERIES["crawl_collection"](spark, str(tmp_path)).collect()
    assert {r.url: r.raw_sha256 for r in got} == {u: sha for u, (_, sha) in want.items()}
