"""Crawls of a made-up site."""

from test_sources import rows

from glossweave.sources import crawl

SITE = {
    "http://a/i.html": '<a href="x/1.html">1</a><A HREF="/x/2.html#y">2</A><a href="http://b/">no</a><a href="#z">z</a><a href="">e</a><a href="mailto:x">m</a><a href="//a/x/2.html">2</a>',
    "http://a/x/1.html": '<a href="2.html">2</a><a href="../i.html">up</a><a href="3.html">3</a><a href="gone.html">gone</a>',
    "http://a/x/2.html": "",
    "http://a/x/3.html": '<a href="4.html">too deep</a>',
    "http://a/x/4.html": "never",
}


def test_crawled(spark):
    site = dict(SITE)
    seeds = spark.createDataFrame([("http://a/i.html",), ("http://a/i.html",), (None,)], "url string")
    pages = crawl.crawled(seeds, lambda urls: [site.get(u) for u in urls], r"^http://a/(?!.*\.\.)")
    assert rows(pages, "url", "level") == [("http://a/i.html", 0), ("http://a/x/1.html", 1), ("http://a/x/2.html", 1), ("http://a/x/3.html", 2), ("http://a/x/gone.html", 2)]
    assert pages.filter("content IS NULL").select("url").first()[0] == "http://a/x/gone.html"
    names = crawl.manifest(pages).collect()
    assert len({r.entry for r in names}) == 4 and all(r.entry.startswith("a_") for r in names)
    assert crawl.crawled(seeds.limit(0), lambda urls: [None] * len(urls), ".").count() == 0
