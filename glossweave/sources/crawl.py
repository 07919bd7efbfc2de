"""Crawls: pages that a provider gives for addresses, level by level, and the manifest of what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as t
from ..plans.stages import kept
from . import providers


def page_links(docs: DataFrame) -> DataFrame:
    """(url): the distinct links of pages as whole addresses, without fragments; links that aren't http or lead nowhere are left out."""
    href = F.explode(F.regexp_extract_all("content", F.lit(r'(?is)<a\b[^>]*?\bhref="([^"#]*)'), F.lit(1)))
    each = docs.select(F.col("url").alias("base"), href.alias("href")).withColumn("href", F.trim("href"))
    each = each.filter((F.col("href") != "") & ~F.rlike("href", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")))
    whole = F.when(F.startswith("href", F.lit("//")), F.concat(F.regexp_extract("base", "^([a-z]+:)", 1), "href")).otherwise(t.url_joined(F.col("base"), F.col("href")))
    return each.select(whole.alias("url")).filter(F.rlike("url", F.lit("^https?://"))).distinct()


def crawled(seeds: DataFrame, fetch: providers.Provider, within: str, depth: int = 2, other=None) -> DataFrame:
    """(url, content, level): the pages of some addresses (url) and what they link to, up to a depth, each once, at the first level that leads to it.

    Only links that match `within` are followed. fetch gives the contents of a batch of addresses on the executors, null for what can't be had; such
    pages have a null content and lead nowhere. other gives the address of a page in another language, which is fetched beside it.
    Each level is kept before the next begins, so that a lost executor doesn't fetch it again.
    """

    def paired(urls: DataFrame) -> DataFrame:
        return urls.select("url").unionByName(urls.select(other(F.col("url")).alias("url"))) if other else urls.select("url")

    todo, out = seeds.select("url").filter("url IS NOT NULL"), None
    for level in range(depth + 1):
        todo = paired(todo).distinct()
        todo = todo.join(out.select("url"), "url", "left_anti") if out is not None else todo
        pages = kept(providers.asked(todo, "url", "content", fetch).withColumn("level", F.lit(level)))
        out = pages if out is None else out.unionByName(pages)
        todo = page_links(pages.filter("content IS NOT NULL")).filter(F.rlike("url", F.lit(within)))
    return out


def manifest(pages: DataFrame) -> DataFrame:
    """(url, entry): under which name each page is stored: its address without the scheme, as a file name, and a hash that tells like names apart."""
    name = F.trim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[^A-Za-z0-9.]+", "_"), F.lit("_"))
    return pages.filter("content IS NOT NULL").select("url", F.concat(F.substring(name, 1, 100), F.lit("-"), F.substring(F.sha2("url", 256), 1, 16), F.lit(".html")).alias("entry"))
