"""Readers of ontologies, handbooks and taxonomies: class axioms in RDF/XML, tables in running text, pages of groups.

As in readers, documents are (url, content), one whole file a row, and a document is the unit that one task holds.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t
from ..operators import walks
from .readers import _full

# The namespaces of RDF/XML, and where a class has its definition, the best first.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XML = "http://www.w3.org/XML/1998/namespace"
DEFINITIONS = ("http://purl.obolibrary.org/obo/IAO_0000115", "http://www.w3.org/2004/02/skos/core#definition", "http://purl.org/dc/terms/description", "http://purl.org/dc/elements/1.1/description")

# What stands in a handbook's table where a description is missing, and the lines of its pages that are no content.
NO_DESCRIPTION = "No description available."
PAGE_LINES = r"^(?:NASIS\s+\d+\.\d+|Obsolete\?\s+ID|07/\d{2}|\d+\s+of\s+\d+)"


def _axioms(url: str, content: str | None) -> list[tuple]:
    """(url, iri, ord, labels, definitions, deprecated, parents) of each element about a class; nothing for what isn't XML."""
    from xml.etree import ElementTree

    out: list[tuple] = []
    depth = 0
    try:
        for event, node in ElementTree.iterparse(io.BytesIO((content or "").encode()), events=("start", "end")):
            depth += 1 if event == "start" else -1
            if event == "start" or depth != 1:  # only whole children of the root
                continue
            iri = node.get(f"{{{RDF}}}about")
            typed = any(c.tag == f"{{{RDF}}}type" and c.get(f"{{{RDF}}}resource") == f"{OWL}Class" for c in node)
            if iri and iri != f"{OWL}Thing" and (node.tag == f"{{{OWL}}}Class" or typed):
                labels, told, above, dead = [], [], [], False
                for c in node:
                    name, text = c.tag.replace("{", "").replace("}", ""), (c.text or "").strip()
                    if name == f"{RDFS}label" and text:
                        labels.append({"lang": c.get(f"{{{XML}}}lang"), "text": text})
                    elif name in DEFINITIONS and text:
                        told.append({"kind": DEFINITIONS.index(name), "text": text})
                    elif name == f"{RDFS}subClassOf" and c.get(f"{{{RDF}}}resource") not in (None, f"{OWL}Thing"):
                        above.append(c.get(f"{{{RDF}}}resource"))
                    elif name == f"{OWL}deprecated":
                        dead = dead or text.lower() in ("true", "1")
                out.append((url, iri, len(out), labels, told, dead, above))
            node.clear()
    except ElementTree.ParseError:
        return []
    return out


def owl_classes(docs: DataFrame) -> DataFrame:
    """(url, iri, code, title, description, deprecated, parents) of the classes of RDF/XML documents.

    The title is the first label in English, else the first without a language; the description the first of the best kind.
    Elements about one class are taken together; parents that are expressions instead of names don't count. A document that
    isn't XML gives nothing.
    """
    names = ["url", "iri", "ord", "labels", "definitions", "deprecated", "parents"]
    schema = "url string, iri string, ord int, labels array<struct<lang: string, text: string>>, definitions array<struct<kind: int, text: string>>, deprecated boolean, parents array<string>"

    def run(frames):
        for frame in frames:
            for u, c in zip(frame["url"], frame["content"], strict=True):
                yield pd.DataFrame(_axioms(u, c), columns=names)

    parts = docs.select("url", "content").mapInPandas(run, schema)
    inorder = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]))
    whole = parts.groupBy("url", "iri").agg(inorder("labels").alias("labels"), inorder("definitions").alias("told"), F.bool_or("deprecated").alias("deprecated"), F.array_distinct(inorder("parents")).alias("parents"))
    english = F.filter("labels", lambda x: F.startswith(F.lower(x["lang"]), F.lit("en")))
    bare = F.filter("labels", lambda x: x["lang"].isNull())
    best = F.array_min(F.transform("told", lambda x: x["kind"]))
    told = F.get(F.filter("told", lambda x: x["kind"] == best), F.lit(0))["text"]
    code = F.regexp_extract(F.rtrim(F.col("iri"), F.lit("#/")), r"([^/#]*)$", 1)
    return whole.select("url", "iri", code.alias("code"), F.coalesce(F.get(english, F.lit(0)), F.get(bare, F.lit(0)))["text"].alias("title"), told.alias("description"), "deprecated", "parents")


def ontology_values(classes: DataFrame, minus: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """Values (url, code, title, description, status, meaning, is_a) of the classes of each ontology, without the subtrees that minus names.

    Names are titles or codes, regardless of case and of underscores for spaces. A class that include names stays with all below; if
    it names any, nothing else does. A kept class hangs from the nearest kept one above.
    """
    listed = lambda names: F.lower("title").isin(*[v for n in names for v in (n.lower(), n.lower().replace("_", " "))]) | F.lower("code").isin(*[n.lower() for n in names]) if names else F.lit(False)
    known = classes.select("url", F.explode("parents").alias("parent"), F.col("iri").alias("child"))
    edges = known.join(classes.select("url", F.col("iri").alias("parent")), ["url", "parent"], "left_semi")
    rooted = classes.join(edges.select("url", F.col("child").alias("iri"), F.lit(True).alias("_below")).distinct(), ["url", "iri"], "left")
    mark = F.when(F.coalesce(listed(include), F.lit(False)), "include").when(F.coalesce(listed(minus), F.lit(False)), "minus")
    mark = mark.when(F.col("_below").isNull(), "minus") if include else mark
    kept = walks.subtree_filter(rooted.select(F.col("url").alias("grp"), F.col("iri").alias("code"), mark.alias("mark")), edges.select(F.col("url").alias("grp"), "child", "parent"))
    above = classes.select(F.col("url").alias("grp"), F.col("iri").alias("is_a"), F.col("code").alias("_above"))
    rows = classes.join(kept.select(F.col("grp").alias("url"), F.col("code").alias("iri"), "is_a"), ["url", "iri"])
    return rows.join(above.withColumnRenamed("grp", "url"), ["url", "is_a"], "left").select("url", "code", "title", "description", F.when(F.col("deprecated"), "DEPRECATED").alias("status"), F.col("iri").alias("meaning"), F.col("_above").alias("is_a"))


def obo_prefixes(classes: DataFrame) -> DataFrame:
    """(url, prefix, uri) of the ontologies whose numbered terms a document has."""
    found = classes.select("url", F.regexp_extract("iri", r"^http://purl\.obolibrary\.org/obo/([A-Za-z]+)_[0-9]+$", 1).alias("prefix")).filter("prefix != ''").distinct()
    return found.select("url", "prefix", F.concat(F.lit("http://purl.obolibrary.org/obo/"), "prefix", F.lit("_")).alias("uri"))


def _all_lines(docs: DataFrame) -> DataFrame:
    """(url, ord, line): lines with single spaces, empty ones too."""
    return docs.select("url", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))


def _before() -> Window:
    return Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)


def _text(column: str) -> Column:
    """The lines of a group as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(column).alias("x")))), lambda r: r["x"]), " ")


def _is(pattern: str) -> Column:
    return F.rlike("line", F.lit(pattern))


def split_fields(text: Column) -> tuple[Column, Column, Column]:
    """What was entered, its label and its description, from a line of a table whose columns ran together.

    The label repeats the entry, regardless of case: the shortest such beginning counts. Else an entry in lower case ends before
    the first word with a capital, and the label takes the words from there that the entry has too, until all of them have occurred; if the first
    isn't one of them, or the description is said to be missing, the label is all the rest. Else all is both entry and label.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    missing = F.endswith(flat, F.lit(NO_DESCRIPTION))
    flat = F.when(missing, F.rtrim(F.substring(flat, F.lit(1), F.length(flat) - len(NO_DESCRIPTION)))).otherwise(flat)
    twice = r"(?is)^(\S+(?: \S+)*?) (\1)(?: (.*))?$"
    lower = r"(?s)^((?:(?:[^A-Za-z ]*[a-z]\S*|[^A-Za-z ]+) )+)([^A-Za-z ]*[A-Z].*)$"
    is_twice, is_lower = F.rlike(flat, F.lit(twice)), F.rlike(flat, F.lit(lower))
    entry, rest = F.rtrim(F.regexp_extract(flat, lower, 1)), F.split(F.regexp_extract(flat, lower, 2), " ")
    keys = lambda words: F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    known, own = F.array_remove(F.array_distinct(keys(F.split(entry, " "))), ""), keys(rest)
    other = F.array_position(F.transform(own, lambda k: (k != "") & ~F.array_contains(known, k)), True)
    until = F.when(other > 0, other - 1).otherwise(F.size(own))
    last = F.array_max(F.transform(known, lambda k: F.array_position(own, k)))
    covered = F.forall(known, lambda k: F.array_contains(own, k))
    n = F.least(until, F.when(covered, last).otherwise(F.size(own))).cast("int")
    n = F.when(missing | (n == 0), F.size(own)).otherwise(n)
    label, told = F.array_join(F.slice(rest, F.lit(1), n), " "), F.array_join(F.slice(rest, n + 1, F.size(own)), " ")
    return (
        F.when(is_twice, F.regexp_extract(flat, twice, 1)).when(is_lower, entry).otherwise(flat),
        F.when(is_twice, F.regexp_extract(flat, twice, 2)).when(is_lower, label).otherwise(flat),
        F.when(is_twice, F.regexp_extract(flat, twice, 3)).when(is_lower, told).otherwise(F.lit("")),
    )


def domain_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domains (url, domain, description) and their rows (url, domain, ord, obsolete, entry, label, description) of a handbook's text.

    `Domain Name:` begins a domain, `Domain Description:` its description, and No or Yes with a number a row; other lines go on with
    what stands before them. What comes before the first domain, and what follows a missing description, is left out.
    """
    name, told, row = r"^Domain Name: ?(\S+)$", r"^Domain Description: ?(.*)$", r"^(No|Yes) [0-9,]+ ?(.*)$"
    lines = _all_lines(docs).filter((F.col("line") != "") & ~_is(PAGE_LINES))
    kind = F.when(_is(name), "name").when(_is(told), "told").when(_is(row), "row")
    marked = lines.withColumn("kind", kind).withColumn("domain", F.last(F.when(_is(name), F.regexp_extract("line", name, 1)), ignorenulls=True).over(_before()))
    marked = marked.withColumn("entry", F.last(F.when(F.col("kind").isNotNull(), F.col("ord")), ignorenulls=True).over(_before())).filter("domain IS NOT NULL")
    text = F.when(F.col("kind") == "told", F.regexp_extract("line", told, 1)).when(F.col("kind") == "row", F.regexp_extract("line", row, 2)).otherwise(F.col("line"))
    first = F.min_by(F.struct("kind", "text", F.startswith("line", F.lit("Yes")).alias("obsolete")), "ord")
    entries = marked.withColumn("text", text).groupBy("url", "domain", "entry").agg(first.alias("f"), F.trim(_text("text")).alias("text"))
    about = F.when((F.col("f.kind") == "told") & ~F.col("f.text").isin("", NO_DESCRIPTION), F.col("text"))
    domains = entries.groupBy("url", "domain").agg(F.max_by(about, F.when(about.isNotNull(), F.col("entry"))).alias("description"))
    entered, label, description = split_fields(F.col("text"))
    w = Window.partitionBy("url", "domain").orderBy("entry")
    rows = entries.filter("f.kind = 'row'").select("url", "domain", (F.row_number().over(w) - 1).alias("ord"), F.col("f.obsolete").alias("obsolete"), entered.alias("entry"), label.alias("label"), _full(description).alias("description"))
    return domains, rows


def _part(docs: DataFrame, begins: str, ends: str) -> DataFrame:
    """Lines behind the first that begins a part, after the first category, up to the first that ends it; page marks and running heads aren't lines."""
    lines = _all_lines(docs).filter(~_is(r"^===PAGE [0-9]+===$|^[0-9]*CXS 192|^GENERAL STANDARD FOR FOOD ADDITIVES"))
    seen = lambda c: F.max(c.cast("int")).over(_before()) == 1
    lines = lines.withColumn("_1", seen(_is(r"^01\.0 "))).withColumn("_b", F.col("_1") & _is(begins)).withColumn("_2", seen(F.col("_b")))
    return lines.withColumn("_3", seen(F.col("_2") & _is(ends))).filter("_2 AND NOT _b AND NOT _3").select("url", "ord", "line")


def category_texts(docs: DataFrame) -> DataFrame:
    """(url, code, description, notes) of the descriptions of dotted categories in the second part of a text, with the footnotes they refer to.

    A footnote begins with its number and a capital and goes on in the lines in small letters that follow it at once. Numbers at the
    end of a line refer to footnotes; those that there are count, in order. Of a code's descriptions the last one counts.
    """
    head, note = r"^([0-9]{2}(?:\.[0-9]+)+) ?(.*)$", r"^([1-9][0-9]?) ([A-Z].*)$"
    lines = _part(docs, r"(?i)\bPART II\b", r"(?i)\bPART III\b|\bANNEX [A-Z]\b")
    kind = F.when(F.col("line") == "", "none").when(_is(head), "head").when(_is(note), "note").when(_is("^[a-z]"), "small").otherwise("text")
    lines = lines.withColumn("kind", kind).withColumn("_led", F.last(F.when(F.col("kind") != "small", F.col("kind")), ignorenulls=True).over(_before()))
    role = F.when((F.col("kind") == "small") & (F.col("_led") == "note"), "note_on").when(F.col("kind") == "small", "text").otherwise(F.col("kind"))
    lines = lines.withColumn("role", role)
    for column, by in (("_code", "head"), ("_note", "note")):
        lines = lines.withColumn(column, F.last(F.when(F.col("role") == by, F.col("ord")), ignorenulls=True).over(_before()))
    lines = lines.withColumn("code", F.last(F.when(F.col("role") == "head", F.regexp_extract("line", head, 1)), ignorenulls=True).over(_before()))
    notes = lines.filter("role IN ('note', 'note_on')").withColumn("x", F.when(F.col("role") == "note", F.regexp_extract("line", note, 2)).otherwise(F.col("line")))
    notes = notes.groupBy("url", "_note").agg(F.min_by(F.regexp_extract("line", note, 1).cast("int"), "ord").alias("number"), _text("x").alias("note"))
    notes = notes.groupBy("url", "number").agg(F.max_by("note", "_note").alias("note"))
    prose = lines.filter("role = 'text' AND code IS NOT NULL")
    texts = prose.groupBy("url", "code", "_code").agg(_text("line").alias("x")).groupBy("url", "code").agg(F.max_by("x", "_code").alias("description"))
    cluster = F.regexp_extract("line", r"""(?:[A-Za-z,;)"']|(?<![0-9])\.) ?([0-9]{1,2}(?:[ ,]+[0-9]{1,2})*)$""", 1)
    asked = prose.select("url", "code", F.explode(F.regexp_extract_all(cluster, F.lit("[0-9]+"), F.lit(0))).alias("n")).select("url", "code", F.col("n").cast("int").alias("number")).distinct()
    found = asked.join(notes, ["url", "number"]).groupBy("url", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "note"))), lambda r: r["note"]).alias("notes"))
    return texts.join(found, ["url", "code"], "left")


def additive_entries(docs: DataFrame) -> DataFrame:
    """(url, name, code, description) of the additives in a text's first table: a line in capitals names each, one with its code and functional class follows."""
    lines = _part(docs, r"(?i)\bTABLE ONE\b", r"(?i)\bTABLE TWO\b")
    code = r"[0-9]{1,4}[A-Za-z]{0,2}(?:\([ivxIVX]{1,6}\))?"
    before, after = rf"(?i)\bINS ({code})", rf"(?i)(?:^| )({code}) ?INS\b"
    is_info = _is(r"(?i)functional class(?:es)? ?:") & (_is(before) | _is(after))
    kind = F.when(is_info, "info").when(_is(r"^[A-Z0-9][A-Z0-9 ,()./'+-]{2,}$"), "name")
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("kind", kind).withColumn("led", F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "line")), ignorenulls=True).over(w))
    uses = F.trim(F.rtrim(F.regexp_extract("line", r"(?i)functional class(?:es)? ?: ?(.*)", 1), F.lit(", ")))
    found = marked.filter("kind = 'info' AND led.kind = 'name'")
    return found.select("url", F.col("led.line").alias("name"), F.coalesce(_full(F.regexp_extract("line", before, 1)), F.regexp_extract("line", after, 1)).alias("code"), F.when(uses != "", F.concat(F.lit("Functional class: "), uses)).alias("description"))


def group_links(docs: DataFrame, headers: str = "t201") -> DataFrame:
    """(url, ord, href, name) of the links in the header cells of one column of tables; link targets are whole URLs."""
    cell = rf'(?is)<th\b[^>]*\bheaders="\Q{headers}\E"[^>]*>\s*<a\s+href="([^"]+)"[^>]*>([^<]+)</a>'
    each = docs.select("url", F.posexplode(F.regexp_extract_all("content", F.lit(cell), F.lit(0))).alias("ord", "x"))
    return each.select("url", "ord", t.url_joined(F.col("url"), F.trim(F.regexp_extract("x", cell, 1))).alias("href"), F.trim(F.regexp_extract("x", cell, 2)).alias("name"))


def group_pages(docs: DataFrame) -> DataFrame:
    """(url, ord, code, title, description) of pages of groups: ord 0 the group, from its heading `Title (CODE)`, then its members, a section each.

    A group is described by its first two paragraphs of more than 40 characters before the sections, a member by its first of more
    than 30 that isn't a sequence of horizons. Pages without such a heading give nothing.
    """
    all_of = lambda c, p, i=1: F.regexp_extract_all(c, F.lit(p), F.lit(i))
    plain = lambda c: F.trim(F.regexp_replace(t.normalize_text(t.strip_tags(c)), r"\s+", " "))
    paragraphs = lambda c: F.transform(all_of(c, r"(?is)<p\b[^>]*>(.*?)</p>"), plain)
    main = F.coalesce(_full(F.regexp_extract("content", r"(?is)<main\b[^>]*>(.*?)</main>", 1)), F.col("content"))
    h1, h2 = r"(?is)<h1\b[^>]*>((?:(?!</h1>).)*)\(([A-Z0-9.]+)\)\s*</h1>(.*)", r"(?is)<h2\b[^>]*>((?:(?!</h2>).)*)\(([^)]+)\)\s*</h2>(.*)"
    pages = docs.select("url", main.alias("body")).filter(F.rlike("body", F.lit(h1)))
    lead = F.regexp_extract(F.regexp_extract("body", h1, 3), r"(?is)^(.*?)(?:<section\b|\z)", 1)
    about = F.array_join(F.slice(F.filter(paragraphs(lead), lambda p: F.length(p) > 40), 1, 2), " ")
    groups = pages.select("url", F.lit(0).alias("ord"), F.regexp_extract("body", h1, 2).alias("code"), plain(F.regexp_extract("body", h1, 1)).alias("title"), _full(about).alias("description"))
    parts = F.filter(all_of("body", r"(?is)<section\b[^>]*>(.*?)</section>"), lambda s: F.rlike(s, F.lit(h2)))
    each = pages.select("url", F.posexplode(parts).alias("ord", "s"))
    good = F.filter(paragraphs(F.regexp_extract("s", h2, 3)), lambda p: (F.length(p) > 30) & ~F.rlike(p, F.lit(r"(?i)^(Common horizon sequence|S[eé]quence typique)")))
    members = each.select("url", (F.col("ord") + 1).alias("ord"), F.trim(F.regexp_extract("s", h2, 2)).alias("code"), plain(F.regexp_extract("s", h2, 1)).alias("title"), F.get(good, F.lit(0)).alias("description"))
    return groups.unionByName(members)


def taxonomy(orders: DataFrame, links: DataFrame, pages: DataFrame, other: DataFrame) -> DataFrame:
    """(code, title, description, is_a, level, other_title, other_description): three levels of orders, groups and members.

    orders (url of the chapter, code, title, description); links of the chapters; pages of groups, and those in another language under the first
    language's URLs, whose members are matched by position. Groups have the code of their order and that of their page's folder.
    """
    none = F.lit(None).cast("string")
    top = orders.select("code", "title", "description", none.alias("is_a"), F.lit(1).alias("level"), none.alias("other_title"), none.alias("other_description"))
    folder = F.upper(F.regexp_extract("href", r"://[^/]+/(?:[^/]+/)*([^/]+)/[^/]+\.html$", 1))
    named = links.join(orders.select("url", F.col("code").alias("_order")), "url").withColumn("_folder", folder).filter("_folder != ''")
    groups = named.select("_order", F.concat_ws(".", "_order", "_folder").alias("_group"), F.col("name").alias("_name"), F.col("href").alias("url"))
    translated = other.select("url", "ord", F.col("title").alias("other_title"), F.col("description").alias("other_description"))
    zero = groups.withColumn("ord", F.lit(0)).join(pages.filter("ord = 0").select("url", "description"), "url", "left").join(translated, ["url", "ord"], "left")
    middle = zero.select(F.col("_group").alias("code"), F.col("_name").alias("title"), "description", F.col("_order").alias("is_a"), F.lit(2).alias("level"), "other_title", "other_description")
    below = pages.filter("ord > 0").join(groups, "url").join(translated, ["url", "ord"], "left")
    return top.unionByName(middle).unionByName(below.select("code", "title", "description", F.col("_group").alias("is_a"), F.lit(3).alias("level"), "other_title", "other_description"))
