"""Readers of further formats: picklist tables, term graphs, registries, and texts whose lines say what they are.

As in readers, documents are (url, content), one whole file a row. Lines that belong to the line before are found by windows over
a document's lines, so a document is the unit that one task holds.
"""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .readers import _full, table_cells


def zip_members(files: DataFrame, suffix: str = "") -> DataFrame:
    """(url, content) of the members with a suffix of zip files (path, content binary), each url `path!member`; what is no zip gives nothing."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        rows += [(f"{path}!{n}", z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.lower().endswith(suffix.lower()) and not n.endswith("/")]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["url", "content"])

    return files.select("path", "content").mapInPandas(run, "url string, content string")


def _roles(header: list[str]) -> dict[str, int]:
    """Which column of a picklist's header is the key, and which are titles and descriptions by language."""
    named = [(i, h.strip().lower()) for i, h in enumerate(header) if h.strip()]
    out = {"code": named[0][0]} if named else {}
    for lang in ("en", "fr"):
        own = [(i, h) for i, h in named[1:] if h.endswith("_" + lang)]
        told = [i for i, h in own if "desc" in h] if len(own) > 1 else []
        out |= {f"title_{lang}": i for i, _ in own if i not in told[:1]} if own else {}
        if own:
            out[f"title_{lang}"] = next(i for i, _ in own if i not in told[:1])
        if told:
            out[f"description_{lang}"] = told[0]
    return out


def picklist_csv(docs: DataFrame) -> DataFrame:
    """(url, ord, code, title_en, description_en, title_fr, description_fr, source) of picklist tables.

    A file begins with a line of field names whose first is empty, then the lines general, en and fr; ord 0 is the list itself, from
    these, with its source. After blank lines come a header and the values. A description that was split at commas that
    aren't quoted is put together again. Other files give nothing.
    """
    names = ["url", "ord", "code", "title_en", "description_en", "title_fr", "description_fr", "source"]

    def parsed(url: str, content: str) -> list[tuple]:
        lines = list(csv.reader(io.StringIO((content or "").lstrip("﻿"))))
        fields = [c.strip().lower() for c in lines[0]] if lines else []
        if len(lines) < 4 or fields[:3] != ["", "title", "description"]:
            return []
        behind = len(fields) - 3

        def about(line: list[str]) -> tuple[str | None, str | None]:
            told = ", ".join(c.strip() for c in line[2 : max(len(line) - behind, 3)])
            return (line[1].strip() or None if len(line) > 1 else None), told or None

        source = lines[1][fields.index("source")].strip() if "source" in fields and len(lines[1]) > fields.index("source") else ""
        rows = [(url, 0, None, *about(lines[2]), *about(lines[3]), source or None)]
        body = [x for x in lines[4:] if any(c.strip() for c in x)]
        role = _roles(body[0]) if body else {}
        for line in body[1:]:
            get = lambda k, line=line: (line[role[k]].strip() or None) if k in role and role[k] < len(line) else None
            if get("code"):
                rows.append((url, len(rows), get("code"), get("title_en"), get("description_en"), get("title_fr"), get("description_fr"), None))
        return rows

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([r for u, c in zip(frame["url"], frame["content"], strict=True) for r in parsed(u, c)], columns=names)

    return docs.select("url", "content").mapInPandas(run, "url string, ord int, " + ", ".join(f"{n} string" for n in names[2:]))


def term_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (iri, label, deprecated) and edges (source, target, label) of term graphs; of nodes with one IRI the first counts, edges are distinct."""
    schema = "nodes array<struct<iri: string, label: string, deprecated: boolean>>, edges array<struct<source: string, target: string, label: string>>"
    graph = docs.select("url", F.from_json("content", schema).alias("g"))
    nodes = graph.select("url", F.posexplode("g.nodes").alias("ord", "n")).filter("coalesce(n.iri, '') != ''")
    first = nodes.groupBy(F.col("n.iri").alias("iri")).agg(F.min_by(F.struct("n.label", "n.deprecated"), F.struct("url", "ord")).alias("f"))
    edges = graph.select(F.explode("g.edges").alias("e")).select("e.source", "e.target", "e.label").distinct()
    return first.select("iri", F.col("f.label").alias("label"), F.coalesce("f.deprecated", F.lit(False)).alias("deprecated")), edges


def descendants(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from pages of descendants, each with its parents, which become edges."""
    schema = "collection array<struct<`@id`: string, prefLabel: string, obsolete: boolean, parents: array<struct<`@id`: string>>>>"
    terms = docs.select("url", F.posexplode(F.from_json("content", schema)["collection"]).alias("ord", "c")).filter("c.`@id` IS NOT NULL")
    first = terms.groupBy(F.col("c.`@id`").alias("iri")).agg(F.min_by(F.struct("c.prefLabel", "c.obsolete"), F.struct("url", "ord")).alias("f"))
    edges = terms.select(F.col("c.`@id`").alias("source"), F.explode("c.parents").alias("p")).select("source", F.col("p.`@id`").alias("target"), F.lit("subClassOf").alias("label")).filter("target IS NOT NULL").distinct()
    return first.select("iri", F.col("f.prefLabel").alias("label"), F.coalesce("f.obsolete", F.lit(False)).alias("deprecated")), edges


def _lines(docs: DataFrame) -> DataFrame:
    """(url, ord, line): lines without the space around them; empty ones are left out."""
    return docs.select("url", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).filter("line != ''")


def _joined(lines: DataFrame, begins: Column) -> DataFrame:
    """lines with `entry`, the number of the last line before that begins an entry, or their own."""
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("entry", F.last(F.when(begins, F.col("ord")), ignorenulls=True).over(w))


def outline(docs: DataFrame) -> DataFrame:
    """(url, context, code, title, description) of outlines of a classification: `Subclass QA` or `Class E` set the context, lines
    like `QA76-90 Computers` are entries, and what follows an entry describes it. Titles of classes have their letters as code and no context.
    """
    lines = _lines(docs).filter(~F.rlike("line", F.lit(r"^(LIBRARY OF CONGRESS|\(Click)")))
    head, named, code, cover = r"^(?:Subclass|Class) ([A-Z]{1,3})$", r"^Subclass ([A-Z]{1,3}) (.+)$", r"^(\(?[A-Z]{1,3}\(?[0-9][0-9.()\-]*) (.+)$", r"^CLASS ([A-Z](?:-[A-Z])*) - (.+)$"
    is_ = lambda p: F.rlike("line", F.lit(p))
    get = lambda p, i: F.regexp_extract("line", p, i)
    kind = F.when(is_(cover), "class").when(is_(named), "subclass").when(is_(head), "head").when(is_(code), "entry").otherwise("more")
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("kind", kind).withColumn("context", F.last(F.when(F.col("kind") == "head", get(head, 1)), ignorenulls=True).over(w))
    # a heading ends the entry before it; covers stand beside
    own = _joined(marked.filter("kind IN ('head', 'entry', 'more')"), F.col("kind") != "more").groupBy("url", "context", "entry")
    first = F.min_by(F.struct("kind", "line"), "ord")
    rest = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "more", F.struct("ord", "line")))), lambda x: x["line"]), " ")
    entries = own.agg(first.alias("f"), rest.alias("description")).filter("f.kind = 'entry' AND context IS NOT NULL").select("url", "context", F.regexp_replace(F.regexp_extract("f.line", code, 1), "[()]", "").alias("code"), F.regexp_extract("f.line", code, 2).alias("title"), _full(F.col("description")).alias("description"))
    none = F.lit(None).cast("string")
    classes = marked.filter("kind = 'class'").select("url", none.alias("context"), F.explode(F.split(get(cover, 1), "-")).alias("code"), get(cover, 2).alias("title"), none.alias("description"))
    subs = marked.filter("kind = 'subclass'").select("url", F.substring(get(named, 1), 1, 1).alias("context"), get(named, 1).alias("code"), get(named, 2).alias("title"), none.alias("description"))
    return entries.unionByName(classes).unionByName(subs)


def numbered_categories(docs: DataFrame) -> DataFrame:
    """(url, code, title) of a table of dotted codes, `01.1 Milk`: titles go on in the lines that follow; page marks, numbers alone and notes aren't titles.

    The table ends where a line says PART II behind its first code.
    """
    row = r"^([0-9]{2}(?:\.[0-9]+)+)(?: (.+))?$"
    lines = _lines(docs).withColumn("is_row", F.rlike("line", F.lit(row)))
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.col("is_row").cast("int")).over(w) == 1
    over = F.max((F.rlike("line", F.lit(r"(?i)^PART +II\b")) & F.col("_begun")).cast("int")).over(w) == 1
    inside = lines.withColumn("_begun", begun).withColumn("_over", over).filter("_begun AND NOT _over")
    good = inside.filter(~F.rlike("line", F.lit(r"^===|^[0-9]+$|^[0-9]+ [A-Z]")) | F.col("is_row"))
    text = F.when(F.col("is_row"), F.regexp_extract("line", row, 2)).otherwise(F.col("line"))
    groups = _joined(good, F.col("is_row")).withColumn("text", text).groupBy("url", "entry")
    found = groups.agg(F.min_by(F.regexp_extract("line", row, 1), "ord").alias("code"), F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")).alias("title"))
    return found.filter("title != ''").select("url", "code", "title")


def split_at_names(docs: DataFrame, names: list[str], stop: str = "§") -> DataFrame:
    """(url, code, title, description): what follows each of some names in a text, up to the next or a stop mark; longer names come before those they begin with."""
    pattern = "(" + "|".join(r"\Q" + n + r"\E" for n in sorted(names, key=len, reverse=True)) + ")"
    flat = docs.select("url", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("text"))
    parts = flat.select("url", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s){pattern}((?:(?!{pattern}).)*)"), F.lit(0))).alias("ord", "part"))
    title = F.regexp_extract("part", "^" + pattern, 1)
    told = F.trim(F.substring_index(F.expr("substring(part, 1 + length(_t))"), stop, 1))
    slug = F.trim(F.regexp_replace(F.lower("_t"), "[^a-z0-9]+", "_"), F.lit("_"))
    return parts.withColumn("_t", title).select("url", "ord", slug.alias("code"), F.col("_t").alias("title"), _full(F.regexp_replace(told, r"^[. ]+|[. ]+$", "")).alias("description"))


def field_registry(docs: DataFrame) -> DataFrame:
    """(url, ord, section, name, namespace, local_name, slot, data_type, enums, description, comments) of seven-column registries of fields.

    `-` is nothing; a line without a field describes its section and has a null name; lines with # are left out.
    """
    rows = docs.select("url", F.posexplode(F.split("content", "\n")).alias("ord", "line")).filter("trim(line) != '' AND line NOT LIKE '#%'")
    cells = F.split("line", "\t")
    get = lambda i: F.nullif(_full(F.get(cells, F.lit(i))), F.lit("-"))
    name = get(1)
    snake = F.lower(F.regexp_replace("local_name", "([a-z0-9])([A-Z])", "$1_$2"))
    out = rows.select("url", "ord", get(0).alias("section"), name.alias("name"), get(2).alias("slot"), get(3).alias("data_type"), get(4).alias("_e"), get(5).alias("description"), get(6).alias("comments")).filter("section IS NOT NULL")
    enums = F.filter(F.transform(F.split("_e", ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "-"))
    out = out.withColumn("local_name", F.expr("CASE WHEN instr(name, ':') > 0 THEN substring(name, instr(name, ':') + 1) ELSE name END"))
    space = F.when(F.contains("name", F.lit(":")), F.substring_index("name", ":", 1)).when(F.col("name").isNotNull(), "dwc")
    return out.select("url", "ord", "section", "name", space.alias("namespace"), "local_name", F.coalesce("slot", snake).alias("slot"), F.when(F.col("name").isNotNull(), F.coalesce("data_type", F.lit("string"))).alias("data_type"), enums.alias("enums"), "description", "comments")


def xml_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (name, label, description) and translations (name, lang, label, description) of XML lists of properties; the first of a name in the order of the documents."""
    whole = r"(?s)<(?:\w+:)?property\b((?:[^>\"]|\"[^\"]*\")*?)(?:/>|>(.*?)</(?:\w+:)?property>)"
    props = docs.select("url", F.posexplode(F.regexp_extract_all("content", F.lit(whole), F.lit(0))).alias("ord", "x"))
    attribute = lambda c, n: _full(F.replace(F.replace(F.replace(F.regexp_extract(c, rf'(?:^|\s)(?:\w+:)?{n}="([^"]*)"', 1), F.lit("&lt;"), F.lit("<")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))
    head, inner = F.regexp_extract("x", whole, 1), F.regexp_extract("x", whole, 2)
    w = Window.partitionBy("name").orderBy("url", "ord")
    first = props.select("url", "ord", attribute(head, "qualName").alias("name"), attribute(head, "label").alias("label"), attribute(head, "description").alias("description"), inner.alias("inner")).filter("name IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    each = first.select("name", F.explode(F.regexp_extract_all("inner", F.lit(r"(?s)<(?:\w+:)?translation\b([^>]*)>"), F.lit(1))).alias("a"))
    return first.select("name", "label", "description"), each.select("name", attribute("a", "lang").alias("lang"), attribute("a", "label").alias("label"), attribute("a", "description").alias("description")).filter("lang IS NOT NULL")


def record_file(docs: DataFrame, suffix: str | None = None, pattern: str | None = None) -> DataFrame:
    """(url, name, link): of the files of a repository record the first with a suffix, or whose name matches, or the first; both null without one."""
    schema = "files array<struct<key: string, links: struct<self: string>>>"
    ok = lambda f: F.endswith(F.lower(f["key"]), F.lit("." + suffix.lower())) if suffix else F.rlike(f["key"], F.lit("(?i)" + pattern)) if pattern else F.lit(True)
    found = F.get(F.filter(F.from_json("content", schema)["files"], ok), F.lit(0))
    return docs.select("url", found.alias("f")).select("url", F.col("f.key").alias("name"), F.col("f.links.self").alias("link"))


def attribute_pages(docs: DataFrame) -> DataFrame:
    """(url, grid, line, code, class, description) of the code tables of attribute pages, for pages of more than two tables or with a table of more than two lines."""
    cells = table_cells(docs)
    lines = cells.groupBy("url", "grid").agg((F.max("line") + 1).alias("n"))
    kept = lines.groupBy("url").agg(F.count("*").alias("tables"), F.max("n").alias("most")).filter("tables > 2 OR most > 2").select("url")
    heads = cells.filter("line = 0").select("url", "grid", "place", F.lower("text").alias("name"))
    coded = heads.filter("name = 'code'").select("url", "grid")
    named = cells.filter("line > 0").join(heads, ["url", "grid", "place"]).join(coded, ["url", "grid"], "left_semi").join(kept, "url", "left_semi")
    wide = named.groupBy("url", "grid", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("m"))
    get = lambda *ks: F.coalesce(*(_full(F.col("m")[k]) for k in ks))
    return wide.select("url", "grid", "line", get("code").alias("code"), get("class", "classe").alias("class"), get("description").alias("description")).filter("code IS NOT NULL")


def listing(docs: DataFrame) -> DataFrame:
    """(url, line, name, version, status, description) of the first table of each page that has a `Name` column."""
    cells = table_cells(docs)
    heads = cells.filter("line = 0").select("url", "grid", "place", F.lower("text").alias("name"))
    first = heads.filter("name = 'name'").groupBy("url").agg(F.min("grid").alias("grid"))
    named = cells.filter("line > 0").join(first, ["url", "grid"]).join(heads, ["url", "grid", "place"])
    wide = named.groupBy("url", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("m"))
    get = lambda k: _full(F.col("m")[k])
    return wide.select("url", "line", get("name").alias("name"), get("version").alias("version"), F.upper(get("status")).alias("status"), get("description").alias("description")).filter("name IS NOT NULL")


def link_table(docs: DataFrame) -> DataFrame:
    """(url, id, title, subject, type, href) of three-column tables of links, in the order of their titles; the id is the link's last number."""
    rows = docs.select("url", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    bare = lambda i: F.trim(F.regexp_replace(F.get(cells, F.lit(i)), r"(?s)<[^>]*>", ""))
    href = F.regexp_extract("row", r'(?is)<a\b[^>]*href="([^"]*)"', 1)
    return rows.filter(F.size(cells) == 3).select("url", F.regexp_extract(href, r"([0-9]+)\D*$", 1).alias("id"), bare(0).alias("title"), bare(1).alias("subject"), bare(2).alias("type"), href.alias("href")).filter("href != ''")


def additive_codes(bindings: DataFrame) -> DataFrame:
    """(code, label, uses) from rows (code, label, use) of several bindings: codes without the E and spaces, uses distinct and in order."""
    code = F.regexp_replace(F.upper("code"), r"^E|\s", "")
    return bindings.groupBy(code.alias("code")).agg(F.min("label").alias("label"), F.array_join(F.sort_array(F.collect_set("use")), ", ").alias("uses"))
