"""Readers of vocabulary formats: files or columns of documents in, rows of values, mappings or places out.

Whole documents (JSON, HTML, YAML, text with sections) are read one file a row and taken apart by column functions, so
that many documents are parsed in parallel; tables are read as they are. Empty texts become nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T


def _full(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(url, content): each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))


def guarded(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched documents (url, content) that aren't empty nor at most 80 % of what is stored."""
    old = stored.select("url", F.length("content").alias("_old"))
    size = F.coalesce(F.length("content"), F.lit(0))
    return fresh.join(old, "url", "left").filter((size > 0) & (F.col("_old").isNull() | (size * 5 > F.col("_old") * 4))).drop("_old")


# Header spellings of classification tables.
HEADERS = {
    "level": ("level", "niveau"),
    "code": ("code",),
    "parent": ("parent", "parent code"),
    "title": ("class title", "titles", "title"),
    "title_fr": ("titres de classes", "titres"),
    "description": ("class definition", "definition"),
    "description_fr": ("définitions de la classe",),
}


def classification_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ord, level, code, parent, title, title_fr, description, description_fr) of a bilingual classification table.

    Headers are recognised regardless of case; columns that a file lacks are null.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    names = {c.replace("﻿", "").strip().lower().split("/")[0]: c for c in raw.columns}
    cols = []
    for name, spellings in HEADERS.items():
        found = next((names[s] for s in spellings if s in names), None)
        cols.append((_full(F.col(f"`{found}`")) if found else F.lit(None).cast("string")).alias(name))
    return raw.select(F.monotonically_increasing_id().alias("ord"), *cols).filter("code IS NOT NULL").withColumn("level", F.expr("try_cast(level AS int)"))


def code_system(docs: DataFrame) -> DataFrame:
    """(url, code, title, description, is_a, level) of FHIR code systems, concepts however deeply nested; what isn't one gives nothing."""
    import json

    import pandas as pd

    names = ["url", "code", "title", "description", "is_a", "level"]

    def run(frames):
        for frame in frames:
            rows = []
            for url, content in zip(frame["url"], frame["content"], strict=True):
                try:
                    system = json.loads(content or "null")
                except (ValueError, RecursionError):
                    continue
                todo = [(c, None, 1) for c in reversed((system.get("concept") or []) if isinstance(system, dict) else [])]
                while todo:
                    c, parent, level = todo.pop()
                    if not isinstance(c, dict):
                        continue
                    if c.get("code") is not None:
                        rows.append((url, str(c["code"]), c.get("display"), (c.get("definition") or "").strip() or None, parent, level))
                    todo += [(x, c.get("code"), level + 1) for x in reversed(c.get("concept") or [])]
            yield pd.DataFrame(rows, columns=names)

    return docs.select("url", "content").mapInPandas(run, "url string, code string, title string, description string, is_a string, level int")


def value_set(docs: DataFrame) -> DataFrame:
    """(url, code, title) of FHIR value sets: all concepts of all inclusions."""
    schema = "compose struct<include: array<struct<concept: array<struct<code: string, display: string>>>>>"
    each = docs.select("url", F.explode(F.from_json("content", schema)["compose"]["include"]).alias("i")).select("url", F.explode("i.concept").alias("c"))
    return each.select("url", F.col("c.code").alias("code"), F.col("c.display").alias("title"))


def sparql_bindings(docs: DataFrame) -> DataFrame:
    """(url, ord, name, value, lang): one row for each variable of each binding of SPARQL results."""
    schema = "results struct<bindings: array<map<string, struct<value: string, `xml:lang`: string>>>>"
    rows = docs.select("url", F.posexplode(F.from_json("content", schema)["results"]["bindings"]).alias("ord", "b"))
    return rows.select("url", "ord", F.explode("b").alias("name", "v")).select("url", "ord", "name", F.col("v.value").alias("value"), F.col("v.`xml:lang`").alias("lang"))


def table_cells(docs: DataFrame) -> DataFrame:
    """(url, grid, line, place, header, text): the cells of all tables of HTML pages; a self-closed cell is empty."""
    rx = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    open_cells = F.regexp_replace("content", r"(?i)<(t[dh])\b([^>]*)/>", "<$1$2></$1>")
    grids = docs.select("url", F.posexplode(rx(open_cells, r"(?is)<table\b[^>]*>(.*?)</table>")).alias("grid", "body"))
    lines = grids.select("url", "grid", F.posexplode(rx(F.col("body"), r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\z)")).alias("line", "row"))
    cells = lines.select("url", "grid", "line", F.posexplode(F.regexp_extract_all("row", F.lit(r"(?is)<(t[dh])\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), F.lit(0))).alias("place", "cell"))
    return cells.select("url", "grid", "line", "place", F.rlike("cell", F.lit("(?i)^<th")).alias("header"), F.trim(F.regexp_replace("cell", r"(?s)<[^>]*>", "")).alias("text"))


def code_table(docs: DataFrame) -> DataFrame:
    """(url, grid, line, code, ...) of HTML tables whose first line names columns, one of them `code`, in lower case."""
    cells = table_cells(docs)
    heads = cells.filter("line = 0").select("url", "grid", "place", F.lower("text").alias("name"))
    coded = heads.filter("name = 'code'").select("url", "grid")
    named = cells.filter("line > 0").join(heads, ["url", "grid", "place"]).join(coded, ["url", "grid"], "left_semi")
    wide = named.groupBy("url", "grid", "line").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("m"))
    get = lambda k: _full(F.col("m")[k])
    return wide.select("url", "grid", "line", get("code").alias("code"), get("display").alias("title"), get("definition").alias("description"), F.upper(get("status")).alias("status"), F.expr("try_cast(m['level'] AS int)").alias("level")).filter("code IS NOT NULL")


def indented_list(docs: DataFrame) -> DataFrame:
    """(url, ord, level, code, title) of list items with class indent-N and texts `CODE - Name`, closed or not."""
    items = docs.select("url", F.posexplode(F.regexp_extract_all("content", F.lit(r'(?is)<li\b[^>]*\bindent-[0-9]+.*?(?=<li\b|</ul>|\z)'), F.lit(0))).alias("ord", "item"))
    text = F.trim(F.regexp_replace("item", r"(?s)<[^>]*>", ""))
    return items.select("url", "ord", F.regexp_extract("item", r"indent-([0-9]+)", 1).cast("int").alias("level"), F.trim(F.regexp_extract(text, r"(?s)^(\S+)\s+-\s+(.*)$", 1)).alias("code"), F.trim(F.regexp_extract(text, r"(?s)^(\S+)\s+-\s+(.*)$", 2)).alias("title")).filter("code != ''")


def definition_list(docs: DataFrame) -> DataFrame:
    """(url, ord, title, description) of <dt>/<dd> pairs; of titles that differ in case alone the first on any page."""
    pairs = docs.select("url", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0))).alias("ord", "pair"))
    bare = lambda p: F.trim(F.regexp_replace(F.regexp_extract("pair", p, 1), r"(?s)<[^>]*>", ""))
    rows = pairs.select("url", "ord", bare(r"(?is)<dt\b[^>]*>(.*?)</dt>").alias("title"), bare(r"(?is)<dd\b[^>]*>(.*?)</dd>").alias("description"))
    w = Window.partitionBy(F.lower("title")).orderBy("url", "ord")
    return rows.filter("title != ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def xml_prefixes(docs: DataFrame) -> DataFrame:
    """(url, prefix, uri) of the namespaces that XML documents declare, without those of the markup itself."""
    found = docs.select("url", F.explode(F.regexp_extract_all("content", F.lit(r'xmlns:[\w.-]+="[^"]*"'), F.lit(0))).alias("x"))
    rows = found.select("url", F.regexp_extract("x", r'xmlns:([\w.-]+)=', 1).alias("prefix"), F.regexp_extract("x", r'="([^"]*)"', 1).alias("uri"))
    return rows.filter(~F.col("prefix").isin("rdf", "rdfs", "owl", "xsd", "xml")).distinct()


def sssom(docs: DataFrame) -> DataFrame:
    """Mapping rows of SSSOM files: a preamble of # lines or YAML up to ---, a header line, tab-separated values.

    Lines without a subject are left out; short lines have nulls.
    """
    body = F.regexp_replace(F.regexp_replace("content", r"(?s)\A(?:.*?\n)?---\r?\n", ""), r"(?m)^#.*\n?", "")
    lines = docs.select("url", F.split(F.trim(body), r"\r?\n").alias("l"))
    # the names are taken before lines become rows, which would each carry the whole file otherwise
    named = lines.select("url", F.split(F.element_at("l", 1), "\t").alias("names"), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))).alias("rest"))
    rows = named.select("url", "names", F.posexplode("rest").alias("ord", "line"))
    cells = F.split("line", "\t")
    pairs = F.transform(F.col("names"), lambda n, i: F.struct(n.alias("k"), F.get(cells, i).alias("v")))
    m = rows.select("url", "ord", F.map_from_entries(pairs).alias("m"))
    want = ["subject_id", "predicate_id", "object_id", "mapping_justification", "subject_label", "object_label"]
    return m.select("url", "ord", *(_full(F.col("m")[c]).alias(c) for c in want)).filter("subject_id IS NOT NULL")


def geonames(spark: SparkSession, path: str, classes: list[str] | None = None, codes: list[str] | None = None) -> DataFrame:
    """Places of a 19-column file, filtered at the scan by feature class and code."""
    names = "gnid name ascii alternates lat lon fclass fcode country cc2 adm1 adm2 adm3 adm4 population elevation dem timezone modified".split()
    rows = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names))
    rows = rows.filter(F.col("fclass").isin(classes)) if classes else rows
    return rows.filter(F.col("fcode").isin(codes)) if codes else rows


def alternate_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Best label of each (gnid, lang), neither historic nor colloquial, preferred before others; and Wikidata ids."""
    names = "id gnid lang value preferred short colloquial historic".split()
    rows = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{n} string" for n in names))
    w = Window.partitionBy("gnid", "lang").orderBy(F.when(F.col("preferred") == "1", 0).otherwise(1), F.col("id").cast("long"))
    good = rows.filter("length(lang) BETWEEN 2 AND 3 AND coalesce(colloquial, '') != '1' AND coalesce(historic, '') != '1'")
    labels = good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("gnid", "lang", "value")
    return labels, rows.filter("lang = 'wkdt'").groupBy("gnid").agg(F.min_by("value", F.col("id").cast("long")).alias("qid"))


def sections(docs: DataFrame, header: str) -> DataFrame:
    """(url, ord, section, line): lines of texts under the last line before that matches header."""
    lines = docs.select("url", F.posexplode(F.split("content", r"\r?\n")).alias("ord", "line"))
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.rlike("line", F.lit(header))
    marked = lines.withColumn("section", F.last(F.when(is_head, F.trim("line")), ignorenulls=True).over(w)).withColumn("_h", is_head)
    return marked.filter("NOT _h AND section IS NOT NULL AND trim(line) != ''").drop("_h")


# How a source is recognised, first match first: where to look, the pattern and the content type. Short names and
# the addresses of publishers come first, then what the document itself shows, then the kind of file.
DETECT = (
    ("url", r"^(?:https?://aims\.fao\.org/aos/agrovoc/|AGROVOC_).", "Thesaurus"),
    ("url", r"^https?://snomed\.info/id/[0-9]+", "OntologyAPI"),
    ("url", r"^(?:https?://purl\.obolibrary\.org/obo/)?[A-Za-z]+[_:][0-9]{4,}$", "OntologyAPI"),
    ("url", r"(?i)nrcs\.usda\.gov.*NASIS.*\.pdf$", "SoilHandbook"),
    ("url", r"fao\.org.*CXS(?:[_+ ]|%20)192", "FoodCodes"),
    ("url", r"(?i)wikidata\.org/wiki/Q207810|wikidata\.org/sparql.*P628", "Additives"),
    ("url", r"(?i)zenodo\.org/(?:api/)?records/.*credit", "Roles"),
    ("url", r"(?i)loc\.gov/catdir/cpso/lcco/?(?:#.*)?$", "LibraryClassification"),
    ("url", r"(?i)sis\.agr\.gc\.ca/cansis/glossary/", "DefinitionList"),
    ("url", r"(?i)statcan\.gc\.ca/.*datatype=classification", "Catalog"),
    ("url", r"(?i)^ISO_COUNTRY(?:_[A-Z]{2})?$|iso\.org/obp/ui/.*#iso:code:3166:[A-Z]{2}\s*$|iso\.org/iso-3166-country-codes", "Country"),
    ("url", r"(?i)^GeoNames_ADM1_[A-Z]{2}$|geonames\.org/.*admin1", "GeoNamesADM1"),
    ("url", r"(?i)^GeoNames_ADM2_[A-Z]{2}$|geonames\.org/.*admin2", "GeoNamesADM2"),
    ("url", r"(?i)^GeoNames_ADM3ADM4_[A-Z]{2}$", "GeoNamesADM34"),
    ("url", r"(?i)^GeoNames_countries$|geonames\.org/.*countryInfo", "GeoNamesCountries"),
    ("url", r"(?i)^GeoWiki_", "GeoWiki"),
    ("url", r"(?i)tdwg[_.-]dwc[_.-]simple\.xsd", "FieldRegistry"),
    ("url", r"(?i)nrcs\.usda\.gov.*\.pdf$", "FieldBook"),
    ("url", r"^https://sis\.agr\.gc\.ca/cansis/nsdb/(?:soil|.*/?snt/|.*/?slt/|.*/?slc/)", "AttributePages"),
    ("url", r"sis\.agr\.gc\.ca.*/taxa/cssc3/", "Taxonomy"),
    ("url", r"terminology\.hl7\.org/(?:[^/]+/)*(?:CodeSystem|ValueSet)-[^/]*\.html$", "CodeTable"),
    ("url", r"terminology\.hl7\.org/(?:[^/]+/)*[^/]*\.html$", "Listing"),
    ("url", r"(?i)//www12\.statcan\.gc\.ca/census-recensement/[^/]+/ref/dict/tab/index-(?:eng|fra)\.cfm", "CensusTable"),
    ("url", r"statcan\.gc\.ca.*p3VD\.pl.*Function=getVD", "IndentedList"),
    ("url", r"(?i)\.(?:owl|ofn|rdf|ttl|n3)(?:$|[?#])", "OWL"),
    ("url", r"(?i)\.sssom\.tsv(?:$|[?#])", "SSSOM"),
    ("head", r'"resourceType"\s*:\s*"CodeSystem"', "CodeSystem"),
    ("head", r'"resourceType"\s*:\s*"ValueSet"', "ValueSet"),
    ("head", r"<rdf:RDF", "OWL"),
    ("head", r"(?i)<table[^>]*class=.?codes", "CodeTable"),
    ("head", r"(?i)<dl\b", "DefinitionList"),
    ("head", r"(?i)^\x{FEFF}?(?:level|niveau)", "Classification"),
    ("head", r"(?i)^\x{FEFF}?\s*,\s*title\s*,\s*description", "Picklist"),
    ("url", r"(?i)\.ya?ml(?:$|[?#])", "LinkML"),
    ("head", r"(?i)<html", "HTML"),
)


def content_type(url: Column, head: Column, rules: list | tuple = DETECT, default: str = "FreeText") -> Column:
    """The first rule that matches, else the default."""
    out = F.lit(default)
    for where, pattern, kind in reversed(rules):
        out = F.when(F.rlike(url if where == "url" else head, F.lit(pattern)), kind).otherwise(out)
    return out


def linkml(docs: DataFrame) -> DataFrame:
    """(url, enum_key, ord, code, title, description, is_a, status, meaning) of the enums of YAML schemas; others give nothing."""
    import pandas as pd

    names = ["url", "enum_key", "ord", "code", "title", "description", "is_a", "status", "meaning"]

    def run(frames):
        import yaml  # not a dependency of the other readers

        for frame in frames:
            rows = []
            for url, content in zip(frame["url"], frame["content"], strict=True):
                try:
                    schema = yaml.safe_load(content or "")
                except yaml.YAMLError:
                    continue
                enums = schema.get("enums") if isinstance(schema, dict) else None
                for key, enum in (enums or {}).items():
                    for i, (code, pv) in enumerate(((enum or {}).get("permissible_values") or {}).items()):
                        rows.append((url, str(key), i, str(code), *(None if not (pv or {}).get(f) else str(pv[f]) for f in names[4:])))
            yield pd.DataFrame(rows, columns=names)

    return docs.select("url", "content").mapInPandas(run, "url string, enum_key string, ord int, code string, title string, description string, is_a string, status string, meaning string")
