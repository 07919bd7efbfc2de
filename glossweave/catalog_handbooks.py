"""Registered queries of ontologies, handbooks, taxonomies and places: documents are made of the tables, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalog import query
from .catalog_readers import _listed, _nations, _parts
from .operators import places
from .sources import crawl, handbooks, readers, sinks

_k = F.col
_HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">'
_OBO = "http://purl.obolibrary.org/obo/"


def _ontologies(table) -> DataFrame:
    """One ontology for each brand: sizes below a root, parts below their sizes."""
    above = lambda c: F.concat(F.lit(f'<rdfs:subClassOf rdf:resource="{_OBO}'), c, F.lit('"/>'))
    item = F.concat(
        F.lit(f'<owl:Class rdf:about="{_OBO}S_'), "p_size", F.lit(f'"><rdfs:label xml:lang="en">size '), "p_size", F.lit("</rdfs:label>"), above(F.lit("R_1")), F.lit("</owl:Class>"),
        F.lit(f'<owl:Class rdf:about="{_OBO}P_'), "p_partkey", F.lit('"><rdfs:label xml:lang="fr">non</rdfs:label><rdfs:label>'), "p_name", F.lit("</rdfs:label>"), above(F.concat(F.lit("S_"), "p_size")),
        F.lit("<rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf><skos:definition>"), "p_type", F.lit("</skos:definition>"), F.when(_k("p_size") % 5 == 0, "<owl:deprecated>true</owl:deprecated>").otherwise(""), F.lit("</owl:Class>"),
    )
    root = f'<owl:Class rdf:about="{_OBO}R_1"><rdfs:label xml:lang="en">root</rdfs:label><rdfs:subClassOf rdf:resource="http://www.w3.org/2002/07/owl#Thing"/></owl:Class>'
    return _parts(table, item).select("url", F.concat(F.lit(_HEAD + root), "items", F.lit("</rdf:RDF>")).alias("content"))


_PART_CLASS = f"SELECT p_brand AS url, 'P_' || p_partkey AS code, p_name AS title, p_type AS description, CASE WHEN p_size % 5 = 0 THEN 'DEPRECATED' END AS status, '{_OBO}P_' || p_partkey AS meaning, 'S_' || p_size AS is_a, p_size FROM part"
_SIZE_CLASS = f"SELECT DISTINCT p_brand AS url, 'S_' || p_size AS code, 'size ' || p_size AS title, NULL AS description, NULL AS status, '{_OBO}S_' || p_size AS meaning, 'R_1' AS is_a, p_size FROM part"
_ROOT_CLASS = f"SELECT DISTINCT p_brand AS url, 'R_1' AS code, 'root' AS title, NULL AS description, NULL AS status, '{_OBO}R_1' AS meaning, NULL AS is_a, 0 AS p_size FROM part"


@query(f"SELECT url, code, title, description, status IS NOT NULL AS deprecated, CASE WHEN code = 'R_1' THEN 0 ELSE 1 END AS n_parents FROM ({_PART_CLASS} UNION ALL {_SIZE_CLASS} UNION ALL {_ROOT_CLASS}) x")
def owl_classes(table, spark):
    """Classes of RDF/XML documents; elements about one class are one."""
    return handbooks.owl_classes(_ontologies(table)).select("url", "code", "title", "description", "deprecated", F.size("parents").alias("n_parents"))


@query(f"SELECT url, code, title, description, status, meaning, CASE WHEN p_size IN (7, 9) AND code LIKE 'P%' THEN 'R_1' ELSE is_a END AS is_a FROM ({_PART_CLASS} UNION ALL {_SIZE_CLASS} UNION ALL {_ROOT_CLASS}) x WHERE p_size NOT IN (7, 9)")
def owl_values_minus(table, spark):
    """Values of ontologies without the subtrees of two classes, named by title and by code."""
    return handbooks.ontology_values(handbooks.owl_classes(_ontologies(table)), ["Size_7", "s_9"])


@query(f"SELECT url, code, title, description, status, meaning, CASE WHEN code LIKE 'P%' THEN is_a END AS is_a FROM ({_PART_CLASS} UNION ALL {_SIZE_CLASS}) x WHERE p_size IN (7, 9)")
def owl_values_include(table, spark):
    """Only the subtrees of two classes."""
    return handbooks.ontology_values(handbooks.owl_classes(_ontologies(table)), include=["Size_7", "s_9"])


@query(f"SELECT url, p AS prefix, '{_OBO}' || p || '_' AS uri FROM (SELECT DISTINCT p_brand AS url FROM part) x, (VALUES ('P'), ('S'), ('R')) AS v(p)")
def obo_prefixes(table, spark):
    """Prefixes of the ontologies whose terms documents have."""
    return handbooks.obo_prefixes(handbooks.owl_classes(_ontologies(table)))


def _handbook(table) -> DataFrame:
    row = F.concat(F.when(_k("p_size") % 3 == 0, "Yes").otherwise("No"), F.lit(" 1,"), "p_partkey", F.lit(" p"), "p_partkey", F.lit(" x P"), "p_partkey", F.lit(" X "), F.when(_k("p_size") % 2 == 0, F.concat(F.lit("about\n  "), "p_type", F.lit("\n3 of 90\n"))).otherwise("No description available.\n"))
    return _parts(table, row).select("url", F.concat(F.lit("Yes 1 lost\nDomain Name: "), F.regexp_replace("url", "[^A-Za-z0-9]", "_"), F.lit("\nDomain Description: All of\nNASIS 7.4\n"), "url", F.lit("\n"), "items").alias("content"))


_DOMAIN = "regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS domain"


@query(f"SELECT DISTINCT p_brand AS url, {_DOMAIN}, 'All of ' || p_brand AS description FROM part")
def handbook_domains(table, spark):
    """Domains of a handbook's text."""
    return handbooks.domain_tables(_handbook(table))[0]


@query(f"""SELECT p_brand AS url, {_DOMAIN}, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_size % 3 = 0 AS obsolete, 'p' || p_partkey || ' x' AS entry, 'P' || p_partkey || ' X' AS label, CASE WHEN p_size % 2 = 0 THEN 'about ' || p_type END AS description FROM part""")
def handbook_rows(table, spark):
    """Rows of its tables, whose columns ran together."""
    return handbooks.domain_tables(_handbook(table))[1]


_SQL_CODE = "lpad(CAST(p_partkey % 90 + 1 AS VARCHAR), 2, '0') || '.' || p_partkey"


@query(f"""SELECT p_brand AS url, {_SQL_CODE} AS code, p_type || ' ' || CASE p_size % 3 WHEN 0 THEN p_name || '.1, 2' WHEN 1 THEN p_name || '.2' ELSE p_name END AS description, CASE p_size % 3 WHEN 0 THEN 'First note going on|Second' WHEN 1 THEN 'Second' END AS notes FROM part""")
def category_texts(table, spark):
    """Descriptions of categories with their footnotes."""
    code = F.concat(F.lpad((_k("p_partkey") % 90 + 1).cast("string"), 2, "0"), F.lit("."), "p_partkey")
    refs = F.when(_k("p_size") % 3 == 0, ".1, 2").when(_k("p_size") % 3 == 1, ".2").otherwise("")
    row = F.concat(code, F.lit(" A heading\n"), "p_type", F.lit("\n===PAGE 8===\n"), "p_name", refs, F.lit("\n"))
    text = F.concat(F.lit("PART II: in the contents\n01.0  Dairy\nPART II: Descriptors\n"), "items", F.lit("1 First note\ngoing on\n2 Second\n99 Not asked for\nPART III\n"), F.lit("01.1 x\nnot this\n"))
    return handbooks.category_texts(_parts(table, row).select("url", text.alias("content"))).withColumn("notes", F.array_join("notes", "|"))


@query("""SELECT p_brand AS url, 'PART NO. ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey % 9000 + 1 AS VARCHAR) || 'a(ii)' ELSE CAST(p_partkey % 9000 + 1 AS VARCHAR) END AS code, CASE WHEN p_size % 3 <> 0 THEN 'Functional class: ' || p_type END AS description FROM part""")
def additive_entries(table, spark):
    """Additives of a text's first table."""
    number = (_k("p_partkey") % 9000 + 1).cast("string")
    uses = F.when(_k("p_size") % 3 != 0, F.concat("p_type", F.lit(","))).otherwise("")
    info = F.when(_k("p_size") % 2 == 0, F.concat(F.lit("INS "), number, F.lit("a(ii) label "))).otherwise(F.concat(number, F.lit("INS label ")))
    row = F.concat(F.lit("A RUNNING HEAD\nPART NO. "), "p_partkey", F.lit("\n"), info, F.lit("Functional Class: "), uses, F.lit("\nINS 1 lost Functional Class: lost\nFoodCatNo x\n"))
    return handbooks.additive_entries(_parts(table, row).select("url", F.concat(F.lit("TABLE ONE 66\n01.0 Dairy\nTABLE ONE\n"), "items", F.lit("TABLE TWO\nNO NAME\nINS 2 Functional Class: x\n")).alias("content")))


def _chapters(table) -> DataFrame:
    cell = F.concat(F.lit('<th headers="t201"><a href="/taxa/N'), "n_nationkey", F.lit("x"), F.translate("n_name", " ", ""), F.lit('/index.html">'), "n_name", F.lit('</a></th><th headers="t2"><a href="/x">no</a></th>'))
    cell = F.regexp_replace(cell, r"/N[0-9]+x", "/")
    return _listed(_nations(table), [F.concat(F.lit("http://h/"), F.lower("r_name"), F.lit(".html")).alias("url")], "n_nationkey", cell).select("url", F.concat(F.lit("<table><tr>"), "items", F.lit("</tr></table>")).alias("content"))


def _group_docs(table, language: str) -> DataFrame:
    """A page for each nation, with a section for each of its suppliers."""
    both = table("supplier").join(F.broadcast(table("nation")), _k("s_nationkey") == _k("n_nationkey"))
    section = F.concat(F.lit("<section><h2><i>"), F.lit(language), "s_name", F.lit("</i> (S."), "s_suppkey", F.lit(")</h2><p>Common horizon sequence: of many letters and signs</p><p>too short</p><p>"), F.rpad("s_name", 41, "-"), F.lit("</p></section>"))
    pages = _listed(both, [F.concat(F.lit("http://h/taxa/"), F.translate("n_name", " ", ""), F.lit("/index.html")).alias("url"), _k("n_name")], "s_suppkey", section)
    head = F.concat(F.lit(f"<h1>no (x)</h1><main><h1>{language}"), "n_name", F.lit(" (G)</h1><p>short</p><p>"), F.rpad("n_name", 50, "+"), F.lit("</p>"))
    return pages.select("url", F.concat(head, "items", F.lit("</main>")).alias("content"))


@query("SELECT 'http://h/' || lower(r_name) || '.html' AS url, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS ord, 'http://h/taxa/' || replace(n_name, ' ', '') || '/index.html' AS href, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def group_links(table, spark):
    """Links of the groups in the header cells of chapters."""
    return handbooks.group_links(_chapters(table))


_GROUP_PAGE = "'http://h/taxa/' || replace(n_name, ' ', '') || '/index.html' AS url"


@query(f"""SELECT {_GROUP_PAGE}, 0 AS ord, 'G' AS code, 'en ' || n_name AS title, rpad(n_name, 50, '+') AS description FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT {_GROUP_PAGE}, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey), 'S.' || s_suppkey, 'en ' || s_name, rpad(s_name, 41, '-') FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def group_pages(table, spark):
    """Groups and their members from pages."""
    return handbooks.group_pages(_group_docs(table, "en "))


@query("""WITH g AS (SELECT *, r_regionkey || '.' || upper(replace(n_name, ' ', '')) AS grp, n_nationkey IN (SELECT s_nationkey FROM supplier) AS paged FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS title, NULL AS description, NULL AS is_a, 1 AS level, NULL AS other_title, NULL AS other_description FROM region
UNION ALL SELECT grp, n_name, CASE WHEN paged THEN rpad(n_name, 50, '+') END, CAST(r_regionkey AS VARCHAR), 2, CASE WHEN paged THEN 'fr ' || n_name END, CASE WHEN paged THEN rpad(n_name, 50, '+') END FROM g
UNION ALL SELECT 'S.' || s_suppkey, 'en ' || s_name, rpad(s_name, 41, '-'), grp, 3, 'fr ' || s_name, rpad(s_name, 41, '-') FROM supplier JOIN g ON s_nationkey = n_nationkey""")
def taxonomy_levels(table, spark):
    """Three levels of a taxonomy in two languages, members matched by position."""
    orders = table("region").select(F.concat(F.lit("http://h/"), F.lower("r_name"), F.lit(".html")).alias("url"), _k("r_regionkey").cast("string").alias("code"), _k("r_name").alias("title"), F.lit(None).cast("string").alias("description"))
    return handbooks.taxonomy(orders, handbooks.group_links(_chapters(table)), handbooks.group_pages(_group_docs(table, "en ")), handbooks.group_pages(_group_docs(table, "fr ")))


def _divisions(table):
    s = table("supplier")
    entries = s.select(F.concat(F.lit("N"), "s_nationkey").alias("scope"), _k("s_suppkey").cast("string").alias("gnid"), _k("s_name").alias("name"), F.lpad("s_suppkey", 9, "0").alias("code"))
    kind = F.when(_k("s_suppkey") % 3 == 0, "Province of it").when(_k("s_suppkey") % 3 == 1, "territory of it").otherwise("")
    facts = s.select(_k("s_suppkey").cast("string").alias("gnid"), F.when(_k("s_suppkey") % 2 == 0, F.concat(F.lit("Q"), "s_suppkey")).alias("qid"), F.lit("").alias("label"), kind.alias("description"))
    return places.divisions(entries, facts, table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("scope"), _k("n_name").alias("country")))


_TYPED = """WITH e AS (SELECT 'N' || s_nationkey AS scope, n_name, CAST(s_suppkey AS VARCHAR) AS gnid, s_name, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS code, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Province' WHEN 1 THEN 'Territory' END AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT scope, n_name, type, count(*) AS n FROM e WHERE type IS NOT NULL GROUP BY ALL),
g AS (SELECT *, type || ' of ' || n_name AS head, n >= 2 AND sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY scope) >= 2 AS header, row_number() OVER (PARTITION BY scope ORDER BY n DESC, type) AS g FROM n)"""


@query(f"""{_TYPED}, r AS (
SELECT scope, g, 0 AS i, '' AS k, head AS code, head AS title, NULL AS description, NULL AS is_a, NULL AS meaning, NULL AS alias, NULL AS status FROM g WHERE header
UNION ALL SELECT e.scope, coalesce(g.g, 2147483647), 1, lower(s_name), gnid, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'Province of it' WHEN 1 THEN 'territory of it' END, head, 'gnf:' || gnid, e.scope || '.' || e.code, NULL FROM e LEFT JOIN g ON e.scope = g.scope AND e.type = g.type AND header)
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY g, i, k, code) AS position, code, title, description, is_a, meaning, alias, status FROM r""")
def place_divisions(table, spark):
    """Divisions of countries under headers of their types."""
    return _divisions(table)[0]


_MAP = "'semapv:ManualMappingCuration' AS mapping_justification"


@query(f"""SELECT 'N' || s_nationkey AS scope, 'gnf:' || s_suppkey AS subject_id, 'skos:broadMatch' AS predicate_id, 'gno:A.ADM1' AS object_id, {_MAP}, s_name AS subject_label, '' AS object_label FROM supplier
UNION ALL SELECT 'N' || s_nationkey, 'gnf:' || s_suppkey, 'skos:exactMatch', 'wd:Q' || s_suppkey, {_MAP}, s_name, s_name FROM supplier WHERE s_suppkey % 2 = 0""")
def place_mappings(table, spark):
    """Their mappings."""
    return _divisions(table)[1]


@query(f"{_TYPED} SELECT scope, string_agg(type, ' or ' ORDER BY g) FILTER (WHERE n >= 2) || ' of ' || n_name AS title FROM g GROUP BY scope, n_name HAVING count(*) FILTER (WHERE n >= 2) > 0")
def place_titles(table, spark):
    """Titles of their enums."""
    return _divisions(table)[2]


@query("""WITH e AS (SELECT 'N' || c_nationkey AS scope, 'N' || c_nationkey || '.' || (c_custkey % 7) AS p1, 'N' || c_nationkey || '.' || (c_custkey % 7) || '.' || (c_custkey % 5) AS p2, c_custkey, c_name FROM customer),
p AS (SELECT *, CASE WHEN c_custkey % 7 < 5 THEN CASE WHEN c_custkey % 5 < 3 THEN 'g' || p2 ELSE 'g' || p1 END END AS above FROM e),
r AS (SELECT scope, coalesce(above, p2) AS p, '.' || CAST(c_custkey AS VARCHAR) AS k, CAST(c_custkey AS VARCHAR) AS code, c_name AS title, coalesce(above, p2) AS is_a, 'gnf:' || c_custkey AS meaning, CAST(c_custkey AS VARCHAR) AS alias FROM p
UNION ALL SELECT DISTINCT scope, p2, '', p2, p2, NULL, NULL, NULL FROM p WHERE above IS NULL)
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY p, k, code) AS position, code, title, NULL AS description, is_a, meaning, alias, NULL AS status FROM r""")
def place_subdivisions(table, spark):
    """Lower levels under second-level divisions, else first-level ones, else headers."""
    c, scope, k = table("customer"), F.concat(F.lit("N"), "c_nationkey"), _k("c_custkey")
    one, two = (k % 7).cast("string"), (k % 5).cast("string")
    entries = c.select(scope.alias("scope"), one.alias("adm1"), two.alias("adm2"), k.cast("string").alias("gnid"), _k("c_name").alias("name"), k.cast("string").alias("code"), F.lit("ADM3").alias("feature"))
    none = table("customer").limit(0).select(*(F.lit("").alias(x) for x in ("gnid", "qid", "label", "description")))
    all_one = table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("s")).crossJoin(spark.range(5).select(_k("id").cast("string").alias("i")))
    first = all_one.select(F.concat_ws(".", "s", "i").alias("code"))
    second = first.crossJoin(spark.range(3).select(_k("id").cast("string").alias("j"))).select(F.concat_ws(".", "code", "j").alias("code"))
    above = first.unionByName(second).select("code", F.concat(F.lit("g"), "code").alias("gnid"))
    return places.subdivisions(entries, none, above)[0]


def _towns(table):
    c, k = table("customer"), _k("c_custkey")
    towns = c.select(F.concat(F.lit("N"), "c_nationkey").alias("scope"), F.when(k % 10 != 9, F.concat(F.lit("Q"), "c_custkey")).alias("qid"), F.when(k % 2 == 0, k.cast("string")).otherwise("").alias("gnid"), _k("c_name").alias("title"), F.lit(None).cast("string").alias("description"), _k("c_mktsegment").alias("kind"), (k % 4 == 0).alias("gone"), F.when(k % 3 == 0, F.array(F.lit("QA"), F.lit("QB"))).alias("parents"))
    sizes = table("customer").select(_k("c_mktsegment").alias("kind")).filter("kind <> 'MACHINERY'").distinct().withColumn("rank", F.length("kind")).withColumn("label", F.initcap("kind"))
    return places.settlements(towns, sizes)


_TOWN = "FROM customer WHERE c_custkey % 10 <> 9"
_SIZE = "CASE WHEN c_mktsegment <> 'MACHINERY' THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END"


@query(f"""WITH r AS (SELECT DISTINCT 'N' || c_nationkey AS scope, length(c_mktsegment) AS r, '' AS k, {_SIZE} AS code, {_SIZE} AS title, NULL AS is_a, NULL AS meaning, NULL AS status {_TOWN} AND c_mktsegment <> 'MACHINERY'
UNION ALL SELECT 'N' || c_nationkey, 2147483647, lower(c_name), 'Q' || c_custkey, c_name, {_SIZE}, 'wd:Q' || c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'historical' END {_TOWN})
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY r, k, code) AS position, code, title, NULL AS description, is_a, meaning, NULL AS alias, status FROM r""")
def place_settlements(table, spark):
    """Settlements under headers of their sizes."""
    return _towns(table)[0]


@query(f"""SELECT 'N' || c_nationkey AS scope, 'wd:Q' || c_custkey AS subject_id, 'skos:exactMatch' AS predicate_id, 'gnf:' || c_custkey AS object_id, {_MAP}, c_name AS subject_label, '' AS object_label {_TOWN} AND c_custkey % 2 = 0
UNION ALL SELECT 'N' || c_nationkey, 'wd:Q' || c_custkey, 'skos:broader', 'wd:' || c_mktsegment, {_MAP}, c_name, {_SIZE} {_TOWN} AND c_mktsegment <> 'MACHINERY'
UNION ALL SELECT 'N' || c_nationkey, 'wd:Q' || c_custkey, 'skos:broader', 'wd:' || p, {_MAP}, c_name, '' FROM customer, (VALUES ('QA'), ('QB')) AS v(p) WHERE c_custkey % 10 <> 9 AND c_custkey % 3 = 0""")
def settlement_mappings(table, spark):
    """Their mappings to the gazetteer, to sizes and to what they are part of."""
    return _towns(table)[1]


@query("""WITH s AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT DISTINCT p_brand, p_size FROM part) d),
c AS (SELECT p_brand, string_agg('<mxCell id="s' || i || '" value="&lt;b>Size ' || p_size || '&lt;/b>&lt;br/>A&lt;br/>B &amp;amp; C" style="rounded=1;whiteSpace=wrap;html=1;" parent="1" vertex="1"><mxGeometry x="' || CAST(floor(717 + 400 * cos(2 * pi() * i / n - pi() / 2)) AS BIGINT) || '" y="' || CAST(floor(519 + 400 * sin(2 * pi() * i / n - pi() / 2)) AS BIGINT) || '" width="220" height="130" as="geometry"/></mxCell><mxCell id="e' || i || '" parent="1" source="c" target="s' || i || '" edge="1"><mxGeometry relative="1" as="geometry"/></mxCell>', '' ORDER BY i) AS cells FROM s GROUP BY 1)
SELECT p_brand AS url, '<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>' || cells || '<mxCell id="c" value="Record" style="ellipse;whiteSpace=wrap;html=1;" parent="1" vertex="1"><mxGeometry x="730" y="529" width="193" height="110" as="geometry"/></mxCell></root></mxGraphModel>' AS xml FROM c""")
def registry_diagram(table, spark):
    """Diagrams of the sections of registries."""
    sections = table("part").select(_k("p_brand").alias("url"), _k("p_size").alias("ord")).distinct()
    return sinks.diagram(sections.select("url", "ord", F.concat(F.lit("Size "), "ord", F.lit(" (all)")).alias("section"), F.array(F.lit("A"), F.lit("B &amp; C")).alias("names")), "Record")


_ADDRESSES = [
    "AGROVOC_c_", "http://snomed.info/id/", "http://purl.obolibrary.org/obo/ENVO_0000", "ENVO:0000", "https://www.nrcs.usda.gov/a/NASIS%207.4.pdf", "https://www.fao.org/docs/CXS_192e.pdf", "https://www.wikidata.org/wiki/Q207810",
    "https://zenodo.org/records/1/files/CRediT.pdf", "https://sis.agr.gc.ca/cansis/glossary/", "https://www.statcan.gc.ca/en/search?datatype=classification", "ISO_COUNTRY_CA", "https://www.iso.org/obp/ui/en/#iso:code:3166:CA",
    "GeoNames_ADM1_CA", "https://download.geonames.org/export/dump/admin2Codes.txt", "GeoNames_ADM3ADM4_CA", "GeoNames_countries", "GeoWiki_ADM1_CA", "https://x.org/tdwg_dwc_simple.xsd", "https://www.nrcs.usda.gov/book.pdf",
    "https://sis.agr.gc.ca/cansis/nsdb/slc/index.html", "https://sis.agr.gc.ca/cansis/taxa/cssc3/index.html", "https://terminology.hl7.org/CodeSystem-x.html", "https://terminology.hl7.org/codesystems.html", "https://www23.statcan.gc.ca/imdb/p3VD.pl?Function=getVD&x=1",
    "https://x.org/a.ttl", "https://x.org/a.sssom.tsv?x", "https://x.org/a.yaml", "https://x.org/a",
]
_HEADS = ["", '{"resourceType": "ValueSet"}', "<rdf:RDF>", "<html><table class='codes'>", "Level,Code", ",title,description", "<HTML>"]
_SQL_RULES = " ".join("WHEN regexp_matches({}, '{}') THEN '{}'".format(where, pattern.replace("'", "''"), kind) for where, pattern, kind in readers.DETECT)


@query(f"""SELECT p_partkey, CASE {_SQL_RULES} ELSE 'FreeText' END AS content_type FROM (SELECT p_partkey, ({_ADDRESSES!r})[p_partkey % {len(_ADDRESSES)} + 1] || CASE WHEN p_partkey % {len(_ADDRESSES)} < 4 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS url, [{", ".join(f"'{h.replace(chr(39), chr(39) * 2)}'" for h in _HEADS)}][p_size % {len(_HEADS)} + 1] AS head FROM part) x""")
def source_detection(table, spark):
    """Content types of addresses and heads by the whole chain of rules."""
    at = _k("p_partkey") % len(_ADDRESSES)
    url = F.concat(F.get(F.array(*map(F.lit, _ADDRESSES)), at.cast("int")), F.when(at < 4, _k("p_partkey").cast("string")).otherwise(""))
    head = F.get(F.array(*map(F.lit, _HEADS)), (_k("p_size") % len(_HEADS)).cast("int"))
    return table("part").select("p_partkey", readers.content_type(url, head).alias("content_type"))


def _site(urls: list[str]) -> list[str | None]:
    """A made-up site: /en/N.html links to /en/N0.html to /en/N4.html, to itself, to its start and to another site; numbers of three digits are missing."""
    out: list[str | None] = []
    for u in urls:
        number = u.rsplit("/", 1)[1].removesuffix(".html")
        own = "".join(f'<a class="x" href="{number}{i}.html#part">{i}</a>' for i in range(5))
        out.append(None if len(number) > 2 else f'<p>{number}</p>{own}<a href="#top">top</a><a href="/en/{number}.html">self</a><a href="http://other/1.html">no</a><a href="mailto:x">mail</a>')
    return out


@query("""WITH s AS (SELECT DISTINCT CAST(1 + n_regionkey AS VARCHAR) AS n FROM nation), d AS (SELECT CAST(i AS VARCHAR) AS i FROM range(5) t(i)),
p AS (SELECT n, 0 AS level FROM s UNION ALL SELECT n || i, 1 FROM s, d UNION ALL SELECT n || d.i || e.i, 2 FROM s, d, d AS e)
SELECT 'http://h/' || lang || '/' || n || '.html' AS url, 'h_' || lang || '_' || n || '.html-' || substring(sha256('http://h/' || lang || '/' || n || '.html'), 1, 16) || '.html' AS entry, level, level < 2 AS found FROM p, (VALUES ('en'), ('fr')) AS v(lang)""")
def crawl_pages(table, spark):
    """Pages of a site in two languages, two levels below the seeds, with the names of those that were found."""
    seeds = table("nation").select(F.concat(F.lit("http://h/en/"), (_k("n_regionkey") + 1).cast("string"), F.lit(".html")).alias("url"))
    pages = crawl.crawled(seeds, _site, "^http://h/en/", other=lambda u: F.replace(u, F.lit("/en/"), F.lit("/fr/")))
    names = crawl.manifest(pages.withColumn("content", F.coalesce("content", F.lit(""))))
    return pages.join(names, "url").select("url", "entry", "level", _k("content").isNotNull().alias("found"))
