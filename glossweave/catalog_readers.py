"""Registered queries of the readers: documents of each format are made of the tables, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalog import query
from .operators import walks
from .sources import formats, readers


def _nations(table) -> DataFrame:
    return table("nation").join(F.broadcast(table("region")), F.col("n_regionkey") == F.col("r_regionkey"))


def _listed(df: DataFrame, by: list, order: str, item, sep: str = "") -> DataFrame:
    """The texts of a group's rows, in order, as one."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, item.alias("x")))), lambda r: r["x"]), sep).alias("items"))


def _parts(table, item, sep: str = "") -> DataFrame:
    """(url, items): one document for each brand."""
    return _listed(table("part"), [F.col("p_brand").alias("url")], "p_partkey", item, sep)


_k = F.col


@query("""SELECT r_name AS url, 'R' || r_regionkey AS code, r_name AS title, NULL AS description, NULL AS is_a, 1 AS level FROM region
UNION ALL SELECT r_name, 'N' || n_nationkey, n_name, 'in ' || r_name, 'R' || r_regionkey, 2 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def fhir_code_system(table, spark):
    """Nested concepts of code systems."""
    kids = _nations(table).groupBy("r_name", "r_regionkey").agg(F.collect_list(F.struct(F.concat(F.lit("N"), "n_nationkey").alias("code"), _k("n_name").alias("display"), F.concat(F.lit("in "), "r_name").alias("definition"))).alias("concept"))
    top = F.struct(F.concat(F.lit("R"), "r_regionkey").alias("code"), _k("r_name").alias("display"), "concept")
    return readers.code_system(kids.select(_k("r_name").alias("url"), F.to_json(F.struct(F.lit("CodeSystem").alias("resourceType"), F.array(top).alias("concept"))).alias("content")))


@query("SELECT p_brand AS url, 'P' || p_partkey AS code, p_name AS title FROM part")
def fhir_value_set(table, spark):
    """Concepts of value sets."""
    g = table("part").groupBy("p_brand", (_k("p_size") % 2).alias("i")).agg(F.collect_list(F.struct(F.concat(F.lit("P"), "p_partkey").alias("code"), _k("p_name").alias("display"))).alias("concept"))
    sets = g.groupBy(_k("p_brand").alias("url")).agg(F.collect_list(F.struct("concept")).alias("include"))
    return readers.value_set(sets.select("url", F.to_json(F.struct(F.struct("include").alias("compose"))).alias("content")))


@query("""SELECT p_brand AS url, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ord, u.n AS name, CASE u.n WHEN 'item' THEN 'P' || p_partkey ELSE p_name END AS value, CASE u.n WHEN 'item' THEN NULL ELSE 'en' END AS lang FROM part, unnest(['item', 'label']) AS u(n)""".replace("row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1", "dense_rank() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1"))
def sparql_rows(table, spark):
    """Variables of SPARQL results."""
    item = F.concat(F.lit('{"item":{"value":"P'), "p_partkey", F.lit('"},"label":{"xml:lang":"en","value":"'), "p_name", F.lit('"}}'))
    docs = _parts(table, item, ",").select("url", F.concat(F.lit('{"results":{"bindings":['), "items", F.lit("]}}")).alias("content"))
    return readers.sparql_bindings(docs)


_ROW = "CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER)"


@query(f"SELECT p_brand AS url, 0 AS grid, {_ROW} AS line, 'C' || p_partkey AS code, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size END AS description, CASE WHEN p_size % 3 = 0 THEN 'ACTIVE' ELSE 'RETIRED' END AS status, 1 + p_size % 4 AS level FROM part")
def html_code_table(table, spark):
    """Tables of codes of HTML pages."""
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), td(F.concat(F.lit("C"), "p_partkey")), td(_k("p_name")), F.when(_k("p_size") % 2 == 0, td(F.concat(F.lit("size "), "p_size"))).otherwise("<td/>"), td(F.when(_k("p_size") % 3 == 0, "active").otherwise("retired")), td((F.lit(1) + _k("p_size") % 4).cast("string")), F.lit("</tr>"))
    docs = _parts(table, row).select("url", F.concat(F.lit("<html><table class=codes><tr><th>Code</th><th>Display</th><th>Definition</th><th>Status</th><th>Level</th></tr>"), "items", F.lit("</table></html>")).alias("content"))
    return readers.code_table(docs)


@query("SELECT p_brand AS url, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ord, 1 + p_size % 3 AS level, 'C' || p_partkey AS code, p_name AS title FROM part")
def html_indented_list(table, spark):
    """Codes and levels of indented lists."""
    item = F.concat(F.lit('<li class="list-group-item indent-'), F.lit(1) + _k("p_size") % 3, F.lit('"><a href="x">C'), "p_partkey", F.lit(" - "), "p_name", F.lit("</a>"))
    return readers.indented_list(_parts(table, item).select("url", F.concat(F.lit("<ul>"), "items", F.lit("</ul>")).alias("content")))


@query("""WITH d AS (SELECT p_brand AS url, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS ord, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS title, p_name AS description FROM part)
SELECT url, ord, title, description FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY url, ord) AS n FROM d) x WHERE n = 1""")
def html_definitions(table, spark):
    """Terms and definitions, the first of titles that differ in case."""
    item = F.concat(F.lit("<dt><b>"), F.when(_k("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")), F.lit("</b></dt><dd>"), "p_name", F.lit("</dd>\n"))
    return readers.definition_list(_parts(table, item).select("url", F.concat(F.lit("<dl>"), "items", F.lit("</dl>")).alias("content")))


@query("SELECT r_name AS url, lower(n_name) AS prefix, 'http://n/' || n_nationkey AS uri FROM nation JOIN region ON n_regionkey = r_regionkey")
def owl_prefixes(table, spark):
    """Namespaces that ontologies declare."""
    docs = _listed(_nations(table), [_k("r_name").alias("url")], "n_nationkey", F.concat(F.lit(" xmlns:"), F.lower("n_name"), F.lit('="http://n/'), "n_nationkey", F.lit('"')))
    return readers.xml_prefixes(docs.select("url", F.concat(F.lit('<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#"'), "items", F.lit("></rdf:RDF>")).alias("content")))


@query(f"""SELECT p_brand AS url, {_ROW} - 1 AS ord, 'x:' || p_partkey AS subject_id, 'skos:exactMatch' AS predicate_id, CASE WHEN p_size % 5 > 0 THEN 'y:' || p_size END AS object_id, CASE WHEN p_size % 5 > 0 THEN 'semapv:Manual' END AS mapping_justification, CASE WHEN p_size % 5 > 0 THEN p_name END AS subject_label, NULL AS object_label FROM part""")
def sssom_rows(table, spark):
    """Mapping rows of SSSOM files, short lines included."""
    line = F.concat(F.lit("x:"), "p_partkey", F.lit("\tskos:exactMatch"), F.when(_k("p_size") % 5 > 0, F.concat(F.lit("\ty:"), "p_size", F.lit("\tsemapv:Manual\t"), "p_name")).otherwise(""))
    head = "#curie_map:\n#  x: http://x/\nsubject_id\tpredicate_id\tobject_id\tmapping_justification\tsubject_label\n"
    return readers.sssom(_parts(table, line, "\n").select("url", F.concat(F.lit(head), "items").alias("content")))


@query("""SELECT p_brand AS url, CAST(3 * row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 2 AS INTEGER) AS ord, 'Section ' || p_partkey AS section, p_name AS line FROM part""")
def text_sections(table, spark):
    """Lines under their headings."""
    return readers.sections(_parts(table, F.concat(F.lit("Section "), "p_partkey", F.lit("\n"), "p_name", F.lit("\n")), "\n").select("url", _k("items").alias("content")), "^Section [0-9]+$")


@query("""SELECT 'g' AS grp, 'W' AS code, NULL AS parent, 0 AS position, 0 AS depth
UNION ALL SELECT 'g', 'R' || r_regionkey, 'W', CAST(1 + 6 * (row_number() OVER (ORDER BY 'R' || r_regionkey) - 1) AS INTEGER), 1 FROM region
UNION ALL SELECT 'g', 'N' || n_nationkey, 'R' || n_regionkey, CAST(1 + 6 * n_regionkey + row_number() OVER (PARTITION BY n_regionkey ORDER BY 'N' || n_nationkey) AS INTEGER), 2 FROM nation""")
def dfs_order(table, spark):
    """A tree in depth-first order."""
    n = table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    r = table("region").select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit("W").alias("parent"))
    return walks.depth_first(n.union(r).select(F.lit("g").alias("grp"), "child", "parent"))


@query("""WITH n AS (SELECT 'N' || n_nationkey AS code, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN 'minus' WHEN n_nationkey % 3 = 0 THEN 'include' END AS mark FROM nation)
SELECT 'g' AS grp, 'W' AS code, NULL AS is_a UNION ALL SELECT 'g', 'R' || r_regionkey, 'W' FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT 'g', code, CASE WHEN n_regionkey % 2 = 0 THEN 'R' || n_regionkey ELSE 'W' END FROM n WHERE CASE mark WHEN 'minus' THEN FALSE WHEN 'include' THEN TRUE ELSE n_regionkey % 2 = 0 END""")
def subtree_filter(table, spark):
    """Subtrees left out and taken in again."""
    n, r = table("nation"), table("region")
    k = _k("n_nationkey")
    nodes = n.select(F.concat(F.lit("N"), k).alias("code"), F.when(k % 4 == 0, "minus").when(k % 3 == 0, "include").alias("mark"))
    nodes = nodes.union(r.select(F.concat(F.lit("R"), "r_regionkey"), F.when(_k("r_regionkey") % 2 == 1, "minus"))).union(spark.createDataFrame([("W", None)], "code string, mark string"))
    edges = n.select(F.concat(F.lit("N"), k).alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent")).union(r.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("W")))
    return walks.subtree_filter(nodes.withColumn("grp", F.lit("g")), edges.withColumn("grp", F.lit("g")))


# further formats


@query(f"""WITH b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand AS url, 0 AS ord, NULL AS code, 'List ' || p_brand AS title_en, 'all, of ' || p_brand AS description_en, 'Liste ' || p_brand AS title_fr, NULL AS description_fr, 'http://s/' || p_brand AS source FROM b
UNION ALL SELECT p_brand, {_ROW}, 'c' || p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_type END, 'fr ' || p_partkey, NULL, NULL FROM part""")
def picklist_csv(table, spark):
    """Picklist tables with their metadata."""
    row = F.concat(F.lit("c"), "p_partkey", F.lit(","), "p_name", F.lit(","), F.when(_k("p_size") % 2 == 0, _k("p_type")).otherwise(""), F.lit(",fr "), "p_partkey")
    b = _k("url")
    head = F.concat(F.lit(",title,description,keywords,source\ngeneral,,,,http://s/"), b, F.lit("\nen,List "), b, F.lit(",all, of "), b, F.lit(",,\nfr,Liste "), b, F.lit(",,,\n,,,,\n,,,,\nkey,Class_en,Description_en,Class_fr\n"))
    return formats.picklist_csv(_parts(table, row, "\n").select("url", F.concat(head, "items").alias("content")))


_GRAPH = "SELECT DISTINCT 'C' || o_custkey AS iri, 'Customer ' || o_custkey AS label, o_custkey % 7 = 0 AS deprecated FROM orders"


def _graphs(table) -> DataFrame:
    o = table("orders")
    node = lambda letter, name: F.struct(F.concat(F.lit(letter), "o_custkey").alias("iri"), F.concat(F.lit(name), "o_custkey").alias("label"), (_k("o_custkey") % 7 == 0).alias("deprecated"))
    edge = F.struct(F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("S"), "o_orderstatus").alias("target"), F.lit("is a").alias("label"))
    g = o.groupBy(_k("o_orderpriority").alias("url")).agg(F.collect_list(node("C", "Customer ")).alias("nodes"), F.collect_list(edge).alias("edges"))
    return g.select("url", F.to_json(F.struct("nodes", "edges")).alias("content"))


@query(_GRAPH)
def graph_nodes(table, spark):
    """Nodes of term graphs, once each."""
    return formats.term_graph(_graphs(table))[0]


@query("SELECT DISTINCT 'C' || o_custkey AS source, 'S' || o_orderstatus AS target, 'is a' AS label FROM orders")
def graph_edges(table, spark):
    """Edges of term graphs, once each."""
    return formats.term_graph(_graphs(table))[1]


@query("SELECT DISTINCT 'http://c/' || o_custkey AS source, 'http://s/' || o_orderstatus AS target, 'subClassOf' AS label FROM orders UNION SELECT DISTINCT 'http://c/' || o_custkey, 'http://p/' || o_orderpriority, 'subClassOf' FROM orders")
def descendant_edges(table, spark):
    """Parents of paged descendants as edges."""
    item = F.concat(F.lit('{"@id":"http://c/'), "o_custkey", F.lit('","prefLabel":"x","parents":[{"@id":"http://s/'), "o_orderstatus", F.lit('"},{"@id":"http://p/'), "o_orderpriority", F.lit('"}]}'))
    pages = _listed(table("orders"), [(_k("o_orderkey") % 50).alias("url")], "o_orderkey", item, ",")
    return formats.descendants(pages.select("url", F.concat(F.lit('{"collection":['), "items", F.lit("]}")).alias("content")))[1]


@query("""SELECT p_brand AS url, 'QA' AS context, 'QA' || p_partkey || '-' || (p_partkey + 5) AS code, p_type AS title, CASE WHEN p_size % 2 = 0 THEN 'including ' || p_name || ' and more' END AS description FROM part
UNION ALL SELECT DISTINCT p_brand, NULL, u.c, 'SCIENCE', NULL FROM part, unnest(['Q', 'S']) AS u(c) UNION ALL SELECT DISTINCT p_brand, 'Q', 'QA', 'Mathematics', NULL FROM part""")
def outline_text(table, spark):
    """Entries, classes and descriptions of outlines."""
    entry = F.concat(F.lit("QA"), "p_partkey", F.lit("-("), _k("p_partkey") + 5, F.lit(")   "), "p_type", F.lit("\n"), F.when(_k("p_size") % 2 == 0, F.concat(F.lit("  including "), "p_name", F.lit("\n\n and more\n"))).otherwise(""))
    return formats.outline(_parts(table, entry).select("url", F.concat(F.lit("LIBRARY OF CONGRESS\nCLASS Q-S - SCIENCE\nSubclass QA Mathematics\nSubclass QA\n"), "items").alias("content")))


@query("""SELECT p_brand AS url, lpad(CAST(p_partkey % 90 + 1 AS VARCHAR), 2, '0') || '.' || p_partkey AS code, p_type || CASE WHEN p_size % 2 = 0 THEN ' and more of it' ELSE '' END AS title FROM part""")
def numbered_categories(table, spark):
    """Titles of dotted codes that go on in the next line."""
    code = F.concat(F.lpad((_k("p_partkey") % 90 + 1).cast("string"), 2, "0"), F.lit("."), "p_partkey")
    row = F.concat(code, F.lit("   "), "p_type", F.lit("\n"), F.when(_k("p_size") % 2 == 0, "  and more of it\n").otherwise(""), F.when(_k("p_size") % 3 == 0, "===PAGE 7===\n12\n\n3 See the note\n").otherwise(""))
    return formats.numbered_categories(_parts(table, row).select("url", F.concat(F.lit("Contents\nPART II: later\n"), "items", F.lit("PART II\n01.1 not this\n")).alias("content")))


@query("""SELECT p_brand AS url, u.i AS ord, u.c AS code, u.t AS title, CASE u.i WHEN 2 THEN NULL ELSE 'about ' || p_brand || ' no ' || u.i END AS description FROM (SELECT DISTINCT p_brand FROM part) p, (VALUES (0, 'writing', 'Writing'), (1, 'writing_review_editing', 'Writing – review & editing'), (2, 'software', 'Software')) AS u(i, c, t)""")
def role_texts(table, spark):
    """What follows names in a text."""
    b = _k("p_brand")
    docs = table("part").select(b.alias("url")).distinct()
    about = lambda i: F.concat(F.lit(" about "), "url", F.lit(f" no {i}. § task one\n§ task two "))
    text = F.concat(F.lit("Roles\n"), F.lit("Writing"), about(0), F.lit("Writing – review & editing"), about(1), F.lit("Software § only a task"))
    return formats.split_at_names(docs.select("url", text.alias("content")), ["Writing", "Software", "Writing – review & editing"])


@query(f"""SELECT p_brand AS url, {_ROW} + 1 AS ord, 'Sec' AS section, CASE WHEN p_size % 2 = 0 THEN 'dc:partName' || p_partkey ELSE 'partName' || p_partkey END AS name, CASE WHEN p_size % 2 = 0 THEN 'dc' ELSE 'dwc' END AS namespace, 'partName' || p_partkey AS local_name, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE 'part_name' || p_partkey END AS slot,
CASE WHEN p_size % 5 = 0 THEN 'integer' ELSE 'string' END AS data_type, CASE WHEN p_size % 7 = 0 THEN ['A', 'B'] END AS enums, p_type AS description, NULL AS comments FROM part
UNION ALL SELECT DISTINCT p_brand, 1, 'Sec', NULL, NULL, NULL, NULL, NULL, NULL, 'the section', NULL FROM part""")
def field_registry(table, spark):
    """Fields and sections of registries."""
    n = _k("p_size")
    line = F.concat(F.lit("Sec\t"), F.when(n % 2 == 0, "dc:").otherwise(""), F.lit("partName"), "p_partkey", F.lit("\t"), F.when(n % 3 == 0, "own").otherwise("-"), F.lit("\t"), F.when(n % 5 == 0, "integer").otherwise("-"), F.lit("\t"), F.when(n % 7 == 0, "A, -, B,").otherwise("-"), F.lit("\t"), "p_type")
    return formats.field_registry(_parts(table, line, "\n").select("url", F.concat(F.lit("# comment\nSec\t\t\t-\t-\tthe section\t-\n"), "items").alias("content")))


def _terms_xml(table) -> DataFrame:
    row = F.concat(F.lit('<property name="x" qualName="http://t/'), _k("p_partkey") % 500, F.lit('" label="'), "p_name", F.lit('" dc:description="&lt;'), "p_type", F.lit('&gt;"><translation xml:lang="fr" label="fr '), "p_partkey", F.lit('"/></property>\n'))
    return _parts(table, row).select("url", F.concat(F.lit("<extension>"), "items", F.lit("</extension>")).alias("content"))


_FIRST_TERMS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_brand, p_partkey) AS n FROM part) x WHERE n = 1"


@query(f"SELECT 'http://t/' || (p_partkey % 500) AS name, p_name AS label, '<' || p_type || '&gt;' AS description FROM ({_FIRST_TERMS}) y")
def xml_terms(table, spark):
    """Terms of XML property lists, the first of a name."""
    return formats.xml_terms(_terms_xml(table))[0]


@query(f"SELECT 'http://t/' || (p_partkey % 500) AS name, 'fr' AS lang, 'fr ' || p_partkey AS label, NULL AS description FROM ({_FIRST_TERMS}) y")
def xml_translations(table, spark):
    """Their translations."""
    return formats.xml_terms(_terms_xml(table))[1]


@query("""SELECT p_brand AS url, arg_min('f' || p_partkey || '.PDF', p_partkey) FILTER (WHERE p_size % 9 = 0) AS name, arg_min('http://f/' || p_partkey, p_partkey) FILTER (WHERE p_size % 9 = 0) AS link FROM part GROUP BY 1""")
def record_file(table, spark):
    """The first file of a record by its suffix."""
    item = F.concat(F.lit('{"key":"f'), "p_partkey", F.when(_k("p_size") % 9 == 0, ".PDF").otherwise(".csv"), F.lit('","links":{"self":"http://f/'), "p_partkey", F.lit('"}}'))
    return formats.record_file(_parts(table, item, ",").select("url", F.concat(F.lit('{"files":['), "items", F.lit("]}")).alias("content")), "pdf")


@query(f"""WITH x AS (SELECT p_brand, p_partkey, p_type, p_size, {_ROW} AS line, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand AS url, 1 AS grid, line, 'C' || p_partkey AS code, p_type AS class, 'of ' || p_size AS description FROM x WHERE n + 1 > 2""")
def attribute_pages(table, spark):
    """Code tables of attribute pages."""
    row = F.concat(F.lit("<tr><td>C"), "p_partkey", F.lit("</td><td>"), "p_type", F.lit("</td><td>of "), "p_size", F.lit("</td></tr>"))
    head = "<table><tr><td>Label</td><td>x</td></tr></table><table><tr><th>Code</th><th>Class</th><th>Description</th></tr>"
    return formats.attribute_pages(_parts(table, row).select("url", F.concat(F.lit(head), "items", F.lit("</table>")).alias("content")))


@query(f"SELECT p_brand AS url, {_ROW} AS line, p_name || ' ' || p_partkey AS name, 'v' || p_size AS version, 'ACTIVE' AS status, p_type AS description FROM part")
def listing_pages(table, spark):
    """The table of a listing page that names things."""
    row = F.concat(F.lit("<tr><td><a>"), "p_name", F.lit(" "), "p_partkey", F.lit("</a></td><td>v"), "p_size", F.lit("</td><td>active</td><td>"), "p_type", F.lit("</td></tr>"))
    head = "<table><tr><th>Other</th></tr><tr><td>no</td></tr></table><table><tr><th>Name</th><th>Version</th><th>Status</th><th>Description</th></tr>"
    return formats.listing(_parts(table, row).select("url", F.concat(F.lit(head), "items", F.lit("</table>")).alias("content")))


@query("SELECT p_brand AS url, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS subject, 'Classification' AS type, '/en/view?id=' || p_partkey AS href FROM part")
def link_tables(table, spark):
    """Rows of link tables with the ids of their links."""
    row = F.concat(F.lit('<tr><td><a href="/en/view?id='), "p_partkey", F.lit('">'), "p_name", F.lit("</a></td><td>"), "p_type", F.lit("</td><td>Classification</td></tr>"))
    return formats.link_table(_parts(table, row).select("url", F.concat(F.lit("<table>"), "items", F.lit("</table>")).alias("content")))


@query("SELECT CAST(100 + p_size AS VARCHAR) || 'B' AS code, min(p_name) AS label, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS uses FROM part GROUP BY 1")
def additive_codes(table, spark):
    """Codes of several rows as one, with their uses."""
    code = F.concat(F.when(_k("p_partkey") % 2 == 0, "E ").otherwise("e"), (_k("p_size") + 100).cast("string"), F.lit("b"))
    return formats.additive_codes(table("part").select(code.alias("code"), _k("p_name").alias("label"), _k("p_type").alias("use")))
