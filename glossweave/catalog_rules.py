"""Registered queries of merge rules, reports, ranked search and text functions, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .catalog import SEARCHES, _mappings, _MAPPINGS, _SQL_QUERIES, _sql_tokens, _terms, query
from .functions import text as t
from .operators import reports, rules, search

# Enums of five sources with every branch of the filters: parts' types are enums, their brands domains.
_PART_ENUMS = """SELECT DISTINCT 'src' || (length(p_type) % 5) AS source_key, p_type AS enum_key, CASE WHEN length(p_type) % 2 = 0 THEN split_part(p_type, ' ', 1) END AS source_domain,
CASE WHEN length(p_type) % 3 = 0 THEN split_part(p_type, ' ', 2) END AS source_schema, CASE WHEN length(p_type) % 4 = 0 THEN 'Draft' END AS status FROM part"""
_SOURCES = [("src0", "OWL", "f0", False), ("src1", "OntologyAPI", "f1", True), ("src2", "LinkML", "f2", True), ("src3", None, "f3", False), ("src4", "GeoNamesSettlement", "f4", None)]
_MINUS = [("src0", "STANDARD"), ("src1", "PROMO"), ("src1", "draft"), ("src3", "TIN"), ("src3", "ECONOMY BRASS"), ("src4", "done")]
_INCLUDE = [("src0", "PROMO"), ("src2", "STANDARD"), ("src2", "BRASS"), ("src3", "TIN")]


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS v({names})"


_SQL_LISTS = f"""s AS ({_values(_SOURCES, "source_key, content_type, path, concise")}), m AS ({_values(_MINUS, "source_key, name")}), i AS ({_values(_INCLUDE, "source_key, name")}),
m2 AS (SELECT m.* FROM m JOIN s USING (source_key) WHERE content_type IS DISTINCT FROM 'OWL'), i2 AS (SELECT i.* FROM i JOIN s USING (source_key) WHERE content_type IS DISTINCT FROM 'OWL'), e AS ({_PART_ENUMS}),
x AS (SELECT e.source_key, enum_key, source_domain, source_schema, upper(status) AS status,
  EXISTS (SELECT 1 FROM m2 WHERE m2.source_key = e.source_key AND m2.name IN (enum_key, coalesce(source_domain, enum_key), coalesce(source_schema, enum_key)))
  OR (e.source_key IN (SELECT source_key FROM i2) AND e.source_key NOT IN (SELECT source_key FROM m2) AND NOT EXISTS (SELECT 1 FROM i2 WHERE i2.source_key = e.source_key AND i2.name IN (enum_key, coalesce(source_domain, enum_key), coalesce(source_schema, enum_key)))) AS excluded FROM e)"""


def _lists(table, spark) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p, n = table("part").select("p_type").distinct(), F.length("p_type")
    word = lambda i: F.split_part("p_type", F.lit(" "), F.lit(i))
    enums = p.select(F.concat(F.lit("src"), n % 5).alias("source_key"), F.col("p_type").alias("enum_key"), F.when(n % 2 == 0, word(1)).alias("source_domain"), F.when(n % 3 == 0, word(2)).alias("source_schema"), F.when(n % 4 == 0, "Draft").alias("status"))
    return enums, spark.createDataFrame(_SOURCES, "source_key string, content_type string, path string, concise boolean"), spark.createDataFrame(_MINUS, "source_key string, name string"), spark.createDataFrame(_INCLUDE, "source_key string, name string")


@query(f"WITH {_SQL_LISTS} SELECT * FROM x")
def enum_in_minus(table, spark):
    """Enums listed by key or annotation; lists of OWL sources are ignored; the status in capitals."""
    return rules.concept_filter(*_lists(table, spark))


@query(f"""WITH {_SQL_LISTS}, old AS (SELECT DISTINCT p_type AS enum_key, 'f' || (p_size % 5) AS source_file FROM part)
SELECT old.enum_key FROM old WHERE (enum_key, source_file) IN (SELECT enum_key, path FROM x JOIN s USING (source_key) WHERE excluded)""")
def stale_enums(table, spark):
    """Enums of the schema that their source now excludes."""
    lists = _lists(table, spark)
    old = table("part").select(F.col("p_type").alias("enum_key"), F.concat(F.lit("f"), F.col("p_size") % 5).alias("source_file")).distinct()
    return rules.stale(old, rules.concept_filter(*lists).filter("excluded"), lists[1])


_PVS = "SELECT 'src' || (p_partkey % 5) AS source_key, p_type AS enum_key, 'c' || p_partkey AS code, CASE p_size % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'done' WHEN 2 THEN 'obsolete' END AS status FROM part"


@query(f"""WITH s AS ({_values(_SOURCES, "source_key, content_type, path, concise")}), m AS ({_values(_MINUS, "source_key, name")}), p AS ({_PVS})
SELECT p.* FROM p JOIN s USING (source_key) WHERE NOT (coalesce(content_type IN ('OWL', 'OntologyAPI', 'GeoNamesSettlement', 'GeoWikiSettlement'), FALSE) AND EXISTS (SELECT 1 FROM m WHERE m.source_key = p.source_key AND m.name = p.status)) AND NOT (coalesce(concise, FALSE) AND coalesce(status, '') = 'obsolete')""")
def status_content_type(table, spark):
    """Values by status, for the content types that have one; obsolete ones go where the source is concise."""
    _, sources, minus, _ = _lists(table, spark)
    status = F.when(F.col("p_size") % 4 == 0, "draft").when(F.col("p_size") % 4 == 1, "done").when(F.col("p_size") % 4 == 2, "obsolete")
    return rules.status_filter(table("part").select(F.concat(F.lit("src"), F.col("p_partkey") % 5).alias("source_key"), F.col("p_type").alias("enum_key"), F.concat(F.lit("c"), "p_partkey").alias("code"), status.alias("status")), sources, minus)


@query("SELECT n_name AS source_key, 'f' || n_nationkey AS path FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def missing_artefacts(table, spark):
    """Sources of which no output exists."""
    made = table("supplier").filter("s_acctbal > 0").select(F.concat(F.lit("f"), "s_nationkey").alias("path"))
    return rules.missing(table("nation").select(F.col("n_name").alias("source_key"), F.concat(F.lit("f"), "n_nationkey").alias("path")), made)


@query("""SELECT source AS enum_key, CAST(doc_id AS VARCHAR) AS code, lang, text AS title FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AND lang <> 'en'""")
def locale_survivors(table, spark):
    """Locale rows of the values that the filters leave."""
    d = table("documents")
    left = d.join(table("labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.col("source").alias("enum_key"), F.col("doc_id").cast("string").alias("code"))
    return rules.surviving_locale(d.filter("lang != 'en'").select(F.col("source").alias("enum_key"), F.col("doc_id").cast("string").alias("code"), "lang", F.col("text").alias("title")), left)


_PREDICATES = ["skos:exactMatch", "skos:broadMatch", "skos:broader"]


@query(f"""WITH m AS ({_MAPPINGS}), v AS (SELECT 'p' AS source_key, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 2 = 0 THEN (SELECT max(subject_id) FROM m) ELSE 'none' END AS meaning FROM part),
g AS (SELECT subject_id, {", ".join(f"coalesce(array_to_string(list(object_id ORDER BY ord, object_id) FILTER (WHERE predicate_id = '{p}'), ','), '') AS {p.rpartition(':')[2]}" for p in _PREDICATES)} FROM m GROUP BY subject_id)
SELECT v.source_key, v.code, v.meaning, {", ".join(p.rpartition(":")[2] for p in _PREDICATES)} FROM v LEFT JOIN g ON g.subject_id = v.meaning""")
def sssom_on_values(table, spark):
    """Mappings put on the values whose meaning they are about."""
    m = _mappings(table)
    top = m.agg(F.max("subject_id").alias("top"))
    v = table("part").crossJoin(F.broadcast(top)).select(F.lit("p").alias("source_key"), F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.col("top")).otherwise("none").alias("meaning"))
    return rules.mapped(v, m, _PREDICATES).select("source_key", "code", "meaning", *(p.rpartition(":")[2] for p in _PREDICATES))


@query(f"""WITH m AS ({_MAPPINGS}), v AS (SELECT DISTINCT subject_id AS meaning, substr(subject_id, 1, 2) AS source_key FROM m) SELECT source_key, predicate_id, count(*) AS n FROM v JOIN m ON subject_id = meaning GROUP BY 1, 2""")
def mapping_counts(table, spark):
    """Mapping rows by source and predicate."""
    m = _mappings(table)
    v = m.select(F.col("subject_id").alias("meaning"), F.substring("subject_id", 1, 2).alias("source_key")).distinct()
    return rules.mapping_counts(v, m)


@query("""WITH k AS (SELECT DISTINCT n_regionkey || '.' || n_nationkey || '.' || (c_custkey % 3) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2 UNION SELECT n_regionkey || '.' || n_nationkey FROM nation WHERE n_nationkey < 20)
SELECT c_custkey, coalesce(a.code, b.code) AS is_a FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k a ON a.code = n_regionkey || '.' || n_nationkey || '.' || (c_custkey % 3) LEFT JOIN k b ON b.code = n_regionkey || '.' || n_nationkey""")
def compound_parent(table, spark):
    """Parents by compound codes, with the level above where the lower one is unknown."""
    c = table("customer").join(F.broadcast(table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    places = c.select("c_custkey", F.col("n_regionkey").cast("string").alias("cc"), F.col("n_nationkey").cast("string").alias("adm1"), (F.col("c_custkey") % 3).cast("string").alias("adm2"))
    two = places.filter("adm2 < 2").select(F.concat_ws(".", "cc", "adm1", "adm2").alias("code"))
    one = table("nation").filter("n_nationkey < 20").select(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("code"))
    return rules.compound_parent(places, two.union(one)).select("c_custkey", "is_a")


_IRIS = "SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'http://purl.obolibrary.org/obo/ENVO_' || p_partkey WHEN 1 THEN 'http://purl.obolibrary.org/obo/x/' || p_partkey ELSE 'urn:' || p_partkey END AS iri FROM part"


@query(f"""SELECT iri, CASE WHEN regexp_matches(iri, '^http://purl\\.obolibrary\\.org/obo/[A-Za-z]+_[A-Za-z0-9]+$') THEN replace(split_part(iri, '/', 5), '_', ':') WHEN starts_with(iri, 'http://purl.obolibrary.org/obo/') THEN 'obo:' || substr(iri, 32) END AS curie FROM ({_IRIS}) x""")
def curie_obo_first(table, spark):
    """CURIEs by OBO's form, else by the longest prefix."""
    k = F.col("p_partkey").cast("string")
    iri = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http://purl.obolibrary.org/obo/ENVO_"), k)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("http://purl.obolibrary.org/obo/x/"), k)).otherwise(F.concat(F.lit("urn:"), k))
    prefixes = spark.createDataFrame([("obo", "http://purl.obolibrary.org/obo/"), ("purl", "http://purl.obolibrary.org/")], "prefix string, uri string")
    return rules.curies(table("part").select(iri.alias("iri")).distinct(), prefixes)


_FOLD = [("CHEBI", "http://c/"), ("chebi", "http://c/"), ("Foo", "http://F/"), ("foo", "http://f/"), ("BAR", "http://b1/"), ("bar", "http://b2/"), ("One", "http://o/")]


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'chebi:' || p_partkey WHEN 1 THEN 'foo:' || p_partkey WHEN 2 THEN 'BAR:' || p_partkey WHEN 3 THEN 'One:' || p_partkey WHEN 4 THEN 'plain' END AS meaning FROM part""")
def prefix_fold_meanings(table, spark):
    """Meanings rewritten where spellings of a prefix fold."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size") % 6
    meaning = F.when(n == 0, F.concat(F.lit("CHEBI:"), k)).when(n == 1, F.concat(F.lit("Foo:"), k)).when(n == 2, F.concat(F.lit("BAR:"), k)).when(n == 3, F.concat(F.lit("One:"), k)).when(n == 4, "plain")
    return rules.folded_meanings(table("part").select("p_partkey", meaning.alias("meaning")), spark.createDataFrame(_FOLD, "prefix string, uri string"))


@query("""WITH l AS (SELECT DISTINCT source AS enum_key, CASE doc_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'description' ELSE 'choice' END AS part, CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS code FROM documents),
old AS (SELECT enum_key, part, code, 'fr' AS lang, 'old' AS text FROM l UNION ALL SELECT enum_key, part, code, 'es', 'viejo' FROM l),
new AS (SELECT source AS enum_key, CASE doc_id % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'description' ELSE 'choice' END AS part, CASE WHEN doc_id % 3 = 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS code, 'fr' AS lang, max('T' || doc_id) AS text FROM documents WHERE lang = 'fr' GROUP BY 1, 2, 3)
SELECT * FROM new UNION ALL SELECT old.* FROM old LEFT JOIN new USING (enum_key, part, code, lang) WHERE new.text IS NULL""")
def translation_parts(table, spark):
    """Translations of names, descriptions and choices put into locale rows."""
    n = F.col("doc_id") % 3
    d = table("documents").select("doc_id", "lang", F.col("source").alias("enum_key"), F.when(n == 0, "name").when(n == 1, "description").otherwise("choice").alias("part"), F.when(n == 2, F.col("doc_id").cast("string")).otherwise("").alias("code"))
    base = d.select("enum_key", "part", "code").distinct()
    old = base.select("*", F.lit("fr").alias("lang"), F.lit("old").alias("text")).union(base.select("*", F.lit("es").alias("lang"), F.lit("viejo").alias("text")))
    subject = F.concat(F.lit("ns:src:"), "enum_key", F.lit(":"), "part", F.when(F.col("code") != "", F.concat(F.lit(":"), "code")).otherwise(""))
    rows = d.filter("lang = 'fr'").select(subject.alias("subject_id"), F.concat(F.lit('"T'), "doc_id", F.lit('"@fr')).alias("object_id"))
    return rules.overlaid(old, rows)


_SLOTS = "SELECT DISTINCT p_brand AS slot_group, p_type AS name FROM part"


@query(f"""SELECT slot_group, name, CAST(row_number() OVER (PARTITION BY lower(slot_group) ORDER BY lower(name), name) AS INTEGER) AS position FROM ({_SLOTS}) x""")
def slot_order(table, spark):
    """Slots by group and name."""
    return rules.slot_order(table("part").select(F.col("p_brand").alias("slot_group"), F.col("p_type").alias("name")).distinct())


@query("""SELECT 'Container' AS class, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS slots FROM nation""")
def auto_slots_class(table, spark):
    """One class of all slots."""
    return rules.slot_class(table("nation").select(F.lit("").alias("slot_group"), F.col("n_name").alias("name")), "Container")


@query("""WITH r AS (SELECT p_brand AS enum_key, CAST(p_partkey AS VARCHAR) AS code, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' Reference: ' || p_type ELSE '' END AS text FROM part),
x AS (SELECT *, nullif(regexp_extract(text, 'Reference: .*$'), '') AS tail FROM r), s AS (SELECT enum_key, tail FROM x WHERE tail IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT x.enum_key, code, CASE WHEN s.tail IS NULL THEN text ELSE rtrim(substr(text, 1, length(text) - length(x.tail))) END AS text, NULL AS hoisted FROM x LEFT JOIN s ON s.enum_key = x.enum_key AND s.tail = x.tail
UNION ALL SELECT enum_key, NULL, NULL, string_agg(tail, ' ' ORDER BY tail) FROM s GROUP BY 1""")
def shared_tail_moved(table, spark):
    """References that values share moved to their enum."""
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Reference: "), "p_type")).otherwise(""))
    return rules.hoisted(table("part").select(F.col("p_brand").alias("enum_key"), F.col("p_partkey").cast("string").alias("code"), text.alias("text")), "Reference: .*$")


@query("""WITH r AS (SELECT p_brand AS grp, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS idx, split_part(p_type, ' ', 1) AS label FROM part), m AS (SELECT *, (min(idx) OVER (PARTITION BY grp) + max(idx) OVER (PARTITION BY grp)) / 2.0 AS mid FROM r)
SELECT grp, idx, CASE WHEN row_number() OVER (PARTITION BY grp, label ORDER BY abs(idx - mid), idx) = 1 THEN label END AS label FROM m""")
def midpoint_labels(table, spark):
    """Of equal labels of a scale that closest to the middle."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return rules.middle_labels(table("part").select(F.col("p_brand").alias("grp"), place.alias("idx"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label")))


_WORD_SCALES = [("quality", "standing", False), ("quality", "ion", True), ("size", "the", False), ("size", "ment", True), ("time", "eau", False)]


@query(f"""WITH s AS ({_values(_WORD_SCALES, "dimension, word, alias")}), w AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
h AS (SELECT DISTINCT id, dimension, word, alias FROM w JOIN s ON contains(w, word) OR contains(word, w) WHERE length(w) > 2), g AS (SELECT id, dimension, sum(CASE WHEN alias THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM h GROUP BY 1, 2)
SELECT id, dimension, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, dimension) AS n FROM g) x WHERE n = 1""")
def scale_match_aliases(table, spark):
    """The scale of a text by words that hold each other, aliases counting half."""
    return rules.scale_scores(table("documents").select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame(_WORD_SCALES, "dimension string, word string, alias boolean"))


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'not there at all 77' ELSE split_part(text, '.', 1) END AS title FROM documents)
SELECT v.doc_id, v.title FROM v JOIN documents d USING (doc_id) WHERE NOT contains({_PLAIN.format("coalesce(d.text, '')")}, {_PLAIN.format("v.title")})""")
def ungrounded_titles(table, spark):
    """Titles that their document doesn't have."""
    d = table("documents")
    v = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "not there at all 77").otherwise(F.substring_index("text", ".", 1)).alias("title"))
    return rules.ungrounded(v, d)


@query("""WITH RECURSIVE e AS (SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS parent FROM customer UNION SELECT 'C' || c_custkey, 'S' || c_mktsegment FROM customer UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'W' FROM region UNION SELECT 'W', 'R0'),
f AS (SELECT DISTINCT node AS root, node FROM e UNION SELECT f.root, e.parent FROM f JOIN e ON e.node = f.node) SELECT root, node FROM f""")
def property_path(table, spark):
    """All that nodes reach over several parents, cycles included."""
    c, n, r = table("customer"), table("nation"), table("region")
    two = lambda d, a, x, b, y: d.select(F.concat(F.lit(a), x).alias("node"), F.concat(F.lit(b), y).alias("parent"))
    edges = two(c, "C", "c_custkey", "N", "c_nationkey").union(two(c, "C", "c_custkey", "S", "c_mktsegment")).union(two(n, "N", "n_nationkey", "R", "n_regionkey"))
    edges = edges.union(r.select(F.concat(F.lit("R"), "r_regionkey"), F.lit("W"))).union(spark.createDataFrame([("W", "R0")], "node string, parent string")).distinct()
    return rules.reached(edges, edges.select("node"))


@query("""WITH k AS (SELECT CASE n_regionkey % 2 WHEN 0 THEN 'GeoNames' ELSE 'GeoWiki' END AS f, 1 + n_nationkey % 4 AS l, chr(65 + n_nationkey) || 'X' AS c FROM nation),
e AS (SELECT f || 'Adm' || l || c AS enum_key, f || '_countries' AS needs FROM k UNION ALL SELECT f || 'Adm' || l || c, f || '_ADM' || u.i || '_' || c FROM k, unnest(range(1, l + 1)) AS u(i)) SELECT * FROM e""")
def geo_dependencies(table, spark):
    """Sources that place enums need."""
    n = table("nation")
    key = F.concat(F.when(F.col("n_regionkey") % 2 == 0, "GeoNames").otherwise("GeoWiki"), F.lit("Adm"), F.lit(1) + F.col("n_nationkey") % 4, F.char(F.lit(65) + F.col("n_nationkey")), F.lit("X"))
    return rules.geo_dependencies(n.select(key.alias("enum_key")).union(spark.createDataFrame([("Other",)], "enum_key string")))


@query("""SELECT n_nationkey AS code, CASE WHEN n_nationkey % 6 = 0 THEN 'territory' WHEN n_nationkey % 5 = 1 THEN 'territory' WHEN n_nationkey % 2 = 0 THEN 'sovereign' WHEN n_nationkey % 7 = 0 THEN 'unknown' ELSE 'disputed' END AS kind FROM nation""")
def country_kinds(table, spark):
    """Countries by the five rules."""
    n, k = table("nation"), F.col("n_nationkey")
    countries = n.select(k.alias("code"), F.when(k % 5 == 1, k + 1).when(k % 5 == 2, k).alias("parent"), F.when(k % 7 != 0, F.col("n_name")).alias("name"))
    return rules.sovereignty(countries, n.filter(k % 6 == 0).select(k.alias("code")), n.filter(k % 2 == 0).select(k.alias("code"))).select("code", "kind")


# reports


@query("""WITH m AS (SELECT n_regionkey AS qid, n_name AS id, 'the ' || n_name || ' of' AS label, n_nationkey / 4.0::DOUBLE AS score, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank, n_nationkey FROM nation WHERE n_regionkey < 4),
q AS (SELECT r_regionkey AS qid, 'nation ' || r_regionkey AS term FROM region), c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT q.qid, CAST(coalesce(rank, 0) AS INTEGER) AS rank, CASE WHEN id IS NULL THEN term || ': (no matches)' ELSE printf('%.2f', score) || '  ' || id || '  ' || label || ' [' || coalesce(n, 0) || ']' END AS text,
CASE WHEN id IS NULL THEN term || chr(9) || '(no matches)' ELSE concat_ws(chr(9), term, id, label, id, printf('%.2f', score), CAST(coalesce(n, 0) AS VARCHAR)) END AS tsv,
CASE WHEN id IS NULL THEN '| ' || term || ' | (no matches) | |' ELSE '| ' || id || ' | ' || label || ' | ' || printf('%.2f', score) || ' |' END AS markdown FROM q LEFT JOIN m USING (qid) LEFT JOIN c ON c_nationkey = n_nationkey""")
def search_report(table, spark):
    """Matches as text, TSV and markdown, with child counts and lines for queries without any."""
    from pyspark.sql import Window

    n = table("nation").filter("n_regionkey < 4")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    m = n.select(F.col("n_regionkey").alias("qid"), rank.alias("rank"), F.col("n_name").alias("id"), F.concat(F.lit("the "), "n_name", F.lit(" of")).alias("label"), F.col("n_name").alias("definition"), (F.col("n_nationkey") / 4).alias("score"))
    kids = table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(F.broadcast(table("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("id"), "n")
    q = table("region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("nation "), "r_regionkey").alias("term"))
    return reports.search_report(q, m, kids)


@query("""SELECT r_name AS source_domain, 'S' || (n_nationkey % 2) AS source_schema, n_name AS enum_key, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE lower(n_name) END AS title, concat_ws(chr(9), r_name, 'S' || (n_nationkey % 2), n_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE lower(n_name) END) AS line FROM nation JOIN region ON n_regionkey = r_regionkey""")
def enum_report(table, spark):
    """Enums with where they come from."""
    n = table("nation").join(F.broadcast(table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.enum_report(n.select(F.col("r_name").alias("source_domain"), F.concat(F.lit("S"), F.col("n_nationkey") % 2).alias("source_schema"), F.col("n_name").alias("enum_key"), F.when(F.col("n_nationkey") % 3 != 0, F.lower("n_name")).alias("title")))


_VIEW = "SELECT p_brand AS enum_key, p_partkey AS ord, 'k' || (p_partkey % 300) AS code, p_name AS title FROM part"


def _view(table) -> tuple[DataFrame, DataFrame]:
    p = table("part")
    enums = p.groupBy(F.col("p_brand").alias("enum_key")).agg(F.min("p_partkey").alias("ord"), F.max("p_type").alias("title"))
    return enums, p.select(F.col("p_brand").alias("enum_key"), F.col("p_partkey").alias("ord"), F.concat(F.lit("k"), F.col("p_partkey") % 300).alias("code"), F.col("p_name").alias("title"))


@query(f"""WITH e AS (SELECT p_brand AS enum_key, min(p_partkey) AS eo FROM part GROUP BY 1), v AS ({_VIEW}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY eo, ord, title) AS n FROM v JOIN e USING (enum_key)) SELECT code, title, eo AS enum_ord, ord FROM r WHERE n = 1""")
def section_merge(table, spark):
    """Sections as one enum."""
    return reports.merged_view(*_view(table))


@query(f"SELECT enum_key, CAST(row_number() OVER (PARTITION BY enum_key ORDER BY ord, code) AS INTEGER) AS position, code, title FROM ({_VIEW}) v")
def section_separate(table, spark):
    """Sections by themselves."""
    return reports.separate_view(*_view(table))


@query(f"SELECT p_brand AS code, NULL AS is_a, max(p_type) AS title, 0 AS depth FROM part GROUP BY 1 UNION ALL SELECT code, enum_key, title, 1 FROM ({_VIEW}) v")
def section_hierarchy(table, spark):
    """Sections as parents of their values."""
    return reports.hierarchy_view(*_view(table))


@query("""SELECT p_brand AS enum_key, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size % 3 = 0 THEN p_type END AS en, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN p_name END AS was_en, CASE WHEN p_size % 5 = 0 THEN 'fr ' || p_name END AS fr FROM part
WHERE CASE WHEN p_size % 3 = 0 THEN p_type END IS NOT NULL OR p_size % 5 = 0 OR (p_size % 2 = 1)""".replace("CASE WHEN p_size % 3 = 0 THEN p_type END AS en", "CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 2 = 1 THEN p_name END AS en"))
def picklist_calibrate(table, spark):
    """What of a picklist differs from the schema."""
    p = table("part").select(F.col("p_brand").alias("enum_key"), F.col("p_partkey").cast("string").alias("code"), "p_size", "p_name", "p_type")
    stored = p.select("enum_key", "code", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("en"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("fr "), "p_name")).alias("fr"))
    return reports.calibrated(stored, p.filter("p_size % 2 = 0").select("enum_key", "code", F.col("p_name").alias("title")))


@query("""SELECT p_brand AS enum_key, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size % 7 = 0 THEN p_type ELSE p_name END AS en, CASE WHEN p_size % 7 = 0 THEN 'm' WHEN p_size % 2 = 0 THEN 'l' WHEN p_size % 3 = 0 THEN 's' END AS fr FROM part""")
def picklist_build(table, spark):
    """Picklists by precedence: mapping, locale, SSSOM."""
    p = table("part").select(F.col("p_brand").alias("enum_key"), F.col("p_partkey").cast("string").alias("code"), "p_size", "p_name", "p_type")
    of = lambda n, v: p.filter(F.col("p_size") % n == 0).select("enum_key", "code", F.lit(v).alias("fr"))
    return reports.built(p.select("enum_key", "code", F.col("p_name").alias("title")), of(2, "l"), of(3, "s"), of(7, "m").join(p.select("enum_key", "code", F.col("p_type").alias("en")), ["enum_key", "code"]))


@query("""WITH a AS (SELECT n_name AS name, unnest(['one', n_name, 'same']) AS text FROM nation), b AS (SELECT n_name AS name, unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'two' ELSE 'one' END, n_name, 'same']) AS text FROM nation WHERE n_nationkey <> 3),
x AS (SELECT name, text, sum(s) AS d FROM (SELECT name, text, -1 AS s FROM a UNION ALL SELECT name, text, 1 FROM b) y GROUP BY 1, 2) SELECT name, CASE WHEN d > 0 THEN '+' ELSE '-' END || text AS line, CAST(abs(d) AS BIGINT) AS times FROM x WHERE d <> 0""")
def picklist_compare(table, spark):
    """Lines that differ between stored and new picklists."""
    n = table("nation")
    old = n.select(F.col("n_name").alias("name"), F.concat_ws("\n", F.lit("one"), "n_name", F.lit("same")).alias("content"))
    new = n.filter("n_nationkey != 3").select(F.col("n_name").alias("name"), F.concat_ws("\n", F.when(F.col("n_nationkey") % 2 == 0, "two").otherwise("one"), "n_name", F.lit("same")).alias("content"))
    return reports.compared(old, new)


# search


@query("""SELECT 's' || n_regionkey AS source_key, n_name AS id, 'enum' AS type, '' AS parent, '' AS term_uri, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS label, '' AS definition FROM nation
UNION ALL SELECT 's' || n_regionkey, 'c' || c_custkey, 'term', CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END, CASE WHEN c_custkey % 2 = 0 THEN 'u:' || c_custkey ELSE '' END, c_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT '__statscan_catalog__', CAST(page_id AS VARCHAR), 'catalog', '', url, 'page', 'classification' FROM pages""")
def search_index_rows(table, spark):
    """Rows of the search index: enums, values and the catalogue."""
    n = table("nation")
    enums = n.select(F.concat(F.lit("s"), "n_regionkey").alias("source_key"), F.col("n_name").alias("enum_key"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.lower("n_name")).alias("title"), F.lit(None).cast("string").alias("description"))
    c = table("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    pvs = c.select(F.concat(F.lit("s"), "n_regionkey").alias("source_key"), F.col("n_name").alias("enum_key"), F.concat(F.lit("c"), "c_custkey").alias("code"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("u:"), "c_custkey")).alias("meaning"))
    pages = table("pages").select(F.col("page_id").cast("string").alias("key"), F.lit(None).cast("string").alias("subject"), "url", F.lit("page").alias("title"), F.lit("classification").alias("entry_type"))
    return search.index_rows(enums, pvs, pages)


@query()
def search_ranked(table, spark):
    """Ranked search by stems: BM25, then phrases and tokens."""
    return search.ranked_search(spark.createDataFrame(list(enumerate(SEARCHES)), "qid int, term string"), _terms(table))


_HITS = "SELECT doc_id % 40 AS qid, 'd' || (doc_id % 97) AS id, n_chars / 16.0::DOUBLE AS score FROM documents"


@query(f"SELECT qid // 4 AS qid, id, max(score) AS score FROM ({_HITS}) h GROUP BY 1, 2")
def search_synonym_pool(table, spark):
    """Matches of synonyms given to their query."""
    d = table("documents").select((F.col("doc_id") % 40).alias("qid"), F.concat(F.lit("d"), F.col("doc_id") % 97).alias("id"), (F.col("n_chars") / 16).alias("score"))
    return search.pooled(d, spark.range(40).select(F.col("id").alias("qid"), F.floor(F.col("id") / 4).alias("orig")))


@query(f"SELECT qid, id, -score AS rank_score, CAST(place AS INTEGER) AS place FROM (SELECT qid, 'd' || doc_id AS id, n_chars / 16.0::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY -n_chars, 'd' || doc_id) AS place FROM (SELECT doc_id % 20 AS qid, doc_id, n_chars FROM documents) d) x WHERE place <= 6")
def search_overfetch(table, spark):
    """Three times as many candidates as are asked for."""
    d = table("documents").select((F.col("doc_id") % 20).alias("qid"), F.concat(F.lit("d"), "doc_id").alias("id"), (-F.col("n_chars") / 16).alias("rank_score"))
    return search.overfetched(d, 2)


# text functions


@query("""WITH w AS (SELECT p_partkey, p_type, list_filter(regexp_split_to_array(p_type, '[^A-Za-z0-9]+'), lambda x: x <> '') AS ws FROM part)
SELECT p_partkey, lower(ws[1]) || array_to_string(list_transform(ws[2:], lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS camel, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g')) AS slug, regexp_replace(p_type, '[^A-Za-z0-9.\\-]+', '_', 'g') AS code, array_to_string(ws, '') AS header FROM w""")
def name_styles(table, spark):
    """Phrases as identifiers."""
    x = F.col("p_type")
    return table("part").select("p_partkey", t.camel_case(x).alias("camel"), t.slug(x).alias("slug"), t.sanitized_code(x).alias("code"), t.header_key(x).alias("header"))


@query("""SELECT user_id % 50 AS k, CASE user_id % 5 WHEN 0 THEN 'special municipalities of the Netherlands' WHEN 1 THEN 'boxes' WHEN 2 THEN 'autonomous regions in Spain' WHEN 3 THEN 'days' ELSE 'branches' END AS plural, count(*) AS n FROM events GROUP BY ALL""")
def plural_types(table, spark):
    """Noun phrases in the plural."""
    k = F.col("user_id") % 5
    one = F.when(k == 0, "special municipality of the Netherlands").when(k == 1, "box").when(k == 2, "autonomous region in Spain").when(k == 3, "day").otherwise("branch")
    return table("events").select((F.col("user_id") % 50).alias("k"), t.plural(one).alias("plural")).groupBy("k", "plural").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS base, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/about' AS root, regexp_extract(url, '^(.*/)', 1) || 'x.html' AS beside, 'http://other/y' AS absolute, replace(regexp_extract(url, '^(.*/)', 1), '/en/', '/fr/') || 'a-fra.html' AS french, CAST(page_id AS VARCHAR) AS id, 'part' || page_id AS fragment FROM pages""")
def url_helpers(table, spark):
    """Links of pages as whole URLs, their French versions, ids and fragments."""
    u = F.regexp_replace("url", r"[?#].*$", "")
    return table("pages").select(
        "page_id", t.base_folder(u).alias("base"), t.url_joined(u, F.lit("/about")).alias("root"), t.url_joined(u, F.lit("x.html")).alias("beside"), t.url_joined(u, F.lit("http://other/y")).alias("absolute"),
        t.french_url(F.concat(t.base_folder(u), F.lit("a-eng.html"))).alias("french"), t.url_id(F.concat(u, F.lit("?a=1&id="), "page_id"), "id").alias("id"), t.fragment(F.concat(u, F.lit("#part"), "page_id")).alias("fragment"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'QA' WHEN p_size % 3 = 1 THEN 'Z' ELSE 'KF' END AS letters, CASE WHEN p_size % 3 < 2 THEN CAST(p_size AS DOUBLE) END AS start, CASE p_size % 3 WHEN 0 THEN p_size + 5.5::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) END AS stop FROM part""")
def code_ranges(table, spark):
    """Letters, start and stop of ranges of codes."""
    n = F.col("p_size").cast("string")
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("QA"), n, F.lit("-"), (F.col("p_size") + 5.5).cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Z"), n)).otherwise("KF")
    letters, start, stop = t.code_range(code)
    return table("part").select("p_partkey", letters.alias("letters"), start.alias("start"), stop.alias("stop"))


@query("""SELECT doc_id, substr(text, greatest(instr(lower(text), 'the ') - 200, 1), 10000) AS around FROM documents WHERE text IS NOT NULL""")
def anchor_window(table, spark):
    """Texts from a little before an anchor on."""
    return table("documents").filter("text IS NOT NULL").select("doc_id", t.anchored(F.col("text"), F.lit("THE ")).alias("around"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr ' || doc_id WHEN doc_id % 2 = 0 THEN 'en ' || doc_id ELSE source END AS label, CASE WHEN doc_id % 3 = 0 THEN 'CA' END AS country, CASE WHEN doc_id % 4 = 0 THEN DATE '2015-10-21' END AS day FROM documents""")
def label_chain(table, spark):
    """Labels by languages and fields, countries of codes and days of HTTP dates."""
    k = F.col("doc_id").cast("string")
    labels = F.create_map(F.lit("fr"), F.when(F.col("lang") == "fr", F.concat(F.lit("fr "), k)).otherwise(" "), F.lit("en"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("en "), k)))
    date = F.when(F.col("doc_id") % 4 == 0, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise("yesterday")
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CA-"), k)).otherwise("canada")
    return table("documents").select("doc_id", t.best_label(labels, ["fr", "de", "en"], F.col("source")).alias("label"), t.alpha2(code).alias("country"), t.http_date(date).alias("day"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, ' OR ' ORDER BY event_type) AS query FROM events GROUP BY 1""")
def or_queries(table, spark):
    """Queries combined by OR."""
    return table("events").groupBy("user_id").agg(t.any_of(F.sort_array(F.collect_set("event_type"))).alias("query"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'eleve' WHEN 1 THEN 'oeuvre' ELSE 'nandu' END AS key FROM customer""")
def folded_keys(table, spark):
    """Sort keys without accents and case."""
    k = F.col("c_custkey") % 3
    return table("customer").select("c_custkey", t.folded(F.when(k == 0, "Élève").when(k == 1, "Œuvre").otherwise("ÑANDÚ")).alias("key"))
