"""Every registered query of the vocabulary engine with its SQL counterpart.

The tables of a star schema stand in for vocabulary sources: regions, nations, suppliers and customers are values of a
hierarchy, documents are terms with definitions, parts are code lists. Operators know nothing of this; the queries map columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import text as t
from .operators import hierarchy, mappings, matching, merge, ranks, search, upkeep
from .sources import readers, sinks
from .streaming import index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "search_token_overlap"

SEARCHES = ["the nation with thinning", "not in the words", "eroned", "hand: of the only onreresh"]


def query(sql: str | None = None):
    """Registers a function of the tables' reader as the query of its name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(t.STOPWORDS))


def _sql_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: len(w) > 1 AND NOT list_contains([{_STOP}], w)))"


def _terms(table) -> DataFrame:
    d = table("documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 10 == 0, "enum").otherwise("pv").alias("type"), F.substring_index("text", ".", 1).alias("label"), F.col("text").alias("definition"), "source", "lang")


_SQL_TERMS = "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 0 THEN 'enum' ELSE 'pv' END AS type, split_part(text, '.', 1) AS label, text AS definition, source, lang FROM documents"
_SQL_QUERIES = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEARCHES)) + ") AS v(qid, term)"


@query(f"""
WITH q AS ({_SQL_QUERIES}), terms AS ({_SQL_TERMS}),
qt AS (SELECT qid, term, {_sql_tokens("term")} AS ts FROM q),
dt AS (SELECT id, type, label, definition, {_sql_tokens("label")} AS lt, {_sql_tokens("definition")} AS dts FROM terms),
s AS (SELECT qid, id, type, round(CASE WHEN contains(lower(label), lower(term)) OR contains(lower(definition), lower(term)) THEN 1.0
      ELSE greatest(CASE WHEN len(ts) > 0 THEN 0.9 * (len(list_intersect(ts, lt)) / len(ts)) ELSE 0 END, CASE WHEN len(ts) > 0 THEN 0.5 * (len(list_intersect(ts, dts)) / len(ts)) ELSE 0 END) END, 4) AS score FROM qt, dt),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN type = 'enum' THEN 0 ELSE 1 END, lower(id), id) AS rank FROM s WHERE score > 0)
SELECT CAST(qid AS INTEGER) AS qid, id, type, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def search_token_overlap(table, spark):
    """Ranked term search by phrase and token overlap."""
    asked = spark.createDataFrame(list(enumerate(SEARCHES)), "qid int, term string")
    return search.overlap_search(asked, _terms(table)).select("qid", "id", "type", F.col("score").cast("double").alias("score"), "rank")


BM25_WORDS = [(0, "that"), (0, "with"), (1, "from"), (1, "which"), (2, "les"), (2, "dans")]


@query(f"""
WITH q AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}')" for i, w in BM25_WORDS)}) AS v(qid, word)), terms AS ({_SQL_TERMS}),
d AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', label, definition)), '[a-z0-9]+') AS ws FROM terms),
st AS (SELECT count(*) AS total, avg(len(ws)) AS mean FROM d),
p AS (SELECT id, len(ws) AS n, word, count(*) AS f FROM d, unnest(ws) AS u(word) GROUP BY id, n, word),
p2 AS (SELECT * FROM p WHERE word IN (SELECT word FROM q)),
df AS (SELECT word, count(*) AS df FROM p2 GROUP BY word),
need AS (SELECT qid, count(*) AS needed FROM q GROUP BY qid),
s AS (SELECT qid, id, sum(greatest(ln((total - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * n / mean))) AS score, count(*) AS c
      FROM p2 JOIN q USING (word) JOIN df USING (word), st GROUP BY qid, id),
r AS (SELECT s.qid, id, round(score, 4) AS score, row_number() OVER (PARTITION BY s.qid ORDER BY round(score, 4) DESC, id) AS rank FROM s JOIN need ON s.qid = need.qid WHERE c = needed)
SELECT CAST(qid AS INTEGER) AS qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def search_bm25_and(table, spark):
    """BM25 of the documents that have all words of a query."""
    return search.bm25_all(spark.createDataFrame(BM25_WORDS, "qid int, word string"), _terms(table))


@query("""
WITH m AS (SELECT doc_id % 50 AS qid, CAST(doc_id % 7 AS VARCHAR) AS id, n_chars / 8.0::DOUBLE AS score, source, n_chars % 3 = 0 AS verbatim, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS definition, doc_id AS ord FROM documents)
SELECT qid, id, max(score) AS score, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, bool_or(verbatim) AS verbatim,
       arg_min(definition, ord) FILTER (WHERE definition <> '') AS definition FROM m GROUP BY qid, id""")
def search_dedup_sources(table, spark):
    """Matches of several sources made one per id."""
    d = table("documents")
    m = d.select((F.col("doc_id") % 50).alias("qid"), (F.col("doc_id") % 7).cast("string").alias("id"), (F.col("n_chars") / 8).alias("score"), "source", (F.col("n_chars") % 3 == 0).alias("verbatim"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("definition"), F.col("doc_id").alias("ord"))
    return search.merge_sources(m)


@query("""
WITH m AS (SELECT l_orderkey % 100 AS qid, CAST(l_partkey AS VARCHAR) || '-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'enum' ELSE 'pv' END AS type, l_discount AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN type = 'enum' THEN 0 ELSE 1 END, score DESC, lower(id), id) AS rank FROM m)
SELECT qid, id, type, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def search_pooled_top_k(table, spark):
    """Enums first, then by score."""
    li = table("lineitem")
    return search.top_k(li.select((F.col("l_orderkey") % 100).alias("qid"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.when(F.col("l_linenumber") == 1, "enum").otherwise("pv").alias("type"), F.col("l_discount").alias("score")), 5, pooled=True)


@query("""
WITH o AS (SELECT substr(p_type, 1, 3) || ':' || (p_partkey % 200) AS id, substr(p_brand, 1, 3) AS ontology, p_partkey AS ord FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN lower(split_part(id, ':', 1)) = lower(ontology) THEN 0 ELSE 1 END, ord) AS n FROM o)
SELECT id, ontology, ord FROM r WHERE n = 1""")
def search_owner_preference(table, spark):
    """Of rows with one id that of the ontology that owns it."""
    p = table("part")
    return search.prefer_owner(p.select(F.concat(F.substring("p_type", 1, 3), F.lit(":"), (F.col("p_partkey") % 200).cast("string")).alias("id"), F.substring("p_brand", 1, 3).alias("ontology"), F.col("p_partkey").alias("ord")))


@query("""
WITH d AS (SELECT source AS source_key, doc_id AS id, n_chars FROM documents), f AS (SELECT source AS source_key, doc_id + 1000000 AS id, n_chars FROM documents WHERE source < 'src15' AND doc_id % 2 = 0)
SELECT * FROM d WHERE source_key NOT IN (SELECT source_key FROM f) UNION ALL SELECT * FROM f""")
def index_upsert(table, spark):
    """Rows of some sources replaced."""
    d = table("documents").select(F.col("source").alias("source_key"), F.col("doc_id").alias("id"), "n_chars")
    return search.upsert(d, d.filter("source_key < 'src15' AND id % 2 = 0").withColumn("id", F.col("id") + 1000000))


@query("""
WITH e AS (SELECT * FROM (VALUES ('soil: how it drains; http://x.org/a'), ('plain; ;a:b' || chr(10) || 'c')) AS v(raw)),
x AS (SELECT raw, trim(u.entry) AS entry FROM e, unnest(string_split_regex(raw, '[;\n]+')) AS u(entry)), y AS (SELECT entry FROM x WHERE entry <> '')
SELECT entry, CASE WHEN regexp_matches(entry, '^[^:/]{1,80}:\\s*.+$') THEN trim(regexp_extract(entry, '^([^:/]{1,80}):\\s*(.+)$', 1)) ELSE entry END AS term,
       CASE WHEN regexp_matches(entry, '^[^:/]{1,80}:\\s*.+$') THEN trim(regexp_extract(entry, '^([^:/]{1,80}):\\s*(.+)$', 2)) END AS description FROM y""")
def query_parse_batch(table, spark):
    """A batch of queries taken apart."""
    raw = spark.createDataFrame([("soil: how it drains; http://x.org/a",), ("plain; ;a:b\nc",)], "raw string")
    e = raw.select(F.explode(t.query_entries(F.col("raw"))).alias("entry"))
    return e.select("entry", t.query_term(F.col("entry")).alias("term"), t.query_description(F.col("entry")).alias("description"))


@query("""
WITH d AS (SELECT doc_id, split_part(text, '.', 1) AS label, text FROM documents)
SELECT doc_id, (contains(lower(label || ' ' || text), 'and the') OR contains(lower(label || ' ' || text), 'eau')) AS verbatim FROM d""")
def verbatim_flag(table, spark):
    """Whether a term or its description is literally there."""
    d = table("documents").withColumn("label", F.substring_index("text", ".", 1))
    return d.select("doc_id", t.is_verbatim(F.lit("and the"), F.lit("eau"), F.col("label"), F.col("text")).alias("verbatim"))


def _sql_replace(x: str) -> str:
    for a, b in t.TYPOGRAPHY:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


@query(f"""SELECT page_id, {_sql_replace("concat('“', url, '” – …', html)")} AS plain FROM pages""")
def normalize_typography(table, spark):
    """Typographic characters made plain."""
    return table("pages").select("page_id", t.normalize_text(F.concat(F.lit("“"), "url", F.lit("” – …"), "html")).alias("plain"))


def _sql_strip(x: str) -> str:
    for tag in t.HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return f"trim(regexp_replace({x}, '(?s)<[^>]+>', '', 'g'))"


@query(f"SELECT page_id, {_sql_strip('html')} AS visible FROM pages")
def tag_strip_visible_text(table, spark):
    """Pages without markup."""
    return table("pages").select("page_id", t.strip_tags(F.col("html")).alias("visible"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS ts FROM pages)
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, hs[pos] AS href, ts[pos] AS label FROM l, unnest(range(1, len(hs) + 1)) AS u(pos)""")
def html_links(table, spark):
    """Links of pages with their texts."""
    p = F.lit(r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>')
    l = table("pages").select("page_id", F.regexp_extract_all("html", p, F.lit(1)).alias("hs"), F.regexp_extract_all("html", p, F.lit(2)).alias("ts"))
    return l.select("page_id", F.posexplode(F.arrays_zip("hs", "ts")).alias("pos", "x")).select("page_id", "pos", F.col("x.hs").alias("href"), F.col("x.ts").alias("label"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?is)<p[ >]')) AS BIGINT) AS paragraphs FROM pages""")
def html_title(table, spark):
    """Titles of pages and how many paragraphs these have."""
    return table("pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"(?is)<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"))


@query("""SELECT p_partkey, CASE WHEN lower(p_brand) <> lower(CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_name END) THEN p_brand END AS title,
       CASE WHEN starts_with('http://x.org/' || p_type, 'http://x.org/') THEN 'x:' || p_type END AS meaning FROM part""")
def build_pv_from_dimension(table, spark):
    """Values with titles that say more than the code, and meanings as CURIEs."""
    p = table("part")
    code = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_name"))
    return p.select("p_partkey", *merge.value(code, F.col("p_brand"), F.concat(F.lit("http://x.org/"), "p_type"), [("x", "http://x.org/"), ("y", "http://")]))


def _pvs(table) -> DataFrame:
    r = table("region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("is_a"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("title"))
    n = table("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("is_a"), (F.col("n_nationkey") + 100).cast("long").alias("ord"), F.col("n_name").alias("title"))
    s = table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), F.concat(F.lit("N"), "s_nationkey").alias("is_a"), (F.col("s_suppkey") + 1000).cast("long").alias("ord"), F.col("s_name").alias("title"))
    return r.unionByName(n).unionByName(s).withColumn("enum_key", F.lit("places"))


_SQL_PVS = """SELECT 'places' AS enum_key, 'R' || r_regionkey AS code, CAST(NULL AS VARCHAR) AS is_a, CAST(r_regionkey AS BIGINT) AS ord, r_name AS title FROM region
UNION ALL SELECT 'places', 'N' || n_nationkey, 'R' || n_regionkey, CAST(n_nationkey + 100 AS BIGINT), n_name FROM nation
UNION ALL SELECT 'places', 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey + 1000, s_name FROM supplier"""


@query(f"""WITH pvs AS ({_SQL_PVS}) SELECT enum_key, is_a AS code, count(*) AS n, array_to_string(list(code ORDER BY ord), ',') AS children FROM pvs WHERE is_a IS NOT NULL GROUP BY enum_key, is_a""")
def geo_hierarchy_children(table, spark):
    """Values with their children."""
    return hierarchy.children(_pvs(table))


@query(f"""WITH RECURSIVE pvs AS ({_SQL_PVS}), up AS (SELECT code, is_a AS ancestor, 1 AS distance FROM pvs WHERE is_a IS NOT NULL
UNION ALL SELECT up.code, pvs.is_a, up.distance + 1 FROM up JOIN pvs ON pvs.code = up.ancestor WHERE pvs.is_a IS NOT NULL)
SELECT code, ancestor, CAST(distance AS INTEGER) AS distance FROM up""")
def ancestor_closure(table, spark):
    """All ancestors of all values."""
    return hierarchy.closure(_pvs(table).select("code", F.col("is_a").alias("parent")))


@query(f"""WITH RECURSIVE pvs AS ({_SQL_PVS}), t AS (SELECT code, is_a, starts_with(code, 'N') AND ord % 2 = 0 AS dropped FROM pvs),
up AS (SELECT code, is_a AS ancestor, 1 AS distance FROM t WHERE is_a IS NOT NULL UNION ALL SELECT up.code, t.is_a, up.distance + 1 FROM up JOIN t ON t.code = up.ancestor WHERE t.is_a IS NOT NULL),
near AS (SELECT up.code, arg_min(ancestor, distance) AS is_a FROM up JOIN t ON t.code = up.ancestor WHERE NOT t.dropped GROUP BY up.code)
SELECT t.code, near.is_a FROM t LEFT JOIN near ON near.code = t.code WHERE NOT t.dropped""")
def surviving_ancestor(table, spark):
    """Parents that were dropped replaced by the nearest that weren't."""
    return hierarchy.surviving_parent(_pvs(table).select("code", "is_a", (F.startswith("code", F.lit("N")) & (F.col("ord") % 2 == 0)).alias("dropped")))


@query("""WITH c AS (SELECT conv_id AS grp, turn AS ord, CAST(1 + turn % 3 AS INTEGER) AS level, conv_id || '-' || turn AS code FROM conversations),
p AS (SELECT c.grp, c.ord, c.level, c.code, max(b.ord) AS at FROM c LEFT JOIN c AS b ON b.grp = c.grp AND b.ord < c.ord AND b.level < c.level GROUP BY ALL)
SELECT p.grp, p.ord, p.level, p.code, CASE WHEN b.level = p.level - 1 THEN b.code END AS is_a FROM p LEFT JOIN c AS b ON b.grp = p.grp AND b.ord = p.at""")
def level_parent_stack(table, spark):
    """Parents from levels of an indented list."""
    return hierarchy.parent_by_level_stack(_levels(table))


@query("""WITH c AS (SELECT conv_id AS grp, turn AS ord, CAST(1 + turn % 3 AS INTEGER) AS level, conv_id || '-' || turn AS code FROM conversations),
p AS (SELECT c.grp, c.ord, c.level, c.code, max(b.ord) AS at FROM c LEFT JOIN c AS b ON b.grp = c.grp AND b.ord < c.ord AND b.level = c.level - 1 GROUP BY ALL)
SELECT p.grp, p.ord, p.level, p.code, b.code AS is_a FROM p LEFT JOIN c AS b ON b.grp = p.grp AND b.ord = p.at""")
def level_parent_scan(table, spark):
    """Parents from levels, however far back."""
    return hierarchy.parent_by_level_scan(_levels(table))


def _levels(table) -> DataFrame:
    return table("conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), (F.lit(1) + F.col("turn") % 3).cast("int").alias("level"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("code"))


@query("""WITH n AS (SELECT DISTINCT 'C' || o_custkey AS iri FROM orders UNION SELECT 'O' || o_orderkey FROM orders), e AS (SELECT 'O' || o_orderkey AS source, 'C' || o_custkey AS target FROM orders),
k AS (SELECT iri FROM n WHERE iri NOT IN (SELECT target FROM e WHERE source = 'O1') AND iri <> 'O1')
SELECT source, target FROM e WHERE source IN (SELECT iri FROM k) AND target IN (SELECT iri FROM k)""")
def expand_subgraph(table, spark):
    """A graph without its root and that root's parents."""
    o = table("orders")
    edges = o.select(F.concat(F.lit("O"), "o_orderkey").alias("source"), F.concat(F.lit("C"), "o_custkey").alias("target"))
    nodes = edges.select(F.col("source").alias("iri")).union(edges.select("target")).distinct()
    return hierarchy.expand(nodes, edges, "O1")[1].select("source", "target")


@query("SELECT 'C' || l_partkey AS code, arg_max('P' || l_suppkey, l_orderkey * 10 + l_linenumber) AS is_a FROM lineitem GROUP BY 1")
def edge_last_parent(table, spark):
    """Of several parents the last."""
    li = table("lineitem")
    return hierarchy.last_parent(li.select(F.concat(F.lit("C"), "l_partkey").alias("source"), F.concat(F.lit("P"), "l_suppkey").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")))


_RANGES = "SELECT p_brand AS grp, p_size AS start, p_size + CAST(p_partkey % 10 AS INTEGER) AS stop, CAST(p_partkey AS VARCHAR) AS code FROM part"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY start, stop DESC, code) AS n FROM ({_RANGES}) x),
p AS (SELECT a.grp, a.start, a.stop, a.code, max(b.n) AS at FROM r a LEFT JOIN r b ON a.grp = b.grp AND b.n < a.n AND b.start <= a.start AND b.stop >= a.stop GROUP BY ALL)
SELECT p.grp, p.start, p.stop, p.code, b.code AS is_a FROM p LEFT JOIN r b ON b.grp = p.grp AND b.n = p.at""")
def interval_parent(table, spark):
    """Parents of nested intervals."""
    p = table("part")
    return hierarchy.interval_parent(p.select(F.col("p_brand").alias("grp"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 10).cast("int").alias("stop"), F.col("p_partkey").cast("string").alias("code")))


@query("""WITH p AS (SELECT DISTINCT (p_size % 9) || '.' || (p_partkey % 7) AS code FROM part UNION SELECT DISTINCT (p_size % 9) || '.' || (p_partkey % 7) || '.' || (p_partkey % 3) FROM part),
w AS (SELECT code, CASE WHEN len(string_split(code, '.')) = 2 THEN split_part(code, '.', 1) || '.0' WHEN len(string_split(code, '.')) > 2 THEN regexp_replace(code, '\\.[^.]*$', '') END AS want FROM p)
SELECT w.code, p.code AS is_a FROM w LEFT JOIN p ON p.code = w.want AND w.want <> w.code""")
def dotted_parent(table, spark):
    """Parents of dotted codes."""
    p = table("part")
    two = F.concat_ws(".", (F.col("p_size") % 9).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    codes = p.select(two.alias("code")).union(p.select(F.concat_ws(".", two, (F.col("p_partkey") % 3).cast("string")))).distinct()
    return hierarchy.dotted_parent(codes)


@query("""WITH n AS (SELECT CAST(n_nationkey // 5 AS BIGINT) AS grp, n_nationkey AS code, CASE WHEN n_nationkey % 7 = 6 THEN n_name ELSE 'L.' || n_nationkey || ' leaves' END AS title FROM nation),
x AS (SELECT *, regexp_extract(title, '^([A-Za-z]*[._-]?)([0-9]+)(?:\\s|$)', 1) AS p, CAST(nullif(regexp_extract(title, '^([A-Za-z]*[._-]?)([0-9]+)(?:\\s|$)', 2), '') AS INTEGER) AS k FROM n),
s AS (SELECT grp, p, count(k) AS c, count(DISTINCT k) AS dc, min(k) AS lo, max(k) AS hi FROM x GROUP BY grp, p)
SELECT x.grp, code, title, CASE WHEN c >= 2 AND lo IN (0, 1) AND hi - lo + 1 = c AND dc = c THEN k END AS rank FROM x JOIN s ON x.grp = s.grp AND x.p = s.p""")
def sibling_rank_detect(table, spark):
    """Ranks of siblings whose titles are numbered on from 0 or 1."""
    n = table("nation")
    return ranks.sibling_ranks(n.select(F.floor(F.col("n_nationkey") / 5).alias("grp"), F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") % 7 == 6, F.col("n_name")).otherwise(F.concat(F.lit("L."), "n_nationkey", F.lit(" leaves"))).alias("title")))


@query("""WITH n AS (SELECT p_type AS enum_key, p_brand AS grp, CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS rank, p_partkey AS ord FROM part),
f AS (SELECT *, min(ord) OVER (PARTITION BY enum_key, grp) AS first FROM n)
SELECT enum_key, grp, code, rank, ord, CAST(row_number() OVER (PARTITION BY enum_key ORDER BY first, rank IS NULL, rank, CASE WHEN rank IS NOT NULL THEN code END, ord) AS INTEGER) AS position FROM f""")
def ranked_sort_order(table, spark):
    """Ranked values first, in each group."""
    p = table("part")
    return ranks.ranked_order(p.select(F.col("p_type").alias("enum_key"), F.col("p_brand").alias("grp"), F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("rank"), F.col("p_partkey").alias("ord")))


@query("""WITH s AS (SELECT p_brand AS grp, CAST(p_size % 7 * 3 AS INTEGER) AS code FROM part), e AS (SELECT grp, min(code) AS lo, max(code) AS hi, count(DISTINCT code) AS n FROM s GROUP BY grp)
SELECT e.grp, CAST(u.code AS INTEGER) AS code, NOT EXISTS (SELECT 1 FROM s WHERE s.grp = e.grp AND s.code = u.code) AS is_intermediate FROM e, unnest(range(lo, hi + 1)) AS u(code) WHERE n >= 2 AND hi - lo <= 20""")
def gap_fill_scale(table, spark):
    """Missing steps of whole-number scales."""
    return ranks.gap_fill(table("part").select(F.col("p_brand").alias("grp"), (F.col("p_size") % 7 * 3).cast("int").alias("code")))


@query("""WITH p AS (SELECT p_brand AS grp, p_partkey AS code, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS title FROM part)
SELECT grp, code, title, coalesce(title, 'between ' || last_value(title IGNORE NULLS) OVER (PARTITION BY grp ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || ' and ' || first_value(title IGNORE NULLS) OVER (PARTITION BY grp ORDER BY code ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS label FROM p""")
def neighbour_labels(table, spark):
    """Labels of steps between two that have one."""
    return ranks.between_labels(table("part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("code"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).alias("title")))


@query("""WITH l AS (SELECT doc_id // 4 AS id, lang, doc_id % 3 = 0 AS preferred, text AS title, doc_id AS ord FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id, lang ORDER BY preferred DESC, ord) AS n FROM l)
SELECT id, lang, preferred, title, ord FROM r WHERE n = 1""")
def best_label_per_lang(table, spark):
    """One label for each language."""
    d = table("documents")
    return ranks.best_labels(d.select(F.floor(F.col("doc_id") / 4).alias("id"), "lang", (F.col("doc_id") % 3 == 0).alias("preferred"), F.col("text").alias("title"), F.col("doc_id").alias("ord")))


@query("""WITH r AS (SELECT p_size AS id, p_type AS type FROM part), f AS (SELECT type, count(*) AS n FROM r GROUP BY type), x AS (SELECT DISTINCT id, r.type, n FROM r JOIN f ON f.type = r.type), y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, type) AS k FROM x)
SELECT id, type FROM y WHERE k = 1""")
def most_frequent_type(table, spark):
    """Each entity's most frequent type."""
    return ranks.dominant_type(table("part").select(F.col("p_size").alias("id"), F.col("p_type").alias("type")))


@query("""WITH n AS (SELECT p_brand AS grp, p_type AS type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT grp, type, n, n >= 2 AND sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY grp) >= 2 AS header, CAST(row_number() OVER (PARTITION BY grp ORDER BY n DESC, type) AS INTEGER) AS position FROM n""")
def type_group_headers(table, spark):
    """Types that head their members."""
    return ranks.type_groups(table("part").select(F.col("p_brand").alias("grp"), F.col("p_type").alias("type")))


@query("""WITH e AS (SELECT user_id AS id, event_type AS type, value > 50 AS flag, CASE WHEN event_id % 2 = 0 THEN value END AS value, CAST(event_id % 4 AS VARCHAR) AS parent, event_id AS ord FROM events)
SELECT id, arg_min(type, coalesce(nullif(list_position(['purchase', 'signup', 'view'], type), 0), 4)::BIGINT * 1000000000 + ord) AS type, bool_or(flag) AS flag, arg_min(value, ord) FILTER (WHERE value IS NOT NULL) AS value, array_to_string(list_sort(list(DISTINCT parent)), ',') AS parents FROM e GROUP BY id""")
def entity_collapse_sticky(table, spark):
    """Rows of an entity made one."""
    e = table("events")
    return ranks.collapsed(e.select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), (F.col("value") > 50).alias("flag"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value"), (F.col("event_id") % 4).cast("string").alias("parent"), F.col("event_id").alias("ord")), ["purchase", "signup", "view"])


@query("""WITH d AS (SELECT source AS enum_key, regexp_extract(text, '[A-Za-z]+\\.$', 0) AS tail FROM documents) SELECT enum_key, tail, count(*) AS n FROM d WHERE tail <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_tail_hoist(table, spark):
    """Tails that several descriptions share."""
    return ranks.shared_tails(table("documents").select(F.col("source").alias("enum_key"), F.col("text").alias("description")), r"[A-Za-z]+\.$")


@query("""SELECT n_regionkey, CAST(CASE WHEN count(*) > 0 THEN floor(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*)) ELSE 0 END AS BIGINT) AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def coverage_pct(table, spark):
    """Whole percent of customers with a balance."""
    c = table("customer").join(F.broadcast(table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_regionkey").agg(ranks.percent(F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)), F.count("*")).alias("pct"))


# merging of two sources, parts of even and odd keys

def _two(table) -> DataFrame:
    p = table("part")
    return p.select(F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("source_key"), F.col("p_brand").alias("enum_key"), F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string")).alias("code"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 40, "obsolete").when(F.col("p_size") > 30, "Draft").alias("status"))


_TWO = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source_key, p_brand AS enum_key, 'c' || (p_partkey % 50) AS code, p_name AS title, CASE WHEN p_size > 40 THEN 'obsolete' WHEN p_size > 30 THEN 'Draft' END AS status FROM part"


@query(f"""WITH p AS ({_TWO}), inc AS (SELECT * FROM (VALUES ('odd', 'c1'), ('odd', 'c3'), ('even', 'c4')) v(source_key, code)), mi AS (SELECT * FROM (VALUES ('even', 'c4'), ('even', 'c6')) v(source_key, code))
SELECT p.* FROM p WHERE CASE WHEN source_key = 'odd' THEN code IN ('c1', 'c3') ELSE code = 'c4' OR code NOT IN ('c4', 'c6') END""")
def minus_include_merge(table, spark):
    """What inclusion and exclusion lists leave."""
    rows = lambda x: spark.createDataFrame(x, "source_key string, code string")
    return merge.included(_two(table), rows([("odd", "c1"), ("odd", "c3"), ("even", "c4")]), rows([("even", "c4"), ("even", "c6")]), ["source_key", "code"])


@query(f"WITH p AS ({_TWO}) SELECT * FROM p WHERE status IS NULL OR upper(status) NOT IN ('OBSOLETE', 'DRAFT')")
def minus_status(table, spark):
    """Values without those of some statuses."""
    return merge.without_status(_two(table), ["obsolete", "DRAFT"])


@query(f"""WITH p AS ({_TWO}) SELECT * FROM p WHERE (source_key, enum_key) NOT IN (SELECT 'odd', enum_key FROM p WHERE code = 'c1')""")
def minus_concepts(table, spark):
    """Enums that a list excludes."""
    p = _two(table)
    return merge.drop_listed(p, p.filter("code = 'c1'").select(F.lit("odd").alias("source_key"), "enum_key"), ["source_key", "enum_key"]).select(*p.columns)


@query("""WITH RECURSIVE t AS (SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_partkey >= 10 THEN CAST(p_partkey // 10 AS VARCHAR) END AS is_a, CAST(p_size // 20 AS VARCHAR) AS title FROM part),
d AS (SELECT t.*, coalesce(t.title = p.title, FALSE) AS dropped FROM t LEFT JOIN t p ON p.code = t.is_a),
up AS (SELECT code, is_a AS a, 1 AS n FROM d WHERE is_a IS NOT NULL UNION ALL SELECT up.code, d.is_a, n + 1 FROM up JOIN d ON d.code = up.a WHERE d.is_a IS NOT NULL),
near AS (SELECT up.code, arg_min(a, n) AS is_a FROM up JOIN d ON d.code = up.a WHERE NOT d.dropped GROUP BY up.code)
SELECT d.code, near.is_a FROM d LEFT JOIN near ON near.code = d.code WHERE NOT d.dropped""")
def concise_rewire(table, spark):
    """Values titled like their parent dropped, their children moved up."""
    p = table("part")
    tree = p.select(F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10).cast("string")).alias("is_a"), F.floor(F.col("p_size") / 20).cast("string").alias("title"))
    return hierarchy.surviving_parent(merge.concise(tree).select("code", "is_a", "dropped"))


_ENUMS = "SELECT CAST(n_nationkey AS VARCHAR) AS enum_key, CASE WHEN n_nationkey > 3 THEN CAST(n_nationkey // 2 AS VARCHAR) END AS is_a, 'src' || (n_nationkey % 4) AS source_key FROM nation"


def _enums(table) -> DataFrame:
    n = table("nation")
    return n.select(F.col("n_nationkey").cast("string").alias("enum_key"), F.when(F.col("n_nationkey") > 3, F.floor(F.col("n_nationkey") / 2).cast("string")).alias("is_a"), F.concat(F.lit("src"), F.col("n_nationkey") % 4).alias("source_key"))


@query(f"""WITH e AS ({_ENUMS}), f AS (SELECT * FROM e WHERE enum_key IN (SELECT CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_nationkey % 3 <> 0))
SELECT f.enum_key, f.source_key, g.enum_key AS is_a FROM f LEFT JOIN f g ON g.enum_key = f.is_a""")
def empty_enum_elim(table, spark):
    """Enums without values dropped."""
    s = table("supplier").filter("s_nationkey % 3 <> 0").select(F.col("s_nationkey").cast("string").alias("enum_key"))
    return merge.non_empty(_enums(table), s).select("enum_key", "source_key", "is_a")


@query(f"WITH e AS ({_ENUMS}) SELECT enum_key, is_a, source_key FROM e WHERE source_key NOT IN ('src0', 'src2')")
def orphan_enums(table, spark):
    """Enums of sources that aren't known."""
    return merge.orphans(_enums(table), spark.createDataFrame([("src0",), ("src2",)], "source_key string")).select("enum_key", "is_a", "source_key")


_SIDES = """o AS (SELECT 'k' || p_partkey AS key, 's' || (p_partkey % 3) AS owner, p_size, p_brand FROM part WHERE p_partkey % 5 <> 0),
n AS (SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE 's' || (p_partkey % 3) END AS owner, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 6 <> 0)"""


@query(f"""WITH {_SIDES} SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'add' WHEN n.key IS NULL THEN 'stale' WHEN o.owner <> n.owner THEN 'conflict' WHEN o.p_size = n.p_size AND o.p_brand = n.p_brand THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n ON o.key = n.key""")
def merge_actions(table, spark):
    """Adds, updates, conflicts and stale keys of a merge."""
    p = table("part")
    key, owner = F.concat(F.lit("k"), "p_partkey").alias("key"), F.concat(F.lit("s"), F.col("p_partkey") % 3)
    old = p.filter("p_partkey % 5 <> 0").select(key, owner.alias("owner"), "p_size", "p_brand")
    new = p.filter("p_partkey % 6 <> 0").select(key, F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(owner).alias("owner"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), "p_brand")
    return merge.actions(old, new, "key", "owner", ["p_size", "p_brand"])


_HOSTS = "SELECT page_id AS ord, substr(regexp_extract(url, '^[a-z]+://([^/.]+)', 1), 1, 4) AS prefix, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS uri FROM pages"


def _hosts(table) -> DataFrame:
    return table("pages").select(F.col("page_id").alias("ord"), F.substring(F.regexp_extract("url", r"^[a-z]+://([^/.]+)", 1), 1, 4).alias("prefix"), F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1).alias("uri"))


@query(f"WITH h AS ({_HOSTS}) SELECT prefix, count(DISTINCT uri) AS n, array_to_string(list_sort(list(DISTINCT uri)), ' ') AS uris FROM h GROUP BY prefix HAVING count(DISTINCT uri) > 1")
def prefix_conflicts(table, spark):
    """Prefixes with several URIs."""
    return merge.prefix_conflicts(_hosts(table))


@query(f"WITH h AS (SELECT CASE WHEN ord % 2 = 0 THEN upper(prefix) ELSE prefix END AS prefix, uri FROM ({_HOSTS}) x) SELECT lower(prefix) AS folded, count(DISTINCT prefix) AS spellings, count(DISTINCT uri) AS uris, count(DISTINCT lower(uri)) AS folded_uris, CASE WHEN count(DISTINCT uri) = 1 THEN 'same' WHEN count(DISTINCT lower(uri)) = 1 THEN 'case' ELSE 'differ' END AS kind FROM h GROUP BY lower(prefix)")
def prefix_case_fold(table, spark):
    """Prefixes that differ in case alone."""
    return merge.folded_prefixes(_hosts(table).withColumn("prefix", F.when(F.col("ord") % 2 == 0, F.upper("prefix")).otherwise(F.col("prefix"))))


@query(f"WITH h AS ({_HOSTS}) SELECT prefix, arg_max(uri, ord) AS uri FROM h GROUP BY prefix")
def prefix_sync(table, spark):
    """The last source's URI of each prefix."""
    return merge.last_prefixes(_hosts(table))


@query("""WITH p AS (SELECT * FROM (VALUES ('a', 'http://'), ('b', 'https://'), ('c', 'http://blog.'), ('d', 'https://m.')) v(prefix, uri)), u AS (SELECT DISTINCT url AS iri FROM pages),
m AS (SELECT iri, arg_max(prefix, len(uri)) AS prefix, max(len(uri)) AS n FROM u JOIN p ON starts_with(iri, uri) GROUP BY iri)
SELECT u.iri, prefix || ':' || substr(u.iri, CAST(n + 1 AS BIGINT)) AS curie FROM u LEFT JOIN m ON m.iri = u.iri""")
def curie_compress_longest(table, spark):
    """IRIs compressed by the longest URI."""
    p = spark.createDataFrame([("a", "http://"), ("b", "https://"), ("c", "http://blog."), ("d", "https://m.")], "prefix string, uri string")
    return mappings.longest_prefix(table("pages").select(F.col("url").alias("iri")).distinct(), p)


def _mappings(table) -> DataFrame:
    s = table("supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("subject_id"), F.when(F.col("s_suppkey") % 2 == 0, "skos:exactMatch").otherwise("skos:broader").alias("predicate_id"), F.concat(F.lit("S"), "s_suppkey").alias("object_id"), F.col("s_suppkey").alias("ord"))
    return s


_MAPPINGS = "SELECT 'N' || s_nationkey AS subject_id, CASE WHEN s_suppkey % 2 = 0 THEN 'skos:exactMatch' ELSE 'skos:broader' END AS predicate_id, 'S' || s_suppkey AS object_id, s_suppkey AS ord FROM supplier"


@query(f"WITH m AS ({_MAPPINGS}) SELECT subject_id, coalesce(array_to_string(list(object_id ORDER BY ord) FILTER (WHERE predicate_id = 'skos:exactMatch'), ','), '') AS \"exactMatch\", coalesce(array_to_string(list(object_id ORDER BY ord) FILTER (WHERE predicate_id = 'skos:broader'), ','), '') AS broader FROM m GROUP BY subject_id")
def sssom_pivot_mappings(table, spark):
    """Mapping rows as columns of their subject."""
    return mappings.pivoted(_mappings(table), ["skos:exactMatch", "skos:broader"])


@query(f"""WITH o AS ({_MAPPINGS}), n AS (SELECT subject_id, predicate_id, object_id, ord + 5000 AS ord FROM o WHERE ord % 3 = 0 UNION ALL SELECT subject_id, 'skos:narrower', object_id, ord + 9000 FROM o WHERE ord % 7 = 0)
SELECT subject_id, predicate_id, object_id, max(ord) AS ord FROM (SELECT * FROM o UNION ALL SELECT * FROM n) x GROUP BY 1, 2, 3""")
def sssom_merge_new_wins(table, spark):
    """Mappings merged, new ones winning."""
    o = _mappings(table)
    n = o.filter("ord % 3 = 0").withColumn("ord", F.col("ord") + 5000).unionByName(o.filter("ord % 7 = 0").withColumn("predicate_id", F.lit("skos:narrower")).withColumn("ord", F.col("ord") + 9000))
    return mappings.merged(o, n)


@query(f"WITH m AS ({_MAPPINGS}) SELECT subject_id, arg_min(object_id, ord) AS uri FROM m WHERE predicate_id = 'skos:exactMatch' GROUP BY subject_id")
def object_uri_first_exact(table, spark):
    """The first exact match of each subject."""
    return mappings.first_object(_mappings(table), "skos:exactMatch")


@query("""WITH l AS (SELECT source AS enum_key, CAST(doc_id // 4 AS VARCHAR) AS code, lang, doc_id, text AS title FROM documents),
loc AS (SELECT enum_key, code, lang, min(title) AS title FROM l GROUP BY 1, 2, 3), tr AS (SELECT enum_key, code, 'fr' AS lang, max('T' || doc_id) AS title FROM l WHERE doc_id % 3 = 0 GROUP BY 1, 2)
SELECT loc.* FROM loc LEFT JOIN tr USING (enum_key, code, lang) WHERE tr.title IS NULL UNION ALL SELECT * FROM tr""")
def translation_overlay(table, spark):
    """Translations put into locale rows."""
    l = table("documents").select(F.col("source").alias("enum_key"), F.floor(F.col("doc_id") / 4).cast("string").alias("code"), "lang", "doc_id", F.col("text").alias("title"))
    rows = l.filter("doc_id % 3 = 0").select(F.concat(F.lit("ns:src:"), "enum_key", F.lit(":choice:"), "code").alias("subject_id"), F.concat(F.lit('"T'), "doc_id", F.lit('"@fr')).alias("object_id"))
    return mappings.translated(l.groupBy("enum_key", "code", "lang").agg(F.min("title").alias("title")), rows)


@query("""WITH l AS (SELECT doc_id // 2 AS code, lang, CASE WHEN doc_id % 5 = 0 THEN 'same' ELSE text END AS title FROM documents), d AS (SELECT code, min(title) AS title FROM l WHERE lang = 'en' GROUP BY code)
SELECT l.code, l.lang, l.title FROM l LEFT JOIN d ON d.code = l.code WHERE l.title IS DISTINCT FROM d.title""")
def locale_delta(table, spark):
    """Labels that differ from the default language's."""
    l = table("documents").select(F.floor(F.col("doc_id") / 2).alias("code"), "lang", F.when(F.col("doc_id") % 5 == 0, "same").otherwise(F.col("text")).alias("title"))
    return merge.locale_delta(l, l.filter("lang = 'en'").groupBy("code").agg(F.min("title").alias("title")), ["code"])


@query("""SELECT s_suppkey AS code, 'skos:broader' AS predicate_id, u.o AS object_id FROM supplier JOIN nation ON s_nationkey = n_nationkey, unnest(list_filter([CASE WHEN s_suppkey % 3 <> 0 THEN 'N' || s_nationkey END, 'R' || n_regionkey], lambda x: x IS NOT NULL)) AS u(o)""")
def containment_rows(table, spark):
    """skos:broader rows of places."""
    s = table("supplier").join(F.broadcast(table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = mappings.containment(s.select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("N"), "s_nationkey")).alias("adm2"), F.concat(F.lit("R"), "n_regionkey").alias("adm1")))
    return rows.withColumnRenamed("subject_id", "code")


@query("SELECT p_partkey, p_size, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'small' WHEN p_size BETWEEN 10 AND 29 THEN 'medium' WHEN p_size BETWEEN 40 AND 50 THEN 'large' END AS category FROM part")
def range_bucket_category(table, spark):
    """Categories of numbers by range."""
    ranges = spark.createDataFrame([(1, 9, "small"), (10, 29, "medium"), (40, 50, "large")], "lo int, hi int, category string")
    return matching.range_bucket(table("part").select("p_partkey", "p_size"), ranges, "p_size")


@query("""SELECT c_custkey, coalesce(s.v, n.n_name, r.r_name) AS value, CASE WHEN s.v IS NOT NULL THEN 1 WHEN n.n_name IS NOT NULL THEN 2 WHEN r.r_name IS NOT NULL THEN 3 END AS stage
FROM customer LEFT JOIN (SELECT s_suppkey, s_name AS v FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) n ON n.n_nationkey = c_nationkey LEFT JOIN region r ON r.r_regionkey = c_nationkey % 5""")
def enrichment_cascade(table, spark):
    """A first map, a fallback and a third."""
    c = table("customer").withColumn("reg", F.col("c_nationkey") % 5)
    maps = [
        (table("supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")), "c_custkey"),
        (table("nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), "c_nationkey"),
        (table("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value")), "reg"),
    ]
    return matching.cascade(c, *maps).select("c_custkey", "value", "stage")


@query("""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, CAST(u.place AS INTEGER) AS place, u.text AS asked, a.text AS told FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.place = u.place""")
def positional_join(table, spark):
    """Questions and answers paired by their place."""
    c = table("conversations")
    u = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("t1"), F.col("text").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("t2"), F.col("text").alias("told"))
    return matching.positional(u, a, "conv_id", "t1", "t2").select("conv_id", "place", "asked", "told")


@query(f"""WITH a AS (SELECT item_id AS lid, {_sql_tokens("split_part(text, '.', 1)")} AS lt FROM benchmark), b AS (SELECT doc_id AS rid, {_sql_tokens("split_part(text, '.', 1)")} AS rt FROM documents),
s AS (SELECT lid, rid, round(len(list_intersect(lt, rt)) / len(list_distinct(list_concat(lt, rt))), 4) AS score FROM a, b WHERE len(list_intersect(lt, rt)) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid) AS n FROM s WHERE score >= 0.2), g AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, lid) AS m FROM f WHERE n = 1)
SELECT lid, rid, score FROM g WHERE m = 1""")
def jaccard_assignment(table, spark):
    """Items and documents paired one to one by token Jaccard."""
    b = table("benchmark").select(F.col("item_id").alias("id"), F.substring_index("text", ".", 1).alias("title"))
    d = table("documents").select(F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("title"))
    return matching.assigned(b, d, 0.2)


@query()
def fuzzy_best_match(table, spark):
    """Names of parts matched with the types of parts by sequence ratio."""
    part = table("part")
    types = part.select("p_type").distinct().select((F.row_number().over(Window.orderBy("p_type")) - 1).alias("ord"), F.col("p_type").alias("key"), F.col("p_type").alias("text"))
    return matching.best_ratio(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), types)


_SCALE = [("quality", "ing"), ("quality", "tion"), ("size", "ment"), ("size", "eau"), ("time", "keit"), ("time", "ung")]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _SCALE)}) v(dimension, word)), h AS (SELECT doc_id AS id, dimension, CAST(count(*) AS DOUBLE) AS score FROM documents JOIN s ON contains(lower(text), word) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, dimension) AS n FROM h)
SELECT id, dimension, score FROM r WHERE n = 1""")
def scale_dimension_match(table, spark):
    """The rating scale that a text's words are of."""
    return matching.scale_matches(table("documents").select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame(_SCALE, "dimension string, word string"))


@query("SELECT item_id, (SELECT count(*) FROM documents d WHERE contains(lower(d.text), lower(b.text))) AS n FROM benchmark b")
def grounding_counts(table, spark):
    """In how many documents an item is literally found."""
    return matching.grounded(table("benchmark"), table("documents").select("doc_id", "text"))


@query("""WITH o AS (SELECT source AS enum_key, CAST(doc_id // 2 AS VARCHAR) AS code, text AS title FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 0), n AS (SELECT o.enum_key, o.code, CASE WHEN len(o.code) = 2 THEN upper(o.title) ELSE o.title END AS title FROM o WHERE o.code NOT LIKE '%7' UNION ALL SELECT 'new', CAST(doc_id AS VARCHAR), 'x' FROM documents WHERE doc_id < 20)
SELECT * FROM (SELECT coalesce(o.enum_key, n.enum_key) AS enum_key, coalesce(o.code, n.code) AS code, CASE WHEN o.code IS NULL THEN 'added' WHEN n.code IS NULL THEN 'removed' WHEN o.title IS DISTINCT FROM n.title THEN 'retitled' END AS action FROM o FULL JOIN n ON o.enum_key = n.enum_key AND o.code = n.code) x WHERE action IS NOT NULL""")
def schema_diff(table, spark):
    """Added, removed and retitled values."""
    d = table("documents")
    o = d.filter("doc_id % 2 = 0 AND doc_id % 10 <> 0").select(F.col("source").alias("enum_key"), F.floor(F.col("doc_id") / 2).cast("string").alias("code"), F.col("text").alias("title"))
    n = o.filter("code NOT LIKE '%7'").withColumn("title", F.when(F.length("code") == 2, F.upper("title")).otherwise(F.col("title")))
    n = n.unionByName(d.filter("doc_id < 20").select(F.lit("new").alias("enum_key"), F.col("doc_id").cast("string").alias("code"), F.lit("x").alias("title")))
    return merge.schema_diff(o, n)


@query("""SELECT p_partkey, CAST(p_partkey AS INTEGER) AS number, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE '' END AS letter, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 9 END AS INTEGER) AS numeral FROM part""")
def code_sort_tuple(table, spark):
    """Codes like 160b(i) as sort keys."""
    p = table("part")
    code = F.concat(F.lit("E"), "p_partkey", F.when(F.col("p_size") % 2 == 0, "b").otherwise(""), F.when(F.col("p_size") % 4 == 0, "(i)").when(F.col("p_size") % 4 == 1, "(iv)").when(F.col("p_size") % 4 == 2, "").otherwise("(ix)"))
    return p.select("p_partkey", t.code_number(code).alias("number"), t.code_letter(code).alias("letter"), t.roman(code).alias("numeral"))


@query("""WITH d AS (SELECT source, doc_id, n_chars AS size, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) SELECT source, doc_id, size, size > 0 AND (before IS NULL OR size * 5 > before * 4) AS size_ok FROM d""")
def size_guard(table, spark):
    """New versions that aren't much smaller than those before."""
    d = table("documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return merge.size_guard(d, Window.partitionBy("source").orderBy("doc_id"))


@query("""WITH e AS (SELECT DISTINCT p_type AS enum_key FROM part) SELECT lower(left(enum_key, 1)) || substr(enum_key, 2) AS name, enum_key AS "range" FROM e WHERE lower(left(enum_key, 1)) || substr(enum_key, 2) NOT IN (SELECT lower(left(enum_key, 1)) || substr(enum_key, 2) FROM e WHERE len(enum_key) % 2 = 0)""")
def auto_slots(table, spark):
    """Slots for enums that have none."""
    e = table("part").select(F.col("p_type").alias("enum_key")).distinct()
    slots = e.filter("length(enum_key) % 2 = 0").select(F.concat(F.lower(F.substring("enum_key", 1, 1)), F.expr("substring(enum_key, 2)")).alias("name"))
    return merge.auto_slots(e, slots)


@query("""SELECT o_orderstatus AS source_key, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH" FROM orders GROUP BY 1""")
def build_report(table, spark):
    """Actions counted by source."""
    return merge.build_report(table("orders").select(F.col("o_orderstatus").alias("source_key"), F.col("o_orderpriority").alias("action")), ["1-URGENT", "2-HIGH"])


@query("""SELECT coalesce(n_name, '(total)') AS enum_key, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name)""")
def lookup_report(table, spark):
    """Values counted by enum, with a total."""
    c = table("customer").join(F.broadcast(table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_name").agg(F.count("*").alias("n")).select(F.coalesce("n_name", F.lit("(total)")).alias("enum_key"), "n")


# sources, reports and streams

@query("""SELECT page_id, CASE WHEN regexp_matches(url, '\\.html($|\\?)') THEN 'page' WHEN regexp_matches(url, '(?i)/en/') THEN 'english' WHEN regexp_matches(html, '(?is)<html lang=.fr') THEN 'french' ELSE 'other' END AS kind FROM pages""")
def source_detect_rules(table, spark):
    """Kinds of sources by the first rule that matches URL or head."""
    p = table("pages")
    rules = [("url", r"\.html($|\?)", "page"), ("url", r"(?i)/en/", "english"), ("head", r"(?is)<html lang=.fr", "french")]
    return p.select("page_id", readers.content_type(F.col("url"), "html", rules, "other").alias("kind"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_activity(table, spark):
    """Events by hour and type; the same on a stream."""
    return index.activity(table("events")).withColumn("total", F.round("total", 4))


@query("""SELECT s_suppkey, CASE WHEN n_nationkey % 6 = 0 THEN 'territory' WHEN n_regionkey = 2 THEN 'sovereign' WHEN s_acctbal < 0 THEN 'disputed' WHEN s_suppkey % 2 = 0 THEN 'sovereign' ELSE 'unknown' END AS kind FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def sovereignty_rules(table, spark):
    """Ordered rules over joined facts."""
    s = table("supplier").join(F.broadcast(table("nation")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    kind = F.when(F.col("n_nationkey") % 6 == 0, "territory").when(F.col("n_regionkey") == 2, "sovereign").when(F.col("s_acctbal") < 0, "disputed").when(F.col("s_suppkey") % 2 == 0, "sovereign").otherwise("unknown")
    return s.select("s_suppkey", kind.alias("kind"))


@query("""SELECT doc_id // 4 AS id, max(CASE WHEN lang = 'en' THEN text END) AS en, max(CASE WHEN lang = 'fr' THEN text END) AS fr FROM documents GROUP BY 1""")
def locale_pivot(table, spark):
    """A column of titles for each language."""
    d = table("documents").select(F.floor(F.col("doc_id") / 4).alias("id"), "lang", F.col("text").alias("title"))
    return d.groupBy("id").pivot("lang", ["en", "fr"]).agg(F.max("title"))


@query("""WITH r AS (SELECT DISTINCT p_brand, p_type FROM part), l AS (SELECT p_brand AS enum_key, list_sort(list(p_type)) AS ts FROM r GROUP BY 1)
SELECT enum_key, CASE len(ts) WHEN 1 THEN ts[1] WHEN 2 THEN ts[1] || ' or ' || ts[2] ELSE array_to_string(ts[1 : len(ts) - 1], ', ') || ', or ' || ts[len(ts)] END || ' of ' || enum_key AS title FROM l""")
def enum_title_synthesis(table, spark):
    """Titles made of an enum's types."""
    return ranks.titles(table("part").select(F.col("p_brand").alias("enum_key"), F.col("p_type").alias("type")))


@query("""WITH y AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?:19|20)[0-9]{2}'), lambda x: CAST(x AS INTEGER)) AS ys FROM pages) SELECT page_id, list_max(ys) AS year FROM y""")
def max_year(table, spark):
    """The latest year that a page names."""
    return table("pages").select("page_id", F.array_max(F.transform(F.regexp_extract_all("html", F.lit("(?:19|20)[0-9]{2}"), F.lit(0)), lambda x: x.cast("int"))).alias("year"))


@query("""SELECT p_brand AS code, arg_max(p_name, p_partkey) AS title, min(p_partkey) AS ord FROM part GROUP BY 1""")
def last_value_first_place(table, spark):
    """Of repeated keys the last value at the first place."""
    return merge.last_value_first_place(table("part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord")), "code", "title", "ord")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_size, p_partkey) AS n FROM part) SELECT p_partkey, p_type, p_size FROM r WHERE n = 1""")
def first_wins_dedup(table, spark):
    """The first of keys that differ in case alone."""
    return merge.first_wins(table("part").select("p_partkey", "p_type", "p_size"), F.lower("p_type"), ["p_size", "p_partkey"])


@query("""SELECT p_brand AS enum_key, '{"name":"' || p_brand || '","rows":[' || string_agg('{"code":"' || p_partkey || '","title":"' || p_name || '"}', ',' ORDER BY p_partkey) || ']}' AS json FROM part GROUP BY 1""")
def picklist_rows(table, spark):
    """Enums as JSON texts."""
    p = table("part").select(F.col("p_brand").alias("enum_key"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("title"))
    return sinks.picklists(p.select("enum_key").distinct(), p)


@query("""SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]+')[1] AS first FROM documents WHERE regexp_matches(text, '^[^.!?]+[.!?]')""")
def first_sentence(table, spark):
    """The first sentence of each text that has one."""
    d = table("documents").filter(F.rlike("text", F.lit(r"^[^.!?]+[.!?]")))
    return d.select("doc_id", F.element_at(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]+"), F.lit(0)), 1).alias("first"))


@query("""WITH x AS (SELECT p_partkey, p_name || ' - ' || p_brand AS phrase FROM part), w AS (SELECT p_partkey, list_filter(string_split_regex(phrase, '[^A-Za-z0-9]+'), lambda x: x <> '') AS ws FROM x)
SELECT p_partkey, array_to_string(list_transform(ws, lambda x: CASE WHEN len(x) > 1 AND upper(x) = x AND regexp_matches(x, '[A-Z]') THEN x ELSE upper(left(x, 1)) || lower(substr(x, 2)) END), '') AS key FROM w""")
def pascal_keys(table, spark):
    """Phrases as identifiers."""
    return table("part").select("p_partkey", t.pascal_key(F.concat("p_name", F.lit(" - "), "p_brand")).alias("key"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN FALSE WHEN n_nationkey % 3 = 1 THEN TRUE ELSE FALSE END AS curie FROM nation""")
def curie_test(table, spark):
    """Which identifiers are CURIEs."""
    n = table("nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("http://x.org/"), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("N:"), "n_name")).otherwise(F.concat(F.lit(":"), "n_name"))
    return n.select("n_nationkey", t.is_curie(text).alias("curie"))


# upkeep

@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^.*T.[A-Z].*$')")
def wildcard_keys(table, spark):
    """Keys that match a shell pattern."""
    return upkeep.selected(table("part").select("p_partkey", "p_type"), "p_type", "*T?[A-Z]*")


@query("""WITH w AS (SELECT DISTINCT word FROM (SELECT p_brand AS word FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT 'none') x)
SELECT word, CASE WHEN word IN (SELECT p_brand FROM part) THEN 'source' WHEN word IN (SELECT n_name FROM nation WHERE n_nationkey < 9) THEN 'enum' ELSE 'unknown' END AS kind FROM w""")
def lookup_arguments(table, spark):
    """Which words are sources, which are enums."""
    p, n = table("part"), table("nation")
    words = p.select(F.col("p_brand").alias("word")).union(n.select("n_name")).union(spark.createDataFrame([("none",)], "word string")).distinct()
    return upkeep.split_arguments(words, p.select(F.col("p_brand").alias("source_key")), n.filter("n_nationkey < 9").select(F.col("n_name").alias("enum_key")))


@query("SELECT source AS source_key, doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def delete_source(table, spark):
    """Rows without those of deleted sources."""
    return upkeep.without_source(table("documents").select(F.col("source").alias("source_key"), "doc_id"), ["src1", "src2"])


@query("SELECT CASE WHEN r_name = (SELECT min(r_name) FROM region) THEN 'NEW' ELSE r_name END AS key, CAST(r_regionkey AS INTEGER) AS ord, CASE WHEN r_name = (SELECT min(r_name) FROM region) THEN '2' ELSE 'v' || r_regionkey END AS version FROM region")
def config_upsert(table, spark):
    """A configuration entry renamed and set in its place."""
    r = table("region")
    first = r.agg(F.min("r_name")).first()[0]
    return upkeep.renamed(r.select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("ord"), F.concat(F.lit("v"), "r_regionkey").alias("version")), first, "NEW", {"version": "2"})


@query("SELECT p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 ELSE p_size END AS rank FROM part")
def rank_preservation(table, spark):
    """Ranks that users gave kept over a refresh."""
    p = table("part").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("rank"))
    return upkeep.refreshed(p, p.filter("code % 3 = 0").withColumn("rank", F.col("rank") * 100), "code", "rank")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name ELSE 'old' END AS comments FROM nation")
def registry_column_update(table, spark):
    """A column replaced where the update says something."""
    n = table("nation")
    updates = n.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("new "), "n_name")).when(F.col("n_nationkey") % 4 == 1, " ").alias("comments"))
    return upkeep.overwritten(n.select("n_nationkey", F.lit("old").alias("comments")), updates, "n_nationkey", "comments")


@query("SELECT o_custkey AS header, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'historical' END AS status FROM orders GROUP BY 1")
def historical_rollup(table, spark):
    """Headers whose members are all historical."""
    return upkeep.historical_headers(table("orders").select(F.col("o_custkey").alias("header"), F.when(F.col("o_orderstatus") == "F", "historical").alias("status")))


@query("SELECT 'N' || n_nationkey AS iri, n_nationkey % 4 = 1 AS deprecated, CASE WHEN n_regionkey = 3 THEN 'OBSOLETE' WHEN n_nationkey % 4 = 1 THEN 'DEPRECATED' END AS status FROM nation")
def obsolete_detection(table, spark):
    """Nodes under the root of obsolete classes, and deprecated ones."""
    n = table("nation")
    iri = F.concat(F.lit("N"), "n_nationkey")
    return upkeep.obsolete(n.select(iri.alias("iri"), (F.col("n_nationkey") % 4 == 1).alias("deprecated")), n.select(iri.alias("source"), F.concat(F.lit("R"), "n_regionkey").alias("target")), "R3")


@query("""WITH u AS (SELECT p_brand AS code, max('made of tin') AS description, list_sort(list(DISTINCT split_part(p_type, ' ', 1))) AS us FROM part GROUP BY 1), n AS (SELECT code, description, list_filter(us, lambda x: NOT contains(lower(description), lower(x))) AS us FROM u)
SELECT code, CASE WHEN len(us) > 0 THEN description || '; ' || array_to_string(us, ', ') ELSE description END AS description FROM n""")
def set_concat_uses(table, spark):
    """Uses joined to the descriptions that don't name them."""
    return upkeep.joined_uses(table("part").select(F.col("p_brand").alias("code"), F.lit("made of tin").alias("description"), F.substring_index("p_type", " ", 1).alias("use")))


@query("""WITH h AS (SELECT r_name AS enum_key, TRUE AS is_header, r_name AS code, 'region ' || r_name AS title, -1 AS ord FROM region UNION ALL SELECT r_name, FALSE, 'N' || n_nationkey, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT enum_key, CAST(row_number() OVER (PARTITION BY enum_key ORDER BY is_header DESC, ord) AS INTEGER) AS position, is_header, code, title FROM h""")
def section_views(table, spark):
    """Enums with their values below."""
    r, n = table("region"), table("nation")
    enums = r.select(F.col("r_name").alias("enum_key"), F.concat(F.lit("region "), "r_name").alias("title"), F.col("r_regionkey").alias("ord"))
    pvs = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("enum_key"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("ord"))
    return upkeep.section_view(enums, pvs)


@query("SELECT DISTINCT p_brand AS prefix, CASE WHEN right(p_brand, 1) = '1' THEN 'one' WHEN right(p_brand, 1) = '2' THEN 'two' ELSE 'default' END AS api FROM part")
def api_router(table, spark):
    """The API that serves a prefix."""
    b = table("part").select(F.col("p_brand").alias("prefix")).distinct()
    apis = b.filter("right(prefix, 1) = '1'").select(F.lit("one").alias("api"), F.lit(1).alias("ord"), F.upper("prefix").alias("prefix"))
    apis = apis.unionByName(b.filter("right(prefix, 1) IN ('1', '2')").select(F.lit("two").alias("api"), F.lit(2).alias("ord"), "prefix"))
    return upkeep.routed(b, apis, "default")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) SELECT k, 'both' AS side FROM (SELECT k FROM o INTERSECT SELECT k FROM c) x UNION ALL SELECT k, 'left' FROM (SELECT k FROM o EXCEPT SELECT k FROM c) y UNION ALL SELECT k, 'right' FROM (SELECT k FROM c EXCEPT SELECT k FROM o) z""")
def key_set_drift(table, spark):
    """Keys on both sides, on the left and on the right alone."""
    o, c = table("orders").select(F.col("o_custkey").alias("k")), table("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    side = lambda d, name: d.withColumn("side", F.lit(name))
    return side(o.intersect(c), "both").union(side(o.subtract(c), "left")).union(side(c.subtract(o), "right"))


@query("""SELECT source AS subject, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS first FROM documents GROUP BY 1""")
def catalog_groups(table, spark):
    """Entries of a catalogue by subject."""
    return ranks.first_members(table("documents").select(F.col("source").alias("subject"), F.col("doc_id").alias("id")), 3)


@query("SELECT CAST(max(p_partkey) + 1 AS BIGINT) AS next_id FROM part")
def picklist_next_id(table, spark):
    """The id of the next picklist."""
    return table("part").agg((F.max("p_partkey") + 1).cast("long").alias("next_id"))
