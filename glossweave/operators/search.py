"""Search over terms: token overlap, BM25 and what follows a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..plans.stages import bounded, kept

K1, B = 1.2, 0.75


def with_tokens(terms: DataFrame) -> DataFrame:
    return terms.withColumn("label_tokens", t.tokens(F.col("label"))).withColumn("definition_tokens", t.tokens(F.col("definition")))


def overlap_search(queries: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """For each query (qid, term) the k terms (id, type, label, definition) of the best score over 0.

    The queries are a stated set, given by a user: phrases may begin inside words, so each is looked for in every term.
    Tokens of a term are taken once, its scores are computed in one row, and only those over 0 become rows.
    """
    asked = queries.select("qid", "term").withColumn("query_tokens", t.tokens(F.col("term")))
    scored = with_tokens(terms).crossJoin(bounded(asked))
    score = t.match_score(F.col("query_tokens"), F.col("term"), F.col("label"), F.col("definition"), F.col("label_tokens"), F.col("definition_tokens"))
    return top_k(scored.withColumn("score", F.round(score, 4)).filter("score > 0").select("qid", "id", "type", "score"), k)


def top_k(matches: DataFrame, k: int, pooled: bool = False) -> DataFrame:
    """The first k matches of each query: by score, enums first among equals, or, pooled, enums first and then by score."""
    enum_first, best = F.when(F.col("type") == "enum", 0).otherwise(1), F.desc("score")
    order = [enum_first, best] if pooled else [best, enum_first]
    w = Window.partitionBy("qid").orderBy(*order, F.lower("id"), "id")
    return matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(terms: DataFrame) -> DataFrame:
    """(id, word, f, len): how often each document has each word, and its number of words."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "label", "definition")), F.lit("[a-z0-9]+"), F.lit(0))
    each = terms.select("id", words.alias("words"))
    return each.select("id", F.size("words").alias("len"), F.explode("words").alias("word")).groupBy("id", "word", "len").agg(F.count("*").alias("f"))


def bm25_all(queries: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """BM25 of the documents that have all words of a query; words (qid, word) are distinct.

    Words that no query has are left out before anything is exploded or shuffled.
    """
    queries = bounded(queries)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "label", "definition")), F.lit("[a-z0-9]+"), F.lit(0))
    wanted = F.broadcast(queries.agg(F.collect_set("word").alias("_wanted")))  # one row, of a set whose size is checked
    each = terms.select("id", words.alias("words")).crossJoin(wanted)
    each = each.select("id", F.size("words").alias("len"), F.explode(F.filter("words", lambda w: F.array_contains("_wanted", w))).alias("word"))
    posted = each.groupBy("id", "word", "len").agg(F.count("*").alias("f"))
    stats = terms.select(F.size(F.regexp_extract_all(F.lower(F.concat_ws(" ", "label", "definition")), F.lit("[a-z0-9]+"), F.lit(0))).alias("len")).agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    df = posted.groupBy("word").agg(F.count("*").alias("df"))
    needed = queries.groupBy("qid").agg(F.count("*").alias("needed"))
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    rows = posted.join(F.broadcast(df), "word").join(queries, "word").crossJoin(F.broadcast(stats)).withColumn("part", part)
    found = rows.groupBy("qid", "id").agg(F.sum("part").alias("score"), F.count("*").alias("n")).join(F.broadcast(needed), "qid").filter("n = needed")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 4)), "id")
    return found.select("qid", "id", F.round("score", 4).alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_sources(matches: DataFrame) -> DataFrame:
    """One row per (qid, id): best score, sources in order, whether any was verbatim, the first definition."""
    return matches.groupBy("qid", "id").agg(
        F.max("score").alias("score"),
        F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"),
        F.bool_or("verbatim").alias("verbatim"),
        F.min_by("definition", F.when(t.text_of(F.col("definition")) != "", F.col("ord"))).alias("definition"),
    )


def prefer_owner(rows: DataFrame) -> DataFrame:
    """For each id the row whose ontology is the id's prefix, else the first."""
    owns = F.lower(F.substring_index("id", ":", 1)) == F.lower("ontology")
    w = Window.partitionBy("id").orderBy(F.when(owns, 0).otherwise(1), "ord")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(index: DataFrame, fresh: DataFrame, key: str = "source_key") -> DataFrame:
    """The index with the rows of each source of fresh replaced by fresh's."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def index_rows(enums: DataFrame, pvs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(source_key, id, type, parent, term_uri, label, definition): a row for each enum, each value and each entry of a catalogue.

    enums (source_key, enum_key, title, description); pvs (source_key, enum_key, code, title, description, meaning); catalog (key, subject,
    url, title, entry_type). A title that is missing is the key or code.
    """
    empty = F.lit("")
    name = F.coalesce(F.nullif("title", empty), "enum_key")
    rows = enums.select("source_key", F.col("enum_key").alias("id"), F.lit("enum").alias("type"), empty.alias("parent"), empty.alias("term_uri"), name.alias("label"), t.text_of(F.col("description")).alias("definition"))
    heads = enums.select("source_key", "enum_key", name.alias("_parent"))
    values = pvs.join(heads, ["source_key", "enum_key"]).select("source_key", F.col("code").alias("id"), F.lit("term").alias("type"), F.col("_parent").alias("parent"), t.text_of(F.col("meaning")).alias("term_uri"), F.coalesce(F.nullif("title", empty), "code").alias("label"), t.text_of(F.col("description")).alias("definition"))
    entries = catalog.select(F.lit("__statscan_catalog__").alias("source_key"), t.text_of(F.col("key")).alias("id"), F.lit("catalog").alias("type"), t.text_of(F.col("subject")).alias("parent"), t.text_of(F.col("url")).alias("term_uri"), t.text_of(F.col("title")).alias("label"), t.text_of(F.col("entry_type")).alias("definition"))
    return rows.unionByName(values).unionByName(entries)


OVERFETCH, STEM_CAP = 3, 0.85


def stem_postings(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, len, stem, f): how often each document has the stems of asked, and its number of words.

    The list of a document's words ends here: neither the rows of single words nor those sent to Python carry it.
    """
    from ..functions.stem import stem

    begins = F.broadcast(asked.agg(F.collect_set(F.expr("substring(stem, 1, greatest(length(stem) - 1, 1))")).alias("_begins")))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "label", "definition")), F.lit("[a-z0-9]+"), F.lit(0))
    each = terms.select("id", words.alias("words")).crossJoin(begins)
    near = F.filter("words", lambda w: F.exists("_begins", lambda b: F.startswith(w, b)))
    each = each.select("id", F.size("words").alias("len"), near.alias("near")).filter(F.size("near") > 0)
    found = each.select("id", "len", F.explode("near").alias("word")).withColumn("stem", stem("word"))
    return found.join(F.broadcast(asked.select("stem").distinct()), "stem", "left_semi").groupBy("id", "len", "stem").agg(F.count("*").alias("f"))


def ranked_search(queries: DataFrame, terms: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, type, score, rank): terms (id, type, label, definition) that have the stems of all of a query's words.

    The 3 k best by BM25 over stems are scored anew: the greater of the phrase and token score and of 0.85 times their share of the best
    BM25. Words of terms are stemmed only if they begin like a stem that is looked for, but for its last letter, which a
    stemmer may change; the others only count for the length.
    """
    from ..functions.stem import stem

    word = F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("term"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*t.STOPWORDS)))).alias("word")
    asked = bounded(queries.select("qid", "term", word).withColumn("stem", stem("word")).select("qid", "term", "stem").distinct())
    posted = kept(stem_postings(asked, terms))
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "label", "definition")), F.lit("[a-z0-9]+"), F.lit(0))
    stats = terms.select(F.size(words).alias("len")).agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    df = posted.groupBy("stem").agg(F.count("*").alias("df"))
    needed = asked.groupBy("qid").agg(F.count("*").alias("needed"))
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    rows = posted.join(F.broadcast(df), "stem").join(asked, "stem").crossJoin(F.broadcast(stats)).withColumn("part", part)
    every = rows.groupBy("qid", "term", "id").agg(F.sum("part").alias("bm25"), F.count("*").alias("n")).join(F.broadcast(needed), "qid").filter("n = needed")
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("bm25", 9)), "id")
    few = every.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= OVERFETCH * k).withColumn("_best", F.max("bm25").over(Window.partitionBy("qid")))
    # the texts stay where they are: only the candidates travel
    full = with_tokens(terms.join(bounded(few), "id").withColumn("label", F.concat_ws(" ", "id", "label"))).withColumn("query_tokens", t.tokens(F.col("term")))
    token = t.match_score(F.col("query_tokens"), F.col("term"), F.col("label"), F.col("definition"), F.col("label_tokens"), F.col("definition_tokens"))
    score = F.round(F.greatest(token, F.col("bm25") / F.col("_best") * STEM_CAP), 4)
    return top_k(full.withColumn("score", score).filter("score > 0").select("qid", "id", "type", "score"), k)


def pooled(matches: DataFrame, origin: DataFrame) -> DataFrame:
    """Matches of expanded queries (qid, id, score) given to the queries that they come from (qid, orig): the best score of each id."""
    return matches.join(bounded(origin), "qid").groupBy(F.col("orig").alias("qid"), "id").agg(F.max("score").alias("score"))


def overfetched(matches: DataFrame, k: int) -> DataFrame:
    """The first 3 k matches (qid, id, rank_score) of each query, the lowest rank score first."""
    w = Window.partitionBy("qid").orderBy("rank_score", "id")
    return matches.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= OVERFETCH * k)
