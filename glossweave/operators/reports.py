"""Reports: search results in three formats, enums, section views, picklists against a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..plans.stages import bounded


def search_report(queries: DataFrame, matches: DataFrame, children: DataFrame) -> DataFrame:
    """(qid, rank, text, tsv, markdown): a line of each format for each match (qid, rank, id, label, definition, score) with the number
    of its children (id, n), and one `(no matches)` line for each query (qid, term) without any."""
    rows = matches.join(children.select("id", F.col("n").alias("_n")), "id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    every = bounded(queries.select("qid", "term")).join(rows, "qid", "left")
    none, score = F.col("id").isNull(), F.format_number("score", 2)
    clip = t.truncated(t.text_of(F.col("definition")))
    words = F.array_join(F.regexp_extract_all(F.lower("term"), F.lit("[a-z0-9]+"), F.lit(0)), "|")
    bold = F.when(words != "", F.regexp_replace(t.text_of(F.col("label")), F.concat(F.lit(r"(?i)\b("), words, F.lit(r")\b")), F.lit("**$1**"))).otherwise(F.col("label"))
    return every.select(
        "qid",
        F.coalesce("rank", F.lit(0)).alias("rank"),
        F.when(none, F.concat("term", F.lit(": (no matches)"))).otherwise(F.concat(score, F.lit("  "), F.col("id"), F.lit("  "), t.text_of(F.col("label")), F.lit(" ["), F.col("_n").cast("string"), F.lit("]"))).alias("text"),
        F.when(none, F.concat_ws("\t", "term", F.lit("(no matches)"))).otherwise(F.concat_ws("\t", "term", "id", t.text_of(F.col("label")), F.regexp_replace(clip, r"[\t\n]", " "), score, F.col("_n").cast("string"))).alias("tsv"),
        F.when(none, F.concat(F.lit("| "), t.cell(F.col("term")), F.lit(" | (no matches) | |"))).otherwise(F.concat(F.lit("| "), t.cell(F.col("id")), F.lit(" | "), t.cell(bold), F.lit(" | "), score, F.lit(" |"))).alias("markdown"),
    )


def enum_report(enums: DataFrame) -> DataFrame:
    """enums (source_domain, source_schema, enum_key, title) with their line's number in the order of these."""
    cols = ["source_domain", "source_schema", "enum_key", "title"]
    return enums.select(*cols, F.concat_ws("\t", *(t.text_of(F.col(c)) for c in cols)).alias("line"))


def merged_view(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """All values of several enums as one, (position, code, title): the first of equal codes stays. enums (enum_key, ord), pvs (enum_key, ord, code, title)."""
    rows = pvs.join(bounded(enums.select("enum_key", F.col("ord").alias("_e"))), "enum_key")
    first = rows.groupBy("code").agg(F.min(F.struct("_e", "ord", "title")).alias("_f"))
    return first.select("code", F.col("_f.title").alias("title"), F.col("_f._e").alias("enum_ord"), F.col("_f.ord").alias("ord"))


def separate_view(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """(enum_key, position, code, title): each enum by itself, numbered from 1."""
    w = Window.partitionBy("enum_key").orderBy("ord", "code")
    return pvs.join(enums.select("enum_key").distinct(), "enum_key", "left_semi").select("enum_key", F.row_number().over(w).alias("position"), "code", "title")


def hierarchy_view(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """(code, is_a, title, depth): enums become values that their own values hang from."""
    heads = enums.select(F.col("enum_key").alias("code"), F.lit(None).cast("string").alias("is_a"), "title", F.lit(0).alias("depth"))
    return heads.unionByName(pvs.join(enums.select("enum_key").distinct(), "enum_key", "left_semi").select("code", F.col("enum_key").alias("is_a"), "title", F.lit(1).alias("depth")))


def calibrated(picklist: DataFrame, schema: DataFrame) -> DataFrame:
    """What of a picklist (enum_key, code, en, fr) differs from the schema (enum_key, code, title): (enum_key, code, en, was_en, fr).

    An English title stays only where it is another than the schema's, with that one beside it; French ones go to mappings.
    Values that the schema lacks keep their title.
    """
    both = picklist.join(schema.select("enum_key", "code", F.col("title").alias("_t")), ["enum_key", "code"], "left")
    own = F.when(~F.col("en").eqNullSafe(F.col("_t")), F.col("en"))
    return both.select("enum_key", "code", own.alias("en"), F.when(own.isNotNull(), F.col("_t")).alias("was_en"), "fr").filter("en IS NOT NULL OR fr IS NOT NULL")


def built(schema: DataFrame, locale: DataFrame, sssom: DataFrame, mapping: DataFrame) -> DataFrame:
    """Picklist rows (enum_key, code, en, fr): overrides of the mapping count over locale rows, these over SSSOM ones for French; English
    ones over the schema's titles. locale and sssom: (enum_key, code, fr); mapping: (enum_key, code, en, fr)."""
    keys = ["enum_key", "code"]
    out = schema.select(*keys, "title").join(sssom.select(*keys, F.col("fr").alias("_s")), keys, "left").join(locale.select(*keys, F.col("fr").alias("_l")), keys, "left")
    out = out.join(mapping.select(*keys, F.col("en").alias("_en"), F.col("fr").alias("_fr")), keys, "left")
    return out.select(*keys, F.coalesce("_en", "title").alias("en"), F.coalesce("_fr", "_l", "_s").alias("fr"))


def compared(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, line): a unified difference of texts (name, content) by line: `-` for lines that only the stored one has, `+` for those of the new one."""
    lines = lambda d, side: d.select("name", F.explode(F.split("content", "\n")).alias("text")).groupBy("name", "text").agg(F.count("*").alias(side))
    both = lines(stored, "a").join(lines(fresh, "b"), ["name", "text"], "full_outer").withColumn("d", F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).filter("d != 0")
    return both.select("name", F.concat(F.when(F.col("d") > 0, "+").otherwise("-"), "text").alias("line"), F.abs("d").alias("times"))
