"""Upkeep of a store: selection by key, deletion, configuration, refreshes and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.stages import bounded


def glob_pattern(pattern: str) -> str:
    """A shell pattern (*, ?, [..]) as a regular expression for the whole text."""
    out = ""
    for c in pattern:
        out += {"*": ".*", "?": ".", "[": "[", "]": "]"}.get(c) or (c if c.isalnum() or c in "_-!" else "\\" + c)
    return f"^{out.replace('[!', '[^')}$"


def selected(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    return rows.filter(F.rlike(key, F.lit(glob_pattern(pattern))))


def split_arguments(words: DataFrame, sources: DataFrame, enums: DataFrame) -> DataFrame:
    """words (word) with their kind: a source's key, an enum's, or unknown."""
    s, e = sources.select(F.col("source_key").alias("word")).distinct(), enums.select(F.col("enum_key").alias("word")).distinct()
    marked = words.join(s.withColumn("_s", F.lit(True)), "word", "left").join(e.withColumn("_e", F.lit(True)), "word", "left")
    return marked.select("word", F.when(F.col("_s"), "source").when(F.col("_e"), "enum").otherwise("unknown").alias("kind"))


def without_source(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.filter(~F.col("source_key").isin(keys))


def renamed(config: DataFrame, old: str, new: str, fields: dict[str, str]) -> DataFrame:
    """config (key, ord, ...) with a key renamed in its place and some fields of it set."""
    at = F.col("key") == old
    return config.select(*(F.when(at, F.lit(new if c == "key" else fields[c])).otherwise(F.col(c)).alias(c) if c == "key" or c in fields else F.col(c) for c in config.columns))


def refreshed(fresh: DataFrame, stored: DataFrame, key: str, column: str) -> DataFrame:
    """fresh with the stored value of a column where there is one: what users set survives a refresh."""
    old = stored.select(key, F.col(column).alias("_old"))
    return fresh.join(old, key, "left").withColumn(column, F.coalesce("_old", F.col(column))).drop("_old")


def overwritten(registry: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """registry with a column replaced by the updates' non-empty values."""
    new = updates.select(key, F.nullif(F.trim(column), F.lit("")).alias("_new"))
    return registry.join(new, key, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def historical_headers(members: DataFrame) -> DataFrame:
    """(header, status): historical where all of a header's members are."""
    return members.groupBy("header").agg(F.when(F.bool_and(F.coalesce(F.col("status") == "historical", F.lit(False))), "historical").alias("status"))


def obsolete(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """nodes (iri, deprecated) with a status: obsolete under the root of obsolete classes, deprecated where marked."""
    gone = edges.filter(F.col("target") == root).select(F.col("source").alias("iri")).distinct().withColumn("_o", F.lit(True))
    return nodes.join(gone, "iri", "left").withColumn("status", F.when(F.col("_o"), "OBSOLETE").when(F.col("deprecated"), "DEPRECATED")).drop("_o")


def joined_uses(rows: DataFrame) -> DataFrame:
    """(code, description): descriptions with the uses that they don't name yet, in order."""
    uses = rows.groupBy("code").agg(F.max("description").alias("description"), F.sort_array(F.collect_set("use")).alias("uses"))
    new = F.filter("uses", lambda u: ~F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lower(u)))
    return uses.select("code", F.when(F.size(new) > 0, F.concat_ws("; ", "description", F.array_join(new, ", "))).otherwise(F.col("description")).alias("description"))


def section_view(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """(position, is_header, code, title): each enum's line before its values, in order."""
    heads = enums.select(F.col("ord").alias("enum_ord"), F.lit(True).alias("is_header"), F.col("enum_key").alias("code"), "title", F.lit(-1).cast("bigint").alias("ord"), "enum_key")
    values = pvs.join(enums.select("enum_key", F.col("ord").alias("enum_ord")), "enum_key").select("enum_ord", F.lit(False).alias("is_header"), "code", "title", F.col("ord").cast("bigint"), "enum_key")
    w = Window.partitionBy("enum_key").orderBy(F.desc("is_header"), "ord")
    return heads.unionByName(values).select("enum_key", F.row_number().over(w).alias("position"), "is_header", "code", "title")


def routed(prefixes: DataFrame, apis: DataFrame, default: str) -> DataFrame:
    """(prefix, api): the first API that serves a prefix, else the default. apis: (api, ord, prefix), a small table."""
    best = apis.groupBy(F.lower("prefix").alias("_p")).agg(F.min_by("api", "ord").alias("_api"))
    return prefixes.join(bounded(best), F.lower("prefix") == F.col("_p"), "left").select("prefix", F.coalesce("_api", F.lit(default)).alias("api"))
