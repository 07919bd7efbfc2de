"""Filters and merging of sources: enums (source_key, enum_key, ...), pvs (source_key, enum_key, code, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.stages import bounded


def value(code: Column, title: Column, meaning: Column, prefixes: list[tuple[str, str]]) -> list[Column]:
    """title, left out where it is the code; meaning, compressed with the first prefix whose URI begins it."""
    short = meaning
    for prefix, uri in reversed(prefixes):
        short = F.when(F.startswith(meaning, F.lit(uri)), F.concat(F.lit(prefix + ":"), F.substring(meaning, len(uri) + 1, 1 << 20))).otherwise(short)
    return [F.when(F.lower(title) != F.lower(code), title).alias("title"), short.alias("meaning")]


def drop_listed(rows: DataFrame, minus: DataFrame, on: list[str]) -> DataFrame:
    """Rows that minus doesn't list."""
    return rows.join(minus.select(*on).distinct(), on, "left_anti")


def included(rows: DataFrame, include: DataFrame, minus: DataFrame, on: list[str]) -> DataFrame:
    """Of a source with inclusions alone, just these; of others what minus leaves, and what is included in spite of it."""
    has = lambda d, name: d.select("source_key").distinct().withColumn(name, F.lit(True))
    marked = (
        rows.join(bounded(has(include, "_inc")), "source_key", "left")
        .join(bounded(has(minus, "_min")), "source_key", "left")
        .join(include.select(*on).distinct().withColumn("_in", F.lit(True)), on, "left")
        .join(minus.select(*on).distinct().withColumn("_out", F.lit(True)), on, "left")
    )
    only = F.col("_inc").isNotNull() & F.col("_min").isNull()
    return marked.filter(F.when(only, F.col("_in").isNotNull()).otherwise(F.col("_in").isNotNull() | F.col("_out").isNull())).select(*rows.columns)


def without_status(pvs: DataFrame, statuses: list[str]) -> DataFrame:
    return pvs.filter(~F.coalesce(F.upper("status").isin([s.upper() for s in statuses]), F.lit(False)))


def concise(tree: DataFrame) -> DataFrame:
    """tree (code, is_a, title) with `dropped`: whether the title is the parent's."""
    up = tree.select(F.col("code").alias("is_a"), F.col("title").alias("_parent_title"))
    return tree.join(up, "is_a", "left").withColumn("dropped", F.coalesce(F.col("title") == F.col("_parent_title"), F.lit(False))).drop("_parent_title")


def non_empty(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """Enums with values; a parent that is gone is no parent."""
    full = enums.join(pvs.select("enum_key").distinct(), "enum_key", "left_semi")
    there = full.select(F.col("enum_key").alias("_there"))
    return full.join(there, F.col("is_a") == F.col("_there"), "left").withColumn("is_a", F.col("_there")).drop("_there")


def orphans(enums: DataFrame, sources: DataFrame) -> DataFrame:
    return enums.join(sources.select("source_key").distinct(), "source_key", "left_anti")


def actions(old: DataFrame, new: DataFrame, key: str, owner: str, fields: list[str]) -> DataFrame:
    """What a merge of new into old does with each key: add, keep, update, conflict (another owner's) or stale."""
    a = old.select(F.col(key), F.col(owner).alias("_old"), F.struct(*fields).alias("_a"))
    b = new.select(F.col(key), F.col(owner).alias("_new"), F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "add")
        .when(F.col("_new").isNull(), "stale")
        .when(F.col("_old") != F.col("_new"), "conflict")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "keep")
        .otherwise("update")
    )
    return both.select(key, action.alias("action"))


def prefix_conflicts(prefixes: DataFrame) -> DataFrame:
    """Prefixes that sources give different URIs."""
    found = prefixes.groupBy("prefix").agg(F.countDistinct("uri").alias("n"), F.array_join(F.sort_array(F.collect_set("uri")), " ").alias("uris"))
    return found.filter("n > 1")


def folded_prefixes(prefixes: DataFrame) -> DataFrame:
    """One row per prefix regardless of case: `same`, `case` (URIs differ in case alone) or `differ`; all but the last fold."""
    found = prefixes.groupBy(F.lower("prefix").alias("folded")).agg(
        F.countDistinct("prefix").alias("spellings"), F.countDistinct("uri").alias("uris"), F.countDistinct(F.lower("uri")).alias("folded_uris")
    )
    return found.withColumn("kind", F.when(F.col("uris") == 1, "same").when(F.col("folded_uris") == 1, "case").otherwise("differ"))


def last_prefixes(prefixes: DataFrame) -> DataFrame:
    """The URI that the last source gives each prefix."""
    return prefixes.groupBy("prefix").agg(F.max_by("uri", "ord").alias("uri"))


def first_wins(rows: DataFrame, key: Column, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_value_first_place(rows: DataFrame, key: str, value_column: str, ord_column: str) -> DataFrame:
    """Of rows with one key the last value, at the place of the first."""
    return rows.groupBy(key).agg(F.max_by(value_column, ord_column).alias(value_column), F.min(ord_column).alias(ord_column))


def build_report(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events (source_key, action) counted by source."""
    return events.groupBy("source_key").pivot("action", kinds).count().na.fill(0)


def locale_delta(locale: DataFrame, default: DataFrame, on: list[str]) -> DataFrame:
    """Titles in other languages that aren't the default's."""
    base = default.select(*on, F.col("title").alias("_base"))
    return locale.join(base, on, "left").filter(~F.col("title").eqNullSafe(F.col("_base")) & F.col("title").isNotNull()).drop("_base")


def auto_slots(enums: DataFrame, slots: DataFrame) -> DataFrame:
    """A slot for each enum that has none."""
    named = enums.select(F.concat(F.lower(F.substring("enum_key", 1, 1)), F.substring("enum_key", 2, 1 << 20)).alias("name"), F.col("enum_key").alias("range"))
    return named.join(slots.select("name").distinct(), "name", "left_anti")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retitled values (enum_key, code)."""
    a, b = (d.select("enum_key", "code", F.struct("title").alias(n)) for d, n in ((old, "_a"), (new, "_b")))
    both = a.join(b, ["enum_key", "code"], "full_outer")
    action = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a.title").eqNullSafe(F.col("_b.title")), "retitled")
    return both.select("enum_key", "code", action.alias("action")).filter("action IS NOT NULL")


def size_guard(rows: DataFrame, w: Window) -> DataFrame:
    """Whether a new version is over 80 % of the one before it; the first is always."""
    before = F.lag("size").over(w)
    return rows.withColumn("size_ok", (F.col("size") > 0) & (before.isNull() | (F.col("size") * 5 > before * 4)))
