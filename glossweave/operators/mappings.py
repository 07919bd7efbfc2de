"""Mapping rows (subject_id, predicate_id, object_id, ord) and what they do to values and locales."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stages import bounded


def pivoted(mappings: DataFrame, predicates: list[str]) -> DataFrame:
    """A column of each subject's objects, in order, for each predicate."""
    own = lambda p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("predicate_id") == p, F.struct("ord", "object_id")))), lambda x: x["object_id"]), ",")
    return mappings.groupBy("subject_id").agg(*(own(p).alias(p.rpartition(":")[2]) for p in predicates))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, new winning for the same subject, predicate and object."""
    keys = ["subject_id", "predicate_id", "object_id"]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", "ord")).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_object(mappings: DataFrame, predicate: str) -> DataFrame:
    return mappings.filter(F.col("predicate_id") == predicate).groupBy("subject_id").agg(F.min_by("object_id", "ord").alias("uri"))


def longest_prefix(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """iris (iri) with a CURIE by the longest URI that begins them. Prefixes are a small registry."""
    hit = iris.join(bounded(prefixes), F.startswith("iri", "uri"), "left")
    best = hit.groupBy("iri").agg(F.max_by(F.struct("prefix", "uri"), F.struct(F.length("uri"), "prefix")).alias("p"))
    return best.select("iri", F.when(F.col("p.prefix").isNotNull(), F.concat("p.prefix", F.lit(":"), F.expr("substring(iri, length(p.uri) + 1)"))).alias("curie"))


def translated(locale: DataFrame, rows: DataFrame) -> DataFrame:
    """Locale rows (enum_key, code, lang, title) with those of translation mappings put in.

    Mappings: subject_id `ns:source:enum:choice:code`, object_id `"text"@lang`.
    """
    hit = rows.select(
        F.regexp_extract("subject_id", r"^[^:]+:[^:]+:(.+):choice:(.+)$", 1).alias("enum_key"),
        F.regexp_extract("subject_id", r"^[^:]+:[^:]+:(.+):choice:(.+)$", 2).alias("code"),
        F.regexp_extract("object_id", r'^"(.*)"@([A-Za-z-]+)$', 2).alias("lang"),
        F.regexp_extract("object_id", r'^"(.*)"@([A-Za-z-]+)$', 1).alias("title"),
    ).filter("enum_key != '' AND lang != ''")
    keys = ["enum_key", "code", "lang"]
    return locale.join(hit.select(*keys).distinct(), keys, "left_anti").select(*keys, "title").unionByName(hit.groupBy(*keys).agg(F.max("title").alias("title")))


def containment(places: DataFrame) -> DataFrame:
    """skos:broader rows from places (code, adm1, adm2) to each level they have."""
    levels = F.explode(F.filter(F.array("adm2", "adm1"), lambda x: x.isNotNull()))
    return places.select(F.col("code").alias("subject_id"), F.lit("skos:broader").alias("predicate_id"), levels.alias("object_id"))
