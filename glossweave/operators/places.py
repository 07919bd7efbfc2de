"""Enums of places: divisions under headers of their types, lower levels under the divisions above, settlements by size; and their mappings.

Values are (scope, position, code, title, description, is_a, meaning, alias, status); headers have no meaning. Mappings are SSSOM rows.
Positions are counted within a scope, a country, so that a window holds one country's places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as t
from ..plans.stages import bounded
from . import ranks

# Mapping predicates and the justification of curated mappings.
EXACT, BROAD_MATCH, BROADER, CURATED = "skos:exactMatch", "skos:broadMatch", "skos:broader", "semapv:ManualMappingCuration"

VALUES = ["code", "title", "description", "is_a", "meaning", "alias", "status"]


def _none() -> Column:
    return F.lit(None).cast("string")


def _known(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """entries (scope, gnid, name, ...) with the facts (gnid, qid, label, description) about them; the name is the label that facts lack."""
    both = entries.join(facts.select("gnid", "qid", "label", "description"), "gnid", "left")
    empty = F.lit("")
    return both.withColumn("title", t.normalize_text(F.coalesce(F.nullif("label", empty), "name"))).withColumn("description", F.nullif(t.normalize_text(F.col("description")), empty)).withColumn("qid", F.nullif("qid", empty))


def _placed(rows: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(*order, "code")
    return rows.select("scope", F.row_number().over(w).alias("position"), *VALUES)


def _mapping(subject: Column, label: Column, predicate: str, object_id: Column, object_label: Column) -> Column:
    return F.struct(subject.alias("subject_id"), F.lit(predicate).alias("predicate_id"), object_id.alias("object_id"), F.lit(CURATED).alias("mapping_justification"), label.alias("subject_label"), object_label.alias("object_label"))


def _mappings(rows: DataFrame, *each: Column) -> DataFrame:
    """The mappings that have an object."""
    every = F.filter(F.array(*each), lambda m: m["object_id"].isNotNull())
    return rows.select("scope", F.explode(every).alias("m")).select("scope", "m.*")


def _of_gazetteer(known: DataFrame, feature: Column) -> DataFrame:
    subject = F.concat(F.lit("gnf:"), "gnid")
    broad = _mapping(subject, F.col("title"), BROAD_MATCH, F.concat(F.lit("gno:A."), feature), F.lit(""))
    exact = _mapping(subject, F.col("title"), EXACT, F.concat(F.lit("wd:"), "qid"), F.col("title"))
    return _mappings(known, broad, exact)


def divisions(entries: DataFrame, facts: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values, mappings and titles of first-level divisions. entries (scope, gnid, name, code); countries (scope, country).

    The type of a division is what its description has before `of`. If two types or more of a country have two divisions or more, they
    are headers `Type of Country`, the most frequent first, each with its divisions by name; the others follow without a parent.
    Otherwise all are listed by name. titles (scope, title): the types of two or more, as `Province or Territory of Country`.
    """
    kind = F.nullif(F.lower(F.regexp_extract(F.trim("description"), r"(?i)^(.+?)\s+of\b", 1)), F.lit(""))
    known = _known(entries, facts).withColumn("type", kind)
    groups = ranks.type_groups(known.filter("type IS NOT NULL").select(F.col("scope").alias("grp"), "type")).select(F.col("grp").alias("scope"), "type", "n", "header", F.col("position").alias("_g"))
    groups = groups.join(countries.select("scope", "country"), "scope", "left")
    capital = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.expr("substring(type, 2)"))
    of = F.when(F.coalesce(F.col("country"), F.lit("")) != "", F.concat(F.lit(" of "), "country")).otherwise("")
    groups = groups.withColumn("_head", F.concat(capital(F.col("type")), of))
    heads = groups.filter("header").select("scope", "_g", F.lit(0).alias("_in"), F.lit("").alias("_key"), F.col("_head").alias("code"), F.col("_head").alias("title"), _none().alias("description"), _none().alias("is_a"), _none().alias("meaning"), _none().alias("alias"), _none().alias("status"))
    own = known.join(groups.filter("header").select("scope", "type", "_g", "_head"), ["scope", "type"], "left")
    alias = F.concat_ws(".", "scope", "code")
    rows = own.select("scope", F.coalesce("_g", F.lit(2**31 - 1)).alias("_g"), F.lit(1).alias("_in"), t.folded(F.col("title")).alias("_key"), F.col("gnid").alias("code"), "title", "description", F.col("_head").alias("is_a"), F.concat(F.lit("gnf:"), "gnid").alias("meaning"), alias.alias("alias"), _none().alias("status"))
    often = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.struct("_g", capital(F.col("type")).alias("x"))))), lambda r: r["x"])
    words = groups.groupBy("scope").agg(often.alias("ts"), F.first("country").alias("country")).filter("size(ts) > 0")
    n = F.size("ts")
    many = F.concat(F.array_join(F.slice("ts", F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", or "), F.element_at("ts", -1))
    titles = words.select("scope", F.concat(F.when(n <= 2, F.array_join("ts", " or ")).otherwise(many), of).alias("title"))
    return _placed(heads.unionByName(rows), "_g", "_in", "_key"), _of_gazetteer(known, F.lit("ADM1")), titles


def subdivisions(entries: DataFrame, facts: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and mappings of lower levels. entries (scope, adm1, adm2, gnid, name, code, feature); above (code, gnid): the known divisions by
    `scope.adm1.adm2` and `scope.adm1`.

    A place hangs from its second-level division, else from its first-level one, else from a header: the code that isn't known.
    Places come by parent and code.
    """
    above = above.select(F.col("code").alias("_c"), F.col("gnid").alias("_gnid"))
    second, first = F.concat_ws(".", "scope", "adm1", "adm2"), F.concat_ws(".", "scope", "adm1")
    known = _known(entries, facts).withColumn("_2", second).withColumn("_1", first)
    known = known.join(above.select(F.col("_c").alias("_2"), F.col("_gnid").alias("_g2")), "_2", "left").join(above.select(F.col("_c").alias("_1"), F.col("_gnid").alias("_g1")), "_1", "left")
    known = known.withColumn("is_a", F.coalesce("_g2", "_g1", "_2"))
    lost = known.filter("_g2 IS NULL AND _g1 IS NULL").select("scope", "_2").distinct()
    heads = lost.select("scope", F.col("_2").alias("_p"), F.lit("").alias("_key"), F.col("_2").alias("code"), F.col("_2").alias("title"), *(_none().alias(c) for c in VALUES[2:]))
    rows = known.select("scope", F.col("is_a").alias("_p"), F.concat(F.lit("."), "code").alias("_key"), F.col("gnid").alias("code"), "title", "description", "is_a", F.concat(F.lit("gnf:"), "gnid").alias("meaning"), F.col("code").alias("alias"), _none().alias("status"))
    return _placed(heads.unionByName(rows), "_p", "_key"), _of_gazetteer(known, F.coalesce(F.nullif("feature", F.lit("")), F.lit("ADM3")))


def settlements(places: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values and mappings of settlements (scope, qid, gnid, title, description, kind, gone, parents); sizes (kind, rank, label).

    Headers of the sizes that occur come first, by rank; then all settlements by name, each under its size, those that are gone with the status
    historical. They are mapped to the gazetteer, to their size and to every place that they are part of. Places without a qid are left out.
    """
    size = bounded(sizes.select("kind", "rank", F.col("label").alias("_size")))
    known = places.filter("qid IS NOT NULL").join(size, "kind", "left")
    used = known.filter("_size IS NOT NULL").select("scope", "rank", "_size").distinct()
    heads = used.select("scope", "rank", F.lit("").alias("_key"), F.col("_size").alias("code"), F.col("_size").alias("title"), *(_none().alias(c) for c in VALUES[2:]))
    meaning = F.concat(F.lit("wd:"), "qid")
    rows = known.select("scope", F.lit(2**31 - 1).alias("rank"), t.folded(F.col("title")).alias("_key"), F.col("qid").alias("code"), "title", "description", F.col("_size").alias("is_a"), meaning.alias("meaning"), _none().alias("alias"), F.when(F.col("gone"), "historical").alias("status"))
    empty = F.lit("")
    maps = _mappings(
        known.withColumn("_p", F.explode_outer(F.array_distinct(F.concat(F.array(_none()), F.coalesce("parents", F.array().cast("array<string>")))))),
        _mapping(meaning, F.col("title"), EXACT, F.when(F.col("_p").isNull(), F.concat(F.lit("gnf:"), F.nullif("gnid", empty))), empty),
        _mapping(meaning, F.col("title"), BROADER, F.when(F.col("_p").isNull() & F.col("_size").isNotNull(), F.concat(F.lit("wd:"), "kind")), F.col("_size")),
        _mapping(meaning, F.col("title"), BROADER, F.concat(F.lit("wd:"), "_p"), empty),
    )
    return _placed(heads.unionByName(rows), "rank", "_key"), maps
