"""Rules of a merge: which enums and values of a source get into the schema, and what goes with them.

sources: (source_key, content_type, path, concise); minus and include lists: (source_key, name); enums: (source_key,
enum_key, source_domain, source_schema, status, ...); pvs: (source_key, enum_key, code, status, meaning, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stages import bounded

# Content types whose values are filtered by status.
STATUS_TYPES = ("OWL", "OntologyAPI", "GeoNamesSettlement", "GeoWikiSettlement")
CONCEPT_LISTS_IGNORED = "OWL"


def named(enums: DataFrame, names: DataFrame) -> DataFrame:
    """(source_key, enum_key) of the enums that a list names by key or by the domain or schema that they are annotated with."""
    labels = enums.select("source_key", "enum_key", F.explode(F.array("enum_key", "source_domain", "source_schema")).alias("name")).filter("name IS NOT NULL")
    return labels.join(bounded(names.select("source_key", "name").distinct()), ["source_key", "name"], "left_semi").select("source_key", "enum_key").distinct()


def concept_filter(enums: DataFrame, sources: DataFrame, minus: DataFrame, include: DataFrame) -> DataFrame:
    """enums with `excluded`, and the status in capitals.

    An enum is excluded if minus names it, or if its source has inclusions but no exclusions and include doesn't name it. The lists
    of OWL sources name classes, not enums, and count for nothing here.
    """
    valid = bounded(sources.filter(F.coalesce("content_type", F.lit("")) != CONCEPT_LISTS_IGNORED).select("source_key"))
    minus, include = (d.join(valid, "source_key", "left_semi") for d in (minus, include))
    some = lambda d, name: bounded(d.select("source_key").distinct().withColumn(name, F.lit(True)))
    mark = lambda d, name: named(enums, d).withColumn(name, F.lit(True))
    keys = ["source_key", "enum_key"]
    out = enums.join(some(minus, "_has_minus"), "source_key", "left").join(some(include, "_has_include"), "source_key", "left")
    out = out.join(mark(minus, "_minus"), keys, "left").join(mark(include, "_include"), keys, "left")
    only = F.col("_has_include").isNotNull() & F.col("_has_minus").isNull()
    excluded = F.col("_minus").isNotNull() | (only & F.col("_include").isNull())
    return out.select(*(F.upper("status").alias("status") if c == "status" else F.col(c) for c in enums.columns), excluded.alias("excluded"))


def stale(schema: DataFrame, excluded: DataFrame, sources: DataFrame) -> DataFrame:
    """(enum_key) of enums in the schema (enum_key, source_file) that a source now excludes and that were merged from its file."""
    files = excluded.join(bounded(sources.select("source_key", F.col("path").alias("source_file"))), "source_key").select("enum_key", "source_file").distinct()
    return schema.join(files, ["enum_key", "source_file"], "left_semi").select("enum_key")


def status_filter(pvs: DataFrame, sources: DataFrame, minus: DataFrame) -> DataFrame:
    """pvs without those whose status their source excludes, for the content types that have a status, and, for concise sources, without obsolete ones."""
    typed = bounded(sources.select("source_key", F.coalesce(F.col("content_type").isin(*STATUS_TYPES), F.lit(False)).alias("_typed"), F.coalesce("concise", F.lit(False)).alias("_concise")))
    out = bounded(minus.select("source_key", F.col("name").alias("status"), F.lit(True).alias("_out")).distinct())
    marked = pvs.join(typed, "source_key", "left").join(out, ["source_key", "status"], "left")
    gone = (F.coalesce("_typed", F.lit(False)) & F.col("_out").isNotNull()) | (F.coalesce("_concise", F.lit(False)) & (F.coalesce("status", F.lit("")) == "obsolete"))
    return marked.filter(~gone).select(*pvs.columns)


def missing(sources: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Sources (source_key, path) of which no artefact (path) exists."""
    return sources.join(artefacts.select("path").distinct(), "path", "left_anti").select("source_key", "path")


def surviving_locale(locale: DataFrame, pvs: DataFrame) -> DataFrame:
    """Locale rows (enum_key, code, lang, title) of values that are still there."""
    return locale.join(pvs.select("enum_key", "code").distinct(), ["enum_key", "code"], "left_semi")


def mapped(pvs: DataFrame, mappings: DataFrame, predicates: list[str]) -> DataFrame:
    """pvs with a column of mapped objects for each predicate, in the order of the mappings, for those whose meaning is a subject."""
    from .mappings import pivoted

    return pvs.join(pivoted(mappings, predicates).withColumnRenamed("subject_id", "meaning"), "meaning", "left")


def mapping_counts(pvs: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source_key, predicate_id, n): how many mapping rows the values of each source get by predicate."""
    hit = pvs.select("source_key", F.col("meaning").alias("subject_id")).join(mappings.select("subject_id", "predicate_id"), "subject_id")
    return hit.groupBy("source_key", "predicate_id").agg(F.count("*").alias("n"))


def compound_parent(places: DataFrame, known: DataFrame) -> DataFrame:
    """places (cc, adm1, adm2, ...) with the parent `cc.adm1.adm2` if that is known (code), else `cc.adm1` if that is, else none."""
    two, one = F.concat_ws(".", "cc", "adm1", "adm2"), F.concat_ws(".", "cc", "adm1")
    codes = known.select(F.col("code").alias("_code")).distinct()
    out = places.join(codes.withColumnRenamed("_code", "_two"), two == F.col("_two"), "left").join(codes.withColumnRenamed("_code", "_one"), one == F.col("_one"), "left")
    return out.withColumn("is_a", F.coalesce("_two", "_one")).drop("_two", "_one")


def curies(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(iri, curie): OBO's own form first, `.../obo/ENVO_01` as `ENVO:01`, then the longest prefix."""
    from .mappings import longest_prefix

    obo = r"^https?://purl\.obolibrary\.org/obo/([A-Za-z]+)_([A-Za-z0-9]+)$"
    own = F.when(F.rlike("iri", F.lit(obo)), F.concat(F.regexp_extract("iri", obo, 1), F.lit(":"), F.regexp_extract("iri", obo, 2)))
    return longest_prefix(iris, prefixes).withColumn("curie", F.coalesce(own, "curie"))


def folded_meanings(pvs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """pvs whose meaning is a CURIE with the prefix in lower case, where all spellings of it have one URI regardless of case."""
    from .merge import folded_prefixes

    fold = folded_prefixes(prefixes).filter("kind != 'differ' AND spellings > 1").select("folded")
    own = F.lower(F.substring_index("meaning", ":", 1))
    out = pvs.withColumn("_p", F.when(F.contains("meaning", F.lit(":")), own)).join(bounded(fold.withColumn("_fold", F.lit(True))), F.col("_p") == F.col("folded"), "left")
    return out.withColumn("meaning", F.when(F.col("_fold"), F.concat("_p", F.lit(":"), F.expr("substring(meaning, instr(meaning, ':') + 1)"))).otherwise(F.col("meaning"))).drop("_p", "_fold", "folded")


def overlaid(locale: DataFrame, rows: DataFrame) -> DataFrame:
    """Locale rows (enum_key, part, code, lang, text) with translations put in; part is name, description or choice.

    Translation mappings: subject_id `ns:source:enum:name`, `...:description` or `...:choice:code`, the enum key may hold colons;
    object_id `"text"@lang`. Of several for one place the greatest text counts.
    """
    form, text = r"^[^:]+:[^:]+:(.+?):(?:(name|description)|(choice):(.+))$", r'(?s)^"(.*)"@([A-Za-z-]+)$'
    get = lambda i: F.regexp_extract("subject_id", form, i)
    hit = rows.select(get(1).alias("enum_key"), F.concat(get(2), get(3)).alias("part"), get(4).alias("code"), F.regexp_extract("object_id", text, 2).alias("lang"), F.regexp_extract("object_id", text, 1).alias("text")).filter("enum_key != '' AND lang != ''")
    keys = ["enum_key", "part", "code", "lang"]
    new = hit.groupBy(*keys).agg(F.max("text").alias("text"))
    return locale.join(new.select(*keys), keys, "left_anti").select(*keys, "text").unionByName(new)


def slot_class(slots: DataFrame, name: str) -> DataFrame:
    """(class, slots): one class that lists all slots, by group and name regardless of case."""
    rows = F.sort_array(F.collect_list(F.struct(F.lower(F.coalesce("slot_group", F.lit(""))).alias("g"), F.lower("name").alias("k"), F.col("name").alias("name"))))
    return slots.agg(F.array_join(F.transform(rows, lambda x: x["name"]), ",").alias("slots")).select(F.lit(name).alias("class"), "slots")


def slot_order(slots: DataFrame) -> DataFrame:
    """slots (slot_group, name) with their position by group and name, regardless of case."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lower(F.coalesce("slot_group", F.lit("")))).orderBy(F.lower("name"), "name")
    return slots.withColumn("position", F.row_number().over(w))


def hoisted(rows: DataFrame, pattern: str) -> DataFrame:
    """(enum_key, code, text, hoisted): values without the tail that two or more of their enum share, which moves to the enum's own row (code null)."""
    tail = F.regexp_extract("text", pattern, 0)
    tailed = rows.select("enum_key", "code", "text", F.nullif(tail, F.lit("")).alias("tail"))
    shared = tailed.filter("tail IS NOT NULL").groupBy("enum_key", "tail").agg(F.count("*").alias("n")).filter("n >= 2")
    both = tailed.join(shared, ["enum_key", "tail"], "left")
    cut = F.rtrim(F.expr("substring(text, 1, length(text) - length(tail))"))
    values = both.select("enum_key", "code", F.when(F.col("n").isNotNull(), cut).otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("hoisted"))
    heads = shared.groupBy("enum_key").agg(F.array_join(F.array_sort(F.collect_list("tail")), " ").alias("hoisted"))
    return values.unionByName(heads.select("enum_key", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("text"), "hoisted"))


def middle_labels(rows: DataFrame) -> DataFrame:
    """rows (grp, idx, label) in which of steps with one label only that closest to the middle of the scale keeps it, the first of two."""
    from pyspark.sql import Window

    middle = (F.min("idx").over(Window.partitionBy("grp")) + F.max("idx").over(Window.partitionBy("grp"))) / 2
    w = Window.partitionBy("grp", "label").orderBy(F.abs(F.col("idx") - F.col("_m")), "idx")
    return rows.withColumn("_m", middle).withColumn("_n", F.row_number().over(w)).withColumn("label", F.when(F.col("_n") == 1, F.col("label"))).drop("_m", "_n")


def scale_scores(texts: DataFrame, scales: DataFrame) -> DataFrame:
    """Of each text (id, text) the scale (dimension, word, alias) of the best score: 1 for each word that holds or is held by one of the
    text's words, and a half for each of its aliases."""
    from pyspark.sql import Window

    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    near = F.contains("w", F.col("word")) | F.contains(F.col("word"), F.col("w"))
    hit = words.filter(F.length("w") > 2).join(bounded(scales.select("dimension", F.lower("word").alias("word"), "alias")), near).select("id", "dimension", "word", "alias").distinct()
    score = hit.groupBy("id", "dimension").agg(F.sum(F.when(F.col("alias"), 0.5).otherwise(1.0)).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "dimension")
    return score.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ungrounded(pvs: DataFrame, documents: DataFrame) -> DataFrame:
    """Values (doc_id, title) whose title isn't in their own document (doc_id, text): both without case, marks and repeated spaces."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    both = pvs.join(documents.select("doc_id", plain(F.col("text")).alias("_text")), "doc_id", "left")
    return both.filter(~F.contains(F.coalesce("_text", F.lit("")), plain(F.col("title")))).drop("_text")


def reached(edges: DataFrame, roots: DataFrame, rounds: int = 64) -> DataFrame:
    """(root, node): all that a property path `parent*` leads to from each root, itself included; edges (node, parent), several parents allowed.

    Each round goes one step from what the round before found first, and is checkpointed; cycles end where nothing is new.
    """
    from ..plans.stages import kept

    found = kept(roots.select(F.col("node").alias("root"), "node").distinct())
    fresh = found
    for _ in range(rounds):
        step = fresh.join(edges.select("node", "parent"), "node").select("root", F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
        fresh = kept(step.join(found, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = kept(found.unionByName(fresh))
    raise ValueError(f"paths of more than {rounds} steps")


def geo_dependencies(keys: DataFrame) -> DataFrame:
    """(enum_key, needs): the sources that each place enum needs, GeoNamesAdm2CA: GeoNames_ADM1_CA and GeoNames_countries."""
    from ..functions.text import source_key_of

    form = r"^(GeoWiki|GeoNames)Adm([1-4])(?:Adm[1-4])?([A-Z]{2})$"
    family, level, land = (F.regexp_extract("enum_key", form, i) for i in (1, 2, 3))
    above = F.when(level.cast("int") > 1, F.transform(F.sequence(F.lit(1), level.cast("int") - 1), lambda n: F.concat(family, F.lit("_ADM"), n.cast("string"), F.lit("_"), land))).otherwise(F.array().cast("array<string>"))
    chain = F.concat(F.array(F.concat(family, F.lit("_countries"))), above, F.array(source_key_of(F.col("enum_key"))))
    return keys.filter(F.rlike("enum_key", F.lit(form))).select("enum_key", F.explode(chain).alias("needs"))


def sovereignty(countries: DataFrame, dependent: DataFrame, members: DataFrame) -> DataFrame:
    """countries (code, parent, name) with `kind`, by five rules in order: listed as dependent is a territory, one that belongs to
    another is one too, a member is sovereign, one without a name is unknown, and the rest is disputed."""
    flag = lambda d, name: bounded(d.select("code").distinct().withColumn(name, F.lit(True)))
    out = countries.join(flag(dependent, "_d"), "code", "left").join(flag(members, "_m"), "code", "left")
    kind = F.when(F.col("_d"), "territory").when(F.col("parent").isNotNull() & (F.col("parent") != F.col("code")), "territory").when(F.col("_m"), "sovereign").when(F.coalesce("name", F.lit("")) == "", "unknown").otherwise("disputed")
    return out.withColumn("kind", kind).drop("_d", "_m")
