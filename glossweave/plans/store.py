"""A vocabulary store in a folder, and runs over it: each step reads the tables it needs and writes new versions of those it changes.

A table is Parquet in `table/v=N`; the last version that was written whole counts, so that a run that is lost midway leaves the
tables as they were, and a step can read what it replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as t
from ..operators import mappings, merge, reports, search, upkeep
from ..sources import handbooks, providers, readers
from .stages import bounded

SCHEMAS = {
    "sources": "source_key string, path string, content_type string",
    "documents": "source_key string, url string, content string",
    "prefixes": "source_key string, prefix string, uri string",
    "enums": "source_key string, enum_key string, title string, description string",
    "pvs": "source_key string, enum_key string, ord int, code string, title string, description string, is_a string, status string, meaning string",
    "mappings": "ord int, subject_id string, predicate_id string, object_id string, mapping_justification string, subject_label string, object_label string",
    "mapped": "source_key string, enum_key string, code string, predicate_id string, objects array<string>",
    "locale": "source_key string, enum_key string, code string, lang string, title string",
}
#: In which order the steps of a run take effect.
ORDER = ("add", "delete", "fetch", "config", "build", "sssom", "lookup", "report", "search", "translate")


class Store:
    """Tables by name; those that were never written are empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        known = self._versions(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v={known[-1]}") if known else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame) -> None:
        last = max(self._versions(name), default=0)
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/v={last + 1}")


def _values(docs: DataFrame) -> dict[str, DataFrame]:
    """The values of documents (url, content, content_type) by the reader of each type, as (url, enum_key, ord, code, ...)."""
    of = lambda kind: docs.filter(F.col("content_type") == kind).select("url", "content")
    return {
        "CodeSystem": readers.code_system(of("CodeSystem")),
        "ValueSet": readers.value_set(of("ValueSet")),
        "CodeTable": readers.code_table(of("CodeTable")),
        "DefinitionList": readers.definition_list(of("DefinitionList")).withColumn("code", t.pascal_key(F.col("title"))),
        "LinkML": readers.linkml(of("LinkML")),
        "OWL": handbooks.ontology_values(handbooks.owl_classes(of("OWL"))),
    }


def add(store: Store, paths: list[str]) -> None:
    """Registers the files of some paths as sources, of the type that their names and contents tell; those that are known are registered anew."""
    docs = readers.documents(store.spark, paths[0])
    for p in paths[1:]:
        docs = docs.unionByName(readers.documents(store.spark, p))
    key = t.sanitized_code(F.regexp_extract("url", r"([^/]+?)(?:\.[^./]*)?$", 1))
    fresh = docs.select(key.alias("source_key"), F.col("url").alias("path"), readers.content_type(F.col("url"), F.col("content")).alias("content_type"))
    fresh = merge.first_wins(fresh, F.col("source_key"), ["path"]).select("source_key", "path", "content_type")
    store.write("sources", search.upsert(store.read("sources"), fresh))


def delete(store: Store, keys: list[str]) -> None:
    """Sources with all that came of them."""
    for name in ("sources", "documents", "prefixes", "enums", "pvs", "mapped", "locale"):
        store.write(name, upkeep.without_source(store.read(name), keys))


def _chosen(store: Store, keys: list[str] | None) -> DataFrame:
    sources = store.read("sources")
    return sources.filter(F.col("source_key").isin(keys)) if keys and keys != ["all"] else sources


def fetch(store: Store, keys: list[str] | None = None) -> None:
    """The documents of sources as they are now; one that lost a fifth or more since it was stored stays as stored."""
    chosen = [r.path for r in _chosen(store, keys).select("path").collect()]  # the registry, a row for each source
    if not chosen:
        return
    docs = store.spark.read.text(chosen, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))
    named = docs.join(bounded(store.read("sources").select("source_key", F.col("path").alias("url"))), "url")
    stored = store.read("documents")
    good = readers.guarded(named, stored.select("url", "content"))
    store.write("documents", search.upsert(stored, good.select(*stored.columns)))


def config(store: Store, keys: list[str] | None = None) -> None:
    """The prefixes that the documents of sources declare."""
    docs = store.read("documents").join(bounded(_chosen(store, keys).select("source_key")), "source_key", "left_semi")
    found = readers.xml_prefixes(docs.select(F.col("source_key").alias("url"), "content")).select(F.col("url").alias("source_key"), "prefix", "uri")
    store.write("prefixes", search.upsert(store.read("prefixes"), found))


def build(store: Store, keys: list[str] | None = None) -> None:
    """The enums and values of sources from their documents, an enum for each source that has none of its own; the first of equal codes stays."""
    chosen = _chosen(store, keys)
    docs = store.read("documents").join(bounded(chosen), "source_key").withColumn("url", F.col("source_key"))
    rows = None
    for part in _values(docs).values():
        enum = F.col("enum_key") if "enum_key" in part.columns else F.col("url")
        null = F.lit(None)
        texts = [(F.col(c) if c in part.columns else null).cast("string").alias(c) for c in ("code", "title", "description", "is_a", "status", "meaning")]
        one = part.select(F.col("url").alias("source_key"), enum.alias("enum_key"), (F.col("ord") if "ord" in part.columns else null).cast("int").alias("ord"), *texts)
        rows = one if rows is None else rows.unionByName(one)
    first = merge.first_wins(rows, F.struct("source_key", "enum_key", "code"), [F.coalesce("ord", F.lit(0)), "title", "description"])
    pvs = store.read("pvs")
    fresh = first.select(*pvs.columns)
    chosen_keys = bounded(chosen.select("source_key"))
    store.write("pvs", pvs.join(chosen_keys, "source_key", "left_anti").unionByName(fresh))
    enums = store.read("pvs").groupBy("source_key", "enum_key").agg(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"))
    store.write("enums", enums)


def sssom(store: Store, predicates: list[str] | None = None) -> None:
    """The objects that the mapping files among the documents give to values by their meaning, for some predicates or all."""
    files = store.read("documents").join(bounded(store.read("sources").filter("content_type = 'SSSOM'").select("source_key")), "source_key", "left_semi")
    rows = readers.sssom(files.select("url", "content"))
    store.write("mappings", mappings.merged(store.read("mappings"), rows.drop("url")))
    known = store.read("mappings")
    known = known.filter(F.col("predicate_id").isin(predicates)) if predicates else known
    both = store.read("pvs").filter("meaning IS NOT NULL").join(known.select(F.col("subject_id").alias("meaning"), "predicate_id", "object_id"), "meaning")
    store.write("mapped", both.groupBy("source_key", "enum_key", "code", "predicate_id").agg(F.sort_array(F.collect_set("object_id")).alias("objects")))


def lookup(store: Store, keys: list[str] | None = None) -> DataFrame:
    """(line): how many values each enum of sources has, and all."""
    rows = store.read("pvs").join(bounded(_chosen(store, keys).select("source_key")), "source_key", "left_semi")
    n = rows.rollup("enum_key").agg(F.count("*").alias("n"), F.grouping("enum_key").alias("g")).orderBy("g", "enum_key")
    return n.select(F.concat_ws("\t", F.when(F.col("g") == 1, "total").otherwise(F.col("enum_key")), F.col("n").cast("string")).alias("line"))


def report(store: Store) -> DataFrame:
    """(line): the enums of all sources."""
    enums = store.read("enums").join(store.read("sources"), "source_key", "left").select(F.col("content_type").alias("source_domain"), F.col("source_key").alias("source_schema"), "enum_key", "title")
    return reports.enum_report(enums).orderBy("source_domain", "source_schema", "enum_key").select("line")


def find(store: Store, text: str, form: str = "text", k: int = 10) -> DataFrame:
    """(line): the best matches of each query of a batch, as text, tsv or markdown."""
    entries = store.spark.range(1).select(F.posexplode(t.query_entries(F.lit(text))).alias("qid", "entry"))
    queries = entries.select("qid", t.query_term(F.col("entry")).alias("term"))
    pvs = store.read("pvs")
    none = store.spark.createDataFrame([], "key string, subject string, url string, title string, entry_type string")
    terms = search.index_rows(store.read("enums"), pvs, none).select("id", "type", "label", "definition")
    terms = merge.first_wins(terms, F.struct("type", "id"), ["label", "definition"]).select("id", "type", "label", "definition")
    best = search.overlap_search(queries, terms, k).join(terms, ["id", "type"])
    kids = pvs.filter("is_a IS NOT NULL").groupBy(F.col("is_a").alias("id")).agg(F.count("*").alias("n"))
    return reports.search_report(queries, best, kids).orderBy("qid", "rank").select(F.col(form).alias("line"))


def translate(store: Store, key: str, lang: str, provider: providers.Provider = providers.silent) -> None:
    """The titles of a source's values in another language, by a provider; what it has no answer for is left out."""
    titles = store.read("pvs").filter(F.col("source_key") == key).select("source_key", "enum_key", "code", F.col("title").alias("_t"))
    told = providers.asked(titles, "_t", "title", provider).filter("title IS NOT NULL").withColumn("lang", F.lit(lang))
    old = store.read("locale")
    store.write("locale", old.filter(~((F.col("source_key") == key) & (F.col("lang") == lang))).unionByName(told.select(*old.columns)))


def run(store: Store, asked: dict, provider: providers.Provider = providers.silent) -> dict[str, DataFrame]:
    """Takes the steps that are asked for (step: argument, None for all) in their order; gives the lines of those that report."""
    unknown = set(asked) - set(ORDER) - {"format", "lang"}
    if unknown:
        raise ValueError(f"no such steps: {sorted(unknown)}")
    steps: dict[str, Callable[[], DataFrame | None]] = {
        "add": lambda: add(store, asked["add"]),
        "delete": lambda: delete(store, asked["delete"]),
        "fetch": lambda: fetch(store, asked["fetch"]),
        "config": lambda: config(store, asked["config"]),
        "build": lambda: build(store, asked["build"]),
        "sssom": lambda: sssom(store, asked["sssom"]),
        "lookup": lambda: lookup(store, asked["lookup"]),
        "report": lambda: report(store),
        "search": lambda: find(store, asked["search"], asked.get("format", "text")),
        "translate": lambda: translate(store, asked["translate"], asked.get("lang", "fr"), provider),
    }
    return {name: lines for name in ORDER if name in asked and (lines := steps[name]()) is not None}
