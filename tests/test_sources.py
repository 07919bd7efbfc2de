"""Readers, sinks and the streamed index on small made-up files."""

import json

from pyspark.sql import functions as F

from glossweave.functions import text as t
from glossweave.operators import walks
from glossweave.sources import providers, readers, sinks
from glossweave.streaming import index


def frame(spark, *texts):
    return spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(texts)], "url string, content string")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_classification_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Level/Niveau,Code,Class title,Titres de classes,Class definition\n1,01,Crops,Cultures,"All, of it"\n2,011,Wheat,Blé,\n', encoding="utf-8")
    got = readers.classification_csv(spark, str(tmp_path / "a.csv")).orderBy("ord").collect()
    assert [(r.level, r.code, r.title, r.title_fr, r.description, r.parent) for r in got] == [(1, "01", "Crops", "Cultures", "All, of it", None), (2, "011", "Wheat", "Blé", None, None)]


def test_fhir(spark):
    system = {"concept": [{"code": "a", "display": "A", "concept": [{"code": "b", "definition": "d", "concept": [{"code": "c"}]}]}]}
    assert rows(readers.code_system(frame(spark, json.dumps(system), "not json")), "code", "is_a", "level") == [("a", None, 1), ("b", "a", 2), ("c", "b", 3)]
    value_set = {"compose": {"include": [{"concept": [{"code": "x", "display": "X"}]}, {"concept": [{"code": "y"}]}]}}
    assert rows(readers.value_set(frame(spark, json.dumps(value_set))), "code", "title") == [("x", "X"), ("y", None)]


def test_bindings(spark):
    found = {"results": {"bindings": [{"item": {"value": "Q1"}, "label": {"value": "x", "xml:lang": "fr"}}]}}
    assert rows(readers.sparql_bindings(frame(spark, json.dumps(found))), "ord", "name", "value", "lang") == [(0, "item", "Q1", None), (0, "label", "x", "fr")]


def test_html(spark):
    page = "<table class=codes><tr><th>Code</th><th>Display</th><th>Status</th><th>Level</th></tr><tr><td>1</td><td><b>One</b></td><td/><td>1</td></tr><tr><td>2<td>Two<td>active<td>2</table><table><tr><td>x</td></tr></table>"
    assert rows(readers.code_table(frame(spark, page)), "code", "title", "status", "level") == [("1", "One", None, 1), ("2", "Two", "ACTIVE", 2)]
    items = '<ul><li class="g indent-1"><a>01 - Crops</a><li class="indent-2">011 - Wheat <b>x</b></li></ul>'
    assert rows(readers.indented_list(frame(spark, items)), "ord", "level", "code", "title") == [(0, 1, "01", "Crops"), (1, 2, "011", "Wheat x")]
    pages = ("<dl><dt>Soil</dt><dd>Earth</dd><dt>clay</dt> <dd>Fine</dd></dl>", "<dl><dt>SOIL</dt><dd>Other</dd></dl>")
    assert rows(readers.definition_list(frame(spark, *pages)), "title", "description") == [("Soil", "Earth"), ("clay", "Fine")]


def test_text_formats(spark):
    owl = '<rdf:RDF xmlns:rdf="http://r#" xmlns:obo="http://o/" xmlns:obo2="http://p/">'
    assert rows(readers.xml_prefixes(frame(spark, owl)), "prefix", "uri") == [("obo", "http://o/"), ("obo2", "http://p/")]
    body = "subject_id\tpredicate_id\tobject_id\nA:1\tskos:exactMatch\tB:1\n\tx\ty\nA:2\tskos:broadMatch\n"
    for head in ("# note\n# x: y\n", "a: b\n---\n", ""):
        assert rows(readers.sssom(frame(spark, head + body)), "subject_id", "predicate_id", "object_id") == [("A:1", "skos:exactMatch", "B:1"), ("A:2", "skos:broadMatch", None)]
    assert rows(readers.sections(frame(spark, "x\nPART A\none\n\ntwo\nPART B\nthree"), "^PART "), "section", "line") == [("PART A", "one"), ("PART A", "two"), ("PART B", "three")]
    kinds = [("http://x/a.owl", ""), ("u", '{"resourceType": "ValueSet"}'), ("u", "words")]
    d = spark.createDataFrame(kinds, "url string, head string").select(readers.content_type(F.col("url"), F.col("head")))
    assert [r[0] for r in d.collect()] == ["OWL", "ValueSet", "FreeText"]


def test_sssom_rows_are_small(spark):
    """The rows of lines carry the header's names alone, not the file: the generator's input is its only wide row."""
    docs = frame(spark, "subject_id\tobject_id\n" + "\n".join(f"A:{i}\tB:{i}" for i in range(3000)))
    found = readers.sssom(docs)
    plan = found._jdf.queryExecution().optimizedPlan()
    generate = next(plan.apply(i) for i in range(99) if plan.apply(i).nodeName() == "Generate")
    carried = {generate.output().apply(i).name() for i in range(generate.output().size())}
    assert carried == {"url", "names", "ord", "line"}
    assert rows(found, "ord", "subject_id", "object_id") == [(i, f"A:{i}", f"B:{i}") for i in range(3000)]


def test_guard(spark):
    fresh, old = frame(spark, "x" * 90, "x" * 80, "", "new"), frame(spark, "y" * 100, "y" * 100, "y")
    assert rows(readers.guarded(fresh, old), "url") == [("u0",), ("u3",)]


def test_geonames(spark, tmp_path):
    line = ["1", "Here", "Here", "", "1", "2", "P", "PPL", "CA", "", "01", "02", "", "", "5", "", "", "", ""]
    (tmp_path / "CA.txt").write_text("\t".join(line) + "\n" + "\t".join(["2", *line[1:6], "A", *line[7:]]) + "\n")
    assert rows(readers.geonames(spark, str(tmp_path / "CA.txt"), classes=["P"]), "gnid", "adm1") == [("1", "01")]
    names = [["1", "1", "fr", "Ici", "", "", "", ""], ["2", "1", "fr", "Ci", "1", "", "", ""], ["3", "1", "wkdt", "Q5", "", "", "", ""], ["4", "1", "en", "Old", "", "", "", "1"]]
    (tmp_path / "alt.txt").write_text("".join("\t".join(x) + "\n" for x in names))
    labels, ids = readers.alternate_names(spark, str(tmp_path / "alt.txt"))
    assert rows(labels, "gnid", "lang", "value") == [("1", "fr", "Ci")] and rows(ids, "gnid", "qid") == [("1", "Q5")]


def test_sinks_and_stream(spark, tmp_path):
    path = str(tmp_path / "index")
    sinks.write_by_source(spark.createDataFrame([("a", "1"), ("b", "2")], "source_key string, id string"), path)
    changes = str(tmp_path / "changes")
    spark.createDataFrame([("a", "9"), ("c", "3")], "source_key string, id string").write.parquet(changes)
    stream = spark.readStream.schema("source_key string, id string").parquet(changes)
    index.keep_index(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(path), "source_key", "id") == [("a", "9"), ("b", "2"), ("c", "3")]


def test_functions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(t.pascal_key(F.lit("Farm Product Price Index - FPPI"))) == "FarmProductPriceIndex"
    assert one(t.pascal_key(F.lit("FPPI"))) == "FPPI"
    assert one(t.snake_case(F.lit("GeoWikiAdm3"))) == "geo_wiki_adm3"
    assert one(t.source_key_of(F.lit("GeoWikiAdm2CA"))) == "GeoWiki_ADM2_CA"
    assert one(t.clip_sentences(F.lit("One. Two! Three?"), 2)) == "One. Two! ..."
    assert one(F.struct(t.code_number(F.lit("160b(i)")), t.code_letter(F.lit("160b(i)")), t.roman(F.lit("160b(i)")))) == (160, "b", 1)
    assert one(t.dotted_key(F.lit("14.1.2.2"))) == [14, 1, 2, 2]
    assert one(t.bold_words(F.lit("Soil is soil"), ["soil"])) == "**Soil** is **soil**"
    assert one(F.struct(*t.language_literal(F.lit('"sol"@fr')))) == ("sol", "fr")


def test_linkml(spark):
    text = "enums:\n  Color:\n    permissible_values:\n      '1': {title: Red, meaning: 'x:1'}\n      2:\n  Empty:\n"
    assert rows(readers.linkml(frame(spark, text, "a: [", "")), "enum_key", "ord", "code", "title", "meaning") == [("Color", 0, "1", "Red", "x:1"), ("Color", 1, "2", None, None)]


def test_providers(spark):
    d = spark.createDataFrame([("a",), (None,)], "x string")
    assert sorted(r.y or "" for r in providers.asked(d, "x", "y", lambda t: [v.upper() for v in t]).collect()) == ["", "A"]
    assert [r.y for r in providers.asked(d, "x", "y").collect()] == [None, None]


def test_walks(spark):
    edges = spark.createDataFrame([("g", "b", "a"), ("g", "c", "b"), ("g", "d", "a"), ("g", "c", "d"), ("g", "a", None), ("h", "x", "y"), ("h", "y", "x")], "grp string, child string, parent string")
    got = walks.depth_first(edges).orderBy("grp", "position").collect()
    assert [(r.code, r.parent, r.depth) for r in got] == [("a", None, 0), ("b", "a", 1), ("c", "b", 2), ("d", "a", 1), ("x", None, 0), ("y", "x", 1)]
    nodes = spark.createDataFrame([("g", "a", None), ("g", "b", "minus"), ("g", "c", "include"), ("g", "d", None)], "grp string, code string, mark string")
    assert sorted((r.code, r.is_a) for r in walks.subtree_filter(nodes, edges.filter("parent IS NOT NULL AND grp = 'g'")).collect()) == [("a", None), ("c", "a"), ("d", "a")]


def test_deep_code_system(spark):
    concept = None
    for k in reversed(range(9)):
        concept = {"code": f"k{k}", **({"concept": [concept]} if concept else {})}
    got = rows(readers.code_system(frame(spark, json.dumps({"concept": [concept]}), "[1]", None)), "code", "is_a", "level")
    assert got == [(f"k{k}", f"k{k - 1}" if k else None, k + 1) for k in range(9)]
