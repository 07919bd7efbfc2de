"""Readers of ontologies, handbooks and taxonomies on small made-up files."""

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from test_sources import frame, rows  # noqa: E402

from pyspark.sql import functions as F

from glossweave.sources import handbooks as h

OBO = "http://purl.obolibrary.org/obo/"


def owl(*classes: str) -> str:
    return (
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" '
        'xmlns:dct="http://purl.org/dc/terms/" xmlns:obo="http://purl.obolibrary.org/obo/">' + "".join(classes) + "</rdf:RDF>"
    )


def owl_class(code: str, *parents: str, inner: str = "", label: str | None = None) -> str:
    above = "".join(f'<rdfs:subClassOf rdf:resource="{OBO}{p}"/>' for p in parents)
    return f'<owl:Class rdf:about="{OBO}{code}">{above}<rdfs:label xml:lang="en-GB">{label or code.lower()}</rdfs:label>{inner}</owl:Class>'


def test_owl_classes(spark):
    doc = owl(
        f'<owl:Class rdf:about="{OBO}A_1"><rdfs:label>plain</rdfs:label><rdfs:label xml:lang="fr">le</rdfs:label><rdfs:label xml:lang="en">the</rdfs:label><dct:description>later</dct:description></owl:Class>',
        f'<rdf:Description rdf:about="{OBO}A_1"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#Class"/><obo:IAO_0000115>first</obo:IAO_0000115></rdf:Description>',
        f'<owl:Class rdf:about="{OBO}A_2"><rdfs:label xml:lang="fr">le</rdfs:label><rdfs:subClassOf rdf:resource="{OBO}A_1"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf><owl:deprecated>true</owl:deprecated></owl:Class>',
        '<owl:Class rdf:about="http://www.w3.org/2002/07/owl#Thing"/>',
    )
    classes = h.owl_classes(frame(spark, doc, "no xml", None))
    assert rows(classes, "code", "title", "description", "deprecated", "parents") == [("A_1", "the", "first", False, []), ("A_2", None, None, True, [OBO + "A_1"])]
    assert rows(h.obo_prefixes(classes), "prefix", "uri") == [("A", OBO + "A_")]
    assert rows(h.ontology_values(classes), "code", "status", "is_a") == [("A_1", None, None), ("A_2", "DEPRECATED", "A_1")]


def test_ontology_values(spark):
    doc = owl(owl_class("A_1"), owl_class("A_2", "A_1", label="left side"), owl_class("A_3", "A_2"), owl_class("A_4", "A_3"), owl_class("B_1"))
    classes = h.owl_classes(frame(spark, doc))
    got = lambda *a: rows(h.ontology_values(classes, *a), "code", "is_a")
    assert got(["Left_Side"], ["A_4"]) == [("A_4", None)]
    assert got(["left side"]) == [("A_1", None), ("B_1", None)]
    assert got([], ["a_2"]) == [("A_2", None), ("A_3", "A_2"), ("A_4", "A_3")]
    assert got(["a_3"], ["a_1", "a_4"]) == [("A_1", None), ("A_2", "A_1"), ("A_4", "A_2")]


def test_split_fields(spark):
    cases = {
        "sandy loam Sandy loam Soil of sand. ": ("sandy loam", "Sandy loam", "Soil of sand."),
        "a a A No description available.": ("a", "a", "A"),
        "till, ablation Ablation till Left by ice.": ("till, ablation", "Ablation till", "Left by ice."),
        "till, unspecified Till Left by ice.": ("till, unspecified", "Till", "Left by ice."),
        "clay Fine soil No description available.": ("clay", "Fine soil", ""),
        "clay Fine soil": ("clay", "Fine soil", ""),
        "Only this": ("Only this", "Only this", ""),
        "all small": ("all small", "all small", ""),
        "": ("", "", ""),
        None: ("", "", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", *(c.alias(n) for c, n in zip(h.split_fields(F.col("x")), "abc", strict=True)))
    assert {r.x: (r.a, r.b, r.c) for r in df.collect()} == cases


def test_domain_tables(spark):
    doc = "Yes 1 lost\nDomain Name: color\nNASIS 7.4\nDomain Description: The hue\nof soil.\nObsolete? ID\nNo 1,204 red Red Like blood,\nor so.\n1 of 9\nYes 7 blue Blue\n\nDomain Name: kind\nDomain Description: No description available.\nnot told\nNo 3 x X\n"
    domains, table = h.domain_tables(frame(spark, doc, "", None))
    assert rows(domains, "domain", "description") == [("color", "The hue of soil."), ("kind", None)]
    assert rows(table, "domain", "ord", "obsolete", "entry", "label", "description") == [("color", 0, False, "red", "Red", "Like blood, or so."), ("color", 1, True, "blue", "Blue", None), ("kind", 0, False, "x", "X", None)]


CODEX = """Contents
PART II: later
TABLE ONE 66
01.0  Dairy
PART II: Food Category Descriptors
01.1 Milk:
Whole and skimmed milk.1, 2
CXS 192-1995
and more since 2004
1 Without sugar
that was added.
2 Or cream
===PAGE 7===

small letters here3
01.2 Cheese
PART III: other
01.2 Not this
TABLE ONE
ACESULFAME
INS 950 Acesulfame Functional Class: Sweetener, Flavour,
FoodCatNo 01.1
NOTES
4-HEXYLRESORCINOL
586INS Antioxidant Functional Class:
INS 4 x Functional Class: lost
TABLE TWO
OTHER
INS 7 x Functional Class: lost
"""


def test_category_texts_and_additives(spark):
    got = rows(h.category_texts(frame(spark, CODEX, "", None)), "code", "description", "notes")
    assert got == [("01.1", "Whole and skimmed milk.1, 2 and more since 2004 small letters here3", ["Without sugar that was added.", "Or cream"])]
    assert rows(h.additive_entries(frame(spark, CODEX, "", None)), "name", "code", "description") == [("4-HEXYLRESORCINOL", "586", None), ("ACESULFAME", "950", "Functional class: Sweetener, Flavour")]


def test_taxonomy(spark):
    chapter = '<table><th headers="t201"> <a href="/taxa/BR/MB/index.html">Melanic</a></th><th headers="t9"><a href="/x/y.html">no</a></th></table>'
    long = "A paragraph that has more than forty characters in it, so it counts."
    page = f"<main><h1>Melanic <b>Brunisol</b> (MB)</h1><p>short</p><p>{long}</p><section><h2>Orthic (O.MB)</h2><p>Common horizon sequence: Ah, Bm, and so on for long</p><p>{long}</p></section><section><h2>none</h2></section></main>"
    docs = lambda url, text: spark.createDataFrame([(url, text)], "url string, content string")
    url = "http://h/taxa/BR/MB/index.html"
    links = h.group_links(docs("http://h/taxa/c5.html", chapter))
    assert rows(links, "href", "name") == [(url, "Melanic")]
    pages = h.group_pages(docs(url, page).unionAll(docs("http://h/none", "<p>x</p>")).unionAll(docs("http://h/null", None)))
    assert rows(pages, "ord", "code", "title", "description") == [(0, "MB", "Melanic Brunisol", long), (1, "O.MB", "Orthic", long)]
    orders = spark.createDataFrame([("http://h/taxa/c5.html", "BR", "Brunisolic", None)], "url string, code string, title string, description string")
    other = h.group_pages(docs(url, "<h1>Brunisol (BM)</h1><section><h2>Orthique (O.BM)</h2></section>"))
    got = rows(h.taxonomy(orders, links, pages, other), "code", "is_a", "level", "other_title")
    assert got == [("BR", None, 1, None), ("BR.MB", "BR", 2, "Brunisol"), ("O.MB", "BR.MB", 3, "Orthique")]


def test_detection(spark):
    from glossweave.sources.readers import content_type

    cases = {
        "AGROVOC_c_1": "Thesaurus", "https://snomed.info/id/12": "OntologyAPI", "ENVO_00010483": "OntologyAPI", "https://www.nrcs.usda.gov/x/NASIS%207.pdf": "SoilHandbook", "https://www.nrcs.usda.gov/x/book.pdf": "FieldBook",
        "https://www.fao.org/x/CXS_192_2015e.pdf": "FoodCodes", "https://query.wikidata.org/sparql?P628": "Additives", "https://www.loc.gov/catdir/cpso/lcco/": "LibraryClassification", "ISO_COUNTRY": "Country",
        "https://www.iso.org/obp/ui/#iso:code:3166:CA": "Country", "GeoNames_ADM2_CA": "GeoNamesADM2", "GeoWiki_ADM2_CA": "GeoWiki", "https://terminology.hl7.org/5.0/ValueSet-x.html": "CodeTable", "https://terminology.hl7.org/x.html": "Listing",
        "https://sis.agr.gc.ca/cansis/nsdb/soil/v2/snt/a.html": "AttributePages", "https://x/a.OWL?b": "OWL", "https://x/a.sssom.tsv": "SSSOM", "x.yml": "LinkML", "x.txt": "FreeText",
    }
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", content_type(F.col("u"), F.lit("")).alias("c")).collect()
    assert dict(map(tuple, got)) == cases
    heads = {"﻿Niveau,Code": "Classification", ",title,description,source": "Picklist", '{"resourceType" : "ValueSet"}': "ValueSet", "<HTML><dl>": "DefinitionList", "<html>": "HTML", "": "FreeText"}
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", content_type(F.lit("x"), F.col("h")).alias("c")).collect()
    assert dict(map(tuple, got)) == heads
