"""Enums of places on small made-up lists."""

from test_sources import rows

from glossweave.operators import places

FACTS = "gnid string, qid string, label string, description string"


def test_divisions(spark):
    entries = spark.createDataFrame([("CA", str(i), f"n{i}", f"0{i}") for i in range(1, 7)] + [("XX", "9", "Zoé", "1"), ("XX", "8", "Ana", "2")], "scope string, gnid string, name string, code string")
    facts = spark.createDataFrame([("1", "Q1", "Québec", "province of Canada"), ("2", "", "Ontario", "Province of Canada"), ("3", None, "", "territory of Canada"), ("4", None, None, "territory of Canada"), ("5", None, "e", "city of x"), ("9", None, None, "part of x"), ("8", None, None, "part of x")], FACTS)
    countries = spark.createDataFrame([("CA", "Canada"), ("XX", "")], "scope string, country string")
    pvs, maps, titles = places.divisions(entries, facts, countries)
    assert rows(pvs.filter("scope = 'CA'"), "position", "code", "is_a", "alias") == [
        (1, "Province of Canada", None, None), (2, "2", "Province of Canada", "CA.02"), (3, "1", "Province of Canada", "CA.01"),
        (4, "Territory of Canada", None, None), (5, "3", "Territory of Canada", "CA.03"), (6, "4", "Territory of Canada", "CA.04"),
        (7, "5", None, "CA.05"), (8, "6", None, "CA.06"),
    ]
    assert rows(pvs.filter("scope = 'XX'"), "position", "code", "title") == [(1, "8", "Ana"), (2, "9", "Zoé")]
    assert rows(titles, "scope", "title") == [("CA", "Province or Territory of Canada"), ("XX", "Part")]
    assert maps.filter("predicate_id = 'skos:broadMatch'").count() == 8
    assert rows(maps.filter("predicate_id = 'skos:exactMatch'"), "subject_id", "object_id", "object_label") == [("gnf:1", "wd:Q1", "Québec")]


def test_subdivisions(spark):
    entries = spark.createDataFrame([("CA", "01", "a", "5", "five", "CA.01.a.5", "ADM4"), ("CA", "02", "b", "6", "six", "CA.02.b.6", ""), ("CA", "03", "c", "7", "seven", "CA.03.c.7", None)], "scope string, adm1 string, adm2 string, gnid string, name string, code string, feature string")
    above = spark.createDataFrame([("CA.01.a", "11"), ("CA.01", "1"), ("CA.02", "2")], "code string, gnid string")
    pvs, maps = places.subdivisions(entries, spark.createDataFrame([], FACTS), above)
    assert rows(pvs, "position", "code", "title", "is_a") == [(1, "5", "five", "11"), (2, "6", "six", "2"), (3, "CA.03.c", "CA.03.c", None), (4, "7", "seven", "CA.03.c")]
    assert rows(maps, "subject_id", "object_id") == [("gnf:5", "gno:A.ADM4"), ("gnf:6", "gno:A.ADM3"), ("gnf:7", "gno:A.ADM3")]


def test_settlements(spark):
    towns = spark.createDataFrame([("CA", "Q1", "1", "Écho", None, "v", False, ["Q8", "Q9"]), ("CA", "Q2", "", "Delta", None, "x", True, None), ("CA", None, "3", "Lost", None, "v", None, [])], "scope string, qid string, gnid string, title string, description string, kind string, gone boolean, parents array<string>")
    sizes = spark.createDataFrame([("t", 1, "Town"), ("v", 2, "Village")], "kind string, rank int, label string")
    pvs, maps = places.settlements(towns, sizes)
    assert rows(pvs, "position", "code", "is_a", "status") == [(1, "Village", None, None), (2, "Q2", None, "historical"), (3, "Q1", "Village", None)]
    assert rows(maps, "subject_id", "predicate_id", "object_id") == [("wd:Q1", "skos:broader", "wd:Q8"), ("wd:Q1", "skos:broader", "wd:Q9"), ("wd:Q1", "skos:broader", "wd:v"), ("wd:Q1", "skos:exactMatch", "gnf:1")]
