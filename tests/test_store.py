"""Runs over a store: the steps in their order, on small files."""

import json

import pytest
from test_handbooks import OBO, owl, owl_class

from glossweave.__main__ import parsed
from glossweave.plans import store as st


def lines(df):
    return [r.line for r in df.collect()]


def test_options():
    folder, asked = parsed(["-i", "x", "-b", "-f", "a", "b", "--search", "soil; rock", "-r"])
    assert (folder, asked) == ("x", {"build": [], "fetch": ["a", "b"], "report": True, "search": "soil; rock", "format": "text", "lang": "fr"})


def test_run(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "Soils.owl").write_text(owl(owl_class("A_1", label="soil"), owl_class("A_2", "A_1", label="sandy soil")))
    (files / "codes.json").write_text(json.dumps({"resourceType": "CodeSystem", "concept": [{"code": "k", "display": "Clay"}, {"code": "k", "display": "Clays"}]}))
    (files / "maps.sssom.tsv").write_text(f"subject_id\tpredicate_id\tobject_id\n{OBO}A_2\tskos:exactMatch\tx:1\n{OBO}A_2\tskos:exactMatch\tx:0\n")
    s = st.Store(spark, str(tmp_path / "store"))
    assert lines(st.report(s)) == []
    out = st.run(s, {"build": None, "lookup": [], "fetch": ["all"], "config": [], "sssom": [], "search": "sandy soil; nothing", "add": [str(files)], "report": True})
    assert list(out) == ["lookup", "report", "search"]
    assert lines(out["lookup"]) == ["Soils\t2", "codes\t1", "total\t3"]
    assert lines(out["report"]) == ["CodeSystem\tcodes\tcodes\t", "OWL\tSoils\tSoils\t"]
    assert lines(out["search"])[0].split()[1] == "A_2" and lines(out["search"])[-1] == "nothing: (no matches)"
    assert [(r.code, r.objects) for r in s.read("mapped").collect()] == [("A_2", ["x:0", "x:1"])]
    assert s.read("prefixes").filter("prefix = 'obo'").count() == 1
    st.run(s, {"translate": "codes"}, lambda texts: ["Argile" if x.startswith("Clay") else None for x in texts])
    assert [(r.code, r.lang, r.title) for r in s.read("locale").collect()] == [("k", "fr", "Argile")]

    (files / "codes.json").write_text("{}")  # far less than before: what is stored stays
    st.run(s, {"fetch": ["codes"], "build": ["codes"]})
    assert lines(st.lookup(s, ["codes"])) == ["codes\t1", "total\t1"]
    st.run(s, {"delete": ["codes"]})
    assert lines(st.lookup(s)) == ["Soils\t2", "total\t2"]
    with pytest.raises(ValueError, match="no such steps"):
        st.run(s, {"burn": None})
