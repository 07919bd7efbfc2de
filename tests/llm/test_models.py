"""Held-out accuracy of the language and toxicity models, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.llm import langid, toxicity

SYLLABLES = {"aa": "tha ing er wo ke".split(), "bb": "é que ou lle ai".split(), "cc": "при вет до мир ка".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, prose(r, lang, r.randint(5, 60)), lang, 0))
    rows += [(900, None, "aa", 0), (901, "", None, 0), (902, "12 !?", "bb", 0), (903, "— … “”", "aa", 0), (None, prose(r, "cc", 9), "cc", 0)]
    rows.append((904, prose(r, "aa", 40) + " " + prose(r, "bb", 12) + " " + prose(r, "aa", 30), "aa", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")


def test_languages(spoken):
    got = {x.doc_id: x for x in langid.predicted(spoken, column="language").collect()}
    assert all(got[i].language.lang == got[i].lang for i in range(300))
    assert all(got[i].language.lang == "und" and got[i].language.score == 0 for i in (900, 901, 902, 903))
    assert got[None].language.lang == "cc"
    mixed = got[904].language
    assert mixed.lang == "aa" and [s.lang for s in mixed.spans] == ["aa", "bb", "aa"] and 0.5 < mixed.score < 1
    none = langid.languages(spoken, None).select("language.lang").distinct().collect()
    assert [x.lang for x in none] == ["und"]
    assert langid.predicted(spoken.limit(0)).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    m = langid.Model(["x", "y", "z"], np.ones((3, langid.FEATURES)), np.ones((3, 30)))
    r = np.random.default_rng(0)
    first = np.array([0, 4, 4, 9, 10])
    e = r.normal(size=(10, 3)).astype(np.float32) * 10
    path = m.path(e, first)
    for a, b in itertools.pairwise(first):
        cost = lambda p: sum(e[a + i, s] for i, s in enumerate(p)) - langid.PENALTY * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=b - a), key=cost)
        assert abs(cost(best) - cost(path[a:b])) < 1e-3


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.2
        w = prose(r, "aa", r.randint(20, 80)).split()
        if bad:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["nasty", "vile"]))
        rows.append((i, " ".join(w), 0))
        labels.append((i, int(bad)))
    truth = dict(labels)
    rows += [(5000, None, 0), (5001, "", 0), (None, "vile nasty vile", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = spark.createDataFrame([*labels, (5000, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    weights = toxicity.train(docs, known.filter("doc_id % 3 <> 1"), "doc_id", "text", "toxic")
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, weights, column="score").collect()}
    held = [i for i in range(1500) if i % 3 == 1]
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= toxicity.LIMIT) == bool(truth[i]) for i in held]
    assert sum(right) / len(right) > 0.97 and got[5000] == got[5001] < 0.5 < got[None]
    assert toxicity.train(docs, known.limit(0), "doc_id", "text", "toxic") is None
    assert toxicity.toxicity(docs, None).agg(F.max("toxicity")).first()[0] == 0
    assert toxicity.toxicity(docs.limit(0), weights).count() == 0


def test_all_languages_are_learned(spoken, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    got = langid.predicted(spoken, column="language").filter("doc_id < 300").select("lang", "language.lang").collect()
    assert {x[1] for x in got} == set(SYLLABLES) and all(x[0] == x[1] for x in got)


def test_emissions_are_the_same_in_any_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from glossweave.llm import text as tx

    r = np.random.default_rng(3)
    m = langid.Model(list("abcde"), r.random((5, langid.FEATURES)) * 9, np.ones((5, 30)))
    w = langid.Words(*tx.string_bytes(pa.array(["", "Ein kurzes Wort", "x" * 300 + " y", "12", "привет é"])))
    want = [sum(m.weights[f[0]] + m.weights[f[1]] for f in w.features[b : b + n]) for b, n in zip(w.begin, w.length, strict=True)]
    for cells in (1, 40, 1 << 21):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(m.emissions(w), want, rtol=1e-4)


def test_very_long_texts(spark, spoken):
    import numpy as np

    r = random.Random(7)
    long = " ".join([prose(r, "aa", 40_000), prose(r, "bb", 150_000), "q" * (1 << 20), prose(r, "cc", 100)])
    assert len(long.encode()) > 2 << 20
    docs = spark.createDataFrame([(1, "short", 1.0), (2, long, 2.0), (3, prose(r, "aa", 9), 3.0)], "doc_id long, text string, lang double")
    model = langid.train(spoken.filter("text IS NOT NULL AND lang IS NOT NULL"), "text", "lang")
    got = {x.doc_id: x for x in langid.languages(docs, model).collect()}
    spans = got[2].language.spans
    assert got[3].language.lang == "aa" and got[2].lang == 2.0
    assert spans[0].lang == "aa" and spans[-1].lang == "cc" and spans[-1].stop == len(long.encode())
    assert sum(s.stop - s.start for s in spans if s.lang == "bb") > 0.5 * (150_000 * 6)
    weights = toxicity.Weights(np.array([], int), np.array([]), -1.0)
    assert len({x.toxicity for x in toxicity.toxicity(docs, weights).collect()}) == 1


def test_ftrl_is_the_plain_rule():
    import math

    import numpy as np
    import pyarrow as pa

    texts = ["one two three", "two four", "", "one one five two", "vile two"] * 6
    labels = [0, 1, 0, 0, 1] * 6
    with np.errstate(over="ignore"):
        got = toxicity.fit(pa.array(texts), np.array(labels, float), epochs=2)
        rows = [f[a:b].tolist() for f, first in toxicity._chunked(pa.array(texts)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for row, y in zip(rows, labels, strict=True):
            at = [*row, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                s = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0) + g - s * w[i], n.get(i, 0) + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert want and set(got.at.tolist()) == set(want) and abs(got.bias - weight("bias")) < 1e-6
    assert all(abs(v - want[i]) < 1e-5 for i, v in zip(got.at.tolist(), got.weight.tolist(), strict=True))


def test_repeated_training_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "a b"), (2, "d")] * 40, "doc_id long, text string")
    once = spark.createDataFrame([(1, "a b"), (2, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    a, b = (toxicity.train(x, labels, "doc_id", "text", "toxic") for x in (docs, once))
    assert a.at.tolist() == b.at.tolist() and a.weight.tolist() == b.weight.tolist() and a.bias == b.bias
