"""The best sequence ratio against all comparisons."""

import random
from difflib import SequenceMatcher

from glossweave.operators import matching


def test_best_ratio(spark, monkeypatch):
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdéÉX") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3)))
    glossary = [(i, f"k{i}", text()) for i in range(40)] + [(40, "null", None), (41, "empty", ""), (42, "again", None)]
    glossary[42] = (42, "again", glossary[3][2].upper())
    titles = [text() for _ in range(60)] + [None, "", glossary[3][2], glossary[3][2], "zz"]
    left = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    table = spark.createDataFrame(glossary, "ord long, key string, text string")

    def brute(title):
        best = max(((SequenceMatcher(None, (title or "").lower(), g.lower()).ratio(), -o, k) for o, k, g in glossary if g is not None), default=(0, 0, None))
        if not title:  # nothing is like an empty title
            return None, 0.0
        return (best[2] if best[0] >= 0.65 else None), round(best[0], 4)

    for size in (matching.ENTRIES, 7):
        monkeypatch.setattr(matching, "ENTRIES", size)
        got = {x.id: (x.match, x.ratio) for x in matching.best_ratio(left, table).collect()}
        assert got == {i: brute(x) for i, x in enumerate(titles)}
    assert {x.ratio for x in matching.best_ratio(left, table.limit(0)).collect()} == {0.0}
    assert matching.best_ratio(left.limit(0), table).count() == 0
