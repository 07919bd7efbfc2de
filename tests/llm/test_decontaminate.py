"""Contamination against plain windows."""

import random
import re

from glossweave.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((-1 if d is None else d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out)


def test_contamination(spark, monkeypatch):
    r = random.Random(4)
    prose = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(["Ab", "c1", "É", "é", "dd"]) + r.choice("xyz") for _ in range(n))
    items = [(i, prose(r.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(30)] + [(7, prose(20)), (None, prose(15)), (99, None), (98, " .,"), (97, prose(13))]
    items += [(96, items[-1][1])]
    docs = [(None, items[3][1]), (0, None), (1, ""), (2, " - ")]
    for i in range(3, 80):
        docs.append((i, " ".join([prose(r.randint(0, 40)), (r.choice(items)[1] or "").upper().replace("É", "É"), prose(r.randint(0, 40))])))
    docs += [(5, docs[9][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, contamination string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (dc.SLICE_BYTES, 600):  # broadcast, joined
        monkeypatch.setattr(dc, "SLICE_BYTES", size)
        got = dc.contamination(frame, bench).select("doc_id", "contamination.*").collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.n_hit, sorted(x["items"])) for x in got) == brute(docs, items)
    assert dc.contamination(frame.limit(0), bench).count() == 0
    assert dc.contamination(frame, bench.limit(0)).filter("contamination.n_hit > 0").count() == 0
