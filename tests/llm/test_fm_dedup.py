"""Windows of earlier documents, and backward search, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import fm_dedup as fm


def brute(rows):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            if i is not None:
                least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "bb", "é", "ccc", "Dd"]) * r.randint(1, 3) + r.choice("xyz,.")
    prose = lambda n: r.choice([" ", "  ", "\n", "\t"]).join(word() for _ in range(n))
    passages = [prose(k) for k in (13, 14, 20, 60)] + ["same " * 40]
    rows = [(0, None), (1, ""), (2, " \n "), (None, passages[2]), (3, " ".join("w%d" % i for i in range(12))), (4, " ".join("w%d" % i for i in range(13)))]
    for i in range(5, 90):
        parts = [prose(r.randint(0, 30)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, 3), r.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(90, rows[10][1]), (91, rows[11][1]), (91, rows[11][1] + " more"), (-5, rows[12][1]), (92, None), (40, rows[13][1])]
    r.shuffle(rows)
    return rows


def test_index():
    r = np.random.default_rng(0)
    for n in (3, 50, 400):
        text = np.append(r.integers(1, 5, n), 0)
        index = fm.FMIndex(text, 5, 8)
        depth = min(8, n)
        ends = np.arange(depth - 1, n)
        length, low, high = index.matching(text, ends, depth)
        for e, m, i, j in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
            places = lambda size, e=e: [k for k in range(n - size + 1) if (text[k : k + size] == text[e - size + 1 : e + 1]).all()]
            assert m == max((size for size in range(1, depth + 1) if len(places(size)) > 1), default=0)
            assert not m or sorted(index.suffixes[i:j].tolist()) == places(m)


@pytest.mark.parametrize("hot", [4096, 1])
def test_cut(spark, hot, monkeypatch):
    monkeypatch.setattr(fm, "block_count", lambda *_: 5)
    rows = corpus(hot)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, k string, _block int")
    gone = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    got = fm.cut_earlier(docs, hot=hot).select("doc_id", "cut.n_words", gone.alias("g"), F.sha2("cut.kept", 256).alias("h")).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_words, x.g, x.h) for x in got) == brute(rows)
    assert fm.cut_earlier(docs.limit(0)).count() == 0
