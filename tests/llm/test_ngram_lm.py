"""Scores against a plain interpolated model in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossweave.llm import ngram_lm as lm

END = "</s>"


class Plain:
    def __init__(self, texts):
        self.count = [Counter() for _ in range(lm.ORDER + 1)]
        for t in texts:
            for n in range(1, lm.ORDER + 1):
                self.count[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
        self.total, self.v = sum(self.count[1].values()), len(self.count[1])

    def p(self, context, w):
        if not context:
            return (self.count[1][(w,)] + 0.5) / (self.total + 0.5 * (self.v + 1))
        size = self.count[len(context)][context]
        return (self.count[len(context) + 1][(*context, w)] + lm.PRIOR * self.p(context[1:], w)) / (size + lm.PRIOR)


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [END]


@pytest.mark.parametrize("held", [1 << 21, 10])
def test_scores(spark, held, monkeypatch):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "block_count", lambda *_: 3)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["The", "cat", "sat", "on", "é", "mat.", "w%d" % r.randint(0, 40)]) for _ in range(r.randint(0, 60))), "x") for i in range(120)]
    rows += [(500, None, "x"), (501, "", "x"), (501, "", "x"), (None, "the cat", "x"), (502, "unseen words only", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = lm.scored(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1).collect()
    learn = [toks(t) for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    model = Plain(learn)
    assert abs(sum(model.p(("the", "cat"), w) for (w,) in model.count[1]) + model.p(("the", "cat"), "?") - 1) < 1e-9
    expect = []
    for i, t, _ in rows:
        w = toks(t)
        base = sum(math.log10(model.p((), x)) for x in w)
        score = sum(math.log10(model.p(tuple(w[max(0, k - lm.ORDER + 1) : k]), w[k])) for k in range(len(w)))
        expect.append((-1 if i is None else i, len(w), sum(model.count[1][(x,)] > 0 for x in w), model.total, round(base, 6), round(score, 6)))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got) == sorted(expect)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    x = lm.scored(docs, F.lit(False)).first()
    assert (x.n_tokens, x.n_known, x.train_tokens) == (3, 0, 0) and x.score == x.base_score == 0
    assert lm.scored(docs.limit(0), F.lit(True)).count() == 0


def test_rare_words_have_ngrams(spark):
    texts = [" ".join(["the"] * 4999)] * 12 + ["rare pair"]  # one in 60,003 tokens
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "rare pair")], "doc_id long, text string")
    x = lm.scored(docs, F.col("doc_id") < 99).filter("doc_id = 99").first()
    root = lambda n: (n + 0.5) / (60003 + 0.5 * 5)
    seen = lambda shorter: (1 + lm.PRIOR * shorter) / (1 + lm.PRIOR)
    assert x.train_tokens == 60003
    assert abs(x.score - math.log10(root(1) * seen(root(1)) * seen(seen(root(13))))) < 1e-9


def test_long_text(spark):
    """A text of several chunks, beside short ones, scores as by itself in pieces of the same tokens."""
    r = random.Random(5)
    text = " ".join("w%d" % r.randint(0, 300) for _ in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.scored(docs, F.lit(True)).collect()}
    model = Plain([toks(text), toks("w1 w2")])
    w = toks(text)
    assert len(text) > 1 << 20 and got[1].n_tokens == len(w)
    assert abs(got[1].score - sum(math.log10(model.p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(len(w)))) < 1e-4
    assert abs(got[2].score - sum(math.log10(model.p(c, x)) for c, x in (((), "w1"), (("w1",), "w2"), (("w1", "w2"), END)))) < 1e-9


def test_traversal():
    """The states behind all places are those that single steps reach."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    with np.errstate(over="ignore"):
        texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 30))) for _ in range(20)]
        g = lm.Grams(pa.array(texts), np.arange(20) < 12)
        automaton, reached = lm._logs(g, g.counts, float(g.counts[1].sum()), int((g.counts[1] > 0).sum()))
        for a, b in zip(g.first[:-1], g.first[1:]):
            state = np.zeros(1, np.int64)
            for i in range(a, b):
                _, state = automaton.step(state, g.number[1][i : i + 1].astype(np.int64))
                assert state[0] == reached[i] or i == b - 1


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_packing(n):
    import numpy as np

    r = np.random.default_rng(n)
    lm_slices = lm.slices
    for size in (1, 2, 5, 4096, 5000):
        keys = np.unique(r.integers(0, 1 << 64, size, np.uint64))
        for b, i, j in lm_slices(keys, n):
            p = lm._tails(keys[i:j], b, n)
            tails, used = lm._from_tails(p + b"x", j - i)
            assert used == len(p) and len(np.unique(tails)) == j - i and (np.diff(tails) > 0).all() and tails.max() < 1 << lm.TAIL
    counts = np.array([0, 1, 2, 3, 4, 257, 258, 259, 10**6, 0, 1])
    assert (lm._from_numbers(b"x" + lm._numbers(counts), len(counts), 1) == counts).all()
