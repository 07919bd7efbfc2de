"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from glossweave.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(s), -1 if i is None else root(i)) for (i, _), s in zip(rows, sets))


def corpus(seed, copies=40):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "é", "x1"]) + str(r.randint(0, 60))
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  TWO"), (4, "a b c d"), (5, "a b c d e"), (6, "a b c d e f"), (None, "one two")]
    base = [[word() for _ in range(r.choice([6, 9, 20, 40, 80, 200]))] for _ in range(25)]
    i = 10
    for b in base:
        for _ in range(r.randint(1, 6)):
            w = list(b)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: int(len(w) * r.uniform(0.75, 1))]
            rows.append((i, " ".join(w)))
            i += 1
    hot = [word() for _ in range(120)]
    for _ in range(copies):
        w = list(hot)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(120)] = word()
        rows.append((i, " ".join(w)))
        i += 1
    rows += [(i, rows[30][1]), (i + 1, rows[31][1].upper()), (12, rows[40][1]), (-7, rows[50][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1 << 20, 400])
def test_near_duplicates(spark, shard, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARD_SHINGLES", shard)
    monkeypatch.setattr(jaccard, "block_count", lambda *_: 3)
    rows = corpus(shard)
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, n int")
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_shingles, -1 if x.component_id is None else x.component_id) for x in got) == brute(rows)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("probed", [1, 64, 10**6])
def test_search(probed, monkeypatch):
    monkeypatch.setattr(jaccard, "PROBED", probed)
    r = np.random.default_rng(3)
    sets = [np.unique(r.choice(60, r.integers(1, 50)).astype(np.uint64)) for _ in range(300)]
    index = jaccard.Index(sets)
    for s in [*sets, np.arange(0, 90, 2, dtype=np.uint64)]:
        found = set(index.search(s).tolist())
        assert found == {i for i, t in enumerate(sets) if 5 * len(np.intersect1d(s, t)) >= 4 * len(np.union1d(s, t))}


@pytest.mark.parametrize("shard", [1 << 20, 400])
def test_link_counts(spark, shard, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARD_SHINGLES", shard)
    monkeypatch.setattr(jaccard, "block_count", lambda *_: 3)
    rows = corpus(shard + 1)
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set() if i is None else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    count = [sum(j != k and bool(a and b) and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for k, a in enumerate(sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs, links=True).collect()
    number = lambda i: -1 if i is None else i
    assert max(count) > 20
    assert sorted((number(x.doc_id), x.n_shingles, x.n_links) for x in got) == sorted((number(i), 1 if i is None else len(s), n) for (i, _), s, n in zip(rows, sets, count))
    assert sorted((number(x.doc_id), x.n_shingles, number(x.component_id)) for x in got) == brute(rows)
