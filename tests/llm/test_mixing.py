"""Apportionment against a plain queue of quotients, and the mix against its contract."""

import heapq
import random
import re

import numpy as np
from pyspark.sql import functions as F

from glossweave.llm import mixing


def plain(votes, seats):
    queue = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(queue)
    out = [0] * len(votes)
    for _ in range(seats if queue else 0):
        _, i, s = heapq.heappop(queue)
        out[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * s + 3), i, s + 1))
    return out


def test_quotas():
    r = random.Random(5)
    for _ in range(200):
        votes = [r.choice([0, 1, 1, 2, r.randint(1, 10**6), r.random()]) for _ in range(r.randint(1, 12))]
        seats = r.randint(0, 400)
        assert mixing.sainte_lague(np.array(votes, float), seats).tolist() == plain(votes, seats), (votes, seats)


def test_targets():
    sizes, w = np.array([10.0, 1000, 500, 0, 40]), np.array([1.0, 2, 3, 1, 2])
    t = mixing.targets(sizes, w)
    assert abs(t.sum() - sizes.sum()) < 1e-6 and (t <= 3 * sizes + 1e-9).all()
    free = t < 3 * sizes - 1e-9
    assert np.ptp((t / w)[free]) < 1e-6


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w%d" % r.randint(0, 9) for _ in range(r.randint(0, 400))), r.choice(["b", "a", "é", "A", None, "A"]), 0) for i in range(800)]
    rows += [(800, None, "b", 0), (801, "", "empty", 0), (None, "x y", "b", 0), (5, rows[5][1], "b", 0)] + [(900 + i, "one two three", "tiny", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted((x.doc_id if x.doc_id is not None else -1, x.size) for x in got) == sorted((i if i is not None else -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, _ in rows)
    by = {}
    for x in got:
        s = by.setdefault(x.source, [0, 0, x.target, x.source_size])
        s[0] += x.size
        s[1] += x.taken
        assert 0 <= x.taken <= 3 * x.size
    names = sorted(k for k in by if k is not None) + [None]
    expect = mixing.targets(np.array([by[k][0] for k in names], float), np.array([1 + i % 3 for i in range(len(names))], float))
    for k, e in zip(names, expect):
        size, taken, target, told = by[k]
        assert size == told and abs(target - e) < 1e-6
        assert abs(taken - target) <= 3 * mixing.BLOCK_TOKENS, (k, taken, target)
    again = mixing.mix(docs.repartition(5)).groupBy("doc_id", "size").agg(F.sum("taken")).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixing.mix(docs).groupBy("doc_id", "size").agg(F.sum("taken")).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
