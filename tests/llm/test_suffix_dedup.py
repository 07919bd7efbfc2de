"""Repeated 200-byte strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossweave.llm import suffix_dedup as sd


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(k) for k in (30, 45, 60, 90, 200)] + ["x" * 450, "ab" * 300]
    texts = [None, "", "short", "x" * 199, "x" * 200, "x" * 201]
    for _ in range(60):
        parts = [prose(r.randint(0, 60)) for _ in range(4)]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[10], texts[11], texts[11][:-3], texts[12][5:] + "tail", texts[13] * 2]
    return texts


def simulated(texts, hot, blocks=4, n=5):
    """The steps without Spark."""
    docs = [pa.table({"_block": pa.array([b] * len(rows), pa.int32()), "i": [i for i, _ in rows], "t": pa.array([t for _, t in rows], pa.string())}) for b in range(blocks) if (rows := [(i, t) for i, t in enumerate(texts) if i % blocks == b])]

    def regroup(tables, *keys):
        groups = defaultdict(list)
        for row in (r for t in tables for r in t.to_pylist()):
            groups[tuple(row[k] for k in keys)].append(row)
        return {k: pa.Table.from_pylist(v, schema=sd._ASK) for k, v in groups.items()}

    told = regroup([sd._settle(hot)(t) for t in regroup([sd._ask(n)(d) for d in docs], "bucket").values()], "block")
    empty = sd._ASK.empty_table()
    sent = [sd._send(n)(d, told.get((d["_block"][0].as_py(),), empty)) for d in docs]
    answers = regroup([sd._answer(t) for t in regroup(sent, "kind", "bucket").values()], "block")
    rows = [x for d in docs for x in sd._cut(n, "cut")(d, answers.get((d["_block"][0].as_py(),), empty)).to_pylist()]
    out = {}
    for x in rows:
        cut = x["cut"]
        out[x["i"]] = (cut["n_bytes"], cut["n_bytes"] - len(cut["kept"]), len(cut["spans"]), hashlib.sha256(cut["kept"]).hexdigest())
    return [out[i] for i in range(len(texts))]


@pytest.mark.parametrize("hot", [4096, 1])
def test_steps(hot, monkeypatch):
    monkeypatch.setattr(sd, "SORTED_AT_ONCE", 3000)
    for seed in (1, 2):
        texts = corpus(seed)
        assert simulated(texts, hot) == brute(texts)


def test_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_spark(spark):
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "block", 1) for i, t in enumerate(texts)], "doc_id long, text string, _block string, t int")
    rows = sd.cut_repeats(docs, column="cut").select("doc_id", "cut.n_bytes", F.octet_length("cut.kept").alias("k"), F.size("cut.spans").alias("s"), F.sha2("cut.kept", 256).alias("h")).collect()
    assert [(x.n_bytes, x.n_bytes - x.k, x.s, x.h) for x in sorted(rows)] == brute(texts)
    assert sd.cut_repeats(docs.limit(0)).count() == 0
