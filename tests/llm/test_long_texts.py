"""Texts beyond a chunk, a block and a shard of the operators' usual size."""

import random

import pytest
from pyspark.sql import functions as F

from glossweave.llm.decontaminate import contamination
from glossweave.llm.fm_dedup import cut_earlier
from glossweave.llm.jaccard import near_duplicates
from glossweave.llm.mixing import mix
from glossweave.llm.ngram_lm import scored
from glossweave.llm.search import top_k
from glossweave.llm.suffix_dedup import cut_repeats
from glossweave.llm.text import CHUNK_BYTES


@pytest.fixture(scope="module")
def words():
    r = random.Random(11)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(170_000)]


@pytest.fixture(scope="module")
def docs(spark, words):
    long = " ".join(words)
    assert len(long) > CHUNK_BYTES
    rows = [(1, long, "a"), (2, long + " the end", "b"), (3, "only a few words here", "a"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def by_id(frame):
    return {x.doc_id: x for x in frame.collect()}


def test_cuts(docs, words):
    got = by_id(cut_repeats(docs))
    assert got[1].cut.kept == b"" and got[2].cut.kept == b" the end" and got[3].cut.kept == b"only a few words here"
    assert [(s.start, s.stop) for s in got[2].cut.spans] == [(0, len(" ".join(words)))]
    got = by_id(cut_earlier(docs))
    assert got[1].cut.kept == " ".join(words) and got[2].cut.kept == "the end" and got[2].cut.n_words == len(words) + 2


def test_benchmark(spark, docs, words):
    items = spark.createDataFrame([("x", " ".join(words[150_000:150_020])), ("y", "not in any of them")], "item_id string, text string")
    got = by_id(contamination(docs, items))
    assert [got[i].contamination.n_hit for i in (1, 2, 3, 4)] == [20, 20, 0, 0]
    assert [(s.start, s.stop) for s in got[1].contamination.spans] == [(150_000, 150_020)] and got[2]["contamination"]["items"] == ["x"]


def test_links_and_scores(docs, words):
    got = by_id(near_duplicates(docs))
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and got[1].n_shingles == len(words) - 4
    got = by_id(scored(docs, F.col("doc_id") != 2))
    assert [got[i].n_tokens for i in (1, 2, 3, 4)] == [len(words) + 1, len(words) + 3, 6, 1] and got[2].n_known == len(words) + 1


def test_mix_and_search(docs, words):
    got = by_id(mix(docs))
    assert [got[i]["size"] for i in (1, 2, 3, 4)] == [len(words), len(words) + 2, 5, 0]
    assert all(x.taken <= 3 * x["size"] for x in got.values())
    found = top_k(docs, docs.filter("doc_id = 1")).orderBy("rank").collect()
    assert {x.doc_id for x in found} == {1, 2}
