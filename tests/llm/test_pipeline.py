"""The pipeline against its stages done plainly, one after the other."""

import random
import re

import corpus_pipeline
from tests.llm.test_jaccard import brute as near_brute


def plain(rows, items):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    root = {i: c for i, _, c in near_brute([r[:2] for r in rows])}
    rows = [r for r in rows if root[r[0]] == r[0]]
    data = {r[0]: r[1].encode() for r in rows}
    seen = {}
    for b in data.values():
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    cut = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        cut[i] = bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + min(13, len(w))]) for w in map(words, items) for k in range(len(w) - min(13, len(w)) + 1) if w}
    out = {}
    for i, t in cut.items():
        w = words(t)
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t))
    return out


def test_run(spark, tmp_path):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("abcdeéx") for _ in range(r.randint(1, 8))) for _ in range(n))
    passages, items = [prose(80), prose(60)], [prose(20), prose(30), "tiny item"]
    rows = [(0, None, "en", "a"), (1, "12 34 !", "en", "a"), (2, "", None, None)]
    for i in range(3, 60):
        parts = [prose(r.randint(5, 60)), r.choice([*passages, "", ""]), r.choice([*items, "", "", ""]), prose(10)]
        rows.append((i, " ".join(parts), r.choice(["en", None]), r.choice(["a", "b", None])))
    rows += [(60, rows[20][1], "en", "a"), (61, rows[21][1] + " end", "fr", "b")]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _language string, _cut int, `_contamination` string"
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "own", x[0], "own") for x in rows], ddl)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: x.size for i, x in got.items()} == plain(rows, items)
    assert all(0 <= x.taken <= 3 * x.size for x in got.values())


def test_no_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, "слово", None), (4, "— …", None), (5, None, None)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()) == [1, 3]


def test_clashing_columns(spark, tmp_path):
    """Columns that are named like those of the operators keep their values."""
    spark.createDataFrame([(1, "tiny item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ddl = "doc_id long, text string, lang string, source string, n_chars long, _language string, _cut int, _contamination string"
    docs = spark.createDataFrame([(1, "some words of a text", "en", "a", 20, "own", 5, "mine")], ddl)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == [(1, "some words of a text", "en", "a", 20, "own", 5, "mine")]


def test_one_source_and_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"word{i} " * (i + 1), "en", None if i < 57 else "z", 0) for i in range(60)]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.source for x in got} == {None, "z"} and all(0 <= x.taken <= 3 * x.size for x in got)
    spark.createDataFrame([], ddl).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
