"""Joins that aren't equalities, and cascades of them."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as t
from ..plans.stages import FEW, bounded


def range_bucket(rows: DataFrame, ranges: DataFrame, column: str) -> DataFrame:
    """rows with the category of the range (lo, hi, category) that their value is in; ranges are a small table without overlaps."""
    return rows.join(bounded(ranges), F.col(column).between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def cascade(rows: DataFrame, *maps: tuple[DataFrame, str]) -> DataFrame:
    """The value of the first map (key, value) that has a row's key in the named column, and that map's number."""
    out, found = rows, []
    for i, (table, key) in enumerate(maps):
        name = f"_v{i}"
        out = out.join(table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(name)), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(name)
    stage = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(i + 1)) for i, n in enumerate(found)))
    return out.withColumn("value", F.coalesce(*found)).withColumn("stage", stage).drop(*found)


def positional(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides paired by their place in the group."""
    number = lambda d, o: d.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(o)))
    return number(left, left_order).join(number(right, right_order), [group, "place"], "left")


def token_jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def assigned(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """One to one: pairs (lid, rid, score) of token Jaccard of at least `least`, best of either side. Both: (id, title).

    Pairs of `least` share one of the n - ceil(least * n) + 1 rarest tokens of either side, so only these are joined: no
    frequent word brings all its titles together.
    """
    words = lambda d, k: d.select(F.col("id").alias(k), t.tokens(F.col("title")).alias(k + "_t"))
    a, b = words(left, "lid"), words(right, "rid")
    each = lambda d, k: d.select(k, F.size(k + "_t").alias("n"), F.explode(k + "_t").alias("w"))
    often = each(a, "lid").select("w").union(each(b, "rid").select("w")).groupBy("w").agg(F.count("*").alias("often"))

    def rare(d: DataFrame, k: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(k).orderBy("often", "w"))
        return each(d, k).join(often, "w").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(k, "w")

    near = rare(a, "lid").join(rare(b, "rid"), "w").select("lid", "rid").distinct()
    scored = near.join(a, "lid").join(b, "rid").withColumn("score", F.round(token_jaccard(F.col("lid_t"), F.col("rid_t")), 4)).filter(F.col("score") >= least)
    best = lambda k, o: F.row_number().over(Window.partitionBy(k).orderBy(F.desc("score"), o))
    first = scored.withColumn("n", best("lid", "rid")).filter("n = 1")
    return first.withColumn("m", best("rid", "lid")).filter("m = 1").select("lid", "rid", "score")


#: Glossary entries that a title is compared with in one row.
ENTRIES = 2_000


def _letters(texts: list[str]) -> np.ndarray:
    """How many characters of each of 64 classes texts have: the sum of two texts' minima is no less than what a matching can pair."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, x in enumerate(texts):
        np.add.at(out[i], np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, 1)
    return out


def _best(titles: list[str], entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each title the highest sequence ratio with an entry, and the first entry that has it; -1 without any over 0."""
    have, size = _letters(titles), np.array([len(x) for x in titles])
    ratio, which = np.zeros(len(titles)), np.full(len(titles), -1)
    matcher = SequenceMatcher(None)
    for k, (entry, own) in enumerate(zip(entries, _letters(entries), strict=True)):
        bound = 2.0 * np.minimum(have, own).sum(axis=1) / np.maximum(size + len(entry), 1)
        matcher.set_seq2(entry)
        for i in np.flatnonzero(bound > ratio):
            matcher.set_seq1(titles[i])
            if (r := matcher.ratio()) > ratio[i]:
                ratio[i], which[i] = r, k
    return ratio, which


def best_ratio(left: DataFrame, glossary: DataFrame, least: float = 0.65) -> DataFrame:
    """left (id, title) with the key of the glossary's entry (ord, key, text) of the best sequence ratio, if it is at least `least`, and the ratio.

    Equal titles are compared once, with a block of the glossary a row; entries whose letters can't reach the best ratio so far are
    passed over. Case doesn't count; of equal ratios the first entry counts. Null and empty titles, and all titles with an empty glossary, have the ratio 0.
    """
    key = F.lower(F.coalesce("title", F.lit("")))
    blocks = glossary.filter("text IS NOT NULL").groupBy(F.floor(F.col("ord") / ENTRIES).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("ord", "key", F.lower("text").alias("text")))).alias("entries"))
    pairs = left.select(key.alias("_t")).distinct().crossJoin(bounded(blocks, FEW // ENTRIES))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("_g"):
                entries, titles = part["entries"].iloc[0], part["_t"].tolist()
                ratio, which = _best(titles, [e["text"] for e in entries])
                found = [entries[k] if k >= 0 else None for k in which]
                yield pd.DataFrame({"_t": titles, "ratio": ratio, "ord": [e["ord"] if e else None for e in found], "key": [e["key"] if e else None for e in found]})

    scored = pairs.mapInPandas(run, "_t string, ratio double, ord long, key string").filter("ratio > 0")
    best = scored.groupBy("_t").agg(F.max_by(F.struct("ratio", "key"), F.struct("ratio", -F.col("ord"))).alias("_b"))
    both = left.select("id", "title", key.alias("_t")).join(best, "_t", "left")
    return both.select("id", "title", F.when(F.col("_b.ratio") >= least, F.col("_b.key")).alias("match"), F.round(F.coalesce("_b.ratio", F.lit(0.0)), 4).alias("ratio"))


def scale_matches(texts: DataFrame, scales: DataFrame) -> DataFrame:
    """Of each text (id, text) the scale (dimension, word) of which it holds most words; scales are a small table."""
    hit = texts.join(bounded(scales), t.holds(F.col("text"), F.col("word"))).groupBy("id", "dimension").agg(F.count("*").cast("double").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "dimension")
    return hit.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def grounded(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, n): in how many texts each of some items is found, ignoring case; the items are a small table."""
    hit = texts.join(bounded(items.select("item_id", F.col("text").alias("_item"))), t.holds(F.col("text"), F.col("_item")))
    n = hit.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
