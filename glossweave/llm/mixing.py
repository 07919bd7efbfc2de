"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets follow the weights, at most CAP times what a source has; the excess goes to the others by weight. The mix is cut in
blocks of BLOCK_TOKENS tokens. Blocks are apportioned to sources by highest quotients of their targets, then those of
a source to its shards by the shards' sizes, so that every shard gets an integer quota and works by itself: it lays its
documents out in seeded order, takes whole passes, and picks the rest of its blocks by seeded rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .blocks import checkpointed, plus

WEIGHTS, CAP = (1, 2, 3), 3
BLOCK_TOKENS = 64
#: Documents in a shard, about.
SHARD_DOCUMENTS = 500
FEW_SOURCES = 1 << 16


def targets(sizes: np.ndarray, weights: np.ndarray, cap: float = CAP) -> np.ndarray:
    """Shares of all tokens by weight, none above cap times its source's size."""
    total, out, free = float(sizes.sum()), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        rest = total - out[~free].sum()
        out[free] = rest * weights[free] / weights[free].sum()
        over = free & (out > cap * sizes)
        if not over.any():
            break
        out[over] = cap * sizes[over]
        free &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """seats by the highest quotients votes / 1, votes / 3, votes / 5 ...; of equal quotients the first party's."""
    votes = np.asarray(votes, float)
    given = np.zeros(len(votes), np.int64)
    if seats <= 0 or not votes.sum() > 0:
        return given
    low, high = 0.0, 2 * votes.sum() / seats + votes.max() * 2
    for _ in range(200):  # the least divisor that gives no seat too many
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if np.floor(votes / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    given = np.floor(votes / high + 0.5).astype(np.int64)
    while given.sum() < seats:
        given[np.argmax(votes / (2 * given + 1))] += 1
    return given


def token_counts(docs: DataFrame, text: str, column: str) -> DataFrame:
    """docs without the text, with the number of its words, runs of anything but space, tab, line feed, VT, FF and CR."""
    schema = plus(docs.drop(text), column, "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.string_bytes(batch.column(text))
            counts = [np.diff(tx.words(part, offs, tx.SPACED)[2]) for *_, part, offs in tx.chunks(data, offsets)]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(counts) if counts else [], pa.int64())], [*names, column])

    return docs.mapInArrow(run, schema)


def _plan(weights: tuple, cap: float):
    def run(table: pa.Table) -> pa.Table:
        """A row for each source; the number of sources bounds this one task."""
        names, sizes, docs = table["_k"].to_pylist(), table["source_size"].to_numpy(), table["n"].to_numpy()
        order = sorted(range(len(names)), key=lambda i: (names[i] == "", names[i]))
        w = np.empty(len(names))
        w[order] = [weights[i % len(weights)] for i in range(len(names))]
        target = targets(sizes, w, cap)
        at = np.array(order)
        quota = np.empty(len(names), np.int64)
        quota[at] = sainte_lague(target[at], round(target.sum() / BLOCK_TOKENS))
        return pa.table({"_k": names, "source_size": sizes, "target": target, "quota": quota, "shards": (docs // SHARD_DOCUMENTS + 1).astype(np.int32)}, schema=_PLAN)

    return run


_PLAN = pa.schema([("_k", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("quota", pa.int64()), ("shards", pa.int32())])


def _deal(table: pa.Table) -> pa.Table:
    """The quotas of a source's shards."""
    table = table.sort_by("shard")
    quotas = sainte_lague(table["tokens"].to_numpy(), table["quota"][0].as_py())
    return pa.table({"_k": table["_k"], "shard": table["shard"], "blocks": pa.array(quotas, pa.int64())})


def _take(seed: int, cap: int):
    def run(docs: pa.Table, quotas: pa.Table) -> pa.Table:
        """Words taken of each document of a shard."""
        if not docs.num_rows:
            return docs.append_column("taken", pa.array([], pa.int64())).drop_columns(["_k", "shard", "draw"])
        docs = docs.sort_by([("draw", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        size = docs["size"].to_numpy()
        total = int(size.sum())
        taken = np.zeros(len(size), np.int64)
        if total:
            wanted = (quotas["blocks"][0].as_py() if quotas.num_rows else 0) * BLOCK_TOKENS
            passes = min(cap, wanted // total)
            taken += passes * size
            n = -(-total // BLOCK_TOKENS)
            with np.errstate(over="ignore"):
                rank = tx.mix(np.arange(1, n + 1, dtype=tx.U64) * tx.U64(0x9E3779B97F4A7C15) + tx.U64(seed * 1000003 + (docs["shard"][0].as_py() + 1) * 7919))
            rest = round((wanted - passes * total) / BLOCK_TOKENS) if passes < cap else 0
            chosen = np.zeros(n, bool)
            chosen[np.argsort(rank, kind="stable")[:rest]] = True
            # chosen tokens before any place of the layout
            before = np.concatenate([[0], np.cumsum(np.where(chosen, BLOCK_TOKENS, 0))])
            ends = np.concatenate([[0], np.cumsum(size)])
            block = np.minimum(ends // BLOCK_TOKENS, n - 1)
            upto = before[block] + np.where(chosen[block], ends - block * BLOCK_TOKENS, 0)
            taken += np.diff(upto)
        return docs.append_column("taken", pa.array(taken, pa.int64())).drop_columns(["_k", "shard", "draw"])

    return run


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) of each document.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Null texts have size 0 and are taken 0 times, as are
    all documents of a source without words. Rows that repeat are documents of their own; equal rows may be taken
    differently. No document is taken more than cap times its size.
    A text of more than 1 MiB is a chunk of its own and read whole. An empty table gives an empty one.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("_text"))
    # a few bytes a document, read by each step below
    sized = checkpointed(token_counts(base, "_text", "size")).withColumn("_k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    totals = sized.groupBy("_k").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = totals.groupBy(F.lit(1).alias("all")).applyInArrow(_plan(weights, cap), "_k string, source_size bigint, target double, quota bigint, shards int")
    draw = F.xxhash64(F.lit(seed), "doc_id", "size")
    # a row for each source: broadcast where that is few, so that the documents stay where they are
    plan = checkpointed(plan)
    plan = F.broadcast(plan) if plan.count() <= FEW_SOURCES else plan
    dealt = sized.join(plan, "_k").withColumn("draw", draw).withColumn("shard", F.pmod(F.xxhash64("draw"), "shards").cast("int"))
    quotas = dealt.groupBy("_k", "quota", "shard").agg(F.sum("size").alias("tokens")).groupBy("_k").applyInArrow(_deal, "_k string, shard int, blocks bigint")
    rows = dealt.select("_k", "shard", "draw", "doc_id", "source", "size", "source_size", "target")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("_k", "shard").cogroup(quotas.groupBy("_k", "shard")).applyInArrow(
        _take(seed, cap), f"doc_id {kind}, source string, size bigint, source_size bigint, target double, taken bigint"
    )


def op7_sainte_lague(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
