"""Jaccard self-join of documents by 5-word shingles, by T-occurrence search (DivideSkip), exactly.

1. Sets that could have a partner: with shingles in order of hash, linked documents share at least l(n) = n / 10 + 1 of
   their first n - ceil(0.8 n) + l(n). Blocks ask which of these shingles occur in two documents or more; documents with too
   few of them have no partner and are done.
2. Equal sets become one. The others are dealt to groups so that any two sets that could be linked, by the number of leading
   shingles that they share, are of one group; groups share shards.
3. Each shard builds an inverted index and searches it with each set: short lists are merged, counts reach T - L or the set
   is no candidate, the L long lists are probed, and all sets that reach the overlap are linked and counted. A group
   above SHARD_SHINGLES is split in parts, each part is searched in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .blocks import BLOCK, BUCKETS, block_count, blocked, checkpointed, slices
from .components import components
from .suffix_dedup import _groups, _quiet, _table

SHINGLE = 5
SHARD_SHINGLES = 1 << 20
#: Small groups share shards of about so many.
BIN_SHINGLES = 1 << 18
#: Similarity, as a fraction: SIMILAR / WHOLE.
SIMILAR, WHOLE = 4, 5
#: Lists of more sets are probed, not merged.
PROBED = 64
#: Lists of more sets than this are long; pairs of a long list are not counted.
LONG = 16


def least_overlap(n):
    """What a set of n must share with any set that it is linked with."""
    return -(-SIMILAR * n // WHOLE)


def _demand(n):
    return n // 10 + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles in order, one document after the other; and where each begins."""
    starts, ends, first = tx.words(data, offsets, tx.SPACED)
    hashes = tx.Rolling(data, fold=True).ranges(starts, ends)
    n = np.diff(first)
    at = np.flatnonzero(tx.within(first, SHINGLE))
    value = tx.word_grams(hashes, SHINGLE)[at] if len(at) else np.zeros(0, tx.U64)
    owner = np.searchsorted(first, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        whole = np.array([tx.word_grams(hashes[first[k] : first[k + 1]], int(n[k]))[0] for k in few], tx.U64)
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, few])
    order, new = _groups(owner, value)
    order = order[new]
    return value[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def _sets(texts: pa.ChunkedArray) -> Iterator[np.ndarray]:
    data, offsets = tx.string_bytes(texts)
    for *_, part, offs in tx.chunks(data, offsets):
        value, first = shingle_sets(part, offs)
        for k in range(len(offs) - 1):
            yield value[first[k] : first[k + 1]]


def _prefix(s: np.ndarray, more: int) -> np.ndarray:
    return s[: len(s) - least_overlap(len(s)) + more]


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
_ASK_DDL = "bucket int, block int, payload binary"


def _asked(texts: pa.ChunkedArray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct leading shingles of a block's documents, and how many of the documents have each."""
    all_ = [_prefix(s, _demand(len(s))) for s, m in zip(_sets(texts), missing, strict=True) if len(s) and not m]
    # mixed, as leading shingles have small hashes and buckets are ranges
    return np.unique(tx.mix(np.concatenate(all_)), return_counts=True) if all_ else (np.zeros(0, tx.U64), np.zeros(0, np.int64))


def _ask(n: int):
    def run(table: pa.Table) -> pa.Table:
        h, count = _asked(table["t"], table["k"].is_null().to_numpy())
        block, rows = table[BLOCK][0].as_py(), []
        for b, i, j in slices(h, n):
            # 39 bits tell shingles of a bucket apart well enough: a clash keeps a document that has no partner
            tail = tx.mix(h[i:j]) >> tx.U64(25)
            rows.append((b, block, (tail & tx.U64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((tail >> tx.U64(32)).astype(np.uint8) | np.where(count[i:j] > 1, 128, 0).astype(np.uint8)).tobytes()))
        return _table(rows, _ASK)

    return _quiet(run)


def _settle(table: pa.Table) -> pa.Table:
    payloads = table["payload"].to_pylist()
    sizes = [len(p) // 5 for p in payloads]
    low = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes, strict=True)]).astype(np.int64)
    high = np.concatenate([np.frombuffer(p, np.uint8, n, 4 * n) for p, n in zip(payloads, sizes, strict=True)])
    key = low | ((high & 127).astype(np.int64) << 32)
    _, group, count = np.unique(key, return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(group, weights=high >> 7) > 0)
    values = [np.packbits(x).tobytes() for x in np.split(shared[group], np.cumsum(sizes)[:-1])]
    return pa.table([table["bucket"].combine_chunks(), table["block"].combine_chunks(), pa.array(values, pa.binary())], schema=_ASK)


_PROFILE = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])


def _profile(n: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _PROFILE.empty_table()
        missing = docs["k"].is_null().to_numpy()
        h, _ = _asked(docs["t"], missing)
        answers = dict(zip(told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True))
        shared = np.zeros(len(h), bool)
        for b, i, j in slices(h, n):
            shared[i:j] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=j - i)
        rows = []
        for k, s, m in zip(docs["k"].to_pylist(), _sets(docs["t"]), missing, strict=True):
            lead = _prefix(s, _demand(len(s)))
            keep = len(s) > 0 and not m and shared[np.searchsorted(h, tx.mix(lead))].sum() >= min(_demand(least_overlap(len(s))), len(lead))
            rows.append((k, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if keep else None, s.tobytes() if keep else None))
        return _table(rows, _PROFILE)

    return _quiet_pair(run)


def _quiet_pair(f):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return f(left, right)

    return run


def _leads(n: int):
    """Leading shingles of each document, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(s, tx.U64) for s in batch.column("shingles").to_pylist()]
            whole = np.array([len(s) for s in sets], np.int64)
            sets = [_prefix(s, _demand(len(s))) for s in sets]
            if not sets:
                continue
            h, sizes = tx.mix(np.concatenate(sets)), [len(s) for s in sets]
            ids, sizes_of = np.repeat(batch.column("k").to_numpy(), sizes), np.repeat(whole, sizes)
            order = np.argsort(h, kind="stable")
            h, ids, sizes_of = h[order], ids[order], sizes_of[order]
            for b, i, j in slices(h, n):
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([h[i:j].tobytes() + ids[i:j].tobytes() + sizes_of[i:j].tobytes()], pa.binary())], ["bucket", "payload"])

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])
PAIR, COUNT, ENTRY = range(3)


def _candidates(table: pa.Table) -> pa.Table:
    """Of a bucket's lists: pairs that short ones hold, with how often; how many long ones each document is in; and those."""
    payloads = table["payload"].to_pylist()
    h, ids, size = (np.concatenate([np.frombuffer(p, t, len(p) // 24, len(p) // 24 * 8 * k) for p in payloads]) for k, t in enumerate((tx.U64, np.int64, np.int64)))
    order = np.lexsort((ids, size, h))
    h, ids, size = h[order], ids[order], size[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    held = np.repeat(np.diff(np.append(first, len(h))), np.diff(np.append(first, len(h))))
    a, b, less = [], [], []
    for gap in range(1, LONG):
        same = np.flatnonzero((h[gap:] == h[:-gap]) & (held[gap:] <= LONG) & (least_overlap(size[gap:]) <= size[:-gap]))
        a.append(np.minimum(ids[same], ids[same + gap]))
        b.append(np.maximum(ids[same], ids[same + gap]))
        less.append(size[same])
    a, b, less = np.concatenate(a), np.concatenate(b), np.concatenate(less)
    order, new = _groups(a, b)
    one = np.flatnonzero(new)
    pairs = (a[order][one], b[order][one], less[order][one], np.diff(np.append(one, len(a))))
    long_ = held > LONG
    names, at, count = np.unique(ids[long_], return_index=True, return_counts=True)
    counts = (names, np.zeros(len(names), np.int64), size[long_][at], count)
    entries = (ids[long_], h[long_].view(np.int64), size[long_], np.ones(int(long_.sum()), np.int64))
    kinds = np.repeat([PAIR, COUNT, ENTRY], [len(x[0]) for x in (pairs, counts, entries)])
    return pa.table([pa.array(kinds, pa.int32()), *(pa.array(np.concatenate(c), pa.int64()) for c in zip(pairs, counts, entries, strict=True))], schema=_FOUND)


def _candidate_links(sets: DataFrame, n: int) -> DataFrame:
    """(u, v) links whose components hold any two sets that could be linked.

    A linked pair shares at least l of its leading shingles, l that of the smaller set, so half of l in short lists or half
    in long ones. For short lists the pairs are counted. A set with half of l in long lists, l that of the least
    partner, is chained to one set for each of these lists and each band of sizes, and these to that of the next band.
    """
    half = lambda size: F.ceil((F.floor(size / 10) + 1) / 2)
    found = checkpointed(sets.mapInArrow(_leads(n), "bucket int, payload binary").groupBy("bucket").applyInArrow(_quiet(_candidates), "kind int, a bigint, b bigint, size bigint, n bigint"))
    pairs = found.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    near = pairs.filter(F.col("n") >= half(F.col("size"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    able = found.filter(F.col("kind") == COUNT).groupBy("a").agg(F.sum("n").alias("n"), F.min("size").alias("size"))
    able = able.filter(F.col("n") >= half(F.ceil(F.col("size") * SIMILAR / WHOLE))).select("a")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(WHOLE / SIMILAR))).cast("int")
    lists = found.filter(F.col("kind") == ENTRY).join(able, "a").select("a", "b", band.alias("band"))
    heads = lists.groupBy("b", "band").agg(F.min("a").alias("v"))
    stars = lists.join(heads, ["b", "band"]).select(F.col("a").alias("u"), "v")
    after = heads.select("b", (F.col("band") - 1).alias("band"), F.col("v").alias("u"))
    # sizes that differ by a quarter at most are of the same band or of neighbouring ones; one more for rounding
    later = heads.select("b", (F.col("band") - 2).alias("band"), F.col("v").alias("u"))
    steps = heads.join(after.union(later), ["b", "band"]).select("u", "v")
    return near.union(stars).union(steps).filter("u != v").distinct()


class Index:
    """An inverted index over sets, searched for those that share at least 4/5 of all with a query.

    Lists of more than PROBED sets are long: they are also kept as bits, a row for each set, so that a probe of a set in all
    of a query's long lists is one AND of two rows.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.by_size = np.argsort(self.sizes, kind="stable")
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        self.tokens, which, n = np.unique(token, return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        self.members = owner[order]  # all lists, one after the other
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.bit = np.where(n > PROBED, np.cumsum(n > PROBED) - 1, -1)
        self.width = int((n > PROBED).sum()) // 64 + 1
        bits = np.zeros((len(sets), self.width * 8), np.uint8)
        at = self.bit[which]
        probed = at >= 0
        np.bitwise_or.at(bits, (owner[probed], at[probed] >> 3), np.left_shift(1, at[probed] & 7).astype(np.uint8))
        self.rows = bits.view(tx.U64)

    def search(self, s: np.ndarray) -> np.ndarray:
        """Sets y with 100 |s & y| >= 80 |s | y|."""
        at = np.searchsorted(self.tokens, s)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == s)]
        need = least_overlap(len(s))
        if len(at) < need:
            return np.zeros(0, np.int64)
        long_, short = self.bit[at], at[self.bit[at] < 0]
        long_ = long_[long_ >= 0]
        # the short lists, merged: sets that occur T - L times or more are candidates
        n = self.first[short + 1] - self.first[short]
        merged = self.members[np.repeat(self.first[short + 1] - np.cumsum(n), n) + np.arange(n.sum())]
        found, counts = np.unique(merged, return_counts=True)
        if need > len(long_):
            enough = counts >= need - len(long_)
            found, counts = found[enough], counts[enough]
        else:  # long lists alone may hold the overlap
            sizes = self.sizes[self.by_size]
            every = np.sort(self.by_size[np.searchsorted(sizes, need) : np.searchsorted(sizes, len(s) * WHOLE // SIMILAR, "right")])
            every_counts = np.zeros(len(self.sizes), np.int64)
            every_counts[found] = counts
            found, counts = every, every_counts[every]
        b = self.sizes[found]
        fits = (b >= need) & (least_overlap(b) <= len(s))
        found, counts, b = found[fits], counts[fits], b[fits]
        if len(long_) and len(found):
            row = np.zeros(self.width * 8, np.uint8)
            np.bitwise_or.at(row, long_ >> 3, np.left_shift(1, long_ & 7).astype(np.uint8))
            row = row.view(tx.U64)
            used = np.flatnonzero(row)
            counts = counts + np.bitwise_count(self.rows[found][:, used] & row[used]).sum(1, dtype=np.int64)
        return found[WHOLE * counts >= SIMILAR * (len(s) + b - counts)]


def _joined(table: pa.Table) -> pa.Table:
    """What a shard finds, its indexed sets with each other or its queries with them: a forest of the links, and how many documents each set is linked with."""
    table = table.sort_by([("queries", "ascending"), ("digest", "ascending"), ("k", "ascending")])
    asking, names = table["queries"].to_numpy(zero_copy_only=False), table["digest"].to_pylist()
    # rows that share an id may bring a set twice
    once = [i for i, name in enumerate(names) if not i or names[i - 1] != name or asking[i - 1] != asking[i]]
    table, asking = table.take(once), asking[once]
    ids, size = table["k"].to_numpy(), table["size"].to_numpy()
    sets = [np.frombuffer(s, tx.U64) for s in table["shingles"].to_pylist()]
    held = int((~asking).sum())
    n, up = np.zeros(len(sets), np.int64), np.arange(len(sets))
    if held:
        index = Index(sets[:held])
        for x in range(held, len(sets)) if held < len(sets) else range(held):
            found = index.search(sets[x])
            found = found[found != x]
            if not len(found):
                continue
            n[x] += size[found].sum()
            if held < len(sets):
                n[found] += size[x]
            # disjoint sets: all that are linked move under one root, paths shorten on the way
            both = np.append(found, x)
            roots = up[both]
            while (up[roots] != roots).any():
                roots = up[roots]
            up[both] = up[roots] = roots.min()
    while (up[up] != up).any():
        up = up[up]
    moved = up != np.arange(len(sets))
    rows = [("u", ids[moved]), ("v", ids[up[moved]])]
    links = pa.table({**{c: pa.array(v, pa.int64()) for c, v in rows}, "digest": pa.nulls(int(moved.sum()), pa.binary()), "n": pa.nulls(int(moved.sum()), pa.int64())})
    linked = np.flatnonzero(n)
    counts = pa.table({"u": pa.nulls(len(linked), pa.int64()), "v": pa.nulls(len(linked), pa.int64()), "digest": table["digest"].take(linked).cast(pa.binary()), "n": pa.array(n[linked], pa.int64())})
    return pa.concat_tables([links, counts])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", links: bool = False) -> DataFrame:
    """(key, n_shingles, component_id) of each document: its set's size and the least id that links lead to, its own included.

    With links there is also n_links, how many other rows each row is linked with.

    Two documents are linked when their sets of distinct 5-word shingles have 100 * intersection >= 80 * union; a text
    of 1 to 4 words has one shingle, the whole. Null and empty texts and those of white space have an empty set and no links.
    Rows that share an id are one node; a row whose id is null has a null component and no links. Other columns are left
    out. An empty table gives an empty one.
    A text of more than 1 MiB is a chunk of its own and read whole.
    """
    blocks = block_count(docs, text)
    n = blocks * BUCKETS
    base = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = blocked(base, "k", "t", blocks)
    known = dealt.groupBy(BLOCK).applyInArrow(_ask(n), _ASK_DDL).groupBy("bucket").applyInArrow(_quiet(_settle), _ASK_DDL)
    profile = checkpointed(dealt.groupBy(BLOCK).cogroup(known.groupBy("block")).applyInArrow(_profile(n), "k bigint, n bigint, digest binary, shingles binary"))
    rest = profile.filter("digest IS NOT NULL")

    classes = rest.groupBy("digest").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.count("*").alias("size"))
    one = checkpointed(rest.select("k", "digest", "shingles").join(classes.select("k", "digest"), ["k", "digest"]))
    group = components(_candidate_links(one, n))
    dealt_to = classes.join(group.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    weights = dealt_to.groupBy("root").agg(F.sum("n").alias("weight"), F.count("*").alias("members")).filter("members > 1")
    small = F.when(F.col("weight") <= SHARD_SHINGLES, F.col("weight"))
    bins = max(1, -(-int(weights.agg(F.coalesce(F.sum(small), F.lit(0))).first()[0]) // BIN_SHINGLES))
    parts = F.ceil(F.col("weight") / F.lit(SHARD_SHINGLES)).cast("int")
    member = dealt_to.join(weights.select("root", parts.alias("parts")), "root").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("k"), "parts").cast("int")).otherwise(0))
    # one row for each pair of parts that a set's part is in
    spread = member.select("k", "digest", "size", "root", "parts", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    shard = F.when(F.col("parts") > 1, F.concat_ws("-", "root", F.least("part", "other"), F.greatest("part", "other"))).otherwise(F.concat(F.lit("bin "), F.pmod(F.xxhash64("root"), F.lit(bins))))
    placed = spread.select("k", "digest", "size", shard.alias("shard"), (F.col("part") > F.col("other")).alias("queries"))
    joined = checkpointed(one.join(placed, ["k", "digest"]).groupBy("shard").applyInArrow(_quiet(_joined), "u bigint, v bigint, digest binary, n bigint"))
    found = components(joined.filter("u IS NOT NULL").select("u", "v"))

    label = classes.join(found.withColumnRenamed("node", "k"), "k", "left").select("digest", "size", F.coalesce("root", "k").alias("component_id"))
    alone = profile.filter("digest IS NULL").select("k", "n", F.col("k").alias("component_id"))
    names = ["k", "n", "component_id"]
    if links:
        others = joined.filter("digest IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("others"))
        label = label.join(others, "digest", "left").withColumn("n_links", F.col("size") - 1 + F.coalesce("others", F.lit(0)))
        alone, names = alone.withColumn("n_links", F.lit(0).cast("long")), [*names, "n_links"]
    out = rest.select("k", "n", "digest").join(label, "digest").select(*names).unionByName(alone)
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), *names[2:])


def op6_divide_skip(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)
