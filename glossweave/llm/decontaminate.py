"""Benchmark decontamination by winnowing.

Fingerprints: of each window of WINDOW words, the least hash of its GRAM-word grams is kept. Any span that a document and
a benchmark item share and that is as long as the window has the same least gram on both sides, so the join of
fingerprints misses none. Each hit is then extended: the whole window must be one of the benchmark's.

A benchmark of up to SLICE_BYTES of text is broadcast. A larger one is dealt to buckets by hash, as the documents are to
blocks: blocks ask the buckets which of their fingerprints the benchmark has, then for the items of the windows that these lead to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .blocks import BLOCK_BYTES, BUCKETS, checkpointed, plus, slices, text_bytes
from .suffix_dedup import _quiet, _table

WINDOW, GRAM = 13, 5
#: Bytes of text of a benchmark that is broadcast; a larger one is joined.
SLICE_BYTES = 32 << 20


class Fingerprints:
    """The windows of some benchmark items and the winnowed grams that lead to them."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.ids = window, gram, ids
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        grams = []
        data, offsets = tx.string_bytes(texts)
        starts, ends, first = tx.words(data, offsets, tx.PLAIN)
        hashes = tx.Rolling(data, fold=True).ranges(starts, ends)
        for i in range(len(ids)):
            own = hashes[first[i] : first[i + 1]]
            n = min(len(own), window)
            if n:
                by_length.setdefault(n, []).append((tx.word_grams(own, n), i))
            if n == window:
                grams.append(tx.sliding_min(tx.word_grams(own, gram), window - gram + 1))
        self.marks = np.zeros(1 << 20, bool)  # by the high bits of a fingerprint
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, tx.U64)
        self.marks[(self.grams >> tx.U64(44)).astype(np.int64)] = True
        self.windows = {}
        for n, parts in by_length.items():
            hashed = np.concatenate([h for h, _ in parts])
            item = np.concatenate([np.full(len(h), i) for h, i in parts])
            order = np.lexsort((item, hashed))
            self.windows[n] = (hashed[order], item[order])

    def candidates(self, n: int, hashes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Places where a window of n words may occur."""
        if n < self.window:
            return np.flatnonzero(inside)
        least = tx.sliding_min(tx.word_grams(hashes, self.gram), n - self.gram + 1)
        at = np.flatnonzero(self.marks[(least >> tx.U64(44)).astype(np.int64)] & inside[: len(least)])
        near = np.searchsorted(self.grams, least[at])
        return at[self.grams[np.minimum(near, len(self.grams) - 1)] == least[at]]

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window's words, places of windows that occur, ranges of their entries in self.windows)."""
        for n, (hashed, _) in self.windows.items():
            inside = tx.within(first, n)
            at = self.candidates(n, hashes, inside)
            if not len(at):
                continue
            if n == self.window:
                full = hashes[at].copy()
                for j in range(1, n):
                    full = full * tx.U64(tx._Q) + hashes[at + j]
                full = tx.mix(full + tx.U64(n))
            else:
                full = tx.word_grams(hashes, n)[at]
            lo, hi = np.searchsorted(hashed, full, "left"), np.searchsorted(hashed, full, "right")
            found = lo < hi
            yield n, at[found], lo[found], hi[found]


def _entries(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Distinct owner << 32 | item over the entries of each range."""
    n = hi - lo
    entry = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
    return np.unique((np.repeat(owner, n).astype(np.int64) << 32) | item[entry])


def _scan(prints: Fingerprints, texts: pa.Array) -> Iterator[tuple[np.ndarray, set]]:
    """For each document: which of its words are hit, and the items (None for an item without id) that hit them."""
    data, offsets = tx.string_bytes(texts)
    for row, last, part, offs in tx.chunks(data, offsets):
        starts, ends, first = tx.words(part, offs, tx.PLAIN)
        hashes = tx.Rolling(part, fold=True).ranges(starts, ends)
        hit = np.zeros(len(hashes), bool)
        items: list[set] = [set() for _ in range(last - row)]
        for n, at, lo, hi in prints.hits(hashes, first):
            hit |= tx.covered(len(hashes), at, n)
            for p in _entries(np.searchsorted(first, at, "right") - 1, lo, hi, prints.windows[n][1]).tolist():
                items[p >> 32].add(prints.ids[p & 0xFFFFFFFF])
        for k in range(last - row):
            yield hit[first[k] : first[k + 1]], items[k]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


class Answered(Fingerprints):
    """The windows of a block's documents that the benchmark has, each with its items."""

    def __init__(self, lengths: list[int], hashed: np.ndarray, ids: list):
        order = np.argsort(hashed, kind="stable")
        self.window, self.ids = WINDOW, ids
        self.windows = dict.fromkeys(lengths, (hashed[order], order))

    def candidates(self, n: int, hashes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.flatnonzero(inside)


def _words(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of each chunk of texts, and the first word of each text."""
    data, offsets = tx.string_bytes(texts)
    for *_, part, offs in tx.chunks(data, offsets):
        starts, ends, first = tx.words(part, offs, tx.PLAIN)
        yield tx.Rolling(part, fold=True).ranges(starts, ends), first


def _winnowed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin, and the fingerprint of each."""
    least = tx.sliding_min(tx.word_grams(hashes, GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(tx.within(first, WINDOW)[: len(least)])
    return at, least[at]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, tx.U64)


_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("items", pa.list_(pa.string()))])
_ASKED_DDL = "bucket int, block bigint, payload binary, items array<string>"


def _benchmark_parts(n: int, whole: bool):
    """Of batches of items (i, t) the fingerprints, or all windows with their items, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                prints = Fingerprints(batch.column("i").to_pylist(), batch.column("t"))
                if not whole:
                    yield from _table([(b, -1, prints.grams[i:j].tobytes(), None) for b, i, j in slices(prints.grams, n)], _ASKED).to_batches()
                    continue
                for hashed, item in prints.windows.values():
                    pairs = [(b, -1, hashed[i:j].tobytes(), [prints.ids[k] for k in item[i:j].tolist()]) for b, i, j in slices(hashed, n)]
                    yield from _table(pairs, _ASKED).to_batches()

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.string_bytes(batch.column("t"))
        n = np.diff(tx.words(data, offsets, tx.PLAIN)[2])
        yield pa.record_batch([pa.array(np.unique(np.minimum(n[n > 0], WINDOW)).astype(np.int64))], ["n"])


def _which(asked: pa.Table, told: pa.Table) -> pa.Table:
    """Of the fingerprints that a block asks about those that the benchmark has."""
    known = _distinct([np.frombuffer(p, tx.U64) for p in told["payload"].to_pylist()])
    rows = []
    for b, block, p, _ in zip(*(asked[c].to_pylist() for c in _ASKED.names), strict=True):
        found = np.frombuffer(p, tx.U64)
        found = found[np.isin(found, known, assume_unique=True)]
        if len(found):
            rows.append((b, block, found.tobytes(), None))
    return _table(rows, _ASKED)


def _items(asked: pa.Table, told: pa.Table) -> pa.Table:
    """The windows that a block asks about and the benchmark has, each with one of its items."""
    hashed = np.concatenate([np.frombuffer(p, tx.U64) for p in told["payload"].to_pylist()] or [np.zeros(0, tx.U64)])
    items = pa.concat_arrays([x.flatten() for x in told["items"].chunks]) if told.num_rows else pa.array([], pa.string())
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    rows = []
    for b, block, p, _ in zip(*(asked[c].to_pylist() for c in _ASKED.names), strict=True):
        wanted = np.frombuffer(p, tx.U64)
        lo, hi = np.searchsorted(hashed, wanted, "left"), np.searchsorted(hashed, wanted, "right")
        n = hi - lo
        entry = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        if len(entry):
            rows.append((b, block, hashed[entry].tobytes(), items.take(pa.array(order[entry])).to_pylist()))
    return _table(rows, _ASKED)


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, spec: str) -> DataFrame:
    """(d, c): the rows of docs, each as one column, with their contamination; benchmark (i, t). Nothing is broadcast."""
    size, more = text_bytes(docs, text), text_bytes(benchmark, "t")
    blocks = max(1, -(-size // BLOCK_BYTES))
    n = BUCKETS * max(blocks, -(-more // BLOCK_BYTES))
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    # written once, so that each step finds a block's documents the same
    base = checkpointed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col(text).alias("t")).withColumn("block", deal))
    texts = base.select("block", "t")
    lengths = sorted(r.n for r in benchmark.mapInArrow(_lengths, "n bigint").distinct().collect())  # 1 to WINDOW

    def ask(table: pa.Table) -> pa.Table:
        keys = _distinct([np.unique(_winnowed(h, first)[1]) for h, first in _words(table["t"])])
        return _table([(b, table["block"][0].as_py(), keys[i:j].tobytes(), None) for b, i, j in slices(keys, n)], _ASKED)

    def extend(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ASKED.empty_table()
        known = _distinct([np.frombuffer(p, tx.U64) for p in told["payload"].to_pylist()])
        keys = []
        for h, first in _words(table["t"]):
            at, least = _winnowed(h, first)
            keys.append(np.unique(tx.word_grams(h, WINDOW)[at[np.isin(least, known)]]))
            keys += [np.unique(tx.word_grams(h, k)[np.flatnonzero(tx.within(first, k))]) for k in lengths if k < WINDOW]
        keys = _distinct(keys)
        return _table([(b, table["block"][0].as_py(), keys[i:j].tobytes(), None) for b, i, j in slices(keys, n)], _ASKED)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        hashed = np.concatenate([np.frombuffer(p, tx.U64) for p in told["payload"].to_pylist()] or [np.zeros(0, tx.U64)])
        ids = [i for x in told["items"].to_pylist() for i in x]
        prints = Answered(lengths, hashed, ids)
        return pa.table([table["d"], _column(((h, i - {None}) for h, i in _scan(prints, table["t"])))], names=["d", "c"])

    by_bucket = lambda asked, whole: asked.groupBy("bucket").cogroup(benchmark.mapInArrow(_benchmark_parts(n, whole), _ASKED_DDL).groupBy("bucket"))
    which = by_bucket(texts.groupBy("block").applyInArrow(_quiet(ask), _ASKED_DDL), False).applyInArrow(_which, _ASKED_DDL)
    windows = texts.groupBy("block").cogroup(which.groupBy("block")).applyInArrow(_loud(extend), _ASKED_DDL)
    found = by_bucket(windows, True).applyInArrow(_items, _ASKED_DDL)
    return base.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_loud(finish), plus(base.select("d"), "c", spec))


def _loud(f):
    """f on two tables, overflows of hashes expected."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return f(a, b)

    return run


_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _column(scanned) -> pa.Array:
    """The new column, from the hit words and the items of each document."""
    names = ("n_words", "n_hit", "items", "spans")
    rows = ((len(hit), int(hit.sum()), sorted(items), [{"start": a, "stop": b} for a, b in _runs(hit)] if hit.any() else []) for hit, items in scanned)
    return pa.array([dict(zip(names, r, strict=True)) for r in rows], _KIND)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", column: str = "contamination") -> DataFrame:
    """docs with one more column: struct<n_words long, n_hit long, items array<string>, spans array<struct<start long, stop long>>>.

    Words: maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is 13 consecutive words of
    an item; an item of 1 to 12 words is one window. A word inside any occurrence of a window is hit. spans are the
    maximal runs of hit words, by word number. Null or empty texts have no words and no hits; items without words
    have no windows; repeated items hit alike, and those that share an id count once; an item whose id is null hits but
    is not in items. An empty benchmark hits nothing.
    A text of more than 1 MiB is a chunk of its own and read whole. A column of docs named like the new one is replaced.
    """
    spec = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>>"
    out = docs.drop(column)
    schema = plus(out, column, spec)
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    if text_bytes(items, "t") > SLICE_BYTES:
        return _joined(out, items, text, spec).select("d.*", F.col("c").alias(column))
    with np.errstate(over="ignore"):
        rows = items.toArrow()  # at most SLICE_BYTES of text
        shared = docs.sparkSession.sparkContext.broadcast(Fingerprints(rows["i"].to_pylist(), rows["t"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                new = _column((hit, found - {None}) for hit, found in _scan(shared.value, batch.column(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, column])

    return out.mapInArrow(run, schema)


def is_contaminated(n_words, n_hit):
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "contamination.*")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
