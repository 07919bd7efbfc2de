"""Exact removal of repeated 200-byte strings by blockwise suffix sorting with a difference cover.

The suffixes of the corpus are never sorted at once. Each suffix is dealt to the *bucket* of its anchor: the least hash of
the 40-byte grams inside its first 200 bytes. Equal 200-byte strings have the same anchor, at the same distance, so they
meet in one bucket, and one bucket is sorted at a time. Within a bucket suffixes are ordered by their first 31 bytes; ties
that are longer are settled by the ranks of a sample of positions, a difference cover of period 31, sorted beforehand. The
period is counted from the anchor, so any two suffixes that can tie have a sampled position at the same distance ahead.

Consecutive suffixes that share an anchor form a *fragment*. Buckets first see only fragments' hashes; those that exist
once or as whole copies only are settled by that, and just the rest send their bytes to be sorted. A bucket with more than
HOT different fragments is split further: its suffixes are dealt by the hash of their 200 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as tx
from .blocks import BLOCK, BUCKETS, block_count, blocked, slices

LENGTH, GRAM = 200, 40
HOT = 4096
#: Suffixes that are sorted at once.
SORTED_AT_ONCE = 150_000
PERIOD = 31
#: A perfect difference set of period 31.
COVER = (0, 1, 3, 8, 12, 18)
DEPTH = 4 * PERIOD

_AHEAD = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
_BACK = np.array([next(d for d in range(PERIOD) if (r - d) % PERIOD in COVER) for r in range(PERIOD)])

NONE, COPIES, SORT, SORT_COPIES, SPLIT, SPLIT_COPIES = range(6)


class Fragments:
    """The fragments of one chunk: the row, where the first suffix starts, how many suffixes, the anchor's distance and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rolling = tx.Rolling(data)
        inside = tx.within(offsets, LENGTH)
        at = np.flatnonzero(inside)
        if not len(at):
            self.start = self.count = self.ahead = np.zeros(0, np.int64)
            self.anchor = self.whole = np.zeros(0, tx.U64)
            return
        grams = rolling.grams(GRAM)
        anchors = tx.minimizers(grams, LENGTH - GRAM + 1)[at]
        new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])
        begin = np.flatnonzero(new)
        self.start = at[begin]
        self.count = np.diff(np.append(begin, len(at)))
        self.ahead = anchors[begin] - self.start
        # mixed again: least hashes are all small, and buckets are ranges of hashes
        self.anchor = tx.mix(grams[anchors[begin]])
        whole = rolling.ranges(self.start, self.start + self.count + (LENGTH - 1))
        self.whole = tx.mix(whole + self.ahead.astype(tx.U64))


def _fragments(texts: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, Fragments]]:
    data, offsets = tx.string_bytes(texts)
    return [(part, offs, Fragments(part, offs)) for _, _, part, offs in tx.chunks(data, offsets)]


def _distinct(parts: list) -> tuple[np.ndarray, ...]:
    """Of a block: anchors and whole hashes of its distinct fragments in order, their counts, the entry of each fragment, one fragment of each entry."""
    anchor = np.concatenate([f.anchor for *_, f in parts]) if parts else np.zeros(0, tx.U64)
    whole = np.concatenate([f.whole for *_, f in parts]) if parts else np.zeros(0, tx.U64)
    order = np.lexsort((whole, anchor))
    a, w = anchor[order], whole[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, bool)
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return a[first], w[first], np.diff(np.append(first, len(a))), entry, order[first]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ASK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
_ASK_DDL = "kind int, bucket int, block int, payload binary"


def _ask(n: int):
    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            block = table[BLOCK][0].as_py()
            a, w, count, *_ = _distinct(_fragments(table["t"]))
            many = np.minimum(count, 2).astype(np.uint8)
            return _table([(0, b, block, a[i:j].tobytes() + w[i:j].tobytes() + many[i:j].tobytes()) for b, i, j in slices(a, n)], _ASK)

    return run


def _joined(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The packed 64-bit columns of all rows, the byte column behind them, and where each row's entries end."""
    payloads = table["payload"].to_pylist()
    sizes = [len(p) // (8 * width + 1) for p in payloads]
    cols = [np.concatenate([np.frombuffer(p, tx.U64, n, 8 * n * k) for p, n in zip(payloads, sizes, strict=True)]) for k in range(width)]
    cols.append(np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n * width) for p, n in zip(payloads, sizes, strict=True)]))
    return cols, np.cumsum(sizes)


def _answers(table: pa.Table, values: list[bytes], kind: int) -> pa.Table:
    return pa.table([pa.array([kind] * len(values), pa.int32()), table["bucket"].combine_chunks(), table["block"].combine_chunks(), pa.array(values, pa.binary())], schema=_ASK)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, first key first, and which places in it begin a new group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, new


def _settle(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """What is known of each fragment from the hashes of a bucket's fragments."""
        (anchor, whole, many), ends = _joined(table, 2)
        order, new = _groups(anchor, whole)
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=many[order]) >= 2
        a = anchor[order][new]
        start = np.concatenate([[True], a[1:] != a[:-1]])
        kinds = np.bincount(np.cumsum(start) - 1)[np.cumsum(start) - 1]
        status = np.where(kinds == 1, NONE, np.where(kinds <= hot, SORT, SPLIT)) + total
        out = np.empty(len(order), np.uint8)
        out[order] = status[group]
        return _answers(table, [x.tobytes() for x in np.split(out, ends[:-1])], 0)

    return _quiet(run)


def _send(n: int):
    """Fragments whose bytes must be sorted, suffixes of split buckets, and the block's own notes."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            if not docs.num_rows:
                return _ASK.empty_table()
            block, parts = docs[BLOCK][0].as_py(), _fragments(docs["t"])
            a, w, _, _, one = _distinct(parts)
            status = _status(told, 0)
            rows = [(2, block, block, status.tobytes())]
            sent = np.flatnonzero((status == SORT) | (status == SORT_COPIES))
            base = np.cumsum([0, *(len(f.start) for *_, f in parts)])
            for b, i, j in slices(a[sent], n):
                own, bodies, meta = sent[i:j], [], []
                for e in own:
                    p = int(np.searchsorted(base, one[e], "right")) - 1
                    data, _, f = parts[p]
                    k = one[e] - base[p]
                    bodies.append(data[f.start[k] : f.start[k] + f.count[k] + LENGTH - 1].tobytes())
                    meta.append((f.count[k], f.ahead[k], status[e] == SORT_COPIES))
                rows.append((0, b, block, len(own).to_bytes(8, "little") + a[own].tobytes() + w[own].tobytes() + np.array(meta, np.int64).tobytes() + b"".join(bodies)))
            hashes, anchors, _, _ = _windows(parts, status, _distinct(parts)[3])
            order, new = _groups(hashes, anchors)
            first = np.flatnonzero(new)
            h, x = hashes[order][first], anchors[order][first]
            many = np.minimum(np.diff(np.append(first, len(order))), 2).astype(np.uint8)
            rows += [(1, b, block, h[i:j].tobytes() + x[i:j].tobytes() + many[i:j].tobytes()) for b, i, j in slices(h, n)]
            return _table(rows, _ASK)

    return run


def _status(told: pa.Table, kind: int) -> np.ndarray:
    """A block's answers of a kind, joined in the order of the buckets."""
    rows = sorted((b, p) for k, b, p in zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True) if k == kind)
    return np.frombuffer(b"".join(p for _, p in rows), np.uint8)


def _windows(parts: list, status: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the suffixes of split buckets: hashes of 200 bytes, anchors, chunk and start."""
    out: list[list] = [[], [], [], []]
    base = 0
    for p, (data, _, f) in enumerate(parts):
        k = np.flatnonzero(status[entry[base : base + len(f.start)]] >= SPLIT)
        base += len(f.start)
        n = f.count[k]
        starts = np.repeat(f.start[k] + n - np.cumsum(n), n) + np.arange(n.sum())
        if len(starts):
            for x, v in zip(out, (tx.Rolling(data).ranges(starts, starts + LENGTH), np.repeat(f.anchor[k], n), np.full(len(starts), p), starts), strict=True):
                x.append(v)
    kinds = (tx.U64, tx.U64, np.int64, np.int64)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds, strict=True))


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys, equal where all keys are equal."""
    order, new = _groups(*keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Bucket:
    """The text of a bucket, with the cover sample's ranks; repeated() sorts its suffixes group by group."""

    def __init__(self, body: np.ndarray, start: np.ndarray, count: np.ndarray, ahead: np.ndarray):
        self.start, self.count, self.ahead = start, count, ahead
        padded = np.concatenate([body, np.zeros(8, np.uint8)])
        self.eight = np.zeros(len(body), tx.U64)
        for k in range(8):
            self.eight = (self.eight << tx.U64(8)) | padded[k : k + len(body)]
        size = count + LENGTH - 1
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(start, size) + offset
        residue = (offset - np.repeat(ahead, size)) % PERIOD
        left = np.repeat(size, size) - offset
        sample = np.isin(residue, COVER)
        self.rank = np.zeros(len(body) + DEPTH, np.int64)
        at = place[sample & (left >= PERIOD)]
        self.rank[at] = _dense(*(self.eight[at + k] for k in (0, 8, 16, 23)))
        for depth in (2 * PERIOD, DEPTH):
            at = place[sample & (left >= depth)]
            ranks = _dense(self.rank[at], self.rank[at + depth // 2])
            self.rank[:] = 0
            self.rank[at] = ranks

    def repeated(self, group: np.ndarray) -> list[np.ndarray]:
        """For each fragment, which of its suffixes share 200 bytes with another of the same group. Groups are consecutive."""
        out: list[np.ndarray] = []
        ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
        total, first = np.cumsum(self.count), 0
        while first < len(group):
            limit = (total[first - 1] if first else 0) + SORTED_AT_ONCE
            last = ends[ends > first]
            last = int(max(last[0], ends[np.searchsorted(ends, np.searchsorted(total, limit, "right"), "right") - 1]))
            n = self.count[first:last]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(self.start[first:last], n) + offset
            distance = offset - np.repeat(self.ahead[first:last], n)
            near = i + _AHEAD[distance % PERIOD]
            far = i + (LENGTH - DEPTH)
            far -= _BACK[(distance + LENGTH - DEPTH) % PERIOD]
            head = [self.eight[i + k] for k in (0, 8, 16, 23)]
            tail = [self.eight[i + LENGTH - PERIOD + k] for k in (0, 8, 16, 23)]
            order, new = _groups(np.repeat(group[first:last], n), distance, *head, self.rank[near], self.rank[far], *tail)
            again = np.empty(len(i), bool)
            again[order] = ~new | np.append(~new[1:], False)
            out += np.split(again, np.cumsum(n)[:-1])
            first = last
        return out


def _sort(table: pa.Table) -> pa.Table:
    """Which suffixes of each fragment that was sent are repeated, as bits."""
    anchors, wholes, metas, bodies, counts = [], [], [], [], []
    for p in table["payload"].to_pylist():
        n = int.from_bytes(p[:8], "little")
        counts.append(n)
        anchors.append(np.frombuffer(p, tx.U64, n, 8))
        wholes.append(np.frombuffer(p, tx.U64, n, 8 + 8 * n))
        metas.append(np.frombuffer(p, np.int64, 3 * n, 8 + 16 * n).reshape(n, 3))
        bodies.append(np.frombuffer(p, np.uint8, offset=8 + 40 * n))
    anchor, whole, meta, body = (np.concatenate(x) for x in (anchors, wholes, metas, bodies))
    size = meta[:, 0] + LENGTH - 1
    start = np.cumsum(size) - size
    order, new = _groups(anchor, whole)
    one = order[new]
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    bucket = Bucket(body, start[one], meta[one, 0], meta[one, 1])
    flags = bucket.repeated(anchor[one])
    flags = [np.ones(len(f), bool) if c else f for f, c in zip(flags, meta[one, 2], strict=True)]
    values, at = [], 0
    for n in counts:
        values.append(np.packbits(np.concatenate([flags[e] for e in entry[at : at + n]])).tobytes())
        at += n
    return _answers(table, values, 0)


def _count(table: pa.Table) -> pa.Table:
    (h, x, many), ends = _joined(table, 2)
    order, new = _groups(h, x)
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.uint8)
    out[order] = (np.bincount(group, weights=many[order]) >= 2)[group]
    return _answers(table, [v.tobytes() for v in np.split(out, ends[:-1])], 1)


def _answer(table: pa.Table) -> pa.Table:
    with np.errstate(over="ignore"):
        kind = table["kind"][0].as_py()
        return table.select(_ASK.names).cast(_ASK) if kind == 2 else _sort(table) if kind == 0 else _count(table)


def _spans(removed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))).reshape(-1, 2)


_RESULT = pa.struct([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _cut(n: int, column: str):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            rows = []
            if docs.num_rows:
                parts = _fragments(docs["t"])
                a, _, _, entry, one = _distinct(parts)
                status = _status(told, 2)
                base = np.cumsum([0, *(len(f.start) for *_, f in parts)])
                count = np.concatenate([f.count for *_, f in parts])
                bits: dict[int, np.ndarray] = {}
                packed = {b: p for k, b, p in zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True) if k == 0}
                sent = np.flatnonzero((status == SORT) | (status == SORT_COPIES))
                for b, i, j in slices(a[sent], n):
                    sizes = count[one[sent[i:j]]]
                    flat = np.unpackbits(np.frombuffer(packed[b], np.uint8), count=int(sizes.sum())).astype(bool)
                    bits.update(zip(sent[i:j].tolist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True))
                hashes, anchors, chunk, starts = _windows(parts, status, entry)
                order, new = _groups(hashes, anchors)
                again = np.zeros(len(order), bool)
                again[order] = _status(told, 1).astype(bool)[np.cumsum(new) - 1]
                for p, (data, offs, f) in enumerate(parts):
                    own = entry[base[p] : base[p + 1]]
                    s = status[own]
                    whole = np.flatnonzero((s == COPIES) | (s == SORT_COPIES) | (s == SPLIT_COPIES))
                    some = np.flatnonzero(s == SORT)
                    single = [f.start[k] + np.flatnonzero(bits[e]) for k, e in zip(some.tolist(), own[some].tolist(), strict=True)]
                    at = np.concatenate([f.start[whole], *single, starts[(chunk == p) & again]]).astype(np.int64)
                    length = np.full(len(at), LENGTH)
                    length[: len(whole)] += f.count[whole] - 1
                    gone = tx.covered(len(data), at, length)
                    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                        g = gone[i:j]
                        cut = g.any()
                        rows.append((j - i, [{"start": x, "stop": y} for x, y in _spans(g).tolist()] if cut else [], data[i:j][~g].tobytes() if cut else data[i:j].tobytes()))
            new = pa.array([dict(zip(("n_bytes", "spans", "kept"), r, strict=True)) for r in rows], _RESULT)
            names = [c for c in docs.column_names if c not in (BLOCK, "_key", "t")]
            return pa.table([*(docs[c] for c in names), new], names=[*names, column])

    return run


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", column: str = "cut", hot: int = HOT) -> DataFrame:
    """docs (without the text, which the result holds) with a column struct<n_bytes long, spans array<struct<start, stop>>, kept binary>.

    Every byte that a 200-byte string covers that starts anywhere else too, in the same document or another, is removed;
    strings are judged on the input and never cross documents. spans are the maximal removed runs, by byte. Null and empty
    texts have no bytes; texts under 200 bytes lose none; repeated rows and rows with null ids are documents of their own;
    an empty table gives an empty one.
    A text of more than 1 MiB is a chunk of its own and read whole. A column of docs named like the new one is replaced.
    """
    n = block_count(docs, text)
    rest = [c for c in docs.columns if c not in (text, column)]
    # the other columns travel as one, so that none can clash
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("t"))
    dealt = blocked(base, "_key", "t", n)
    n *= BUCKETS
    asked = dealt.groupBy(BLOCK).applyInArrow(_ask(n), _ASK_DDL)
    known = asked.groupBy("bucket").applyInArrow(_settle(hot), _ASK_DDL)
    sent = dealt.groupBy(BLOCK).cogroup(known.groupBy("block")).applyInArrow(_send(n), _ASK_DDL)
    sorted_ = sent.groupBy("kind", "bucket").applyInArrow(_answer, _ASK_DDL)
    cut = T._parse_datatype_string("struct<n_bytes:bigint,spans:array<struct<start:bigint,stop:bigint>>,kept:binary>")
    schema = T.StructType([base.schema["_row"], T.StructField(column, cut)])
    out = dealt.groupBy(BLOCK).cogroup(sorted_.groupBy("block")).applyInArrow(_cut(n, column), schema)
    return out.select("_row.*", column)


def _quiet(f):
    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return f(table)

    return run


def op2_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select(
        "doc_id",
        F.col("cut.n_bytes").alias("n_bytes"),
        (F.col("cut.n_bytes") - F.octet_length("cut.kept")).cast("long").alias("n_removed"),
        F.size("cut.spans").cast("long").alias("n_spans"),
        F.sha2(F.col("cut.kept"), 256).alias("kept_sha256"),
    )
