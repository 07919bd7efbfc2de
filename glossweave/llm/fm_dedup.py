"""Removal of 13-word windows that an earlier document has, with compressed FM-indexes, one per shard.

Windows are dealt to shards by their anchor, the least hash of the 3-word grams inside. Consecutive windows of a document
that share an anchor form a *fragment*. Shards first see fragments' hashes with the least document that has them; a
fragment whose anchor has no other surroundings anywhere is settled by that. The words of the rest go to their shard,
which builds one FM-index over them: the Burrows-Wheeler transform in a wavelet matrix of packed bits. Documents' fragments
are then streamed through it: backward search from each position gives its matching statistics, the length of the
longest match that ends there, up to the threshold of 13 words; each position that reaches it reports its interval of
suffixes, whose least document decides. An anchor with more than HOT different fragments is split: its windows are
dealt by the hash of their 13 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as tx
from .blocks import BLOCK, BUCKETS, block_count, blocked, slices
from .suffix_dedup import _ASK, _ASK_DDL, _answers, _dense, _groups, _quiet, _table

WINDOW, GRAM = 13, 3
HOT = 4096
#: Windows that are searched at once.
SEARCHED_AT_ONCE = 200_000
LAST = np.int64(np.iinfo(np.int64).max)
OWN, LESS, SEARCH, SPLIT = range(4)


def _quiet_pair(f):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return f(left, right)

    return run


class Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).tobytes(), tx.U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (tx.U64(1) << (at & 63).astype(tx.U64)) - tx.U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Backward search of up to depth symbols over texts of small integers (0 ends a text)."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n, rank, span = len(text), text.astype(np.int64), 1
        while span < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:]
            rank = _dense(rank, ahead)
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        last = text[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.height = max(1, int(symbols - 1).bit_length())
        self.levels = []
        for level in reversed(range(self.height)):
            bits = (last >> level & 1).astype(bool)
            self.levels.append((level, Bits(bits), int(n - bits.sum())))
            last = np.concatenate([last[~bits], last[bits]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        shift = self.first[symbol] - self.base[symbol]
        return self._descend(symbol, low) + shift, self._descend(symbol, high) + shift

    def matching(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a text that is in the index itself: for each end, how many symbols up to it occur in another
        place too, depth at most, and the interval of suffixes that begin with them."""
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes))
        left = np.arange(len(ends))
        for j in range(depth):
            a, b = self.extend(text[ends[left] - j], low[left], high[left])
            again = b - a > 1
            left = left[again]
            low[left], high[left] = a[again], b[again]
            length[left] += 1
        return length, low, high


class LeastOf:
    """The least value of any range."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        span = 1
        while span * 2 <= len(values):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-span], t[span:]))
            span *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), self.tables[0].dtype)
        power = np.frexp(high - low)[1] - 1
        for p in np.unique(power):
            k = np.flatnonzero(power == p)
            out[k] = np.minimum(self.tables[p][low[k]], self.tables[p][high[k] - (1 << int(p))])
        return out


class Fragments:
    """Words of a chunk and its fragments: document, first word, windows, the anchor's distance, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = tx.words(data, offsets, tx.SPACED)
        self.words = tx.Rolling(data).ranges(self.starts, self.ends)
        at = np.flatnonzero(tx.within(self.first, WINDOW))
        self.start = self.count = self.ahead = self.document = np.zeros(0, np.int64)
        self.anchor = self.whole = np.zeros(0, tx.U64)
        if not len(at):
            return
        grams = tx.word_grams(self.words, GRAM)
        anchors = tx.minimizers(grams, WINDOW - GRAM + 1)[at]
        begin = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.start = at[begin]
        self.count = np.diff(np.append(begin, len(at)))
        self.ahead = anchors[begin] - self.start
        # mixed again: least hashes are all small, and buckets are ranges of hashes
        self.anchor = tx.mix(grams[anchors[begin]])
        sums = np.zeros(len(self.words) + 1, tx.U64)
        p, inverse = tx._power(len(self.words) + 1)
        np.cumsum(self.words * p[:-1], out=sums[1:])
        stop = self.start + self.count + WINDOW - 1
        self.whole = tx.mix((sums[stop] - sums[self.start]) * inverse[self.start] + (self.count * 64 + self.ahead).astype(tx.U64))
        self.document = np.searchsorted(self.first, self.start, "right") - 1


class Block:
    """The fragments of a block, its distinct ones in order, and the least document of each."""

    def __init__(self, table: pa.Table):
        data, offsets = tx.string_bytes(table["t"])
        ids = table["k"].combine_chunks()
        self.ids = ids.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.parts = [(row, part, offs, Fragments(part, offs)) for row, _, part, offs in tx.chunks(data, offsets)]
        join = lambda f, t: np.concatenate([f(x) for x in self.parts]) if self.parts else np.zeros(0, t)
        anchor, whole = join(lambda x: x[3].anchor, tx.U64), join(lambda x: x[3].whole, tx.U64)
        self.count = join(lambda x: x[3].count, np.int64)
        document = self.ids[join(lambda x: x[3].document + x[0], np.int64)]
        order, new = _groups(anchor, whole, document)
        anchor_, whole_ = anchor[order], whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor_[1:] != anchor_[:-1]) | (whole_[1:] != whole_[:-1])
        self.one = order[new]  # the fragment of the least document
        self.anchor, self.whole, self.least = anchor[self.one], whole[self.one], document[self.one]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.base = np.cumsum([0, *(len(f.start) for *_, f in self.parts)])

    def windows(self, status: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows of split anchors: hashes, anchors, documents, chunk and first word."""
        out: list[list] = [[], [], [], [], []]
        for p, (row, _, _, f) in enumerate(self.parts):
            k = np.flatnonzero(status[self.entry[self.base[p] : self.base[p + 1]]] == SPLIT)
            n = f.count[k]
            starts = np.repeat(f.start[k] + n - np.cumsum(n), n) + np.arange(n.sum())
            if len(starts):
                for x, v in zip(out, (tx.word_grams(f.words, WINDOW)[starts], np.repeat(f.anchor[k], n), self.ids[np.repeat(f.document[k] + row, n)], np.full(len(starts), p), starts), strict=True):
                    x.append(v)
        kinds = (tx.U64, tx.U64, np.int64, np.int64, np.int64)
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, kinds, strict=True))


def _ask(n: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table)
        block = table[BLOCK][0].as_py()
        return _table([(0, k, block, b.anchor[i:j].tobytes() + b.whole[i:j].tobytes() + b.least[i:j].tobytes()) for k, i, j in slices(b.anchor, n)], _ASK)

    return _quiet(run)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Three packed columns of all rows, and where each row's entries end."""
    payloads = table["payload"].to_pylist()
    sizes = [len(p) // 24 for p in payloads]
    cols = [np.concatenate([np.frombuffer(p, t, n, 8 * n * k) for p, n in zip(payloads, sizes, strict=True)]) for k, t in enumerate((tx.U64, tx.U64, np.int64))]
    return *cols, np.cumsum(sizes)


def _settle(hot: int):
    def run(table: pa.Table) -> pa.Table:
        anchor, whole, least, ends = _columns(table)
        order, new = _groups(anchor, whole)
        group = np.cumsum(new) - 1
        all_least = np.minimum.reduceat(least[order], np.flatnonzero(new))
        a = anchor[order][new]
        start = np.concatenate([[True], a[1:] != a[:-1]])
        kinds = np.bincount(np.cumsum(start) - 1)[np.cumsum(start) - 1]
        at = np.empty(len(order), np.int64)
        at[order] = group
        status = np.where(kinds[at] == 1, np.where(all_least[at] < least, LESS, OWN), np.where(kinds[at] <= hot, SEARCH, SPLIT)).astype(np.uint8)
        values = []
        for k in np.split(np.arange(len(order)), ends[:-1]):
            values.append(len(k).to_bytes(8, "little") + status[k].tobytes() + all_least[at[k]][status[k] == LESS].tobytes())
        return _answers(table, values, 0)

    return _quiet(run)


def _rows(told: pa.Table, kind: int) -> list[bytes]:
    return [p for _, p in sorted((b, p) for k, b, p in zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True) if k == kind)]


def _send(n: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _ASK.empty_table()
        b, block = Block(docs), docs[BLOCK][0].as_py()
        status, less = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for p in _rows(told, 0):
            m = int.from_bytes(p[:8], "little")
            status.append(np.frombuffer(p, np.uint8, m, 8))
            less.append(np.frombuffer(p[8 + m :], np.int64))
        status = np.concatenate(status)
        rows = [(2, block, block, len(status).to_bytes(8, "little") + status.tobytes() + np.concatenate(less).tobytes())]
        sent = np.flatnonzero(status == SEARCH)
        for k, i, j in slices(b.anchor[sent], n):
            own, words, meta = sent[i:j], [], []
            for e in own:
                p = int(np.searchsorted(b.base, b.one[e], "right")) - 1
                f = b.parts[p][3]
                x = b.one[e] - b.base[p]
                words.append(f.words[f.start[x] : f.start[x] + f.count[x] + WINDOW - 1])
                meta.append((f.count[x], b.least[e]))
            rows.append((0, k, block, len(own).to_bytes(8, "little") + b.anchor[own].tobytes() + b.whole[own].tobytes() + np.array(meta, np.int64).tobytes() + np.concatenate(words).tobytes()))
        hashes, anchors, docs_, _, _ = b.windows(status)
        order, new = _groups(hashes, anchors)
        first = np.flatnonzero(new)
        h, x = hashes[order][first], anchors[order][first]
        least = np.minimum.reduceat(docs_[order], first) if len(first) else docs_
        rows += [(1, k, block, h[i:j].tobytes() + x[i:j].tobytes() + least[i:j].tobytes()) for k, i, j in slices(h, n)]
        return _table(rows, _ASK)

    return _quiet_pair(run)


def _search(table: pa.Table) -> pa.Table:
    """For each window of each fragment that was sent, the least document that has it."""
    anchors, wholes, metas, bodies, counts = [], [], [], [], []
    for p in table["payload"].to_pylist():
        n = int.from_bytes(p[:8], "little")
        counts.append(n)
        anchors.append(np.frombuffer(p, tx.U64, n, 8))
        wholes.append(np.frombuffer(p, tx.U64, n, 8 + 8 * n))
        metas.append(np.frombuffer(p, np.int64, 2 * n, 8 + 16 * n).reshape(n, 2))
        bodies.append(np.frombuffer(p, tx.U64, offset=8 + 32 * n))
    anchor, whole, meta, body = (np.concatenate(x) for x in (anchors, wholes, metas, bodies))
    size = meta[:, 0] + WINDOW - 1
    order, new = _groups(anchor, whole)
    first = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    one = order[first]
    least = np.minimum.reduceat(meta[order, 1], first)
    # the distinct fragments, each followed by a 0
    start = (np.cumsum(size) - size)[one]
    n = size[one]
    names, symbol = np.unique(body, return_inverse=True)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(n + 1) - (n + 1)
    text = np.zeros(int((n + 1).sum()), np.int64)
    text[np.repeat(begin, n) + inner] = symbol[np.repeat(start, n) + inner] + 1
    index = FMIndex(text, len(names) + 1, WINDOW)
    owner = np.repeat(np.arange(len(one)), n + 1)
    smallest = LeastOf(least[owner][index.suffixes])
    m = meta[one, 0]
    at = np.repeat(begin, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    found = np.empty(len(at), np.int64)
    own = np.repeat(least, m)
    for i in range(0, len(at), SEARCHED_AT_ONCE):
        part = slice(i, i + SEARCHED_AT_ONCE)
        length, low, high = index.matching(text, at[part] + (WINDOW - 1), WINDOW)
        whole = length == WINDOW
        found[part] = own[part]
        found[part][whole] = smallest.of(low[whole], high[whole])
    each = np.split(found, np.cumsum(m)[:-1])
    values, k = [], 0
    for c in counts:
        values.append(np.concatenate([each[e] for e in entry[k : k + c]]).tobytes())
        k += c
    return _answers(table, values, 0)


def _least(table: pa.Table) -> pa.Table:
    h, x, least, ends = _columns(table)
    order, new = _groups(h, x)
    out = np.empty(len(order), np.int64)
    out[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return _answers(table, [v.tobytes() for v in np.split(out, ends[:-1])], 1)


def _answer(table: pa.Table) -> pa.Table:
    kind = table["kind"][0].as_py()
    return table.select(_ASK.names).cast(_ASK) if kind == 2 else _search(table) if kind == 0 else _least(table)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def kept_text(data: np.ndarray, f: Fragments, offsets: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The words of each document that are not gone, joined by one space."""
    kept = np.flatnonzero(~gone)
    document = np.searchsorted(f.first, kept, "right") - 1
    more = kept[:-1][document[1:] == document[:-1]] if len(kept) else kept
    flags = tx.covered(len(data), f.starts[kept], f.ends[kept] - f.starts[kept]) if len(kept) else np.zeros(len(data), bool)
    out = data.copy()
    flags[f.ends[more]] = True
    out[f.ends[more]] = 0x20
    flat = out[flags].tobytes()
    at = np.concatenate([[0], np.cumsum(flags)])[offsets]
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _cut(n: int, column: str):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        n_words, spans, texts = [], [], []
        if docs.num_rows:
            b = Block(docs)
            note = _rows(told, 2)[0] if told.num_rows else bytes(8)
            m = int.from_bytes(note[:8], "little")
            status = np.frombuffer(note, np.uint8, m, 8)
            least = b.least.copy()
            least[status == LESS] = np.frombuffer(note[8 + m :], np.int64)
            bodies = {k: p for kind, k, p in zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["payload"].to_pylist(), strict=True) if kind == 0}
            searched: dict[int, np.ndarray] = {}
            sent = np.flatnonzero(status == SEARCH)
            for k, i, j in slices(b.anchor[sent], n):
                sizes = b.count[b.one[sent[i:j]]]
                searched.update(zip(sent[i:j].tolist(), np.split(np.frombuffer(bodies[k], np.int64), np.cumsum(sizes)[:-1]), strict=True))
            hashes, anchors, owner, chunk, first = b.windows(status)
            order, new = _groups(hashes, anchors)
            again = np.zeros(len(order), bool)
            told_least = np.frombuffer(b"".join(_rows(told, 1)), np.int64)
            again[order] = told_least[np.cumsum(new) - 1] < owner[order] if len(order) else False
            for p, (row, data, offs, f) in enumerate(b.parts):
                entry = b.entry[b.base[p] : b.base[p + 1]]
                s, own = status[entry], b.ids[f.document + row]
                whole = np.flatnonzero((s <= LESS) & (least[entry] < own))
                single = [f.start[k] + np.flatnonzero(searched[entry[k]] < own[k]) for k in np.flatnonzero(s == SEARCH).tolist()]
                at = np.concatenate([f.start[whole], *single, first[(chunk == p) & again]]).astype(np.int64)
                length = np.full(len(at), WINDOW)
                length[: len(whole)] += f.count[whole] - 1
                gone = tx.covered(len(f.words), at, length)
                no_id = b.missing[row : row + len(offs) - 1]
                if no_id.any():
                    gone &= ~np.repeat(no_id, np.diff(f.first))
                texts += kept_text(data, f, offs, gone)
                for i, j in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True):
                    g = gone[i:j]
                    n_words.append(j - i)
                    spans.append([{"start": x, "stop": y} for x, y in np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]]))).reshape(-1, 2).tolist()] if g.any() else [])
        new = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(texts, pa.binary()).cast(pa.string())], ["n_words", "spans", "kept"])
        names = [c for c in docs.column_names if c not in (BLOCK, "t", "k")]
        return pa.table([*(docs[c] for c in names), new], names=[*names, column])

    return _quiet_pair(run)


def cut_earlier(docs: DataFrame, key: str = "doc_id", text: str = "text", column: str = "cut", hot: int = HOT) -> DataFrame:
    """key and a column struct<n_words long, spans array<struct<start, stop>>, kept string> for each document.

    Every word that a window of 13 consecutive words covers whose words also start in a document with a smaller id is
    removed; windows are judged on the input. kept is the rest, joined by one space; spans are the removed runs by word
    number. Null and empty texts have no words; texts of under 13 words lose none. A row whose id is null loses none and
    makes no other row lose any; rows that share an id don't count as earlier than each other. An empty table gives an
    empty one. Other columns are left out, so none can clash.
    A text of more than 1 MiB is a chunk of its own and read whole.
    """
    n = block_count(docs, text)
    base = docs.select(F.col(key).alias("_key"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = blocked(base, "k", "t", n)
    n *= BUCKETS
    asked = dealt.groupBy(BLOCK).applyInArrow(_ask(n), _ASK_DDL)
    known = asked.groupBy("bucket").applyInArrow(_settle(hot), _ASK_DDL)
    sent = dealt.groupBy(BLOCK).cogroup(known.groupBy("block")).applyInArrow(_send(n), _ASK_DDL)
    searched = sent.groupBy("kind", "bucket").applyInArrow(_quiet(_answer), _ASK_DDL)
    schema = T.StructType([base.schema["_key"], T.StructField(column, T._parse_datatype_string("struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,kept:string>"))])
    out = dealt.groupBy(BLOCK).cogroup(searched.groupBy("block")).applyInArrow(_cut(n, column), schema)
    return out.withColumnRenamed("_key", key)


def op3_fm_index(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gone = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return cut_earlier(docs).select("doc_id", F.col("cut.n_words").alias("n_words"), gone.alias("n_removed"), F.sha2("cut.kept", 256).alias("kept_sha256"))
