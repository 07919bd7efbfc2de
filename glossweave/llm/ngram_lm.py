"""Scores of a word n-gram model as one weighted backoff automaton.

Smoothed n-grams are arcs between states, which are the contexts; a state without an arc for the next word follows its
failure arc, which costs the context's backoff weight, to the shorter context, down to the root, which has an arc for every
word. A text is scored in one traversal from left to right that carries the state and adds the log-probabilities up.

The counts are those of the whole training corpus, and every n-gram of it is an arc, also those that occur once:
P(w) = (count(w) + 0.5) / (N + 0.5 (V + 1)), the unseen word included;
P(w | c) = (count(c w) + PRIOR P(w | shorter c)) / (count(c) + PRIOR), so the backoff weight of c is PRIOR / (count(c) + PRIOR).
Every occurrence of a context has a word behind it (the end is a word and no context), so the probabilities of all words add
up to 1 in every state.

Blocks send each bucket of hashes their distinct n-grams, once, with how often the block's training documents have them; the
bucket adds these up and answers each block with the sums. Nothing else is shuffled but the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import text as tx
from .blocks import BLOCK, block_count, blocked, edges, slices
from .langid import remainder
from .suffix_dedup import _quiet, _table

ORDER = 3
#: Weight of the shorter context, in occurrences.
PRIOR = 64.0
END = tx.U64(0x1D8E4E27C47D124F)
#: Words that a task holds before it sends them.
HELD = 1 << 21
#: Steps that are taken at once.
STEPS = 1 << 18

_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
_ROWS_DDL = "kind int, bucket int, block int, n int, payload binary"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's words and its end, and where each document begins."""
    starts, ends, first = tx.words(data, offsets, tx.SPACED)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full(len(starts) + len(first) - 1, END, tx.U64)
    out[np.arange(len(starts)) + owner] = tx.Rolling(data, fold=True).ranges(starts, ends)
    return out, first + np.arange(len(first))


def _texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of a whole column."""
    data, offsets = tx.string_bytes(texts)
    parts = [tokens(part, offs) for *_, part, offs in tx.chunks(data, offsets)]
    if not parts:
        return np.zeros(0, tx.U64), np.zeros(1, np.int64)
    sizes = np.cumsum([0, *(len(w) for w, _ in parts)])
    return np.concatenate([w for w, _ in parts]), np.concatenate([[0], *(f[1:] + s for (_, f), s in zip(parts, sizes, strict=False))])


#: So many bits of a hash tell the keys of a bucket apart: of less than a million, as a bucket's share of the blocks is bounded, one in a million meets another.
TAIL = 40


def _tails(keys: np.ndarray, bucket: int, n: int) -> bytes:
    """Sorted keys of a bucket: their low bits by bit, and their high ones as a row of bits, a 1 for each key and a 0 for each step."""
    tail = (keys - edges_of(n)[bucket]) >> np.uint64(max(0, 65 - int(n).bit_length() - TAIL))
    width = TAIL + 1 - len(keys).bit_length()
    high = (tail >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(len(keys) + (2 << (TAIL - width)), np.uint8)
    unary[high + np.arange(len(keys))] = 1
    low = np.empty((len(keys), width), np.uint8)
    for k in range(width):
        low[:, k] = tail >> np.uint64(k) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def _from_tails(p: bytes, n: int) -> tuple[np.ndarray, int]:
    """The keys of a row of n, and how many bytes they take."""
    width = TAIL + 1 - int(n).bit_length()
    steps = -(-(n + (2 << (TAIL - width))) // 8)
    size = -(-n * width // 8)
    unary = np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8, steps)))
    bits = np.unpackbits(np.frombuffer(p, np.uint8, size, steps), count=n * width).reshape(n, width)
    padded = np.zeros((n, 64), np.uint8)
    padded[:, :width] = bits
    low = np.packbits(padded, axis=1, bitorder="little").view(np.int64).ravel()
    return (unary - np.arange(n)) << width | low, steps + size


def _numbers(values: np.ndarray) -> bytes:
    """Two bits each; 3 stands for those from 3 on, which follow in a byte, and for 255 on behind these."""
    few = np.minimum(values, 3).astype(np.uint8)
    more = values[few == 3] - 3
    byte = np.minimum(more, 255).astype(np.uint8)
    return np.packbits(np.stack([few >> 1, few & 1], 1)).tobytes() + byte.tobytes() + more[byte == 255].astype(np.int64).tobytes()


def _from_numbers(p: bytes, n: int, at: int = 0) -> np.ndarray:
    size = -(-2 * n // 8)
    bits = np.unpackbits(np.frombuffer(p, np.uint8, size, at), count=2 * n).reshape(n, 2)
    out = (bits[:, 0] << 1 | bits[:, 1]).astype(np.int32)
    some = np.flatnonzero(out == 3)
    more = np.frombuffer(p, np.uint8, len(some), at + size).astype(np.int32)
    large = np.flatnonzero(more == 255)
    more[large] = np.frombuffer(p, np.int64, len(large), at + size + len(some))
    out[some] += more
    return out


@functools.cache
def edges_of(n: int) -> np.ndarray:
    return edges(n)


def _vocabulary(n: int):
    """A task's distinct words by bucket, and how many words it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list[np.ndarray], total: int) -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(parts))
            found = [(b, int(total if not k else 0), j - i, _tails(keys[i:j], b, n)) for k, (b, i, j) in enumerate(slices(keys, n))]
            yield from _table(found, _VOCABULARY).to_batches()

        parts: list[np.ndarray] = []
        held, total = 0, 0
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = tx.string_bytes(batch.column("t"))
                for *_, part, offs in tx.chunks(data, offsets):
                    w, _ = tokens(part, offs)
                    parts.append(np.unique(w))
                    held, total = held + len(parts[-1]), total + len(w)
                    if held >= HELD:
                        parts = [np.unique(np.concatenate(parts))]
                        held = len(parts[0])
                        if held >= HELD // 2:
                            yield from rows(parts, total)
                            parts, held, total = [], 0, 0
            if parts:
                yield from rows(parts, total)

    return run


_VOCABULARY = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("size", pa.int32()), ("payload", pa.binary())])


def _distinct(table: pa.Table) -> pa.Table:
    parts = [_from_tails(p, m)[0] for p, m in zip(table["payload"].to_pylist(), table["size"].to_pylist(), strict=True)]
    return pa.table({"n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "v": pa.array([len(np.unique(np.concatenate(parts)))], pa.int64())})


class Grams:
    """The tokens of a block; of each order the distinct n-grams, in order of their hashes, and the number of the one that ends at each place."""

    def __init__(self, texts, learn: np.ndarray):
        self.tokens, self.first = _texts(texts)
        n = np.diff(self.first)
        taught = np.repeat(learn, n)
        before = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], n)
        self.keys, self.counts, self.number = {}, {}, {}
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(before >= k - 1).astype(np.int32)
            own = (tx.word_grams(self.tokens, k) if k > 1 else self.tokens)[at - (k - 1)] if len(at) else np.zeros(0, tx.U64)
            self.keys[k], which = np.unique(own, return_inverse=True)
            del own
            self.counts[k] = np.bincount(which, weights=taught[at], minlength=len(self.keys[k])).astype(np.int32)
            self.number[k] = np.full(len(self.tokens), -1, np.int32)
            self.number[k][at] = which


def _ask(n: int):
    def run(table: pa.Table) -> pa.Table:
        block, g = table[BLOCK][0].as_py(), Grams(table["t"], table["learn"].to_numpy(zero_copy_only=False))
        return _table([(k, b, block, j - i, _tails(g.keys[k][i:j], b, n) + _numbers(g.counts[k][i:j])) for k in g.keys for b, i, j in slices(g.keys[k], n)], _ROWS)

    return _quiet(run)


def _add(table: pa.Table) -> pa.Table:
    """The sums over all blocks, for each block in the order in which it asked."""
    rows, tails, counts = [], [], []
    for kind, bucket, block, n, p in zip(*(table[c].to_pylist() for c in ("kind", "bucket", "block", "n", "payload")), strict=True):
        rows.append((kind, bucket, block, n))
        tail, at = _from_tails(p, n)
        tails.append(tail)
        counts.append(_from_numbers(p, n, at))
    names, which = np.unique(np.concatenate(tails), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
    each = np.split(total[which], np.cumsum([len(t) for t in tails])[:-1])
    return _table([(*row, _numbers(v)) for row, v in zip(rows, each, strict=True)], _ROWS)


class Automaton:
    """States and arcs of the part of the model that a block's texts can reach. State 0 is the root."""

    def __init__(self, root: np.ndarray, next_of_word: np.ndarray):
        self.root, self.next_of_word = root, next_of_word  # the root's arcs, by the number of the word
        self.failure, self.cost = np.zeros(1, np.int64), np.zeros(1)
        self.arcs = np.zeros(0, np.int64)  # state << 32 | word, in order
        self.weight, self.target = np.zeros(0), np.zeros(0, np.int64)

    def add_states(self, failure: np.ndarray, cost: np.ndarray) -> np.ndarray:
        new = np.arange(len(self.failure), len(self.failure) + len(failure))
        self.failure, self.cost = np.concatenate([self.failure, failure]), np.concatenate([self.cost, cost])
        return new

    def add_arcs(self, state: np.ndarray, word: np.ndarray, weight: np.ndarray, target: np.ndarray) -> None:
        arcs = np.concatenate([self.arcs, state << 32 | word])
        order = np.argsort(arcs, kind="stable")
        self.arcs = arcs[order]
        self.weight, self.target = np.concatenate([self.weight, weight])[order], np.concatenate([self.target, target])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each state, and the state that follows."""
        total, state = np.zeros(len(word)), state.copy()
        follow = np.empty(len(word), np.int64)
        left = np.arange(len(word))
        while len(left):
            s, w = state[left], word[left]
            arc = s << 32 | w
            near = np.minimum(np.searchsorted(self.arcs, arc), max(len(self.arcs) - 1, 0))
            hit = (self.arcs[near] == arc if len(self.arcs) else np.zeros(len(arc), bool)) & (s > 0)
            at_root = s == 0
            total[left[hit]] += self.weight[near[hit]]
            follow[left[hit]] = self.target[near[hit]]
            total[left[at_root]] += self.root[w[at_root]]
            follow[left[at_root]] = self.next_of_word[w[at_root]]
            left = left[~hit & ~at_root]
            total[left] += self.cost[state[left]]
            state[left] = self.failure[state[left]]
        return total, follow


def _logs(g: Grams, counts: dict[int, np.ndarray], total: float, vocabulary: int) -> tuple[Automaton, np.ndarray]:
    """The automaton of a block, and the state that is reached behind each of its tokens.

    The automaton forgets all but the last ORDER - 1 words, so the state behind a place is the longest known context that ends
    there, whatever came before. So the steps of the traversal needn't wait for each other.
    """
    word = g.number[1].astype(np.int64)
    p = {1: (counts[1] + 0.5) / (total + 0.5 * (vocabulary + 1))}
    root = np.log10(p[1])
    automaton = Automaton(root, np.zeros(len(root), np.int64))
    one = {k: np.zeros(len(g.keys[k]), np.int32) for k in g.keys}  # a place where each n-gram ends
    for k in g.keys:
        at = np.flatnonzero(g.number[k] >= 0)
        one[k][g.number[k][at]] = at
    state = {k: np.zeros(len(g.keys[k]), np.int64) for k in range(1, ORDER)}  # 0: it is no context
    arcs = []
    for k in range(1, ORDER + 1):
        at = one[k]
        if k > 1:
            context, shorter = g.number[k - 1][at - 1], p[k - 1][g.number[k - 1][at]]
            size = counts[k - 1][context]
            p[k] = (counts[k] + PRIOR * shorter) / (size + PRIOR)
        if k < ORDER:
            known = np.flatnonzero((counts[k] > 0) & (g.tokens[at] != END))
            fall = state[k - 1][g.number[k - 1][at[known]]] if k > 1 else np.zeros(len(known), np.int64)
            state[k][known] = automaton.add_states(fall, np.log10(PRIOR / (counts[k][known] + PRIOR)))
            if k == 1:
                automaton.next_of_word[known] = state[1][known]
        if k > 1:
            seen = np.flatnonzero(counts[k] > 0)
            target = state[k][seen] if k < ORDER else state[k - 1][g.number[k - 1][at[seen]]]
            arcs.append((state[k - 1][context[seen]], word[at[seen]], np.log10(p[k][seen]), target))
    automaton.add_arcs(*(np.concatenate(x) for x in zip(*arcs, strict=True)))
    reached = np.zeros(len(word), np.int64)
    for k in range(1, ORDER):
        own = np.where(g.number[k] >= 0, state[k][g.number[k]], 0) if len(state[k]) else reached
        reached = np.where(own > 0, own, reached)
    return automaton, reached


_SCORED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(n: int, total: float, vocabulary: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([docs["_key"], *(pa.array([], f.type) for f in _SCORED)], names=["_key", *_SCORED.names])
        g = Grams(docs["t"], docs["learn"].to_numpy(zero_copy_only=False))
        answers = {(k, b): p for k, b, p in zip(*(told[c].to_pylist() for c in ("kind", "bucket", "payload")), strict=True)}
        counts = {k: np.concatenate([_from_numbers(answers[k, b], j - i) for b, i, j in slices(g.keys[k], n)] or [np.zeros(0, np.int64)]) for k in g.keys}
        del answers
        automaton, reached = _logs(g, counts, total, vocabulary)
        before = np.zeros(len(reached), np.int64)
        before[1:] = reached[:-1]
        before[g.first[:-1]] = 0
        word = g.number[1]
        logs = np.concatenate([automaton.step(before[i : i + STEPS], word[i : i + STEPS].astype(np.int64))[0] for i in range(0, len(word), STEPS)])
        sums = lambda x: np.add.reduceat(x, g.first[:-1])
        values = (np.diff(g.first), sums((counts[1][g.number[1]] > 0).astype(np.int64)), sums(automaton.root[g.number[1]]), sums(logs))
        return pa.table([docs["_key"], *(pa.array(v, f.type) for v, f in zip(values, _SCORED, strict=True))], names=["_key", *_SCORED.names])

    def quiet(docs: pa.Table, told: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            return run(docs, told)

    return quiet


def scored(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each document; train is a condition on its columns.

    Tokens are words, A-Z lower-cased, then one end; a null text is empty and has the end alone. base_score is the sum of
    the words' own log10 probabilities, score that of the model. Documents for which train is null are not learned
    from. Repeated rows count and are scored each, also those that share an id. A very long text is a block of its own. An
    empty table gives an empty one; with nothing to learn from, all words are unknown. Other columns are left out.
    """
    n = block_count(docs, text)
    blocks = 2 * n  # of half the size, for the memory that all n-grams of a block take
    learn = F.coalesce(train, F.lit(False))
    words = docs.filter(learn).select(F.col(text).alias("t")).mapInArrow(_vocabulary(n), "bucket int, n bigint, size int, payload binary")
    total, vocabulary = words.groupBy("bucket").applyInArrow(_quiet(_distinct), "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    base = docs.select(F.col(key).alias("_key"), F.col(text).alias("t"), learn.alias("learn"))
    dealt = blocked(base, "_key", "t", blocks)
    asked = dealt.groupBy(BLOCK).applyInArrow(_ask(n), _ROWS_DDL)
    told = asked.groupBy("kind", "bucket").applyInArrow(_quiet(_add), _ROWS_DDL)
    schema = T.StructType([base.schema["_key"], *T._parse_datatype_string("n_tokens bigint, n_known bigint, base_score double, score double").fields])
    out = dealt.groupBy(BLOCK).cogroup(told.groupBy("block")).applyInArrow(_score(n, float(total), int(vocabulary)), schema)
    return out.select(F.col("_key").alias(key), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def op5_backoff_automaton(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return scored(docs, remainder("doc_id", 5) != 1).select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
