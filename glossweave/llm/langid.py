"""Language identification of mixed texts: scripts narrow the candidates of each word, a Viterbi pass labels spans.

Each word has a score in each language, the log-probability of its hashed character 3- and 4-grams. The best path through
the words pays PENALTY for each change of language, so a foreign name doesn't break a span and a foreign passage does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .blocks import plus

FEATURES = 1 << 16
PENALTY = 12.0
#: Overlapping n-grams count the same evidence several times.
TEMPER = 0.4
#: Languages that a task counts at once.
LANGUAGES = 256
#: Emissions that are computed at once, n-grams times languages.
CELLS = 1 << 21
#: A language is written in the scripts that at least this share of its words begin with.
SCRIPT_SHARE = 0.02
UNDETERMINED = "und"
_VITERBI_BYTES = 4 << 20

#: First code points of ranges of scripts, by the Unicode blocks; the last column names the script.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
)
_SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_FIRST = np.array([first for first, _ in SCRIPTS])
_SCRIPT_OF = np.array([_SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

#: Bytes of words: A-Z, a-z and all of characters beyond ASCII.
LETTERS = tx.class_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Words:
    """Words of a chunk and the features of their n-grams, feature by feature in the order of the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = tx.words(data, offsets, LETTERS)
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        if len(data) > 1:  # the capitals of Latin-1 in UTF-8
            capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:][capital] += 32
        plain = np.concatenate([[32], np.where(LETTERS[data], low, 32), [32, 32]]).astype(np.uint32)
        at = np.flatnonzero(LETTERS[data])
        three = plain[at] | plain[at + 1] << 8 | plain[at + 2] << 16
        four = three | plain[at + 3] << 24
        spread = lambda x, by: ((x * np.uint32(by)) >> np.uint32(16)).astype(np.uint16)
        self.features = np.stack([spread(three, 0x9E3779B1), spread(four ^ (four >> np.uint32(15)), 0x85EBCA77)], 1)
        length = self.ends - self.starts
        self.begin = np.cumsum(length) - length
        self.length = length
        self.scripts = self._scripts(data)

    def _scripts(self, data: np.ndarray) -> np.ndarray:
        """The script of each word's first character."""
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
        b0, b1, b2, b3 = (padded[self.starts + k] for k in range(4))
        point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63)))
        return _SCRIPT_OF[np.searchsorted(_SCRIPT_FIRST, point, "right") - 1]


class Model:
    """Log-probabilities of features by language, and the languages that use each script."""

    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.names = names
        self.weights = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * FEATURES)).T.astype(np.float32) * np.float32(TEMPER)
        used = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        self.barred = np.where(used.T | ~used.any(0)[:, None], 0, -1e6).astype(np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        out = np.empty((len(w.starts), len(self.names)), np.float32)
        stop, first = np.append(w.begin[1:], len(w.features)), 0
        while first < len(out):
            # words of about CELLS n-grams times languages; a longer word has its languages in turn
            last = max(first + 1, int(np.searchsorted(stop, w.begin[first] + CELLS // len(self.names), "right")))
            f = w.features[w.begin[first] : stop[last - 1]]
            wide = max(1, CELLS // len(f))
            for k in range(0, len(self.names), wide):
                weights = self.weights[:, k : k + wide]
                out[first:last, k : k + wide] = np.add.reduceat(weights[f[:, 0]] + weights[f[:, 1]], w.begin[first:last] - w.begin[first], axis=0)
            first = last
        return out + self.barred[w.scripts]

    def path(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of each word; all documents advance together."""
        n, k = np.diff(first), len(self.names)
        out = np.zeros(len(emissions), np.int64)
        order = np.argsort(-n, kind="stable")
        begin = first[:-1][order]
        active = np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")  # documents with more than t words
        kind = np.uint8 if k <= 256 else np.int32
        came = np.zeros((len(emissions), k), kind)
        own = np.arange(k, dtype=kind)
        score = np.zeros((len(order), k), np.float32)
        for t, a in enumerate(active.tolist()):
            s = score[:a]
            if t:
                best = s.argmax(1)
                switch = s[np.arange(a), best] - np.float32(PENALTY)
                stay = s >= switch[:, None]
                came[begin[:a] + t] = np.where(stay, own, best[:, None])
                s = np.where(stay, s, switch[:, None])
            score[:a] = s + emissions[begin[:a] + t]
        state = score.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            out[at] = state[:a]
            if t:
                state[:a] = came[at, state[:a]]
        return out


def train(docs: DataFrame, text: str, lang: str) -> Model | None:
    """A model of all rows of docs with a text and a language; None where there is none. Counts are summed by tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts, scripts = np.zeros((0, FEATURES)), np.zeros((0, len(_SCRIPT_NAMES)))

        def rows() -> Iterator[pa.RecordBatch]:
            for name, k in names.items():
                for kind, row in ((0, counts[k]), (1, scripts[k])):
                    at = np.flatnonzero(row)
                    yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(row[at], pa.float64())], ["name", "kind", "at", "n"])

        for batch in (b.slice(i, LANGUAGES) for b in batches for i in range(0, b.num_rows, LANGUAGES)):
            if len(names) > LANGUAGES:
                yield from rows()
                names, counts, scripts = {}, counts[:0], scripts[:0]
            data, offsets = tx.string_bytes(batch.column(text))
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column(lang).to_pylist()], np.int64)
            grow = len(names) - len(counts)
            counts, scripts = np.vstack([counts, np.zeros((grow, FEATURES))]), np.vstack([scripts, np.zeros((grow, scripts.shape[1]))])
            for row, last, part, offs in tx.chunks(data, offsets):
                w = Words(part, offs)
                of_word = np.repeat(langs[row:last], np.diff(w.first))
                of_gram = np.repeat(of_word, w.length)
                for k in range(2):
                    counts += np.bincount(of_gram * FEATURES + w.features[:, k].astype(np.int64), minlength=counts.size).reshape(counts.shape)
                scripts += np.bincount(of_word * scripts.shape[1] + w.scripts, minlength=scripts.size).reshape(scripts.shape)
        yield from rows()

    rows = docs.select(F.col(text), F.col(lang)).mapInArrow(count, "name string, kind int, at int, n double").groupBy("name", "kind", "at").agg(F.sum("n").alias("n"))
    # at most FEATURES + scripts rows a language
    table = rows.toArrow()
    if not table.num_rows:
        return None
    names = sorted(set(table["name"].to_pylist()))
    of = {n: i for i, n in enumerate(names)}
    which = np.array([of[n] for n in table["name"].to_pylist()])
    kind, at, n = (table[c].to_numpy() for c in ("kind", "at", "n"))
    counts, scripts = np.zeros((len(names), FEATURES)), np.zeros((len(names), len(_SCRIPT_NAMES)))
    counts[which[kind == 0], at[kind == 0]] = n[kind == 0]
    scripts[which[kind == 1], at[kind == 1]] = n[kind == 1]
    return Model(names, counts, scripts)


_KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])


def languages(docs: DataFrame, model: Model | None, text: str = "text", column: str = "language") -> DataFrame:
    """docs with a column struct<lang string, score double, spans array<struct<lang, start, stop>>>.

    spans are byte ranges of the text from the first word of a run of one language to the last; lang is the language with
    most letters' bytes, the first by name among equals, score its share of these. Null texts, and texts without a letter,
    are `und` with score 0 and no spans, as are all where the model is None.
    A text of more than 1 MiB is a chunk of its own and read whole. Repeated rows are labelled alike; a column
    of docs named like the new one is replaced.
    """
    base = docs.drop(column)
    schema = plus(base, column, "struct<lang:string,score:double,spans:array<struct<lang:string,start:bigint,stop:bigint>>>")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows: list[dict] = []
            data, offsets = tx.string_bytes(batch.column(text))
            for _, _, part, offs in tx.chunks(data, offsets, _VITERBI_BYTES) if m else ():
                first, starts, ends, score, shift, n = [[0]], [], [], [], 0, 0
                for *_, p, o in tx.chunks(part, offs):  # only one piece's n-grams at a time
                    w = Words(p, o)
                    first.append(w.first[1:] + n)
                    starts.append(w.starts + shift)
                    ends.append(w.ends + shift)
                    score.append(m.emissions(w))
                    shift, n = shift + o[-1], n + len(w.starts)
                    del w
                first, starts, ends = np.concatenate(first).astype(np.int64), np.concatenate(starts), np.concatenate(ends)
                path = m.path(np.concatenate(score), first)
                del score
                for k in range(len(offs) - 1):
                    rows.append(_label(m.names, path[first[k] : first[k + 1]], starts[first[k] : first[k + 1]] - offs[k], ends[first[k] : first[k + 1]] - offs[k], part[offs[k] : offs[k + 1]]))
            if not m:
                rows = [_NOTHING] * batch.num_rows
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, _KIND)], [*names, column])

    return base.mapInArrow(run, schema)


_NOTHING = {"lang": UNDETERMINED, "score": 0.0, "spans": []}


def _label(names: list[str], path: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> dict:
    if not len(path):
        return _NOTHING
    if data.max() >= 0x80 and not (((data | 32) >= 97) & ((data | 32) <= 122)).any() and not any(c.isalpha() for c in data.tobytes().decode()):
        return _NOTHING
    weight = np.bincount(path, weights=ends - starts, minlength=len(names))
    best = int(weight.argmax())
    cut = np.flatnonzero(path[1:] != path[:-1]) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(path)]]) - 1
    return {
        "lang": names[best],
        "score": float(weight[best] / weight.sum()),
        "spans": [{"lang": names[path[i]], "start": int(starts[i]), "stop": int(ends[j])} for i, j in zip(a.tolist(), b.tolist(), strict=True)],
    }


def remainder(key: str, n: int):
    """crc32 of a column's text, modulo n; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def predicted(docs: DataFrame, text: str = "text", column: str = "language") -> DataFrame:
    """docs with the language that a model of the rows outside of the fifth that is held out gives each text."""
    learn = docs.filter((remainder("doc_id", 5) != 0) & F.col(text).isNotNull() & F.col("lang").isNotNull())
    return languages(docs, train(learn, text, "lang"), text, column)


def op4_viterbi(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return predicted(docs).select("doc_id", held, F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
