"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Each coordinate has its own learning rate, and L1 keeps the weight of a feature at 0 until its gradients add up to more
than noise; what is broadcast are the weights that aren't 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .blocks import plus
from .langid import remainder

FEATURES = 1 << 20
#: At most this many labelled documents are learned from, those with the least hashes of their ids.
TRAINING_DOCUMENTS = 16_384
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
LIMIT = 0.7

#: Runs of letters; digits and other characters separate.
WORDS = tx.class_table([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct features, one document after the other, and where each begins: words, pairs, pairs with one word between."""
    starts, ends, first = tx.words(data, offsets, WORDS)
    h = tx.Rolling(data, fold=True).ranges(starts, ends)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = [(owner, h)]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            parts.append((owner[gap:][same], tx.mix(h[:-gap] * tx.U64(3) + h[gap:] * tx.U64(5) + tx.U64(salt))[same]))
    key = np.unique(np.concatenate([(o.astype(tx.U64) << tx.U64(20)) | (v >> tx.U64(44)) for o, v in parts]))
    return (key & tx.U64(FEATURES - 1)).astype(np.int64), np.searchsorted(key, np.arange(len(first), dtype=tx.U64) << tx.U64(20))


class Weights:
    """Sparse weights of a model, and its bias."""

    def __init__(self, at: np.ndarray, weight: np.ndarray, bias: float):
        self.at, self.weight, self.bias = at.astype(np.int32), weight.astype(np.float32), float(bias)

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES, np.float32)
        out[self.at] = self.weight
        return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    rows = [f[a:b].astype(np.int32) for f, first in _chunked(texts) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    for _ in range(epochs):
        for at, label in zip(rows, labels.tolist(), strict=True):
            i = np.append(at, FEATURES)
            w = _weights(z[i], n[i])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    w = _weights(z, n)
    at = np.flatnonzero(w[:FEATURES])
    return Weights(at, w[at], w[FEATURES])


def _chunked(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = tx.string_bytes(texts)
    return (features(part, offs) for *_, part, offs in tx.chunks(data, offsets))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int = TRAINING_DOCUMENTS) -> Weights | None:
    """Weights from at most limit labelled documents; None where there are none.

    A document with several labels has the highest; rows that share an id are one document, with the least of their texts.
    """
    ids = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    ids = ids.orderBy(F.xxhash64(key), key).limit(limit)  # limit bounds what is broadcast
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(ids), key)
    rows = rows.groupBy(key).agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")).select("_text", "_label", F.xxhash64(key).alias("_order"))

    def run(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            table = table.sort_by([("_order", "ascending"), ("_text", "ascending"), ("_label", "ascending")])
            w = fit(table["_text"], table["_label"].to_numpy().astype(float))
            return pa.table({"at": [w.at.tobytes()], "weight": [w.weight.tobytes()], "bias": [w.bias]})

    found = rows.groupBy(F.lit(0).alias("_one")).applyInArrow(run, "at binary, weight binary, bias double").collect()
    return Weights(np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]) if found else None


def toxicity(docs: DataFrame, weights: Weights | None, text: str = "text", column: str = "toxicity") -> DataFrame:
    """docs with a column of the probability, 0 to 1, that the text is toxic; higher: likelier.

    Null and empty texts have the model's bias alone; where no model could be learned, all are 0.
    A text of more than 1 MiB is a chunk of its own and read whole. Repeated rows score alike;
    a column of docs named like the new one is replaced.
    """
    base = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            w = shared.value
            dense = w.dense() if w else None
            for batch in batches:
                scores = []
                data, offsets = tx.string_bytes(batch.column(text))
                for row, last, part, offs in tx.chunks(data, offsets):
                    if w:
                        at, first = features(part, offs)
                        sums = np.concatenate([[0], np.cumsum(dense[at], dtype=np.float64)])
                        scores.append(1 / (1 + np.exp(-np.clip(w.bias + sums[first[1:]] - sums[first[:-1]], -35, 35))))
                    else:
                        scores.append(np.zeros(last - row))
                names = [n for n in batch.schema.names if n != column]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, column])

    return base.mapInArrow(run, plus(base, column, "double"))


def op8_ftrl(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 3) != 1)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    scored = toxicity(docs, train(docs, labels, "doc_id", "text", "toxic"), column="score")
    return scored.select("doc_id", held, "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
