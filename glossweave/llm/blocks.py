"""Documents dealt in blocks, and questions that the blocks put to the whole corpus.

A block is a bounded set of documents, chosen by a hash of their ids. A step over blocks sends each *bucket* (a range of
64-bit hashes) one packed row of the distinct keys that it asks about; the bucket answers each block with one packed row,
entry by entry. So a key that a third of all documents have is one entry per block, not one row per document, and the
tasks that answer hold bounded arrays.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Buckets for each block: what a bucket gathers is a fraction of a block.
BUCKETS = 4
BLOCK = "_block"


def plus(df: DataFrame, name: str, ddl: str) -> T.StructType:
    """The schema of df with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(ddl))])


def text_bytes(docs: DataFrame, text: str) -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def block_count(docs: DataFrame, text: str) -> int:
    return max(1, math.ceil(text_bytes(docs, text) / BLOCK_BYTES))


def blocked(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """docs with the block of each row, which depends on its id and text alone."""
    return docs.withColumn(BLOCK, F.pmod(F.xxhash64(F.col(key), F.length(F.col(text))), F.lit(n)).cast("int"))


def edges(n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit hashes begins."""
    return np.array([-(-(b << 64) // n) for b in range(n)], np.uint64)


def slices(hashes: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of each bucket that has some of the sorted hashes."""
    cuts = np.append(np.searchsorted(hashes, edges(n)), len(hashes))
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    return list(zip(full.tolist(), cuts[full].tolist(), cuts[full + 1].tolist(), strict=True))


def checkpoint_dir(spark) -> str:
    """The shared folder of the session. Where none is set, local sessions (as in tests) have one of their own; a cluster must name one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint()


