"""Calls to models and translators from within a plan, by batches; without a provider they give nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A provider takes the texts of a batch and returns as many answers, null where it has none.
Provider = Callable[[list[str]], list[str | None]]


def silent(texts: list[str]) -> list[str | None]:
    """The provider for sessions without one."""
    return [None] * len(texts)


def asked(rows: DataFrame, column: str, answer: str, provider: Provider = silent, size: int = 50) -> DataFrame:
    """rows with a column of the provider's answers to the texts of a column; nulls aren't asked about."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(answer, StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            known = frame.index[frame[column].notna()]
            for i in range(0, len(known), size):
                part = known[i : i + size]
                told = provider(frame.loc[part, column].tolist())
                if len(told) != len(part):
                    raise ValueError(f"{len(part)} texts asked about, {len(told)} answers")
                out.loc[part] = told
            yield frame.assign(**{answer: out})

    return rows.mapInPandas(run, schema)
