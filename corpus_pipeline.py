"""The corpus pipeline: five stages, each one operator applied to all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossweave.llm.blocks import checkpoint_dir
from glossweave.llm.decontaminate import contamination, is_contaminated
from glossweave.llm.jaccard import near_duplicates
from glossweave.llm.langid import UNDETERMINED, predicted
from glossweave.llm.mixing import mix
from glossweave.llm.suffix_dedup import cut_repeats


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter have no language and go; those with letters stay where no labelled row teaches a language."""
    found = _free(docs, "_language")
    return predicted(docs, column=found).filter((F.col(found)["lang"] != UNDETERMINED) | F.col("text").rlike(r"\p{L}")).select(*_columns(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Rows that share an id are one document."""
    gone = near_duplicates(docs).filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice or more are cut out of the texts; characters that a cut divides go whole."""
    column = _free(docs, "_cut")
    cut = cut_repeats(docs, column=column)
    kept = F.col(column)["kept"].cast("string")
    whole = F.when(F.is_valid_utf8(kept), kept).otherwise(F.regexp_replace(F.make_valid_utf8(kept), "�", ""))
    rows = cut.withColumn("text", whole).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items cover a twentieth of the words or more go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    column = _free(docs, "_contamination")
    hit = F.col(column)
    return contamination(docs, benchmark, column=column).filter(~is_contaminated(hit["n_words"], hit["n_hit"])).select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("repeated_strings", repeated_strings), ("decontamination", decontaminated), ("mixture", mixed)]

#: The stages aren't expressible in SQL; tests hold the pipeline against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; only the last one's input stays there."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what this stage has read
            files.delete(path(before), True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
