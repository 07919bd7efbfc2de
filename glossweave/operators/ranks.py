"""Ranks among siblings, scales, labels and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_NUMBERED = r"^([A-Za-z]*[._-]?)([0-9]+)(?:\s|$)"


def sibling_ranks(pvs: DataFrame) -> DataFrame:
    """rank: the number that a title begins with, where a group's numbers with one prefix are 0 or 1 and on, without gaps or repeats."""
    numbered = pvs.withColumn("_prefix", F.regexp_extract("title", _NUMBERED, 1)).withColumn("_n", F.when(F.regexp_extract("title", _NUMBERED, 2) != "", F.regexp_extract("title", _NUMBERED, 2).cast("int")))
    w = Window.partitionBy("grp", "_prefix")
    stats = numbered.withColumn("_c", F.count("_n").over(w)).withColumn("_lo", F.min("_n").over(w)).withColumn("_hi", F.max("_n").over(w))
    # numbers without repeats: as many as the span has, each once
    unique = F.size(F.collect_set("_n").over(w))
    ok = (F.col("_c") >= 2) & F.col("_lo").isin(0, 1) & (F.col("_hi") - F.col("_lo") + 1 == F.col("_c")) & (unique == F.col("_c"))
    return stats.withColumn("rank", F.when(ok & F.col("_n").isNotNull(), F.col("_n"))).drop("_prefix", "_n", "_c", "_lo", "_hi")


def ranked_order(pvs: DataFrame) -> DataFrame:
    """position: groups as first seen, in each ranked values by rank and code, then the others in their order."""
    first = F.min("ord").over(Window.partitionBy("enum_key", "grp"))
    w = Window.partitionBy("enum_key").orderBy("_first", F.col("rank").isNull(), "rank", F.when(F.col("rank").isNotNull(), F.col("code")), "ord")
    return pvs.withColumn("_first", first).withColumn("position", F.row_number().over(w)).drop("_first")


def gap_fill(scale: DataFrame, span: int = 20) -> DataFrame:
    """Missing whole steps of scales (grp, code): those of two values or more that span at most 20."""
    ends = scale.groupBy("grp").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.countDistinct("code").alias("n")).filter(F.expr(f"n >= 2 AND hi - lo <= {span}"))
    steps = ends.select("grp", F.explode(F.sequence("lo", "hi")).alias("code"))
    return steps.join(scale.select("grp", "code").distinct().withColumn("_known", F.lit(True)), ["grp", "code"], "left").select("grp", "code", F.col("_known").isNull().alias("is_intermediate"))


def between_labels(rows: DataFrame) -> DataFrame:
    """Rows without a title get `between A and B` of their neighbours that have one."""
    w = Window.partitionBy("grp").orderBy("code")
    before = F.last("title", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("title", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("label", F.coalesce("title", F.concat(F.lit("between "), before, F.lit(" and "), after)))


def best_labels(labels: DataFrame) -> DataFrame:
    """Of each (id, lang) the preferred label, else the first."""
    w = Window.partitionBy("id", "lang").orderBy(F.desc("preferred"), "ord")
    return labels.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dominant_type(rows: DataFrame) -> DataFrame:
    """Of the types of each entity (id, type) the one that is most frequent overall, the first by name among equals."""
    freq = rows.groupBy("type").agg(F.count("*").alias("_f"))
    w = Window.partitionBy("id").orderBy(F.desc("_f"), "type")
    return rows.select("id", "type").distinct().join(freq, "type").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "type")


def type_groups(rows: DataFrame) -> DataFrame:
    """(grp, type, n, header): types with two members or more are headed, if a group has two such types."""
    n = rows.groupBy("grp", "type").agg(F.count("*").alias("n"))
    heads = F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).over(Window.partitionBy("grp"))
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "type")
    return n.withColumn("header", (F.col("n") >= 2) & (heads >= 2)).withColumn("position", F.row_number().over(order))


def collapsed(rows: DataFrame, ranking: list[str]) -> DataFrame:
    """One row per entity: best-ranked type, a flag that any row sets, first value, all parents in order."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranking)), F.col("type")), F.lit(0)), F.lit(len(ranking) + 1))
    return rows.groupBy("id").agg(
        F.min_by("type", F.struct(rank, "ord")).alias("type"),
        F.bool_or("flag").alias("flag"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value"),
        F.array_join(F.sort_array(F.collect_set("parent")), ",").alias("parents"),
    )


def shared_tails(rows: DataFrame, pattern: str) -> DataFrame:
    """Tails of descriptions that two values of an enum or more share; they move to the enum."""
    tail = F.regexp_extract("description", pattern, 0)
    return rows.withColumn("tail", tail).filter("tail != ''").groupBy("enum_key", "tail").agg(F.count("*").alias("n")).filter("n >= 2")


def percent(part, whole):
    """Whole percent, 0 of nothing."""
    return F.when(whole > 0, F.floor(F.lit(100) * part / whole)).otherwise(F.lit(0)).cast("long")


def titles(rows: DataFrame) -> DataFrame:
    """`A, B, or C of enum` from the types of each enum."""
    each = rows.groupBy("enum_key").agg(F.sort_array(F.collect_set("type")).alias("ts"))
    n = F.size("ts")
    many = F.concat(F.array_join(F.slice("ts", 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", or "), F.element_at("ts", -1))
    listed = F.when(n == 1, F.element_at("ts", 1)).when(n == 2, F.array_join("ts", " or ")).otherwise(many)
    return each.select("enum_key", F.concat(listed, F.lit(" of "), "enum_key").alias("title"))


def first_members(rows: DataFrame, k: int) -> DataFrame:
    """(subject, n, first): how many members (subject, id) each subject has, and its first k in order, all that is ever gathered of it."""
    w = Window.partitionBy("subject").orderBy("id")
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).groupBy("subject").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"].cast("string")), ",").alias("first"))
    return rows.groupBy("subject").agg(F.count("*").alias("n")).join(first, "subject").select("subject", "n", "first")
