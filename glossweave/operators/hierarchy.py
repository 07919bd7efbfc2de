"""Parents, ancestors and subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.stages import kept


def children(pvs: DataFrame) -> DataFrame:
    """(enum_key, code, n, children): how many values have each value as their parent, and which, in order."""
    kids = pvs.filter("is_a IS NOT NULL").groupBy("enum_key", "is_a")
    kids = kids.agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]), ",").alias("children"))
    return kids.withColumnRenamed("is_a", "code")


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(code, ancestor, distance) over edges (code, parent) with at most one parent each, safe in cycles.

    Distances double each round, so the rounds grow with the logarithm of the depth.
    """
    known = kept(edges.filter("parent IS NOT NULL").select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    for _ in range(rounds):
        far = known.filter(F.col("distance") == reach).alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.code"))
        more = far.select(F.col("a.code").alias("code"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        more = more.filter("code != ancestor").join(known.select("code", "ancestor"), ["code", "ancestor"], "left_anti")
        more = more.groupBy("code", "ancestor").agg(F.min("distance").alias("distance"))
        grown = kept(known.unionByName(more))
        if grown.count() == known.count():
            break
        known, reach = grown, reach * 2
    return known


def surviving_parent(tree: DataFrame) -> DataFrame:
    """tree (code, is_a, dropped) without dropped rows, is_a the nearest ancestor that isn't dropped."""
    up = closure(tree.select("code", F.col("is_a").alias("parent")))
    alive = tree.filter(~F.col("dropped")).select(F.col("code").alias("ancestor"))
    nearest = up.join(alive, "ancestor").groupBy("code").agg(F.min_by("ancestor", "distance").alias("is_a"))
    return tree.filter(~F.col("dropped")).select("code").join(nearest, "code", "left")


def parent_by_level_stack(rows: DataFrame) -> DataFrame:
    """Parent: the nearest row before with a lower level, if that is one level up. Rows: (grp, ord, level, code), any level.

    One pass over a group's sorted rows keeps a stack of levels that rise from bottom to top. Rows without a level have no
    parent and are none.
    """
    base = rows.drop("is_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            parents = []
            for grp, level, code in zip(*(batch.column(c).to_pylist() for c in ("grp", "level", "code")), strict=True):
                if grp != group:
                    group, stack = grp, []
                if level is None:
                    parents.append(None)
                    continue
                while stack and stack[-1][0] >= level:
                    stack.pop()
                parents.append(stack[-1][1] if stack and stack[-1][0] == level - 1 else None)
                stack.append((level, code))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.schema.field("code").type)], [*batch.schema.names, "is_a"])

    dealt = base.repartition("grp").sortWithinPartitions("grp", "ord")
    return dealt.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("is_a", base.schema["code"].dataType)]))


def parent_by_level_scan(rows: DataFrame) -> DataFrame:
    """Parent: the nearest row before that is one level up, however far back; any level.

    Each row is the parent of the level below and a child of its own, so a window over the level that both meet in finds it.
    """
    base = rows.drop("is_a")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("child"), F.col("level").alias("meet")), F.struct(F.lit(False).alias("child"), (F.col("level") + 1).alias("meet"))))
    both = base.withColumn("_s", sides)
    w = Window.partitionBy("grp", "_s.meet").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(~F.col("_s.child"), F.col("code")), ignorenulls=True).over(w)
    return both.withColumn("is_a", found).filter("_s.child").drop("_s")


def dotted_parent(pvs: DataFrame) -> DataFrame:
    """XX.Y belongs to XX.0, longer codes to theirs without the last part, where these exist."""
    parts = F.size(F.split("code", r"\."))
    shorter = F.when(parts == 2, F.concat(F.substring_index("code", ".", 1), F.lit(".0"))).when(parts > 2, F.regexp_replace("code", r"\.[^.]*$", ""))
    known = pvs.select(F.col("code").alias("_known")).distinct()
    return pvs.withColumn("_want", shorter).join(known, (F.col("_want") == F.col("_known")) & (F.col("_want") != F.col("code")), "left").withColumn("is_a", F.col("_known")).drop("_want", "_known")


def expand(nodes: DataFrame, edges: DataFrame, root: str, include_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of a graph but for the root and its direct parents, and the edges between the nodes that are left."""
    parents = edges.filter(F.col("source") == root).select(F.col("target").alias("iri"))
    out = nodes.join(parents, "iri", "left_anti")
    out = out if include_self else out.filter(F.col("iri") != root)
    ids = out.select("iri")
    left = edges.join(ids.withColumnRenamed("iri", "source"), "source", "left_semi").join(ids.withColumnRenamed("iri", "target"), "target", "left_semi")
    return out, left


def last_parent(edges: DataFrame) -> DataFrame:
    """(code, is_a): of several parents the last."""
    return edges.groupBy(F.col("source").alias("code")).agg(F.max_by("target", "ord").alias("is_a"))


def interval_parent(ranges: DataFrame) -> DataFrame:
    """Parent: the nearest interval before, by (start, -end), that holds this one. Rows: (grp, start, stop, code).

    One pass over a group's sorted rows keeps a stack of intervals that can still hold later ones: their ends fall from
    bottom to top, so there are never more than the group has distinct ends. Intervals without a start or an end hold nothing.
    """
    base = ranges.drop("is_a")
    code = base.schema["code"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            parents = []
            for grp, start, stop, name in zip(*(batch.column(c).to_pylist() for c in ("grp", "start", "stop", "code")), strict=True):
                if grp != group:
                    group, stack = grp, []
                if start is None or stop is None:
                    parents.append(None)
                    continue
                while stack and stack[-1][0] < stop:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                if stack and stack[-1][0] == stop:
                    stack.pop()  # this one is nearer and ends at the same place
                stack.append((stop, name))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.schema.field("code").type)], [*batch.schema.names, "is_a"])

    dealt = base.repartition("grp").sortWithinPartitions("grp", "start", F.desc("stop"), "code")
    return dealt.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("is_a", code)]))
