"""Walks whose order decides the result, one ontology or enum a group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _children(edges: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for parent, child in zip(edges["parent"], edges["child"], strict=True):
        out.setdefault(parent, []).append(child)
    return out


def depth_first(edges: DataFrame) -> DataFrame:
    """(grp, code, parent, position, depth) from (grp, child, parent): children after their parent, roots and siblings sorted.

    A node with several parents belongs to the first that is visited; nodes of cycles without a root come last, as roots.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = sorted(set(rows["child"]) | set(rows["parent"].dropna()))
        kids = _children(rows.dropna(subset=["parent"]).sort_values("child"))
        below = set(rows.loc[rows["parent"].notna(), "child"])
        seen: dict[str, tuple] = {}
        for root in [c for c in known if c not in below] + [c for c in known if c in below]:
            stack = [(root, None, 0)]
            while stack:
                code, parent, depth = stack.pop()
                if code in seen:
                    continue
                seen[code] = (parent, len(seen), depth)
                stack += [(k, code, depth + 1) for k in reversed(kids.get(code, [])) if k not in seen]
        return pd.DataFrame([(rows["grp"].iloc[0], c, *v) for c, v in seen.items()], columns=["grp", "code", "parent", "position", "depth"])

    return edges.select("grp", "child", "parent").groupBy("grp").applyInPandas(run, "grp string, code string, parent string, position int, depth int")


def subtree_filter(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, code, is_a) of the kept nodes. nodes: (grp, code, mark), mark `minus`, `include` or null; edges: (grp, child, parent).

    A mark holds for all below until another one; a node with several parents is visited first by the first in order; the
    parent of a kept node is the nearest kept one above on the way by which it was visited.
    """

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        marks = dict(zip(n["code"], n["mark"], strict=True))
        kids = _children(e.sort_values(["parent", "child"]))
        below = set(e["child"])
        seen: set[str] = set()
        out = []
        for root in sorted(c for c in marks if c not in below):
            stack = [(root, None, True)]
            while stack:
                code, above, keep = stack.pop()
                if code in seen or code not in marks:
                    continue
                seen.add(code)
                keep = {"minus": False, "include": True}.get(marks[code], keep)
                if keep:
                    out.append((n["grp"].iloc[0], code, above))
                stack += [(k, code if keep else above, keep) for k in reversed(kids.get(code, []))]
        return pd.DataFrame(out, columns=["grp", "code", "is_a"])

    return nodes.groupBy("grp").cogroup(edges.groupBy("grp")).applyInPandas(run, "grp string, code string, is_a string")
