"""Writers of merged results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_by_source(rows: DataFrame, path: str) -> None:
    """Parquet partitioned by source_key; only the partitions of sources that rows has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)


def sssom_lines(mappings: DataFrame) -> DataFrame:
    """(subject_id, object_id, line) of mapping rows, tab-separated, to be written in the order of subject and object."""
    cols = ["subject_id", "predicate_id", "object_id", "mapping_justification", "subject_label", "object_label"]
    return mappings.select("subject_id", "object_id", F.concat_ws("\t", *(F.coalesce(F.col(c), F.lit("")) if c in mappings.columns else F.lit("") for c in cols)).alias("line"))


def picklists(enums: DataFrame, pvs: DataFrame) -> DataFrame:
    """(enum_key, json): each enum with its values in order, as one JSON text."""
    rows = pvs.groupBy("enum_key").agg(F.sort_array(F.collect_list(F.struct("ord", "code", "title"))).alias("rows"))
    values = F.transform("rows", lambda r: F.struct(r["code"].alias("code"), r["title"].alias("title")))
    return enums.join(rows, "enum_key", "left").select("enum_key", F.to_json(F.struct(F.col("enum_key").alias("name"), values.alias("rows"))).alias("json"))


def markdown(matches: DataFrame) -> DataFrame:
    """(qid, rank, line) of a search report."""
    from ..functions.text import cell, truncated

    return matches.select("qid", "rank", F.concat(F.lit("| "), cell(F.col("id")), F.lit(" | "), cell(truncated(F.col("label"))), F.lit(" | "), F.format_number("score", 2), F.lit(" |")).alias("line"))


def diagram(sections: DataFrame, centre: str, fields: int = 5) -> DataFrame:
    """(url, xml): a draw.io page for each registry (url, ord, section, names): its sections with their first fields, on a circle around a centre."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    label = F.concat(F.lit("<b>"), F.trim(F.regexp_replace("section", r"\s*\([^)]*\)", "")), F.lit("</b>"), F.array_join(F.transform(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, fields), lambda x: F.concat(F.lit("<br/>"), x)), ""))
    listed = sections.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("ord", label.alias("label")))).alias("s"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def box(s, i):
        turn = F.lit(2) * F.pi() * i / F.size("s") - F.pi() / 2
        x, y = F.floor(F.lit(717) + F.lit(400) * F.cos(turn)), F.floor(F.lit(519) + F.lit(400) * F.sin(turn))
        return text(
            '<mxCell id="s', i, '" value="', escaped(s["label"]), '" style="rounded=1;whiteSpace=wrap;html=1;" parent="1" vertex="1"><mxGeometry x="', x, '" y="', y, '" width="220" height="130" as="geometry"/></mxCell>',
            '<mxCell id="e', i, '" parent="1" source="c" target="s', i, '" edge="1"><mxGeometry relative="1" as="geometry"/></mxCell>',
        )

    cells = F.array_join(F.transform("s", box), "")
    middle = text('<mxCell id="c" value="', escaped(F.lit(centre)), '" style="ellipse;whiteSpace=wrap;html=1;" parent="1" vertex="1"><mxGeometry x="730" y="529" width="193" height="110" as="geometry"/></mxCell>')
    return listed.select("url", text('<mxGraphModel><root><mxCell id="0"/><mxCell id="1" parent="0"/>', cells, middle, "</root></mxGraphModel>").alias("xml"))
