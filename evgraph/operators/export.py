"""Diagrams as documents: containers and components, lanes, and a page with a drawing."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from .diagrams import icon, lane


def containers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """analysis_id and a JSON document: containers by category with their components, and relations by slug."""
    part = F.struct(slug(F.col("id")).alias("id"), "name", lane(F.concat_ws(" ", "name", "category")).alias("lane"))
    grouped = nodes.groupBy("analysis_id", "category").agg(F.array_sort(F.collect_list(part)).alias("components"))
    boxes = grouped.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("container"), "components"))).alias("containers"))
    line = F.struct(slug(F.col("source_id")).alias("source"), slug(F.col("target_id")).alias("target"), "label", "state")
    lines = edges.groupBy("analysis_id").agg(F.array_sort(F.collect_list(line)).alias("relations"))
    return boxes.join(lines, "analysis_id", "left").select("analysis_id", F.to_json(F.struct("containers", "relations")).alias("document"))


def lanes(nodes: DataFrame) -> DataFrame:
    """analysis_id, id, name, lane and icon of each node."""
    shown = lane(F.concat_ws(" ", "name", "category"))
    return nodes.select("analysis_id", slug(F.col("id")).alias("id"), "name", shown.alias("lane"), icon(shown).alias("icon"))


def page(nodes: DataFrame, edges: DataFrame, title: str, most: int = 500) -> str:
    """A standalone page that draws at most so many nodes of one analysis, by tier and rank."""
    shown = nodes.orderBy("tier", "rank", "id").limit(most).collect()
    place = {n["id"]: (40 + 220 * i, 40 + 90 * n["tier"]) for n in shown for i in [sum(m["tier"] == n["tier"] and m["rank"] < n["rank"] for m in shown)]}
    kept = edges.where(F.col("source_id").isin(list(place)) & F.col("target_id").isin(list(place))).orderBy("source_id", "target_id", "label").limit(4 * most).collect() if place else []
    lines = "".join('<line x1="{}" y1="{}" x2="{}" y2="{}" stroke="#888"/>'.format(*(v + o for end in ("source_id", "target_id") for v, o in zip(place[e[end]], (90, 20), strict=True))) for e in kept)
    boxes = "".join(f'<g><rect x="{x}" y="{y}" width="180" height="40" rx="6" fill="#fff" stroke="#333"/><text x="{x + 10}" y="{y + 25}">{escape(n["name"])}</text></g>' for n in shown for x, y in [place[n["id"]]])
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><svg xmlns="http://www.w3.org/2000/svg" width="1600" height="900">{lines}{boxes}</svg></body></html>'
