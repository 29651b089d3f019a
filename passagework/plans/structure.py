"""Typeset lines to blocks: tables masked, reading order, heading levels, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.structure import heading_levels, merge_paragraphs, outside_tables, reading_order
from passagework.session import cut


def structure_lines(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of every document in reading order."""
    ordered = cut(reading_order(outside_tables(lines, tables), tables))
    prose = ordered.filter("kind = 'line'").drop("kind")
    levelled = cut(heading_levels(prose))
    blocks = merge_paragraphs(levelled)
    ruled = ordered.filter("kind = 'table'").select(
        "document_id", "order", "page", "text", "x0", "y0", "x1", "y1", F.lit("table").alias("type"), F.lit("text").alias("source"))
    return blocks.unionByName(ruled, allowMissingColumns=True)
