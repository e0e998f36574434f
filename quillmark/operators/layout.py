"""Template recommendation: a score for each template by density, pages and preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Template, units a page, and base scores for dense, light and balanced content.
TEMPLATES = [("professional", 2500, 80, 86, 94), ("minimal", 2200, 68, 94, 86), ("compact", 3300, 94, 72, 82)]
DENSE, LIGHT, PAGE_PENALTY, PREFERENCE = 2500, 1100, 12, 4


def density(units: Column) -> Column:
    return F.when(units > DENSE, "dense").when(units < LIGHT, "light").otherwise("balanced")


def ranked(docs: DataFrame, target_pages: int) -> DataFrame:
    """Rows (id, density, template, estimated_pages, score, rank) of (id, units, preferred).

    The templates are an array exploded in place: three rows a document, no join.
    """
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("template"), F.lit(c).alias("capacity"), F.lit(a).alias("dense"), F.lit(b).alias("light"), F.lit(m).alias("balanced")) for i, (n, c, a, b, m) in enumerate(TEMPLATES)]))
    rows = docs.select("id", "units", "preferred", density(F.col("units")).alias("density"), each)
    pages = F.greatest(F.lit(1), F.ceil(F.col("units") / F.col("capacity"))).cast("int")
    base = F.when(F.col("density") == "dense", F.col("dense")).when(F.col("density") == "light", F.col("light")).otherwise(F.col("balanced"))
    liked = F.when(F.col("preferred") == F.col("template"), PREFERENCE).otherwise(0)
    rows = rows.withColumn("estimated_pages", pages).withColumn("score", T.clamp(base - F.abs(F.col("estimated_pages") - target_pages) * PAGE_PENALTY + liked, 0, 100))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "ord")
    return rows.select("id", "density", "template", "estimated_pages", "score", F.row_number().over(order).alias("rank"))


def sql(rows: str, target_pages: int = 1) -> str:
    values = ", ".join(f"({i}, '{n}', {c}, {a}, {b}, {m})" for i, (n, c, a, b, m) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT *, CASE WHEN units > {DENSE} THEN 'dense' WHEN units < {LIGHT} THEN 'light' ELSE 'balanced' END AS density FROM ({rows})),
r AS (SELECT d.*, t.*, greatest(1, ceil(units / t.capacity))::INTEGER AS estimated_pages
  FROM d, (VALUES {values}) t(ord, template, capacity, dense, light, balanced)),
s AS (SELECT *, greatest(0, least(100, CASE density WHEN 'dense' THEN dense WHEN 'light' THEN light ELSE balanced END - abs(estimated_pages - {target_pages}) * {PAGE_PENALTY} + CASE WHEN preferred = template THEN {PREFERENCE} ELSE 0 END)) AS score FROM r)
SELECT id, density, template, estimated_pages, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord)::INTEGER AS rank FROM s
"""
