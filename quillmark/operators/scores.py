"""Rule scores: capped dimensions and penalty audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"


def dimensions(docs: DataFrame) -> DataFrame:
    """The six dimensions of (doc_id, text, quality) and their rounded total."""
    s = F.col("s")
    facts = docs.withColumn("s", T.statements(F.col("text"))).select(
        "doc_id", "quality", F.size(s).alias("bullets"), F.size(F.filter(s, lambda x: F.size(T.numbers(x)) > 0)).alias("metric"),
        F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"), F.size(F.filter(s, lambda x: x.rlike("[。.]$"))).alias("stopped"),
        F.size(F.filter(F.split("text", "\n"), lambda p: F.length(F.trim(p)) > 0)).alias("sections"), F.col("text").rlike(CONTACT).alias("contact"),
    )
    bullets, metric, sections, quality = (F.col(c) for c in ("bullets", "metric", "sections", "quality"))

    def when(cond: Column, points: int) -> Column:
        return F.when(cond, points).otherwise(0)

    parts = {
        "impact": F.least(F.lit(25.0), 8 + F.least(F.lit(9.0), metric * 2.25) + F.least(F.lit(8), metric)),
        "completeness": F.least(F.lit(15), 6 + when(F.col("contact"), 2) + when(sections >= 1, 3) + when(sections >= 2, 2) + when(sections >= 3, 2)),
        "clarity": 9 + when(bullets > 0, 3) + when((F.col("chars") > 0) & (F.col("chars") <= 120 * bullets), 3),
        "structure": F.least(F.lit(15), 7 + F.least(F.lit(5), sections) + when(bullets > 0, 3)),
        "ats": 15 - when(quality == 0, 6) - when(quality.isNull(), 2),
        "language": 12 + when(bullets > 0, 2) - when((F.col("stopped") > 0) & (F.col("stopped") < bullets), 2),
    }
    rows = facts.select("doc_id", *[v.cast("double").alias(k) for k, v in parts.items()])
    return rows.withColumn("total", T.half_up(sum((F.col(k) for k in parts), F.lit(0.0)), 1))


def findings(rules: Sequence[tuple[Column, str, str]]) -> Column:
    """Array of (code, severity) of the rules (condition, code, severity) that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for cond, code, severity in rules]))


def penalised(found: Column, error: int, warning: int, note: int = 0) -> Column:
    """100 less the penalties of the findings, not below 0."""
    def cost(f: Column) -> Column:
        return F.when(f["severity"] == "error", error).when(f["severity"] == "warning", warning).otherwise(note)

    return F.greatest(F.lit(0), 100 - F.aggregate(found, F.lit(0), lambda a, f: a + cost(f)))


def parse_audit(docs: DataFrame) -> DataFrame:
    """(doc_id, findings, score, passed) of (doc_id, text, quality)."""
    rules = [
        (~F.col("text").rlike(CONTACT), "CONTACT_MISSING", "error"), (F.col("text").contains("|"), "TABLE_LAYOUT", "warning"),
        (F.col("quality") == 0, "LOW_CONFIDENCE_TEXT", "warning"), (F.trim("text") == "", "NO_SECTIONS", "error"),
    ]
    rows = docs.select("doc_id", findings(rules).alias("f"))
    codes = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform("f", lambda x: x["code"])), ", "), F.lit("]"))
    return rows.select("doc_id", codes.alias("findings"), penalised(F.col("f"), 25, 10, 2).alias("score"), (~F.exists("f", lambda x: x["severity"] == "error")).alias("passed"))
