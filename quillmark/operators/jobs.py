"""Postings: requirements, their class and importance, risks, and relevance ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values: (category, importance, pattern), the first that fits; and what fits none.
REQUIREMENT_CLASSES = [
    ("nice_to_have", 0.45, "优先|加分|preferred|nice to have|bonus"),
    ("must_have", 1.0, r"必须|任职要求|本科|硕士|\d+\s*年|required|must|degree|years? of"),
    ("responsibility", 0.8, "负责|职责|工作内容|you will|responsibilit|duties"),
    ("constraint", 0.8, "地点|出差|薪资|到岗|location|travel|salary|on[- ]site|remote"),
]
OTHER_CLASS = ("skill", 0.65)
#: (code, severity, pattern) of risks.
RISKS = [
    ("UPFRONT_FEE", "high", "培训费|押金|保证金|先交费|registration fee|deposit"),
    ("DISCRIMINATORY", "high", r"仅限男性|仅限女性|已婚已育|年龄[：:]?\s*\d|male only|female only|marital status"),
    ("UNPAID_TRIAL", "medium", "无薪试岗|免费试岗|unpaid trial"),
    ("VAGUE_COMPENSATION", "low", "薪资面议|上不封顶|高额回报|competitive salary"),
    ("CONTACT_OFF_PLATFORM", "medium", "私人微信|个人账户|telegram|whatsapp"),
]
BULLETS = "[•·●▪]"
MOST_REQUIREMENTS, MOST_KEYWORDS = 30, 12
# ---------------------------------------------------------------------------------------


def category(line: Column) -> Column:
    out = F.lit(OTHER_CLASS[0])
    for name, _, pattern in reversed(REQUIREMENT_CLASSES):
        out = F.when(line.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def importance(of: Column) -> Column:
    out = F.lit(OTHER_CLASS[1])
    for name, weight, _ in REQUIREMENT_CLASSES:
        out = F.when(of == name, weight).otherwise(out)
    return out


def requirements(postings: DataFrame) -> DataFrame:
    """The requirements of (id, text): the lines after the title, classified, with their first keywords.

    The title is the first line of at most 60 characters. The limits of 30 lines
    and 12 keywords are part of the operator.
    """
    lines = T.statements(F.regexp_replace(T.unwrapped(F.col("text")), BULLETS, "\n"))
    rows = postings.select("id", lines.alias("lines"))
    rows = rows.withColumn("title", F.coalesce(F.get(F.filter("lines", lambda x: F.length(x) <= 60), F.lit(0)), F.lit("Target role")))
    kept = F.slice(F.filter("lines", lambda x: (x != F.col("title")) & (F.length(x) >= 6)), 1, MOST_REQUIREMENTS)
    rows = rows.select("id", "title", F.posexplode(kept).alias("pos", "line")).withColumn("category", category(F.col("line")))
    return rows.withColumn("importance", importance(F.col("category"))).withColumn("keywords", F.slice(T.keywords(F.col("line")), 1, MOST_KEYWORDS))


def risks(postings: DataFrame) -> DataFrame:
    """(id, code, severity, excerpt) of every risk pattern that a text meets, by its first match."""
    found = [F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.regexp_extract("text", f"(?i){pattern}", 0).alias("m")) for code, severity, pattern in RISKS]
    rows = postings.select("id", F.inline(F.array(*found))).where("m <> ''")
    return rows.select("id", "code", "severity", T.excerpt(F.col("m"), 80).alias("excerpt"))


def relevance(shared: Column, importance: Column, status: Column) -> Column:
    """What a requirement adds to a text's relevance; gaps and conflicts add nothing, partial matches 0.6."""
    part = F.when(status == "met", 1.0).when(status == "partial", 0.6).otherwise(0.0)
    return importance * part * shared
