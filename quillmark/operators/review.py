"""Copy review: conservative rewriting, consistency, suggestion selection, apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values: (Java pattern, RE2 pattern, replacement, message), in order. --------------
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
REWRITES = {
    "en": [
        (rf"(?i){_L}in order to{_R}", r"(?i)\bin order to\b", "to", "Shortened 'in order to'"),
        (rf"(?i){_L}successfully[{T.SPACE}]+", rf"(?i)\bsuccessfully[{T.SPACE}]+", "", "Removed an unsupported intensifier"),
        (rf"(?i){_L}was responsible for{_R}", r"(?i)\bwas responsible for\b", "Responsible for", "Removed unnecessary passive phrasing"),
        (rf"[{T.SPACE}]+,", rf"[{T.SPACE}]+,", ",", "Normalized comma spacing"),
    ],
    "zh": [
        ("主要负责", "主要负责", "负责", "删除弱化表达“主要”"),
        ("成功地", "成功地", "", "删除无法增加事实信息的副词"),
        (r"在([\p{IsHan}A-Za-z0-9+#.]+)方面", r"在([\p{Han}A-Za-z0-9+#.]+)方面", "$1", "压缩“在…方面”结构"),
        (rf"[{T.SPACE}]*，[{T.SPACE}]*", rf"[{T.SPACE}]*，[{T.SPACE}]*", "，", "统一中文逗号空格"),
    ],
}
SUPERLATIVE = "(?i)行业领先|世界级|顶尖|第一|best[- ]in[- ]class|world[- ]class|industry[- ]leading"
KEPT_NOTE = "为保护指定术语，已保留原文。"
MOST_SUGGESTIONS = 8
# -----------------------------------------------------------------------------------------


def rewritten(rows: DataFrame, text: str, language: str) -> DataFrame:
    """``rows`` with ``rewritten`` and ``changes``: the messages of the rules that met something."""
    rows = rows.withColumn("rewritten", T.normalize(F.col(text))).withColumn("changes", F.array().cast("array<string>"))
    for pattern, _, by, message in REWRITES[language]:
        met = F.col("rewritten").rlike(pattern)
        rows = rows.withColumn("changes", F.when(met, F.array_append("changes", F.lit(message))).otherwise(F.col("changes")))
        rows = rows.withColumn("rewritten", F.regexp_replace("rewritten", pattern, by))
    return rows.withColumn("rewritten", T.normalize(F.col("rewritten")))


def preserving(rows: DataFrame, text: str, terms: str) -> DataFrame:
    """Rewritten rows, put back to the original where one of the array ``terms`` got lost."""
    lost = F.exists(terms, lambda t: ~F.contains(F.col("rewritten"), t))
    return rows.withColumn("changes", F.when(lost, F.array(F.lit(KEPT_NOTE))).otherwise(F.col("changes"))).withColumn("rewritten", F.when(lost, T.normalize(F.col(text))).otherwise(F.col("rewritten")))


def terminal_issues(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Rows whose closing punctuation differs from that of at least half of their group, with a fixed text."""
    ends = F.col("normal").rlike("[。.!]$")
    rows = rows.withColumn("normal", T.normalize(F.col(text))).withColumn("ends", ends)
    rows = rows.withColumn("most", F.avg(F.col("ends").cast("int")).over(Window.partitionBy(group)) >= 0.5)
    bare = F.regexp_replace("normal", "[。.!]$", "")
    fixed = F.when(F.col("most"), F.concat(bare, F.lit("."))).otherwise(bare)
    return rows.where((F.col("normal") != "") & (F.col("ends") != F.col("most"))).withColumn("suggested", fixed).drop("normal", "ends", "most")


def selected(candidates: DataFrame, group: str) -> DataFrame:
    """Up to eight suggestions of a group, those that need proof first, none with a path, rationale or question seen before.

    The three keys interact, so this is one ordered fold over a group's suggestions
    and not three de-duplications; groups are as small as a document's suggestions.
    """
    first = F.struct(F.when(F.col("kind") == "needs_proof", 0).otherwise(1).alias("priority"), F.col("pos").alias("pos"), "path", "rationale", "question", "kind")
    rows = candidates.groupBy(group).agg(F.array_sort(F.collect_list(first)).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        seen = F.exists(kept, lambda k: (k["path"] == x["path"]) | (k["rationale"] == x["rationale"]) | ((x["question"] != "") & (k["question"] == x["question"])))
        return F.when(seen, kept).otherwise(F.array_append(kept, x))

    start = F.slice("all", 1, 1)
    kept = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), start, step)
    return rows.select(group, F.posexplode(F.slice(kept, 1, MOST_SUGGESTIONS)).alias("rank", "s")).select(group, "rank", "s.pos", "s.kind", "s.path", "s.rationale", "s.question")


def largest_remainder(rows: DataFrame, group: str, weight: Column, total: Column, order: str) -> DataFrame:
    """``rows`` with ``share``: ``total`` units of each group by weight, at least 1 each; leftovers to the largest fractions."""
    by = Window.partitionBy(group)
    rows = rows.withColumn("w", F.greatest(F.lit(1.0), weight)).withColumn("total", total)
    rows = rows.withColumn("exact", F.col("total") * F.col("w") / F.sum("w").over(by)).withColumn("base", F.floor("exact"))
    rows = rows.withColumn("left", F.col("total") - F.sum("base").over(by)).withColumn("turn", F.row_number().over(by.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), order)))
    return rows.withColumn("share", F.col("base") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).drop("w", "exact", "base", "left", "turn")


def even_share(total: Column, size: Column, place: Column) -> Column:
    """``total`` split over ``size`` places from 0, the first ones taking what is left over."""
    return F.floor(total / size) + F.when(place < total % size, 1).otherwise(0)


def minutes(total: Column, weight: Column, group: str, order: str) -> Column:
    """Minutes by weight to one decimal; the last row of a group takes the remainder."""
    by = Window.partitionBy(group)
    part = T.half_up(total * weight / F.sum(weight).over(by), 1)
    so_far = F.sum(part).over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    last = F.row_number().over(by.orderBy(F.desc(order))) == 1
    return F.when(last, F.round(total - F.coalesce(so_far, F.lit(0.0)), 1)).otherwise(part)
