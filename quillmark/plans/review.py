"""Queries of copy review: rewriting, consistency, suggestions, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import review
from quillmark.plans.catalog import query
from quillmark.plans.evidence import LINES, lines
from quillmark.plans.jobs import _phrase, _sql_phrase
from quillmark.sources.tables import table

_EN = ["Worked in order to win", "I successfully  shipped it", "She was responsible for data , too", "Plain words"]
_ZH = ["主要负责平台建设 ， 完成", "成功地完成项目", "在数据分析方面有经验", "普通文字"]


def _sql_rewrite(x: str, language: str) -> tuple[str, str]:
    """(rewritten, changes joined by ;) of a normalised SQL text."""
    messages, now = [], D.normalize(x)
    for _, pattern, by, message in review.REWRITES[language]:
        messages.append(f"CASE WHEN regexp_matches({now}, '{pattern}') THEN {D.lit(message)} END")
        now = f"regexp_replace({now}, '{pattern}', '{by.replace('$1', chr(92) + '1')}', 'g')"
    return D.normalize(now), f"concat_ws('; ', {', '.join(messages)})"


def _rewrite_sql(language: str, phrases: list[str]) -> str:
    new, changes = _sql_rewrite("t", language)
    return f"SELECT doc_id, {new} AS rewritten, {changes} AS changes FROM (SELECT doc_id, coalesce(text, '') || ' ' || {_sql_phrase('doc_id', phrases)} AS t FROM documents)"


def _rewrite(spark: SparkSession, sf_dir: str, language: str, phrases: list[str]) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _phrase("doc_id", phrases)).alias("t"))
    return review.rewritten(rows, "t", language).select("doc_id", "rewritten", F.array_join("changes", "; ").alias("changes"))


@query(_rewrite_sql("en", _EN))
def rewrite_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten by the English rules; a phrase for each rule is added by doc_id."""
    return _rewrite(spark, sf_dir, "en", _EN)


@query(_rewrite_sql("zh", _ZH))
def rewrite_zh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rewritten by the Chinese rules; a phrase for each rule is added by doc_id."""
    return _rewrite(spark, sf_dir, "zh", _ZH)


@query(f"""
WITH n AS (SELECT doc_id, pos, {D.normalize('text')} AS t FROM {LINES}), e AS (SELECT *, regexp_matches(t, '[。.!]$') AS ends FROM n),
m AS (SELECT *, avg(ends::INTEGER) OVER (PARTITION BY doc_id) >= 0.5 AS most FROM e)
SELECT doc_id, pos, CASE WHEN most THEN regexp_replace(t, '[。.!]$', '') || '.' ELSE regexp_replace(t, '[。.!]$', '') END AS suggested FROM m WHERE t <> '' AND ends <> most
""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose closing punctuation differs from that of their document's majority."""
    return review.terminal_issues(lines(spark, sf_dir), "doc_id", "text").select("doc_id", "pos", "suggested")


@query()
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight suggestions for every document: unproven superlatives first, then rewrites.

    The selection is an ordered fold, so there is no oracle; tests hold it against
    a plain loop. Phrases that make rules fire are added by document and position.
    """
    extra = ["", " best-in-class", " in order to win", " , done", " world class", " successfully done"]
    rows = lines(spark, sf_dir).withColumn("text", F.concat("text", F.get(F.array(*map(F.lit, extra)), ((F.col("doc_id") + F.col("pos")) % len(extra)).cast("int"))))
    rows = review.rewritten(rows, "text", "en")
    proof = F.col("text").rlike(review.SUPERLATIVE)
    changed = F.col("rewritten") != T.normalize(F.col("text"))
    rows = rows.where(proof | changed).select(
        "doc_id", "pos", F.when(proof, "needs_proof").otherwise("rewrite").alias("kind"), F.concat(F.lit("/lines/"), (F.col("pos") % 40).cast("string")).alias("path"),
        F.when(proof, F.concat(F.lit("needs independent proof: "), F.lower(F.regexp_extract("text", review.SUPERLATIVE, 0)))).otherwise(F.array_join("changes", "; ")).alias("rationale"), F.when(proof, "What supports this?").otherwise("").alias("question"),
    )
    return review.selected(rows, "doc_id")


@query("""
WITH r AS (SELECT source, doc_id, greatest(1.0, (doc_id % 17)::DOUBLE) AS w, 37 + length(source) AS total FROM documents),
x AS (SELECT *, total * w / sum(w) OVER (PARTITION BY source) AS exact, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM r),
b AS (SELECT *, floor(exact) AS base FROM x),
t AS (SELECT *, total - sum(base) OVER (PARTITION BY source) AS left_over, row_number() OVER (PARTITION BY source ORDER BY round(exact - base, 9) DESC, doc_id) AS turn FROM b)
SELECT source, doc_id, (base + CASE WHEN turn <= left_over THEN 1 ELSE 0 END)::BIGINT AS share, (floor(total / n) + CASE WHEN place < total % n THEN 1 ELSE 0 END)::BIGINT AS even FROM t
""")
def apportion_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap shared out over the documents of a source, by weight with largest remainders and evenly."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id")
    rows = review.largest_remainder(rows, "source", (F.col("doc_id") % 17).cast("double"), 37 + F.length("source"), "doc_id")


    by = Window.partitionBy("source")
    place, size = F.row_number().over(by.orderBy("doc_id")) - 1, F.count("*").over(by)
    return rows.select("source", "doc_id", F.col("share").cast("long").alias("share"), review.even_share(F.col("total"), size, place).cast("long").alias("even"))
