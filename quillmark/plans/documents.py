"""Queries over whole documents: keywords, ids, statements, locale, safety, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import layout, lines, safety
from quillmark.plans.catalog import query
from quillmark.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"SELECT keyword, count(*) AS n_docs FROM (SELECT unnest({D.keywords('text')}) AS keyword FROM {_DOCS}) GROUP BY keyword")
def keyword_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every keyword."""
    return _texts(spark, sf_dir).select(F.explode(T.keywords(F.col("text"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_docs"))


@query(f"SELECT doc_id, {D.stable_id('doc', 'text')} AS id FROM {_DOCS}")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed id of every document."""
    return _texts(spark, sf_dir).select("doc_id", T.stable_id("doc", F.col("text")).alias("id"))


@query(f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS statement FROM (SELECT doc_id, {D.statements('text')} AS s FROM {_DOCS})")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of every document, in order from 0."""
    return _texts(spark, sf_dir).select("doc_id", F.posexplode(T.statements(F.col("text"))).alias("pos", "statement")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, number FROM (SELECT doc_id, unnest({D.numbers('text')}) AS number FROM {_DOCS})")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct numeric tokens of every document."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.numbers(F.col("text"))).alias("number"))


@query(f"""
SELECT doc_id, han, latin, CASE WHEN han >= 10 AND latin >= 30 THEN 'mixed' WHEN han > latin * 0.2 THEN 'zh-CN' ELSE 'en-US' END AS locale
FROM (SELECT doc_id, len(regexp_extract_all(t, '\\p{{Han}}'))::INTEGER AS han, len(regexp_extract_all(t, '[A-Za-z]'))::INTEGER AS latin
  FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN {D.lit(' 项目管理与数据分析的实践经验总结')} WHEN 1 THEN {D.lit('个人简介')} ELSE '' END AS t FROM {_DOCS}))
""")
def locale_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locale by counts of Han and Latin characters.

    The driver's texts hold no Han characters, so a fixed phrase chosen by
    doc_id % 5 is appended, here and in the oracle.
    """
    more = F.when(F.col("doc_id") % 5 == 0, " 项目管理与数据分析的实践经验总结").when(F.col("doc_id") % 5 == 1, "个人简介").otherwise("")
    return lines.located(_texts(spark, sf_dir).withColumn("text", F.concat("text", more)), "text").select("doc_id", "han", "latin", "locale")


_CHARACTERS = f"""
SELECT doc_id, unicode(c) AS code_point, count(*) AS n
FROM (SELECT doc_id, unnest(string_split(text || CASE doc_id % 4 WHEN 0 THEN chr(8203) || chr(9) || chr(7) WHEN 1 THEN chr(57344) || chr(65533) WHEN 2 THEN chr(8238) || chr(173) ELSE '' END, '')) AS c FROM {_DOCS})
WHERE c <> '' GROUP BY ALL
"""


@query(f"SELECT doc_id, code_point, label, n FROM (SELECT doc_id, code_point, n, {safety.sql_label('code_point')} AS label FROM ({_CHARACTERS})) WHERE label IS NOT NULL")
def text_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that may not render, by document and code point.

    A fixed set of such characters chosen by doc_id % 4 is appended, here and in
    the oracle, as the driver's texts hold none.
    """
    odd = F.when(F.col("doc_id") % 4 == 0, "​\t\x07").when(F.col("doc_id") % 4 == 1, "�").when(F.col("doc_id") % 4 == 2, "‮­").otherwise("")
    return safety.unsafe_characters(_texts(spark, sf_dir).withColumn("text", F.concat("text", odd)), "doc_id", "text")


@query(layout.sql("SELECT doc_id AS id, length(coalesce(text, '')) AS units, CASE doc_id % 4 WHEN 0 THEN 'professional' WHEN 1 THEN 'minimal' WHEN 2 THEN 'compact' END AS preferred FROM documents"))
def layout_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates ranked for every document, with a preference chosen by doc_id % 4."""
    wish: Column = F.when(F.col("doc_id") % 4 == 0, "professional").when(F.col("doc_id") % 4 == 1, "minimal").when(F.col("doc_id") % 4 == 2, "compact")
    return layout.ranked(_texts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.length("text").alias("units"), wish.alias("preferred")), target_pages=1)


_PAGE = "(SELECT page_id, coalesce(html, '') AS html FROM pages)"


@query(f"""
WITH m AS (SELECT page_id, '## Question' || chr(10) || '中文：**' || title || '** English: [' || title || '](http://x.y/z)' || chr(10) || '- first ' || title || chr(10) || '## Answer' || chr(10) || 'other' AS md
  FROM (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title FROM {_PAGE})),
s AS (SELECT page_id, regexp_extract(md, '(?s)## Question\\s*\\n(.*?)(?:\\n## |$)', 1) AS section FROM m),
p AS (SELECT page_id, section, {lines.sql_plain('section')} AS plain FROM s)
SELECT page_id, plain, trim(regexp_extract(plain, '中文[：:]\\s*(.*?)\\s*English[：:]', 1)) AS zh, trim(regexp_extract(plain, 'English[：:]\\s*(.*)', 1)) AS en FROM p
""")
def section_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown section made from each page's title, extracted, stripped and split by language."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<h1>(.*?)</h1>", 1)
    md = F.concat(F.lit("## Question\n中文：**"), title, F.lit("** English: ["), title, F.lit("](http://x.y/z)\n- first "), title, F.lit("\n## Answer\nother"))
    plain = table(spark, sf_dir, "pages").select("page_id", lines.plain(lines.section(md, "Question")).alias("plain"))
    return plain.select("page_id", "plain", lines.chinese(F.col("plain")).alias("zh"), lines.english(F.col("plain")).alias("en"))
