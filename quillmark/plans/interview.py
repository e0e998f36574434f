"""Queries of the interview side: retrieval, plans, stories, answers, chat windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import interview, review
from quillmark.plans.catalog import query
from quillmark.plans.evidence import LINES, lines
from quillmark.plans.jobs import _sql_phrase
from quillmark.sources.tables import table

WANTED = ["thing", "erth", "ention", "anat", "ough", "ndea", "the", "stion"]
_WANTED = "[" + ", ".join(f"'{w}'" for w in WANTED) + "]"
_ANSWERS = ["In that situation my goal was clear", "I saved 35% because of the result, for example 12 hours", "The decision was a trade-off, we analysed 3 options", "结果提升 20%，具体分析", ""]
_CATALOG = f"(SELECT item_id AS id, item_id % 4 AS locale, {D.keywords('coalesce(text, chr(32))')} AS words FROM benchmark)"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 4).alias("locale"), T.keywords(F.coalesce("text", F.lit(" "))).alias("words"))


@query(f"SELECT locale, id, len(list_intersect(words, {_WANTED}))::INTEGER AS score, row_number() OVER (PARTITION BY locale ORDER BY len(list_intersect(words, {_WANTED})) DESC, id)::INTEGER AS rank FROM {_CATALOG} QUALIFY rank <= 6")
def question_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six questions for each locale by keyword overlap."""
    return interview.retrieved(_catalog(spark, sf_dir), F.array(*map(F.lit, WANTED)), 6, "locale").select("locale", "id", "score", "rank")


@query(f"""
SELECT id, 8 * (id % 3 = 0)::INTEGER + 3 * len(list_intersect(words, {_WANTED}[:4])) + 5 * (id % 5 = 0)::INTEGER + len(list_intersect(words, {_WANTED}[5:])) AS score FROM {_CATALOG}
""")
def question_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every question by role, family, skill and skill tokens."""
    a, b = (F.array(*map(F.lit, w)) for w in (WANTED[:4], WANTED[4:]))
    score = interview.knowledge_score((F.col("id") % 3 == 0).cast("int"), F.size(F.array_intersect("words", a)), (F.col("id") % 5 == 0).cast("int"), F.size(F.array_intersect("words", b)))
    return _catalog(spark, sf_dir).select("id", score.cast("long").alias("score"))


@query(f"""
WITH s AS (SELECT locale, id, row_number() OVER (PARTITION BY locale ORDER BY len(list_intersect(words, {_WANTED})) DESC, id) AS ord FROM {_CATALOG} QUALIFY ord <= 7),
w AS (SELECT *, count(*) OVER (PARTITION BY locale) AS n, 1.0 + ord % 3 AS weight FROM s),
m AS (SELECT *, floor(45.0 * weight / sum(weight) OVER (PARTITION BY locale) * 10 + 0.5) / 10 AS part FROM w)
SELECT locale, id, ord::INTEGER AS ord, floor(45.0 / n * 10 + 0.5) / 10 AS even_minutes, CASE WHEN ord = n THEN round(45.0 - coalesce(sum(part) OVER (PARTITION BY locale ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 1) ELSE part END AS minutes, n < 12 AS shortage FROM m
""")
def interview_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of 45 minutes for each locale, split evenly and by weight."""
    rows = interview.retrieved(_catalog(spark, sf_dir), F.array(*map(F.lit, WANTED)), 7, "locale").withColumnRenamed("rank", "ord")
    n = F.count("*").over(Window.partitionBy("locale"))
    weighted = review.minutes(F.lit(45.0), (1 + F.col("ord") % 3).cast("double"), "locale", "ord")
    return rows.select("locale", "id", "ord", T.half_up(45.0 / n, 1).alias("even_minutes"), weighted.alias("minutes"), (n < 12).alias("shortage"))


@query(f"""
SELECT doc_id, pos, {D.stable_id('story', "concat_ws(':', doc_id, pos)")} AS story_id, {D.excerpt('text', 32)} AS title, {D.excerpt('text', 70)} AS action,
  CASE WHEN len({D.numbers('text')}) > 0 THEN {D.excerpt('text', 100)} ELSE '{interview.RESULT}' END AS result, len({D.numbers('text')}) = 0 AS incomplete FROM {LINES} WHERE pos < 8
""")
def story_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of the first eight statements of every document, as many as the operator takes."""
    claims = lines(spark, sf_dir).where("pos < 8").withColumn("claim_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")))
    made = interview.stories(claims)
    key = F.split("claim_id", ":")
    return made.select(key[0].cast("long").alias("doc_id"), key[1].cast("long").alias("pos"), "story_id", "title", "action", "result", "incomplete")


_ANSWER = f"(SELECT conv_id, turn, {D.normalize('coalesce(text, chr(32)) || chr(32) || ' + _sql_phrase('(conv_id + turn)', _ANSWERS))} AS t FROM conversations)"
_HITS = f"len(list_intersect({D.keywords('t')}, {_WANTED}))"


def _sql_mark(pattern: str, points: float) -> str:
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN {points}::DOUBLE ELSE 0::DOUBLE END"


_FEATURES = f"""(SELECT conv_id, turn, n AS length, least(20::DOUBLE, 7 + h * 4 + CASE WHEN n >= 20 THEN 3 ELSE 0 END) AS relevance,
  least(20::DOUBLE, 5 + {' + '.join(_sql_mark(p, 3.5) for p in interview.STRUCTURE_MARKS)}) AS structure,
  least(20::DOUBLE, 4 + len({D.numbers('t')}) * 4 + {_sql_mark(interview.EXAMPLE_MARK, 4)}) AS evidence, least(20::DOUBLE, 7 + h * 4 + {_sql_mark(interview.DECISION_MARK, 3)}) AS "roleCompetency",
  (CASE WHEN n = 0 THEN 0 WHEN n < 20 THEN 9 WHEN n <= 250 THEN 17 WHEN n <= 400 THEN 13 ELSE 9 END)::DOUBLE AS clarity
  FROM (SELECT *, {_HITS} AS h, {D.answer_length('t')} AS n FROM {_ANSWER}))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit(" ")), F.lit(" "), F.get(F.array(*map(F.lit, _ANSWERS)), ((F.col("conv_id") + F.col("turn")) % len(_ANSWERS)).cast("int")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), F.array(*map(F.lit, WANTED)).alias("expected"))
    return interview.features(rows, "t", "expected").drop("t", "expected")


@query(f'SELECT *, floor((relevance + structure + evidence + "roleCompetency" + clarity) * 10 + 0.5) / 10 AS overall FROM {_FEATURES}')
def answer_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five capped dimensions of every turn, read as an answer; a phrase for each marker is added by turn."""
    return _features(spark, sf_dir)


@query(f"""
SELECT conv_id, turn, rank::INTEGER AS rank, dimension, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score, ord) AS rank FROM (
  {' UNION ALL '.join(f"SELECT conv_id, turn, {i} AS ord, '{d}' AS dimension, {chr(34)}{d}{chr(34)} AS score FROM {_FEATURES}" for i, d in enumerate(interview.DIMENSIONS))})) WHERE rank <= 2
""")
def answer_coach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two weakest dimensions of every turn."""
    return interview.weakest(_features(spark, sf_dir), ["conv_id", "turn"]).drop("advice")


_ANSWER_LINES = "(SELECT conv_id AS doc_id, turn AS answer_id, text || ' 42 hours' AS text FROM conversations WHERE text IS NOT NULL)"


@query(f"""
WITH a AS (SELECT doc_id, answer_id, {D.keywords('text')} AS words, {D.numbers('text')} AS nums FROM {_ANSWER_LINES}),
c AS (SELECT doc_id, pos AS claim_id, {D.keywords('text')} AS words, {D.numbers('text')} AS claim_nums FROM {LINES})
SELECT doc_id, answer_id, claim_id, len(list_intersect(a.words, c.words))::BIGINT AS shared, array_to_string(list_sort(list_filter(nums, lambda x: NOT list_contains(claim_nums, x))), ',') AS unmatched
FROM a JOIN c USING (doc_id) WHERE len(list_intersect(a.words, c.words)) > 0 AND len(claim_nums) > 0 AND len(list_filter(nums, lambda x: NOT list_contains(claim_nums, x))) > 0
""")
def answer_vs_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose numbers the statements of the document with the conversation's id do not have."""
    answers = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("answer_id"), F.concat("text", F.lit(" 42 hours")).alias("text"))
    return interview.unsupported_numbers(answers, lines(spark, sf_dir).withColumnRenamed("pos", "claim_id"), "doc_id")


@query("""
SELECT conv_id, turn, len(w) AS n_before, coalesce(array_to_string(w, ' / '), '') AS context FROM (
  SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS w FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))
""")
def chat_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the whole texts of the up to ten turns before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-10, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("m"))
    rows = rows.withColumn("w", F.collect_list("m").over(before))
    return rows.select("conv_id", "turn", F.nullif(F.size("w"), F.lit(0)).cast("long").alias("n_before"), F.array_join("w", " / ").alias("context"))
