"""Queries of the posting side: requirements, risks, matching, coverage, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import claims, jobs
from quillmark.plans.catalog import query
from quillmark.sources.tables import table

#: Phrases that the driver's texts lack, so that every class and risk occurs; chosen by id.
_CLASS_PHRASES = ["preferred background in stats", "degree required for this role", "you will lead the duties", "travel and remote work possible", "plain skill line"]
_RISK_PHRASES = ["A registration fee applies", "male only please", "unpaid trial week", "competitive salary offered", "contact us on telegram", "薪资面议 押金", "nothing special"]


def _phrase(key: str, phrases: list[str]):
    return F.get(F.array(*map(F.lit, phrases)), (F.col(key) % len(phrases)).cast("int"))


def _sql_phrase(key: str, phrases: list[str]) -> str:
    return f"([{', '.join(map(D.lit, phrases))}])[{key} % {len(phrases)} + 1]"


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), _phrase("item_id", _CLASS_PHRASES))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.alias("text"))


_SQL_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for n, _, p in jobs.REQUIREMENT_CLASSES) + f" ELSE '{jobs.OTHER_CLASS[0]}' END"
_SQL_IMPORTANCE = "CASE category " + " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, w, _ in jobs.REQUIREMENT_CLASSES) + f" ELSE {jobs.OTHER_CLASS[1]}::DOUBLE END"
_REQUIREMENTS = f"""(SELECT *, {_SQL_IMPORTANCE} AS importance FROM (SELECT *, {_SQL_CATEGORY} AS category FROM (
  SELECT id, title, generate_subscripts(kept, 1) - 1 AS pos, unnest(kept) AS line FROM (
    SELECT id, title, list_slice(list_filter(lines, lambda x: x <> title AND length(x) >= 6), 1, {jobs.MOST_REQUIREMENTS}) AS kept FROM (
      SELECT id, lines, coalesce(list_filter(lines, lambda x: length(x) <= 60)[1], 'Target role') AS title FROM (
        SELECT item_id AS id, {D.statements(f"regexp_replace(coalesce(text, '') || chr(10) || {_sql_phrase('item_id', _CLASS_PHRASES)}, '{jobs.BULLETS}', chr(10), 'g')")} AS lines FROM benchmark))))))"""


@query(f"SELECT id, title, pos::INTEGER AS pos, line, category, importance, len({D.keywords('line')}) AS n_keywords FROM {_REQUIREMENTS}")
def jd_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified requirements of every benchmark item, read as a posting; a phrase for each class is added by id."""
    rows = jobs.requirements(_postings(spark, sf_dir))
    return rows.select("id", "title", "pos", "line", "category", "importance", F.size(T.keywords(F.col("line"))).cast("long").alias("n_keywords"))


_RISK_TEXT = f"(SELECT doc_id AS id, coalesce(text, '') || ' ' || {_sql_phrase('doc_id', _RISK_PHRASES)} AS text FROM documents)"


@query(" UNION ALL ".join(f"SELECT id, '{c}' AS code, '{s}' AS severity, regexp_extract(text, '(?i){p}') AS excerpt FROM {_RISK_TEXT} WHERE regexp_matches(text, '(?i){p}')" for c, s, p in jobs.RISKS))
def job_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk findings in every document, with a phrase appended by doc_id as the driver's texts have none."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _phrase("doc_id", _RISK_PHRASES))
    return jobs.risks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))


def _words(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), T.keywords(F.coalesce("text", F.lit(""))).alias("words"))


_DOC_WORDS = f"(SELECT doc_id AS id, unnest({D.keywords(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS word FROM documents)"
_ITEM_WORDS = f"(SELECT item_id AS id, unnest({D.keywords(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS word FROM benchmark)"
_PAIRS = f"(SELECT i.id AS left_id, d.id AS right_id, count(*) AS shared FROM {_ITEM_WORDS} i JOIN {_DOC_WORDS} d USING (word) GROUP BY ALL)"


@query(f"SELECT left_id AS item_id, right_id AS doc_id, shared, row_number() OVER (PARTITION BY left_id ORDER BY shared DESC, right_id)::INTEGER AS rank FROM {_PAIRS} QUALIFY rank <= 3")
def keyword_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents that share most keywords with each benchmark item."""
    pairs = claims.overlaps(_words(spark, sf_dir, "benchmark", "item_id"), _words(spark, sf_dir, "documents", "doc_id"))
    return claims.top_claims(pairs, 3).select(F.col("left_id").alias("item_id"), F.col("right_id").alias("doc_id"), "shared", "rank")


_REQ = f"(SELECT id * 100 + pos AS id, id AS item_id, importance, {D.keywords('line')} AS words FROM {_REQUIREMENTS})"
_REQ_PAIRS = f"(SELECT r.id AS left_id, d.id AS right_id, count(*) AS shared FROM (SELECT id, unnest(words) AS word FROM {_REQ}) r JOIN {_DOC_WORDS} d USING (word) GROUP BY ALL)"
_STATUS = f"""(SELECT r.id, r.item_id, r.importance, coalesce(best, 0) AS best, CASE WHEN bad THEN 'conflict' WHEN best IS NULL THEN 'gap' WHEN best >= least(2, greatest(1, len(words))) THEN 'met' ELSE 'partial' END AS status
FROM {_REQ} r LEFT JOIN (SELECT left_id, max(shared) AS best, bool_or(right_id % 91 = 3) AS bad FROM {_REQ_PAIRS} GROUP BY left_id) p ON p.left_id = r.id)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = jobs.requirements(_postings(spark, sf_dir)).select((F.col("id") * 100 + F.col("pos")).alias("id"), F.col("id").alias("item_id"), "importance", T.keywords(F.col("line")).alias("words")).withColumn("n_words", F.size("words"))
    docs = _words(spark, sf_dir, "documents", "doc_id")
    status = claims.matched(needs, docs, docs.where(F.col("id") % 91 == 3))
    return status.join(needs.select("id", "item_id"), "id")


@query(f"SELECT id AS requirement_id, item_id, importance, best, status FROM {_STATUS}")
def job_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match status of every requirement against all documents, as one candidate's claim set.

    Those with doc_id % 91 = 3 count as conflicting.
    """
    return _matched(spark, sf_dir).select(F.col("id").alias("requirement_id"), "item_id", "importance", "best", "status")


@query(f"SELECT item_id, {D.half_up('sum(importance * CASE status WHEN ' + chr(39) + 'met' + chr(39) + ' THEN 1.0 WHEN ' + chr(39) + 'partial' + chr(39) + ' THEN 0.5 ELSE 0.0 END) / nullif(sum(importance), 0.0) * 100', 1)} AS coverage FROM {_STATUS} GROUP BY item_id")
def job_match_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted evidence coverage of every posting."""
    return _matched(spark, sf_dir).groupBy("item_id").agg(claims.coverage(F.col("status"), F.col("importance")).alias("coverage"))


_SCORED = f"""(SELECT d.doc_id, d.doc_id % 10 AS section, d.source, coalesce(score, 0.0) AS score, d.lang = 'es' AS pinned FROM documents d LEFT JOIN (
  SELECT right_id, sum(importance * CASE status WHEN 'met' THEN 1.0 WHEN 'partial' THEN 0.6 ELSE 0.0 END * shared) AS score FROM {_REQ_PAIRS} p JOIN {_STATUS} s ON s.id = p.left_id GROUP BY right_id) x ON x.right_id = d.doc_id)"""


@query(f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS slot FROM {_SCORED}),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) AS place, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, slot) AS rank FROM s WHERE NOT pinned),
n AS (SELECT a.source, a.slot AS new_slot, b.doc_id, b.score, b.slot AS old_slot, false AS pinned FROM m a JOIN m b ON a.source = b.source AND a.place = b.rank
  UNION ALL SELECT source, slot, doc_id, score, slot, true FROM s WHERE pinned)
SELECT source, doc_id, old_slot::INTEGER AS old_slot, new_slot::INTEGER AS new_slot, round(score, 6) AS score, pinned FROM n
""")
def job_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every source re-ranked by relevance to all postings together; Spanish ones keep their place.

    Relevance is a sum over shared words, so a word's worth is summed over the
    requirements that have it first and no pairs are made. The result is a
    permutation: movable rows share out the places that movable rows held, by
    score and then by their former order.
    """
    status = _matched(spark, sf_dir).select("id", "importance", "status")
    needs = jobs.requirements(_postings(spark, sf_dir)).select((F.col("id") * 100 + F.col("pos")).alias("id"), F.explode(T.keywords(F.col("line"))).alias("word"))
    worth = needs.join(status, "id").groupBy("word").agg(F.sum(jobs.relevance(F.lit(1), F.col("importance"), F.col("status"))).alias("worth"))
    words = _words(spark, sf_dir, "documents", "doc_id").select(F.col("id").alias("doc_id"), F.explode("words").alias("word"))
    scores = words.join(worth, "word").groupBy("doc_id").agg(F.sum("worth").alias("score"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang") == "es").alias("pinned")).join(scores, "doc_id", "left")
    rows = rows.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6)).withColumn("slot", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    by = Window.partitionBy("source", "pinned")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy("slot"))).withColumn("rank", F.row_number().over(by.orderBy(F.when(~F.col("pinned"), -F.col("score")), "slot")))
    places = rows.select("source", "pinned", F.col("place").alias("rank"), F.col("slot").alias("new_slot"))
    return rows.join(places, ["source", "pinned", "rank"]).select("source", "doc_id", F.col("slot").alias("old_slot"), "new_slot", "score", "pinned")
