"""Claims mined from documents' statements, their assessment, conflicts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import duck as D
from quillmark.functions import text as T
from quillmark.operators import claims, scores
from quillmark.plans.catalog import query
from quillmark.sources.tables import table

_DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"
LINES = f"(SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS text FROM (SELECT doc_id, {D.statements('text')} AS s FROM {_DOCS}))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all documents as (doc_id, pos, text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(T.statements(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


_MISSING = f"concat_ws('|', CASE WHEN method IS NULL THEN '{T.MISSING_METHOD}' END, CASE WHEN NOT metric THEN '{T.MISSING_RESULT}' END)"
_PARTS = f"(SELECT *, {D.method('text')} AS method, len({D.numbers('text')}) > 0 AS metric FROM {LINES})"


@query(f"SELECT doc_id, pos, {D.excerpt('text', 70)} AS action, method, CASE WHEN metric THEN {D.excerpt('text', 100)} END AS result, {_MISSING} AS missing FROM {_PARTS}")
def claim_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action, method, result and missing information of every statement."""
    parts = T.claim_parts(F.col("text"))
    return lines(spark, sf_dir).select("doc_id", "pos", *[parts[k].alias(k) for k in ("action", "method", "result")], F.array_join(parts["missing"], "|").alias("missing"))


_SEED = "concat_ws(':', doc_id, pos, text)"


@query(f"""
SELECT doc_id, pos, {D.stable_id('claim', _SEED)} AS claim_id, {D.stable_id('evidence', _SEED)} AS evidence_id, text,
  {D.excerpt('text', 70)} AS action, method, CASE WHEN metric THEN {D.excerpt('text', 100)} END AS result, {_MISSING} AS missing,
  CASE WHEN doc_id % 3 = 0 THEN {claims.UNSOURCED}::DOUBLE ELSE {claims.SOURCED}::DOUBLE END AS confidence, 'resume_only' AS status
FROM {_PARTS}
""")
def evidence_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim and an evidence asset for every statement; documents with doc_id % 3 = 0 count as without source."""
    return claims.mined(lines(spark, sf_dir).withColumn("sourced", F.col("doc_id") % 3 != 0))


@query("""
WITH e AS (SELECT doc_id AS evidence_id, (doc_id // 3) AS claim_id, CASE doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'user_statement' WHEN 2 THEN 'resume_text' ELSE 'link' END AS kind, quality = 1 AS verified FROM labels),
c AS (SELECT doc_id AS claim_id, doc_id % 5 = 0 AS sourced FROM documents),
f AS (SELECT claim_id, bool_or(kind NOT IN ('resume_text', 'user_statement') AND verified) AS i, bool_or(kind = 'user_statement' AND verified) AS u, bool_or(kind = 'resume_text') AS r FROM e GROUP BY claim_id)
SELECT claim_id, status, CASE status WHEN 'supported' THEN 0.92::DOUBLE WHEN 'user_confirmed' THEN 0.82::DOUBLE WHEN 'resume_only' THEN 0.65::DOUBLE ELSE 0.3::DOUBLE END AS confidence
FROM (SELECT claim_id, CASE WHEN coalesce(i, false) THEN 'supported' WHEN coalesce(u, false) THEN 'user_confirmed' WHEN coalesce(r, false) OR sourced THEN 'resume_only' ELSE 'needs_evidence' END AS status FROM c LEFT JOIN f USING (claim_id))
""")
def claim_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims, labels as their evidence: three consecutive labels belong to one claim."""
    labels = table(spark, sf_dir, "labels")
    kind = F.when(F.col("doc_id") % 4 == 0, "document").when(F.col("doc_id") % 4 == 1, "user_statement").when(F.col("doc_id") % 4 == 2, "resume_text").otherwise("link")
    evidence = labels.select(F.col("doc_id").alias("evidence_id"), kind.alias("kind"), (F.col("quality") == 1).alias("verified"))
    links = labels.select(F.col("doc_id").alias("evidence_id"), F.expr("doc_id div 3").alias("claim_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 5 == 0).alias("sourced"))
    return claims.assessed(docs, links, evidence)


@query(f"""
WITH c AS (SELECT doc_id, pos, {D.keywords('text')} AS words, {D.numbers('text')} AS nums FROM {LINES}),
n AS (SELECT * FROM c WHERE len(nums) > 0)
SELECT a.doc_id, a.pos AS left_pos, b.pos AS right_pos, len(list_intersect(a.words, b.words))::BIGINT AS shared, array_to_string(a.nums, ',') AS left_numbers, array_to_string(b.nums, ',') AS right_numbers
FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.pos < b.pos
WHERE len(list_intersect(a.words, b.words)) >= 2 AND len(list_intersect(a.nums, b.nums)) = 0
""")
def claim_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of statements of one document that agree in words and differ in numbers."""
    return claims.conflicts(lines(spark, sf_dir), "doc_id")


@query(f"""
WITH d AS (SELECT doc_id, text, quality, {D.statements('text')} AS s FROM {_DOCS} LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
f AS (SELECT doc_id, quality, len(s) AS bullets, len(list_filter(s, lambda x: len({D.numbers('x')}) > 0)) AS metric, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS chars,
  len(list_filter(s, lambda x: regexp_matches(x, '[。.]$'))) AS stopped, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: length(trim(p))), lambda n: n > 0)) AS sections,
  regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') AS contact FROM d)
SELECT doc_id, impact, completeness, clarity, structure, ats, language, {D.half_up('impact + completeness + clarity + structure + ats + language', 1)} AS total FROM (SELECT doc_id,
  least(25.0, 8 + least(9, metric * 2.25) + least(8, metric))::DOUBLE AS impact,
  least(15.0, 4 + 2 + CASE WHEN contact THEN 2 ELSE 0 END + CASE WHEN sections >= 1 THEN 3 ELSE 0 END + CASE WHEN sections >= 2 THEN 2 ELSE 0 END + CASE WHEN sections >= 3 THEN 2 ELSE 0 END)::DOUBLE AS completeness,
  (9 + CASE WHEN bullets > 0 THEN 3 ELSE 0 END + CASE WHEN chars > 0 AND chars <= 120 * bullets THEN 3 ELSE 0 END)::DOUBLE AS clarity,
  least(15.0, 7 + least(5, sections) + CASE WHEN bullets > 0 THEN 3 ELSE 0 END)::DOUBLE AS structure,
  (15 - CASE WHEN quality = 0 THEN 6 ELSE 0 END - CASE WHEN quality IS NULL THEN 2 ELSE 0 END)::DOUBLE AS ats,
  (12 + CASE WHEN bullets > 0 THEN 2 ELSE 0 END - CASE WHEN stopped > 0 AND stopped < bullets THEN 2 ELSE 0 END)::DOUBLE AS language FROM f)
""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six capped dimensions of every document and their total.

    Structure is read as: lines are sections, statements are bullets, an address
    with @ is a contact; a label of poor quality lowers the parse score, a missing
    label counts as text recognised from an image.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return scores.dimensions(docs.join(labels, "doc_id", "left"))


@query(f"""
SELECT doc_id, list_sort(list_filter([CASE WHEN NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') THEN 'CONTACT_MISSING' END, CASE WHEN contains(text, '|') THEN 'TABLE_LAYOUT' END,
  CASE WHEN quality = 0 THEN 'LOW_CONFIDENCE_TEXT' END, CASE WHEN trim(text) = '' THEN 'NO_SECTIONS' END], lambda x: x IS NOT NULL))::VARCHAR AS findings,
  greatest(0, 100 - CASE WHEN NOT regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') THEN 25 ELSE 0 END - CASE WHEN contains(text, '|') THEN 10 ELSE 0 END - CASE WHEN quality = 0 THEN 10 ELSE 0 END - CASE WHEN trim(text) = '' THEN 25 ELSE 0 END) AS score,
  regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+') AND trim(text) <> '' AS passed
FROM {_DOCS} LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)
""")
def ats_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the parse audit and the score they leave, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return scores.parse_audit(docs.join(labels, "doc_id", "left"))
