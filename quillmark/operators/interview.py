"""Question retrieval, plans, stories, answer scores and coaching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values ------------------------------------------------------------------------------
STRUCTURE_MARKS = [r"(?i)(?:当时|背景|situation|context)", r"(?i)(?:目标|任务|task|goal)", r"(?i)(?:我|本人|I\s)", r"(?i)(?:结果|最终|提升|降低|result|outcome)"]
EXAMPLE_MARK = r"(?i)(?:例如|具体|because|for example|specifically)"
DECISION_MARK = r"(?i)(?:权衡|决策|协作|分析|trade-?off|decision|collaborat|analy)"
DIMENSIONS = ["relevance", "structure", "evidence", "roleCompetency", "clarity"]
ADVICE = {
    "relevance": "第一句直接回应问题，并删去与目标能力无关的背景。",
    "structure": "按“背景—目标—个人行动—结果”四步重组回答。",
    "evidence": "从真实经历中补充一个可核实结果；没有数字时可说明范围、反馈或交付物。",
    "roleCompetency": "明确说明你的判断、取舍及其与岗位能力的关系。",
    "clarity": "将回答控制在一个核心故事，使用短句并避免重复。",
}
SITUATION, TASK, RESULT = "待补充：当时的背景与约束", "待补充：你需要达成的具体目标", "待补充：可核实的结果或影响"
# -------------------------------------------------------------------------------------------


def retrieved(catalog: DataFrame, wanted: Column, k: int, group: str) -> DataFrame:
    """The k rows of (group, id, words) with most words in the array ``wanted``, ties to the smaller id, with rank."""
    rows = catalog.withColumn("score", F.size(F.array_intersect("words", wanted)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def knowledge_score(exact_role: Column, family: Column, exact_skills: Column, skill_tokens: Column) -> Column:
    return 8 * exact_role + 3 * family + 5 * exact_skills + skill_tokens


def features(rows: DataFrame, answer: str, expected: str) -> DataFrame:
    """``rows`` with the five capped dimensions, the overall score and the answer's length.

    ``answer`` is a text column, ``expected`` an array of lower-case keywords.
    """
    text = F.col("__answer")
    rows = rows.withColumn("__answer", T.normalize(T.unwrapped(F.col(answer)))).withColumn("length", T.answer_length(text))
    rows = rows.withColumn("__hits", F.size(F.array_intersect(T.keywords(text), F.transform(F.col(expected), F.lower))))
    hits, size = F.col("__hits"), F.col("length")

    def mark(pattern: str, points: float) -> Column:
        return F.when(text.rlike(pattern), points).otherwise(0.0)

    scores = {
        "relevance": 7 + hits * 4 + F.when(size >= 20, 3).otherwise(0),
        "structure": 5 + sum((mark(p, 3.5) for p in STRUCTURE_MARKS), F.lit(0.0)),
        "evidence": 4 + F.size(T.numbers(text)) * 4 + mark(EXAMPLE_MARK, 4.0),
        "roleCompetency": 7 + hits * 4 + mark(DECISION_MARK, 3.0),
        "clarity": F.when(size == 0, 0).when(size < 20, 9).when(size <= 250, 17).when(size <= 400, 13).otherwise(9),
    }
    for name, value in scores.items():
        rows = rows.withColumn(name, T.clamp(value.cast("double"), 0.0, 20.0))
    return rows.withColumn("overall", T.half_up(sum((F.col(d) for d in DIMENSIONS), F.lit(0.0)), 1)).drop("__answer", "__hits")


def weakest(rows: DataFrame, key: list[str], k: int = 2) -> DataFrame:
    """The k lowest dimensions of each row, in their fixed order among equals, with advice."""
    each = F.array(*[F.struct(F.col(d).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("dimension")) for i, d in enumerate(DIMENSIONS)])
    low = F.slice(F.array_sort(each), 1, k)
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    rows = rows.select(*key, F.posexplode(low).alias("rank", "d"))
    return rows.select(*key, (F.col("rank") + 1).alias("rank"), F.col("d.dimension").alias("dimension"), F.col("d.score").alias("score"), advice[F.col("d.dimension")].alias("advice"))


def stories(claims: DataFrame) -> DataFrame:
    """(claim_id, story_id, title, situation, task, action, result, keywords, risk) of (claim_id, text)."""
    parts = T.claim_parts(T.normalize(F.col("text")))
    return claims.select(
        "claim_id", T.stable_id("story", F.col("claim_id")).alias("story_id"), T.excerpt(F.col("text"), 32).alias("title"), F.lit(SITUATION).alias("situation"), F.lit(TASK).alias("task"),
        parts["action"].alias("action"), F.coalesce(parts["result"], F.lit(RESULT)).alias("result"), F.slice(T.keywords(F.col("text")), 1, 10).alias("keywords"), parts["result"].isNull().alias("incomplete"),
    )


def unsupported_numbers(answers: DataFrame, claims: DataFrame, within: str) -> DataFrame:
    """Answers and claims of one ``within`` that share a keyword, where the claim has numbers and the answer has others.

    Answers without numbers and claims without numbers are dropped before the join,
    which goes by (within, keyword).
    """
    a = answers.select(within, "answer_id", T.keywords(F.col("text")).alias("words"), F.array_sort(T.numbers(F.col("text"))).alias("nums")).where(F.size("nums") > 0)
    c = claims.select(within, "claim_id", T.keywords(F.col("text")).alias("words"), F.array_sort(T.numbers(F.col("text"))).alias("claim_nums")).where(F.size("claim_nums") > 0)
    shared = a.select(within, "answer_id", F.explode("words").alias("word")).join(c.select(within, "claim_id", F.explode("words").alias("word")), [within, "word"])
    pairs = shared.groupBy(within, "answer_id", "claim_id").agg(F.count("*").alias("shared"))
    found = pairs.join(a.select(within, "answer_id", "nums"), [within, "answer_id"]).join(c.select(within, "claim_id", "claim_nums"), [within, "claim_id"])
    return found.withColumn("unmatched", F.array_except("nums", "claim_nums")).where(F.size("unmatched") > 0).select(within, "answer_id", "claim_id", "shared", F.array_join("unmatched", ",").alias("unmatched"))
