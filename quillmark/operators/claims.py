"""Claims and evidence: mining, assessment, conflict, overlap and coverage joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Confidences by status, and by whether a claim has a source.
CONFIDENCE = {"supported": 0.92, "user_confirmed": 0.82, "resume_only": 0.65, "needs_evidence": 0.3}
SOURCED, UNSOURCED = 0.7, 0.6


def mined(lines: DataFrame) -> DataFrame:
    """Claims and evidence ids of (doc_id, pos, text, sourced) lines of at least four characters."""
    rows = lines.withColumn("text", T.normalize(F.col("text"))).where(F.length("text") >= 4)
    seed = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.col("text"))
    parts = T.claim_parts(F.col("text"))
    return rows.select(
        "doc_id", "pos", T.stable_id("claim", seed).alias("claim_id"), T.stable_id("evidence", seed).alias("evidence_id"), "text",
        *[parts[k].alias(k) for k in ("action", "method", "result")], F.array_join(parts["missing"], "|").alias("missing"),
        F.when(F.col("sourced"), SOURCED).otherwise(UNSOURCED).alias("confidence"), F.lit("resume_only").alias("status"),
    )


def assessed(claims: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status and confidence of (claim_id, sourced) from linked (evidence_id, kind, verified).

    Evidence is folded to three flags for each claim before it meets the claims,
    so a claim with very many assets is aggregated on the map side.
    """
    kind, sure = F.col("kind"), F.col("verified")
    flags = links.join(evidence, "evidence_id").groupBy("claim_id").agg(
        F.bool_or(~kind.isin("resume_text", "user_statement") & sure).alias("independent"),
        F.bool_or((kind == "user_statement") & sure).alias("confirmed"),
        F.bool_or(kind == "resume_text").alias("resume"),
    )
    no = F.lit(False)
    status = (
        F.when(F.coalesce("independent", no), "supported").when(F.coalesce("confirmed", no), "user_confirmed")
        .when(F.coalesce("resume", no) | F.col("sourced"), "resume_only").otherwise("needs_evidence")
    )
    return claims.join(flags, "claim_id", "left").select("claim_id", status.alias("status")).withColumn("confidence", by_status(F.col("status")))


def by_status(status: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def conflicts(claims: DataFrame, within: str) -> DataFrame:
    """Pairs of claims of one ``within`` that share two keywords and no number, though both have numbers.

    Claims without numbers are dropped first. The pairs come from an inverted index
    (within, keyword), so only claims with a keyword in common meet; numbers are
    compared on the pairs alone.
    """
    rows = claims.select(within, "pos", T.keywords(F.col("text")).alias("words"), F.array_sort(T.numbers(F.col("text"))).alias("nums")).where(F.size("nums") > 0)
    index = rows.select(within, "pos", F.explode("words").alias("word"))
    a, b = index.alias("a"), index.alias("b")
    same = (F.col(f"a.{within}") == F.col(f"b.{within}")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.pos") < F.col("b.pos"))
    pairs = a.join(b, same).groupBy(F.col(f"a.{within}").alias(within), F.col("a.pos").alias("left_pos"), F.col("b.pos").alias("right_pos")).agg(F.count("*").alias("shared")).where("shared >= 2")
    left = rows.select(within, F.col("pos").alias("left_pos"), F.col("nums").alias("left_nums"))
    right = rows.select(within, F.col("pos").alias("right_pos"), F.col("nums").alias("right_nums"))
    found = pairs.join(left, [within, "left_pos"]).join(right, [within, "right_pos"]).where(~F.arrays_overlap("left_nums", "right_nums"))
    return found.select(within, "left_pos", "right_pos", "shared", F.array_join("left_nums", ",").alias("left_numbers"), F.array_join("right_nums", ",").alias("right_numbers"))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, shared) of all pairs of (id, words) that share a word, by an inverted index.

    The counts are combined on the map side; a word on very many rows is a skewed
    join key, which adaptive execution splits.
    """
    a = left.select(F.col("id").alias("left_id"), F.explode("words").alias("word"))
    b = right.select(F.col("id").alias("right_id"), F.explode("words").alias("word"))
    return a.join(b, "word").groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def top_claims(pairs: DataFrame, k: int) -> DataFrame:
    """The k right rows with most shared words for each left one, ties to the smaller id."""
    order = Window.partitionBy("left_id").orderBy(F.desc("shared"), "right_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, best): the most words that any right row shares with each left one, of (id, words) on both sides.

    Left rows with the same words are looked up once. The left side's index goes to
    every task and the pairs are counted where their right row is, so no pair is shuffled.
    """
    rows = left.select("id", F.array_sort("words").alias("words"))
    index = rows.select("words").distinct().select("words", F.explode("words").alias("word"))
    texts = right.select(F.col("id").alias("right_id"), "words").repartition("right_id").select("right_id", F.explode("words").alias("word"))
    counts = texts.join(F.broadcast(index), "word").groupBy("right_id", "words").agg(F.count("*").alias("shared"))
    best = counts.groupBy("words").agg(F.max("shared").alias("best"))
    return rows.join(best, "words").select(F.col("id").alias("left_id"), "best")


def matched(requirements: DataFrame, claims: DataFrame, conflicting: DataFrame) -> DataFrame:
    """Status of each (id, words, n_words, importance) requirement against all (id, words) claims.

    ``conflicting`` are the claims, likewise with their words, that contradict what they share a word with.
    """
    denied = conflicting.select(F.explode("words").alias("word")).distinct()
    bad = requirements.select(F.col("id").alias("left_id"), F.explode("words").alias("word")).join(denied, "word", "left_semi").select("left_id").distinct().withColumn("conflict", F.lit(True))
    best = best_overlaps(requirements, claims)
    rows = requirements.join(best, F.col("id") == F.col("left_id"), "left").drop("left_id").join(bad, F.col("id") == F.col("left_id"), "left")
    enough = F.col("best") >= F.least(F.lit(2), F.greatest(F.lit(1), F.col("n_words")))
    status = F.when(F.col("conflict"), "conflict").when(F.col("best").isNull(), "gap").when(enough, "met").otherwise("partial")
    return rows.select("id", "importance", F.coalesce("best", F.lit(0)).alias("best"), status.alias("status"))


def coverage(status: Column, weight: Column) -> Column:
    """Weighted share of met requirements, partial ones half, in percent; 0 without weight."""
    part = F.sum(weight * F.when(status == "met", 1.0).when(status == "partial", 0.5).otherwise(0.0))
    return F.coalesce(T.half_up(part / F.nullif(F.sum(weight), F.lit(0.0)) * 100, 1), F.lit(0.0))
