"""Readers of text-like sources, through Spark's own data sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import lines

WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"
LEAST_CONFIDENCE = 0.0


def recognised_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's TSV: rows with text and a confidence, which becomes a share of 1."""
    rows = spark.read.schema(WORDS).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.where((F.trim("text") != "") & (F.col("conf") >= LEAST_CONFIDENCE)).withColumn("conf", F.col("conf") / 100)


def markdown_units(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, title, body) of Markdown files with a front matter of ``key: value`` lines."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    return rows.select("file", F.trim(F.regexp_extract(front, r"(?m)^id:\s*(.*)$", 1)).alias("id"), F.trim(F.regexp_extract(front, r"(?m)^title:\s*(.*)$", 1)).alias("title"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def sections(units: DataFrame, titles: list[str]) -> DataFrame:
    """The plain text of each named section of ``markdown_units`` rows."""
    return units.select("file", "id", *[lines.plain(lines.section(F.col("body"), t)).alias(t) for t in titles])


def mismatched(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that only one of a listing and the files has, and which."""
    a, b = listed.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only", F.lit("listed")).unionByName(b.join(a, key, "left_anti").withColumn("only", F.lit("found")))
