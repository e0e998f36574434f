"""Characters that a renderer may not show, by ranges of code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values: (label, first, last) of each range of code points ---------------------------
RANGES = [
    ("不可见控制字符", 0x00, 0x08), ("不可见控制字符", 0x0B, 0x0C), ("不可见控制字符", 0x0E, 0x1F), ("不可见控制字符", 0x7F, 0x9F),
    ("不可见格式字符", 0xAD, 0xAD), ("不可见格式字符", 0x200B, 0x200F), ("不可见格式字符", 0x202A, 0x202E), ("不可见格式字符", 0x2060, 0x206F), ("不可见格式字符", 0xFE00, 0xFE0F), ("不可见格式字符", 0xFEFF, 0xFEFF), ("不可见格式字符", 0xE0100, 0xE01EF),
    ("占位方框", 0x25A1, 0x25A1), ("无效替代字符", 0xFFFC, 0xFFFD), ("无效 Unicode 字符", 0xD800, 0xDFFF),
    ("私用字形", 0xE000, 0xF8FF), ("私用字形", 0xF0000, 0xFFFFD), ("私用字形", 0x100000, 0x10FFFD), ("表情或图标字符", 0x1F000, 0x1FAFF), ("表情或图标字符", 0x1FC00, 0x1FFFF),
]
#: Labels of what an exported text may leave out.
OMITTED = ("不可见控制字符", "不可见格式字符", "私用字形", "表情或图标字符")
# -------------------------------------------------------------------------------------------


def label(code_point: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, first, last in RANGES:
        out = F.when(code_point.between(first, last), name).otherwise(out)
    return out


def sql_label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {first} AND {last} THEN '{name}'" for name, first, last in RANGES) + " END"


def unsafe_characters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code_point, label, n): how often each such character occurs in each text.

    Only characters in the ranges are exploded, so ordinary text makes no rows.
    """
    inside = "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for _, first, last in RANGES)
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{inside}]"), F.lit(0))).alias("c"))
    counted = found.groupBy(key, F.ascii("c").alias("code_point")).agg(F.count("*").alias("n"))
    return counted.select(key, "code_point", label(F.col("code_point")).alias("label"), "n")


def exportable(text: Column) -> Column:
    """The text with each omittable character as a space, and white space made single."""
    inside = "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for name, first, last in RANGES if name in OMITTED)
    return T.normalize(F.regexp_replace(text, f"[{inside}]", " "))


def sql_exportable(x: str) -> str:
    inside = "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for name, first, last in RANGES if name in OMITTED)
    return f"trim(regexp_replace(regexp_replace({x}, '[{inside}]', ' ', 'g'), '[{T.SPACE}]+', ' ', 'g'))"
