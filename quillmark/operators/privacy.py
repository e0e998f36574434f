"""Redaction of personal data and detection of instructions in untrusted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values: (type, pattern, placeholder), applied in this order. ----------------------
_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
PII_RULES = [
    ("email", rf"{_EDGE}(?i:[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}){_END}", "[EMAIL]"),
    ("id_number", r"(?<!\d)\d{17}[\dXx](?!\d)", "[ID_NUMBER]"),
    ("phone", r"(?<!\d)(?:\+?86[-\s]?)?1[3-9]\d{9}(?!\d)|(?<!\d)(?:\+?\d{1,3}[-\s]?)?(?:\d[-\s]?){7,12}(?!\d)", "[PHONE]"),
    ("address", r"(?i:地址|住址|Address)\s*[：:]\s*[^\n,，;；]{6,80}", "[ADDRESS]"),
    ("url", rf"{_EDGE}(?i:https?)://[^\s<>{{}}\[\]\"']+", "[URL]"),
]
#: (code, pattern) of instructions that untrusted text must not give.
INSTRUCTIONS = [
    ("IGNORE_INSTRUCTIONS", "ignore (?:all |any )?(?:previous|prior|system) instructions?|忽略(?:之前|以上|系统)(?:的)?(?:指令|要求)"),
    ("ROLE_OVERRIDE", "you are now|act as (?:a|an)|你现在是|扮演(?:一个)?"),
    ("SECRET_REQUEST", "system prompt|developer message|api key|系统提示词|开发者消息|密钥"),
    ("TOOL_INSTRUCTION", "run (?:this )?(?:command|tool)|execute (?:a )?command|运行(?:这个)?命令|调用(?:这个)?工具"),
]
# -----------------------------------------------------------------------------------------


def redact(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the redacted text in place and a count column ``n_<type>`` for each type.

    The steps are columns of their own, so each regular expression runs once.
    """
    for kind, pattern, placeholder in PII_RULES:
        rows = rows.withColumn(f"n_{kind}", F.regexp_count(F.col(text), F.lit(pattern))).withColumn(text, F.regexp_replace(F.col(text), pattern, placeholder))
    return rows


def instructions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, pos, excerpt): every match of every instruction pattern, in order."""
    def matches(code: str, pattern: str) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(f"(?i){pattern}"), F.lit(0))
        return F.transform(every, lambda m, i: F.struct(F.lit(code).alias("code"), i.alias("pos"), m.alias("m")))

    found = F.flatten(F.array(*[matches(code, pattern) for code, pattern in INSTRUCTIONS]))
    return rows.select(key, F.inline(found)).select(key, "code", "pos", T.excerpt(F.col("m"), 80).alias("excerpt"))
