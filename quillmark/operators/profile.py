"""Roles of text blocks and seniority of titles, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Fixed values ------------------------------------------------------------------------------
FOOTER_FROM, HEADING_MOST, HEADING_WEIGHT = 0.94, 32, 600
CONTACT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|(?:\+?86[- ]?)?1[3-9]\d{9}"
BULLET = r"^\s*(?:[•·●▪*]|[-–—]\s|\d+[.)、]\s*)"
HEADING_WORDS = "经历|教育|技能|项目|证书|奖项|简介|experience|education|skills?|projects?|summary|profile"
SENIORITY = [("intern", "intern|实习"), ("entry", "entry|junior|初级|应届"), ("mid", "mid|中级"), ("senior", "senior|高级|资深"), ("lead", "lead|head|负责人|专家"), ("executive", "executive|director|vp|总监|高管")]
# -------------------------------------------------------------------------------------------


def role(text: Column, y: Column, weight: Column) -> Column:
    """Footer, contact, list item, heading or paragraph, whichever rule fits first."""
    heading = (F.length(text) <= HEADING_MOST) & ~text.rlike("[。.!?？！；;，,]$") & (text.rlike(f"(?i){HEADING_WORDS}") | (weight >= HEADING_WEIGHT))
    return F.when(y >= FOOTER_FROM, "footer").when(text.rlike(CONTACT), "contact").when(text.rlike(BULLET), "list-item").when(heading, "heading").otherwise("paragraph")


def sql_role(text: str, y: str, weight: str) -> str:
    return f"""CASE WHEN {y} >= {FOOTER_FROM} THEN 'footer' WHEN regexp_matches({text}, '{CONTACT}') THEN 'contact' WHEN regexp_matches({text}, '{BULLET}') THEN 'list-item'
  WHEN length({text}) <= {HEADING_MOST} AND NOT regexp_matches({text}, '[。.!?？！；;，,]$') AND (regexp_matches({text}, '(?i){HEADING_WORDS}') OR {weight} >= {HEADING_WEIGHT}) THEN 'heading' ELSE 'paragraph' END"""


def seniority(title: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(SENIORITY):
        out = F.when(F.lower(T.normalize(title)).rlike(pattern), name).otherwise(out)
    return out


def sql_seniority(title: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({title}), '{p}') THEN '{n}'" for n, p in SENIORITY) + " ELSE '' END"
