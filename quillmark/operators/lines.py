"""Line and section level text operators: locale, headings, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

# The names under which a section may stand ---------------------------------
SECTION_NAMES = {
    "summary": ["个人简介", "个人总结", "职业概要", "自我评价", "profile", "summary", "professional summary", "objective"],
    "experience": ["工作经历", "工作经验", "职业经历", "实习经历", "experience", "work experience", "professional experience", "employment"],
    "education": ["教育背景", "教育经历", "学习经历", "education", "academic background"],
    "projects": ["项目经历", "项目经验", "项目实践", "projects", "project experience", "selected projects"],
    "skills": ["核心技能", "专业技能", "技能", "技术栈", "skills", "core skills", "technical skills", "competencies"],
    "certifications": ["证书", "资质证书", "资格证书", "certifications", "licenses"],
    "awards": ["荣誉奖项", "奖项", "荣誉", "awards", "honors"],
    "publications": ["发表论文", "出版物", "论文", "publications", "research"],
    "languages": ["语言能力", "语言", "languages"],
}
DATE = r"(?i)(?:19|20)\d{2}(?:[./-]\d{1,2})?\s*(?:-|--|~|至|to)\s*(?:(?:19|20)\d{2}(?:[./-]\d{1,2})?|至今|现在|present|current)|(?:19|20)\d{2}(?:[./-]\d{1,2})?"
# ------------------------------------------------------------------------------------------


def locale(han: Column, latin: Column) -> Column:
    return F.when((han >= 10) & (latin >= 30), "mixed").when(han > latin * 0.2, "zh-CN").otherwise("en-US")


def located(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with counts of Han and Latin characters and the locale they make likely."""
    counted = docs.withColumn("han", F.regexp_count(F.col(text), F.lit(r"\p{IsHan}"))).withColumn("latin", F.regexp_count(F.col(text), F.lit("[A-Za-z]")))
    return counted.withColumn("locale", locale(F.col("han"), F.col("latin")))


def heading_key(text: Column) -> Column:
    """A heading in lower case without spaces and separators."""
    return F.regexp_replace(F.lower(T.normalize(text)), rf"[{T.SPACE}:：|｜/\\\-_]+", "")


def section_type(text: Column) -> Column:
    """The section that a heading names; null for other lines."""
    names = {name.replace(" ", ""): kind for kind, names in SECTION_NAMES.items() for name in names}
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), heading_key(text))


def section(markdown: Column, title: str) -> Column:
    """The text under ``## title`` up to the next such heading."""
    return F.regexp_extract(markdown, rf"(?s)## {title}\s*\n(.*?)(?:\n## |$)", 1)


def plain(markdown: Column) -> Column:
    """Markdown without links, tags, emphasis and bullets, its white space made single."""
    for pattern, by in _MARKS:
        markdown = F.regexp_replace(markdown, pattern, by.replace("\\1", "$1"))
    return T.normalize(markdown)


_MARKS = [(r"\[([^\]]*)\]\([^)]*\)", "\\1"), (r"<[^>]+>", " "), (r"[*_`]+", ""), (r"(?m)^[ \t]*[-+][ \t]+", "")]


def sql_plain(x: str) -> str:
    for pattern, by in _MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"trim(regexp_replace({x}, '[{T.SPACE}]+', ' ', 'g'))"


def chinese(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"中文[：:]\s*(.*?)\s*English[：:]", 1))


def english(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"English[：:]\s*(.*)", 1))
