"""Small rules as Column expressions and aggregates: text, dates, names, follow-ups, structure of lines, order changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import lines

# Fixed values ------------------------------------------------------------------------------
TECHNICAL = r"[A-Za-z][A-Za-z0-9.+#_-]{1,40}"
MEASURED = r"(?i)\d+(?:\.\d+)?\s*(?:ms|qps|rps|s|%|％|万|亿)?"
MOST_TERMS = 60
FONT_WEIGHTS = [(["thin"], 100), (["extralight", "ultralight"], 200), (["light"], 300), (["medium"], 500), (["semibold", "demibold"], 600), (["extrabold", "ultrabold"], 800), (["black", "heavy"], 900), (["bold"], 700)]
PLAIN_WEIGHT = 400
TARGET_LABEL = r"(?i)^(.*?(?:求职意向|目标岗位|target\s+(?:role|position))\s*[:：]\s*).*$"
FACTS = ["resume_only", "user_confirmed", "supported"]
LEAST_CONFIDENCE = 0.75
PAGE_VISIBLE, PAGE_STRONG, PAGE_RANGE, PAGE_DEVIATION, TEXT_RANGE, TEXT_DEVIATION = 0.001, 0.0005, 32, 2, 24, 2
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
MOBILE = r"(?:^|[^0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}(?:$|[^0-9])"
URL = r"(?i)(?:https?://|www\.|linkedin\.com|github\.com)[^\s,，;；]+"
NAME_MOST, HEADLINE_MOST, FILE_MOST, FILE_DEFAULT = 80, 160, 180, "resume.pdf"
DAY_MS = 24 * 3_600_000
# -------------------------------------------------------------------------------------------


def preserved_terms(text: Column) -> Column:
    """Technical terms, measured values without spaces, and numbers of a text: each once, in that order, at most MOST_TERMS."""
    measured = F.transform(F.regexp_extract_all(text, F.lit(MEASURED), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.slice(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(TECHNICAL), F.lit(0)), measured, T.numbers(text))), 1, MOST_TERMS)


def font_weight(name: Column) -> Column:
    """The weight that a font's name tells; null without a name."""
    plain, out = F.regexp_replace(F.lower(name), "[^a-z0-9]+", ""), F.lit(PLAIN_WEIGHT)
    for parts, weight in reversed(FONT_WEIGHTS):
        out = F.when(plain.rlike("|".join(parts)), weight).otherwise(out)
    return F.when(F.length(name) > 0, out)


def font_style(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.when(F.lower(name).rlike("italic|oblique"), "italic").otherwise("normal"))


def entry_date(start: Column, end: Column, current: Column) -> Column:
    """``start - end``, the end being 至今 for what goes on; empty without start and end."""
    start, end = F.nullif(start, F.lit("")), F.nullif(end, F.lit(""))
    return F.when(start.isNull() & end.isNull(), "").otherwise(F.concat_ws(" - ", start, F.coalesce(end, F.when(current, "至今"))))


def headline(current: Column, title: Column) -> Column:
    """The title, behind the label of a target role if the present headline has one."""
    label = F.regexp_extract(F.trim(F.coalesce(current, F.lit(""))), TARGET_LABEL, 1)
    return F.concat(label, F.trim(title))


def locale_fits(prompt: Column, locale: Column) -> Column:
    """Whether a prompt's scripts are those of its locale."""
    han, latin = prompt.rlike(r"\p{IsHan}"), prompt.rlike(r"\p{IsLatin}")
    return F.when(locale == "en-US", latin & ~han).when(locale == "mixed", han & latin).otherwise(han)


def progress(share: Column) -> Column:
    """The percentage to show when ``share`` of the expected time is over: ever slower, never done."""
    left = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    return F.least(F.lit(99), F.floor(1 + 98 * (1 - left * left))).cast("long")


def enhanced(version: Column, capability: str) -> Column:
    """Whether a source version ``capability@major.…`` is of major version 2 or more."""
    major = F.regexp_extract(version, rf"^\Q{capability}\E@(\d+)\.", 1)
    return F.coalesce(major.try_cast("int") >= 2, F.lit(False))


def expiry(declared: Column, now: Column, keep_ms: int = DAY_MS) -> Column:
    """Milliseconds at which a record ends: as declared, but never after ``now`` + ``keep_ms``; that if the text is no time."""
    told = F.unix_millis(F.try_to_timestamp(declared))
    return F.least(F.coalesce(told, now + keep_ms), now + keep_ms)


def answers_differently(answer: Column, original: Column) -> Column:
    """Whether an answer has two characters or more and is not the original, white space aside."""
    a = T.normalize(answer)
    return (F.length(a) >= 2) & ~a.eqNullSafe(T.normalize(original))


def next_follow_up(candidates: Column, asked: Column, most: Column) -> Column:
    """The first candidate with text that was not asked yet; null if none, or if ``most`` were asked."""
    trimmed = F.transform(candidates, lambda x: F.trim(x))
    left = F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & ~F.array_contains(asked, x))
    return F.when(F.size(asked) < most, F.try_element_at(left, F.lit(1)))


def question_cursor(questions: DataFrame, most: Column) -> DataFrame:
    """(plan, cursor) of (plan, idx, evaluated, pending): the first question without evaluation or with a follow-up left, else how many there are."""
    open_ = ~F.col("evaluated") | (F.col("pending") & (most > 0))
    return questions.groupBy("plan").agg(F.coalesce(F.min(F.when(open_, F.col("idx"))), F.count("*")).alias("cursor"))


def similarity(a: Column, b: Column) -> Column:
    """Dice's coefficient of the sets of 3-grams of two compact texts; their lengths' ratio where one of 8 or more is in the other."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    size = F.least(F.lit(3), short)

    def grams(x: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substr(x, i, size)))

    held = F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
    dice = 2.0 * F.size(F.array_intersect(grams(a), grams(b))) / (F.size(grams(a)) + F.size(grams(b)))
    return F.when(short == 0, 0.0).when(a == b, 1.0).when((short >= 8) & held, short / long).otherwise(dice)


def compacted(text: Column) -> Column:
    """Lower case without punctuation, symbols and white space."""
    return F.regexp_replace(F.lower(text), rf"[\p{{P}}\p{{S}}{T.SPACE}]+", "")


def search_key(text: Column) -> Column:
    """Lower case, everything but letters and numbers as one space; for compatibility forms apply ``unicode.nfkc`` before."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def distinct_texts(texts: Column) -> Column:
    """Texts that differ in more than white space, each once in its normalised form; empty ones go."""
    return F.array_distinct(F.filter(F.transform(texts, T.normalize), lambda x: x != ""))


def file_name(name: Column) -> Column:
    """The last part of a path without control characters, at most FILE_MOST characters; FILE_DEFAULT if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(FILE_DEFAULT)), r"\\", "/"), "([^/]*)/*$", 1)
    cleaned = F.regexp_replace(base, r"[\p{C}\p{Z}&&[^ ]]", "")
    return F.substring(F.when(cleaned == "", FILE_DEFAULT).otherwise(cleaned), 1, FILE_MOST)


def visible_page(n: Column, visible: Column, strong: Column, spread: Column, deviation: Column) -> Column:
    return (n > 0) & (visible >= PAGE_VISIBLE) & (strong >= PAGE_STRONG) & (spread >= PAGE_RANGE) & (deviation >= PAGE_DEVIATION)


def visible_text(n: Column, spread: Column, deviation: Column) -> Column:
    return (n > 0) & (spread >= TEXT_RANGE) & (deviation >= TEXT_DEVIATION)


def valid_share(text: Column) -> Column:
    """Share of a text's characters outside white space that are neither control, unassigned, private nor replacement; 0 without any."""
    all_ = F.regexp_count(text, F.lit(rf"[^{T.SPACE}]"))
    return F.when(all_ > 0, F.regexp_count(text, F.lit(rf"[^{T.SPACE}\p{{C}}\x{{FFFD}}]")) / all_).otherwise(0.0)


def area_share(boxes: DataFrame, page: str, area: Column) -> DataFrame:
    """(page, share): the boxes' (x0, top, x1, bottom) areas over the page's, within 0 and 1; overlaps count twice."""
    own = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("bottom") - F.col("top"), F.lit(0.0))
    share = F.least(F.greatest(F.sum(own) / F.max(area), F.lit(0.0)), F.lit(1.0))
    return boxes.groupBy(page).agg(F.when(F.max(area) > 0, share).otherwise(0.0).alias("share"))


def structured(rows: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, t) with the section and the entry that each is in.

    A line that names a section starts it and belongs to no entry; lines before the
    first are the preamble, section 0. Within a section a line with a date starts an
    entry if one of the entry's lines before has a date, so the first date splits none.
    """
    kind, dated = lines.section_type(F.col("t")), F.regexp_extract("t", lines.DATE, 0) != ""
    rows = rows.withColumn("type", kind).withColumn("section", F.count("type").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.last("type", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    dates = F.count_if(dated & F.col("type").isNull()).over(Window.partitionBy(key, "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("kind", head).withColumn("entry", F.when(F.col("type").isNull(), F.greatest(dates - 1, F.lit(0)))).withColumn("heading", F.col("type").isNotNull()).drop("type")


def contacts(rows: DataFrame, key: str) -> DataFrame:
    """(key, email, phone, url, label, name, headline) of lines (key, pos, t).

    The first line with an address, number or link tells each; of the lines before the
    first section that have none of these and no date, the first short one is the name
    and the next the headline.
    """
    def first(pattern: str, group: int = 0) -> Column:
        found = F.regexp_extract("t", pattern, group)
        return F.min(F.when(found != "", F.struct("pos", found.alias("x"))))["x"]

    plain = ~F.col("t").rlike(f"{EMAIL}|{MOBILE}|{URL}") & (F.regexp_extract("t", lines.DATE, 0) == "") & (F.trim("t") != "")
    section = F.count(lines.section_type(F.col("t"))).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("candidate", plain & (section == 0) & (F.length("t") <= HEADLINE_MOST)).withColumn("short", F.col("candidate") & (F.length("t") <= NAME_MOST))
    named = F.min(F.when(F.col("short"), F.col("pos"))).over(Window.partitionBy(key))
    rows = rows.withColumn("named", named)
    link = F.col("url")
    label = F.when(F.contains(link, F.lit("linkedin")), "LinkedIn").when(F.contains(link, F.lit("github")), "GitHub").when(link.isNotNull(), "Link")
    found = rows.groupBy(key).agg(
        first(EMAIL).alias("email"), first(MOBILE).alias("phone"), first(URL).alias("url"), F.min(F.when(F.col("pos") == F.col("named"), F.col("t"))).alias("name"),
        F.min(F.when(F.col("candidate") & ~F.col("pos").eqNullSafe(F.col("named")), F.struct("pos", "t")))["t"].alias("headline"),
    )
    return found.withColumn("phone", F.regexp_replace("phone", r"^[^0-9+]|[^0-9]$", "")).withColumn("label", label)


def merged_role(heading: Column, contact: Column, item: Column, given: Column) -> Column:
    """A block's role: heading before contact before list item before the role it was given, else paragraph."""
    return F.when(heading, "heading").when(contact, "contact").when(item, "list-item").when(given != "unknown", given).otherwise("paragraph")


def first_equal(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """``rows`` (id, text) with ``claim``, the least of ``claims`` (claim, text) whose text is the same, white space aside.

    Claims are first cut down to one for each text, with partial sums before the shuffle.
    """
    first = claims.select("claim", T.normalize(F.col("text")).alias("k")).groupBy("k").agg(F.min("claim").alias("claim"))
    return rows.withColumn("k", T.normalize(F.col("text"))).join(first, "k", "left").drop("k")


def order_changes(rows: DataFrame, key: str, before: list[Column], after: list[Column]) -> DataFrame:
    """(key, before, after): the ids of each group in both orders, where these differ."""
    both = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*before, "id"))).alias("b"), F.array_sort(F.collect_list(F.struct(*after, "id"))).alias("a"))
    ids = both.select(key, F.transform("b", lambda x: x["id"]).alias("before"), F.transform("a", lambda x: x["id"]).alias("after"))
    return ids.where(F.col("before") != F.col("after"))


def one_click(rows: DataFrame) -> DataFrame:
    """Suggestions that may be taken at once: pending, of the current revision, rewrites that change the text as it still stands, by a model."""
    q = F.col
    changed = (F.trim(F.coalesce("proposed", F.lit(""))) != "") & ~q("proposed").eqNullSafe(q("original")) & (q("before_hash") == q("now_hash"))
    return rows.where((q("source") == "ai") & (q("status") == "pending") & (q("revision") == q("current")) & (q("kind") == "rewrite") & changed)


def rebound(rows: DataFrame) -> DataFrame:
    """Suggestions after an edit: a pending one whose text has changed since is stale; others go to the new revision."""
    gone = (F.col("status") == "pending") & ~F.col("before_hash").eqNullSafe(F.col("now_hash"))
    return rows.withColumn("status", F.when(gone, "stale").otherwise(F.col("status"))).withColumn("revision", F.when(F.col("status") == "pending", F.col("current")).otherwise(F.col("revision")))
