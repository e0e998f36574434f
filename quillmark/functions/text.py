"""Scalar text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------
#: White space as browsers' regular expressions have it, for use inside a class.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
STOP_WORDS = ["and", "the", "with", "for", "from", "that", "this", "your", "you", "our", "are", "will", "工作", "负责", "相关", "以及", "进行", "能够", "具备", "要求", "岗位"]
LATIN_TOKEN = r"[a-z][a-z0-9+#.]{1,}"
METHOD_WORDS = "通过|采用|使用|利用|基于|using|via|with"
MISSING_METHOD, MISSING_RESULT = "具体方法或个人动作", "可核实的结果或影响"
UNTRUSTED_OPEN, UNTRUSTED_CLOSE = "[UNTRUSTED_DOCUMENT_DATA]", "[/UNTRUSTED_DOCUMENT_DATA]"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
# ------------------------------------------------------------------------------

HAN_TOKEN = r"\p{IsHan}{2,6}"
#: A number at ASCII word edges; Java's own \b would count Han characters as word characters.
NUMBER = r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?:%(?=[A-Za-z0-9_])|(?![A-Za-z0-9_]))"


def normalize(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def keywords(text: Column) -> Column:
    """Latin tokens in lower case, then Han runs, each once in order of appearance, without stop words."""
    found = F.concat(F.regexp_extract_all(F.lower(text), F.lit(LATIN_TOKEN), F.lit(0)), F.regexp_extract_all(text, F.lit(HAN_TOKEN), F.lit(0)))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def overlap(left: Column, right: Column) -> Column:
    """Tokens of ``left`` that ``right`` has, in the order of ``left``."""
    return F.array_intersect(left, right)


def numbers(text: Column) -> Column:
    """Distinct numeric tokens in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def statements(text: Column) -> Column:
    """Normalised pieces of at least four characters between newlines, statement marks and sentence ends."""
    pieces = F.split(text, rf"\r?\n|[。；;]|(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(pieces, normalize), lambda s: F.length(s) >= 4)


def excerpt(text: Column, most: int = 80) -> Column:
    """The normalised text, cut to ``most`` characters with an ellipsis as the last."""
    whole = normalize(text)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, 1, most - 1), F.lit("…")))


def stable_id(prefix: str, text: Column) -> Column:
    """``prefix_`` and the 32-bit FNV-1a hash of the UTF-16 units in base 36."""
    def fold(h: Column, unit: Column) -> Column:
        return h.bitwiseXOR(unit) * F.lit(FNV_PRIME) % F.lit(1 << 32)

    def step(h: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        high, low = F.shiftright(point - 0x10000, 10) + 0xD800, (point - 0x10000) % 1024 + 0xDC00
        return F.when(point < 0x10000, fold(h, point)).otherwise(fold(fold(h, high), low))

    hashed = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), step)
    return F.concat(F.lit(prefix + "_"), F.lower(F.conv(hashed.cast("string"), 10, 36)))


def method(text: Column) -> Column:
    """The first method phrase of a normalised text; null if none."""
    found = F.regexp_extract(text, rf"(?i)(?:{METHOD_WORDS})[{SPACE}]*[^，,。.;；]+", 0)
    return F.when(found != "", found)


def claim_parts(text: Column) -> dict[str, Column]:
    """Action, method, result and the codes of what is missing, of a normalised text."""
    how, metric = method(text), F.size(numbers(text)) > 0
    missing = F.array_compact(F.array(F.when(how.isNull(), MISSING_METHOD), F.when(~metric, MISSING_RESULT)))
    return {"action": excerpt(text, 70), "method": how, "result": F.when(metric, excerpt(text, 100)), "missing": missing}


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding of halves towards positive infinity, on the binary value."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def wrapped(text: Column) -> Column:
    return F.concat(F.lit(UNTRUSTED_OPEN + "\n"), text, F.lit("\n" + UNTRUSTED_CLOSE))


def unwrapped(text: Column) -> Column:
    head, tail = UNTRUSTED_OPEN + "\n", "\n" + UNTRUSTED_CLOSE
    inner = F.substring(text, len(head) + 1, F.greatest(F.length(text) - len(head) - len(tail), F.lit(0)))
    return F.when(text.startswith(head) & text.endswith(tail), inner).otherwise(text)


def answer_length(text: Column) -> Column:
    """Latin words plus half the Han characters, rounded up."""
    return (F.regexp_count(text, F.lit("[A-Za-z0-9]+")) + F.ceil(F.regexp_count(text, F.lit(r"\p{IsHan}")) / 2)).cast("int")
