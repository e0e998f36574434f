"""URL filter: logistic regression on hashed character n-grams of host and path, and listed rules.

Everything is a DataFrame or SQL expression: n-grams by ``transform``, hashing by
``md5``, training by a fold over a small labelled table, scoring by looking the
weights up in a constant array.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
EPOCHS = 5
RATE = 1.0
#: The bias takes smaller steps: it is in every row, and the last rows would else decide it.
BIAS_STEP = 0.1
DECAY = 1e-3

_SPAM = "casino poker slots jackpot betting bets wager win pills pharmacy viagra buy cheap loans payday porn adult xxx escort replica discount free winner prize bonus tracker ads clicks popup crypto miracle".split()
_ORDINARY = "library museum garden school hospital weather harbour river council railway kitchen history science music theatre forum wiki docs archive research village sport travel nature market bridge letters news".split()
_SECTIONS = "en de fr es".split()
_SPAM_PATHS, _ORDINARY_PATHS = "click out claim deal go".split(), "guide topic story about visit".split()


def examples(seed: int, each: int) -> list[tuple[str, int]]:
    """Labelled URLs of a seeded grammar: ``each`` of spam, gambling, tracking or the like (1), half as many again ordinary ones (0).

    Two words of a class name the host; a third of the ordinary hosts have a name of
    random syllables, as unfamiliar names are mostly ordinary. Schemes, leading
    labels, suffixes and most paths are drawn alike for both classes.
    """
    made, pick = {}, random.Random(seed).choice

    def coined() -> str:
        return "".join(pick("bcdfghjklmnprstvw") + pick("aeiou") + pick(["", "", "n", "r", "s", "l", "th"]) for _ in range(pick([2, 3, 4])))

    kinds = [(1, _SPAM, _SPAM_PATHS, each), (0, _ORDINARY, _ORDINARY_PATHS, each), (0, None, _ORDINARY_PATHS, each // 2)]
    for label, words, paths, many in kinds:
        goal = len(made) + many
        while len(made) < goal:
            name = words[(goal - len(made)) % len(words)] + pick(["-", ""]) + pick(words) if words else coined()  # each word leads as often
            host = pick(["", "", "www.", "m.", "blog."]) + name + pick([".example.org", ".example.net", ".test"])
            path = f"{pick(_SECTIONS + _SECTIONS + paths)}/{pick(range(1, 1000))}{pick(['', '/', '.html', '?page=2', '#top'])}"
            made[f"{pick(['http', 'https'])}://{host}/{path}"] = label
    return list(made.items())


#: The labelled URL table, of ours: no host is taken from any table.
LABELLED: list[tuple[str, int]] = examples(1, 140)

#: The listed rules: (verdict, host, path prefix).
RULES: list[tuple[str, str, str]] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def grams(text: Column, tag: str, n: int = 4) -> Column:
    """The character n-grams of ``^text$``, marked with ``tag``; texts below n characters give one."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(whole) - (n - 1)))
    return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substring(whole, i, F.lit(n))))


def buckets(host: Column, path: Column, n: int = 4) -> Column:
    """Distinct hashed n-grams of host and path, from 0 to BUCKETS - 1, ascending."""
    every = F.concat(grams(host, "h", n), grams(path, "p", n))
    return F.array_sort(F.array_distinct(F.transform(every, lambda g: (F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))))


def _chance(weights: Column, own: Column) -> Column:
    """The logistic of the bias (last weight) and the bucket weights, scaled by the number of buckets."""
    total = F.aggregate(own, F.lit(0.0), lambda a, b: a + F.element_at(weights, b + F.lit(1)))
    margin = F.element_at(weights, -1) + total / F.sqrt(F.greatest(F.size(own), F.lit(1)).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def trained(labelled: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """Weights (one a bucket, then the bias) by stochastic gradient descent over (url, label).

    The table is a small one by contract; it is folded, in the order of its URLs,
    inside a single expression. Rows with a null url or label are left out.
    """
    own = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select(F.md5(F.col("url").cast("binary")).alias("at"), F.col("label").cast("double").alias("y"), buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("own"))
    share = F.lit(1.0) / F.sqrt(F.greatest(F.size("own"), F.lit(1)).cast("double"))
    places = F.sequence(F.lit(0), F.lit(BUCKETS))
    dense = F.transform(places, lambda i: F.when(i == BUCKETS, F.lit(BIAS_STEP)).when(F.array_contains("own", i), share).otherwise(F.lit(0.0)))
    table = own.agg(F.array_sort(F.collect_list(F.struct("at", "y", "own", dense.alias("dense")))).alias("xs"))
    zero = F.array_repeat(F.lit(0.0), BUCKETS + 1)
    steps = F.flatten(F.array_repeat(F.col("xs"), epochs))

    def step(w: Column, x: Column) -> Column:
        slope = F.lit(rate) * (x["y"] - _chance(w, x["own"]))
        return F.zip_with(w, x["dense"], lambda v, h: v * F.lit(1 - rate * DECAY) + F.when(h > 0, slope * h).otherwise(0.0))

    return list(table.select(F.aggregate(steps, zero, step).alias("w")).first()["w"])


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # a longer one covers a shorter one
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def labelled_table(spark: SparkSession) -> DataFrame:
    """LABELLED as rows, without a detour through Python objects on executors."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judged(pages: DataFrame, url: str, weights: Sequence[float], cut: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    A null url, or one without ``://``, has an empty host and path; no rule fits
    it and the model judges the empty strings. Long urls are judged whole;
    repeated rows each get their verdict. Columns of ``pages`` named like one
    that is added are replaced.
    """
    made = ("host", "path", "rule", "verdict", "score")
    own = [(f"c{i}", c) for i, c in enumerate(pages.columns) if c not in made]
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    at = F.col(f"c{pages.columns.index(url)}")
    parts = plain.select(*[c for c, _ in own], host_of(at).alias("host"), path_of(at).alias("path"))
    rule, say = rule_of(F.col("host"), F.col("path"))
    out = parts.withColumn("score", _chance(F.lit(list(weights)), buckets(F.col("host"), F.col("path"))))
    out = out.withColumn("rule", rule).withColumn("verdict", F.coalesce(say, F.when(F.col("score") >= cut, "block").otherwise("allow")))
    return out.toDF(*[c for _, c in own], *out.columns[len(own) :])
