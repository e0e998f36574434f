"""Quality rules with risk-controlled thresholds.

Each rule is a score of a text, higher being worse. Labelled rows give, for every
stratum and rule, how many good and bad texts lie at each score. Going down from
the largest score, a cutoff is accepted while the exact binomial (Clopper-Pearson)
upper bound on the share of good texts at or above it stays within the rule's part
of the allowed risk. Stopping at the first cutoff that fails makes the walk one
test, so only strata and rules have to be corrected for (Bonferroni).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import store
from quillmark.llm.text import WORD_CHARACTER, Texts, bytes_table, mix, slices

_SYMBOLS, _BANG = bytes_table("#*$%&|<>"), bytes_table("!")
_UPPER, _LOWER = bytes_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), bytes_table("abcdefghijklmnopqrstuvwxyz")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bang", "n_upper", "n_lower")
#: Scores are whole numbers from 0 to BINS, so what the labels gather is bounded.
BINS = 200
#: Share of a stratum's good texts that all rules together may reject, and the chance of being wrong on that.
RISK, CONFIDENCE = 0.05, 0.95
#: Bad texts that must be caught for each good one that is lost.
COST = 10


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for every text of an Arrow column; null counts as empty."""
    made = {name: np.zeros(len(column), np.int64) for name in COUNTS}
    for first, n in slices(column):
        for name, values in _counts(Texts(column.slice(first, n))).items():
            made[name][first : first + n] = values
    return made


def _counts(texts: Texts) -> dict[str, np.ndarray]:
    words = texts.words(lower=False)
    doc = words.doc()
    starts, ends, at = texts.lines()
    held = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    line = mix(texts.spans(starts[held], ends[held]) + mix(at[held].astype(np.uint64)))
    own = at[held]
    _, once = np.unique(line, return_index=True)
    distinct = np.bincount(own[once], minlength=texts.n)
    lines = np.bincount(own, minlength=texts.n)
    grams = words.grams(3)
    whole = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    _, kind, times = np.unique(mix(grams[whole] + mix(doc[whole].astype(np.uint64))), return_inverse=True, return_counts=True)
    again = whole[times[kind] > 1]
    repeat = np.zeros(len(doc), bool)
    for k in range(3):
        repeat[again + k] = True
    return {
        "n_words": words.counts, "word_chars": texts.count(WORD_CHARACTER), "n_symbols": texts.count(_SYMBOLS), "n_dup_lines": lines - distinct,
        "n_repeat_words": np.bincount(doc[repeat], minlength=texts.n), "n_lines": lines, "n_bang": texts.count(_BANG), "n_upper": texts.count(_UPPER), "n_lower": texts.count(_LOWER),
    }


def counted(docs: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with COUNTS, and without its text unless asked for; columns named like a count are replaced.

    A null text counts as empty; texts are taken whole, repeated rows alike.
    """
    kept = [f for f in docs.schema.fields if f.name not in COUNTS and (with_text or f.name != text)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = counts_of(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[c]) for c in COUNTS)], [*(f.name for f in kept), *COUNTS])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule's score over COUNTS, from 0 to BINS."""
    def share(part: Column, of: Column, top: float) -> Column:
        return F.least(F.lit(BINS), F.floor(F.lit(float(BINS)) * (part.cast("double") / F.greatest(of, F.lit(1)) / top))).cast("int")

    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "symbols": share(F.col("n_symbols"), F.col("n_words"), 4.0),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines"), 1.0),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words"), 1.0),
        "capitals": share(F.col("n_upper"), letters, 1.0),
        "bangs": share(F.col("n_bang"), F.col("n_words"), 2.0),
    }


def risk_bound(errors: int, n: int, delta: float) -> float:
    """The Clopper-Pearson upper bound: the share p at which so few errors have probability ``delta``."""
    if n == 0 or errors >= n:
        return 1.0
    if errors == 0:
        return 1.0 - delta ** (1.0 / n)
    low, high = errors / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if _at_most(errors, n, p) > delta:
            low = p
        else:
            high = p
    return high


def _at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p) with p at or above k / n, from the largest term down."""
    if p >= 1.0:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        if term < 1e-18 * total:
            break
    return total


def cutoff(good: list[int], bad: list[int], risk: float, delta: float) -> int | None:
    """The accepted cutoff for one rule that serves best; None if none catches more than it costs.

    ``good`` and ``bad`` count texts by score, 0 to BINS. Among accepted cutoffs
    (all of which keep the guarantee) that with the most bad texts less COST times
    the good ones is taken, the highest of equals.
    """
    n, errors, caught, best, found = sum(good), 0, 0, 0, None
    for score in range(BINS, 0, -1):
        errors += good[score]
        if risk_bound(errors, n, delta) > risk:
            break
        caught += bad[score]
        if caught - COST * errors > best:
            best, found = caught - COST * errors, score
    return found


def thresholds(counts: DataFrame, labels: DataFrame, label: str, stratum: str, key: str = "doc_id", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """(__stratum, __cutoffs), a map from rule to cutoff, from all labelled rows. 1 marks a good text.

    Every stratum with labels is judged; those without an accepted cutoff have no
    row. Rows with a null key or label are left out; a key labelled twice is good
    only if all its labels are. A null stratum is a stratum by itself (``""``).
    Texts that fail the base rules are not judged by the learned ones, so they
    don't count here. The table is saved, so ``counts`` is not read again.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(F.col(label).cast("int")).alias("__good"))
    scores = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("score")) for r, s in rules().items()]))
    rows = counts.where(~base_failed()).select(key, F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), scores.alias("s")).join(known, key)
    cells = store.saved(rows.groupBy("stratum", "s.rule", "s.score").agg(F.count_if(F.col("__good") != 0).alias("good"), F.count_if(F.col("__good") == 0).alias("bad")), "quality_cells")
    part, delta = risk / len(rules()), (1 - confidence) / max(1, cells.select("stratum").distinct().count() * len(rules()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                good, bad = [0] * (BINS + 1), [0] * (BINS + 1)
                for c in r["cells"]:
                    good[c["score"]], bad[c["score"]] = c["good"], c["bad"]
                found.append((r["stratum"], r["rule"], cutoff(good, bad, part, delta)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), pa.int32()))] if found else [pa.array([], t) for t in (pa.string(), pa.string(), pa.int32())], ["stratum", "rule", "at"])

    hists = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("score", "good", "bad")).alias("cells"))
    kept = hists.mapInArrow(run, "stratum string, rule string, at int").where("at is not null")
    out = store.saved(kept.groupBy(F.col("stratum").alias("__stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "at"))).alias("__cutoffs")), "quality_cutoffs")
    store.dropped(cells)
    return out


def judged(docs: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``docs`` with ``__rejected``: whether a rule's score reaches the cutoff of the row's stratum."""
    rows = docs.join(F.broadcast(cutoffs), F.coalesce(F.col(stratum), F.lit("")) == F.col("__stratum"), "left")
    made = F.lit(False)
    for rule, score in rules().items():
        made = made | F.coalesce(score >= F.try_element_at("__cutoffs", F.lit(rule)), F.lit(False))
    return rows.withColumn("__rejected", made).drop("__stratum", "__cutoffs")


def filtered(docs: DataFrame, labels: DataFrame, label: str, stratum: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the learned cutoffs, with their own columns, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, stratum, text = (f"c{names.index(c)}" for c in (key, stratum, text))
    counts = store.saved(counted(plain.select(key, stratum, text), text), "quality")
    cutoffs = thresholds(counts, labels.select(F.col(f"`{names[int(key[1:])]}`").alias(key), label), label, stratum, key)
    store.dropped(counts)
    return counted(plain, text, with_text=True).where(~base_failed()).transform(judged, cutoffs, stratum).where("not __rejected").select(*plain.columns).toDF(*names)
