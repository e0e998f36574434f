"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted on a bounded sample of the labelled rows, in one task, and
comes back as sparse weights: at most 2**BITS of them, whatever the corpus. Every
text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.text import LETTERS_ONLY, Texts, mix, slices

BITS = 19
#: At most so many labelled rows of each class are fitted on, by the order of a hash of their ids.
SAMPLE = 3000
STEMS = (4, 5)
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1.5, 0.5


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed feature) of words, word pairs and pairs around one word; with repeats.

    A word is a run of letters (or of bytes beyond ASCII), A-Z lower-cased. Its
    first STEMS bytes are features too, so that inflected forms share weight.
    """
    words = texts.words(lower=True, between=LETTERS_ONLY)
    doc, h = words.doc(), words.hashes
    mask = np.uint64((1 << BITS) - 1)
    docs, found = [doc], [mix(h + np.uint64(11)) & mask]
    for size in STEMS:
        long = words.ends - words.starts > size
        docs.append(doc[long])
        found.append(mix(texts.spans(words.starts[long], words.starts[long] + size, lower=True) + np.uint64(100 + size)) & mask)
    for gap, salt in ((1, 13), (2, 17)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        found.append(mix(mix(h[:-gap] + np.uint64(salt)) * np.uint64(3) + h[gap:])[same] & mask)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, float]], seed: int = 5) -> np.ndarray:
    """Weights (2**BITS, then the bias) after EPOCHS passes in a fixed shuffled order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0
    order = np.random.RandomState(seed)

    def weight(i: np.ndarray) -> np.ndarray:
        part = z[i]
        w = -(part - np.sign(part) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(part) <= l1[i]] = 0.0
        return w

    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            own, label = examples[k]
            i = np.append(own, size)
            w = weight(i)
            slope = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            if abs(slope) < 1e-3:
                continue
            step = (np.sqrt(n[i] + slope * slope) - np.sqrt(n[i])) / ALPHA
            z[i] += slope - step * w
            n[i] += slope * slope
    return weight(np.arange(size + 1))


def trained(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the non-zero weights; the bias is feature 2**BITS.

    ``labels`` holds the rows to learn from. Rows with a null key or label, and
    labels without a text, are left out; a key labelled twice counts as 1 if any
    of its labels is. Without usable rows the model is empty and scores 0.5.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__y"))
    picked = [known.where(F.col("__y") == y).orderBy(F.xxhash64(key), key).limit(SAMPLE) for y in (0, 1)]
    rows = docs.select(key, text).join(F.broadcast(picked[0].unionByName(picked[1])), key)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column(1)):
                part = batch.slice(first, n)
                doc, feature = features(Texts(part.column(1)))
                pairs = np.unique(doc << BITS | feature)
                cut = np.searchsorted(pairs, np.arange(n + 1) << BITS)
                own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                blobs = [own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2).cast(pa.int32()), pa.array(blobs, pa.binary())], ["k", "y", "own"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "own"], kind="stable")
        w = ftrl([(np.frombuffer(own, np.int32).astype(np.int64), float(y)) for own, y in zip(pdf["own"], pdf["y"], strict=True)])
        kept = np.flatnonzero(w)
        return pd.DataFrame({"i": [kept.astype(np.int32).tobytes()], "w": [w[kept].tobytes()]})

    found = rows.mapInArrow(extract, "k string, y int, own binary").groupBy().applyInPandas(fit, "i binary, w binary").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.frombuffer(found[0]["i"], np.int32).astype(np.int64), np.frombuffer(found[0]["w"])


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A function from an Arrow text column to scores in (0, 1)."""
    def score(column: pa.Array) -> np.ndarray:
        weights = np.zeros((1 << BITS) + 1)
        weights[model[0]] = model[1]
        out = np.empty(len(column))
        for first, n in slices(column):
            doc, feature = features(Texts(column.slice(first, n)))
            hit = np.flatnonzero(weights[feature])
            pairs = np.unique(doc[hit] << BITS | feature[hit])
            margin = np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], minlength=n) + weights[-1]
            out[first : first + n] = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
        return out

    return score


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text, with a score: higher is likelier toxic.

    A null or empty text has the bias alone. Texts are scored whole, repeated rows
    alike; other columns pass through, and one called ``name`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, name)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    find = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(find(batch.column(batch.num_columns - 1)))], [*[f.name for f in kept], name])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(run, f"{schema}, `{name}` double")


def filtered(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    find = scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(find(batch.column(text)) < cut))

    return docs.mapInArrow(run, docs.schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds
