"""Language-model scores from a hidden Markov model over word classes.

A token is a lower-cased word or the end of a text. Its class hashes its last four
bytes; the model's states emit classes, and a class emits its words by their
counts in the training texts, with one share left for words not seen. So

    P(text) = P(classes | states) * product of (c + 1) / (C + V + 1)

with c the word's count, and C and V the tokens and distinct words of its class.

Counts of words are exact and cover all training texts: tasks encode their texts
with dictionaries of their own, the dictionaries' entries meet in buckets of the
word's hash, and the totals go back to the dictionaries they came from. Each round of
Baum-Welch adds up expected counts over all training texts, each as one whole
sequence, partition by partition. Scores come from the scaled forward recursion over
whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import store
from quillmark.llm.text import Texts, mix, slices

CLASSES, STATES, ROUNDS = 4096, 8, 5
#: Steps of the recursions whose values are held at a time, and tokens that go through them together.
STRETCH, TOGETHER = 256, 1 << 20
#: Tokens that share a dictionary.
CHUNK = 1 << 21
_END = np.uint64(0x5F3759DF9E3779B9)
_SMOOTH = 0.05


def _tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class) of each token, and the tokens of each text; class 0 is the end."""
    words = texts.words(lower=True)
    tail = np.maximum(words.starts, words.ends - 4)
    kind = 1 + (texts.spans(tail, words.ends, lower=True) % np.uint64(CLASSES - 1)).astype(np.int64)
    at = words.first[1:]
    return np.insert(words.hashes, at, _END), np.insert(kind, at, 0).astype(np.uint16), words.counts + 1


def encoded(docs: DataFrame, key: str, text: str, held_out: Column, buckets: int) -> DataFrame:
    """Saved rows of texts (chunk, key, held_out, tokens, classes) and of dictionaries (chunk, bucket, words).

    ``tokens`` are positions in the chunk's dictionary, which is in order of bucket
    and hash; ``words`` is a bucket's part of it.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for first, n in slices(batch.column(1)):
                own = batch.slice(first, n)
                held.append((own, *_tokens(Texts(own.column(1)))))
                size += len(held[-1][1])
                if size >= CHUNK:
                    yield from flush(held, part << 24 | number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from flush(held, part << 24 | number)

    def flush(held: list, chunk: int) -> Iterator[pa.RecordBatch]:
        hashes, classes = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
        words, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        bucket = (mix(words) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        tokens = place[at]
        sizes = np.concatenate([x[3] for x in held])
        learn = np.concatenate([~x[0].column(2).to_numpy(zero_copy_only=False).astype(bool) for x in held])
        made = np.empty(len(order), WORD)
        made["hash"], made["class"] = words[order], classes[first][order]
        made["n"] = np.bincount(tokens[np.repeat(learn, sizes)], minlength=len(order))
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        row = 0
        for own, *_ in held:
            n = own.num_rows
            bounds = ends[row : row + n + 1]
            yield _batch([pa.array(np.full(n, chunk)), own.column(0), own.column(2), _binary(tokens, bounds), _binary(classes, bounds), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())])
            row += n
        full = np.flatnonzero(np.diff(cut))
        n = len(full)
        yield _batch([pa.array(np.full(n, chunk)), pa.nulls(n, held[0][0].column(0).type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(full.astype(np.int32)), pa.array([made[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())])

    def _batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, ["chunk", "key", "held_out", "tokens", "classes", "bucket", "words"])

    rows = docs.select(F.col(key).alias("key"), text, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return store.saved(rows.mapInArrow(run, f"chunk long, key {kind}, held_out boolean, tokens binary, classes binary, bucket int, words binary"), "encoded")


WORD = np.dtype([("hash", "u8"), ("class", "u2"), ("n", "u4")])


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary for each ``values[bounds[i] : bounds[i + 1]]``."""
    own = np.ascontiguousarray(values[bounds[0] : bounds[-1]])
    offsets = (bounds - bounds[0]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(own.tobytes())]).cast(pa.binary())


def totals_of(rows: DataFrame, buckets: int) -> DataFrame:
    """Saved: the training counts of each chunk's words (chunk, bucket, counts), and each bucket's classes (part, c, v)."""
    groups = math.isqrt(buckets)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, WORD) for x in pdf["words"]]
        every = np.concatenate(parts)
        words, first, at = np.unique(every["hash"], return_index=True, return_inverse=True)
        n = np.bincount(at, every["n"], minlength=len(words)).astype(np.int64)
        kind = every["class"][first]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        out = pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "counts": [x.tobytes() for x in np.split(n[at], ends)], "part": None, "c": None, "v": None})
        c = np.bincount(kind, n, minlength=CLASSES).astype(np.int64)
        v = np.bincount(kind, n > 0, minlength=CLASSES).astype(np.int64)
        return pd.concat([out, pd.DataFrame({"chunk": [None], "bucket": [None], "counts": [None], "part": [int(pdf["bucket"].iloc[0]) % groups], "c": [c], "v": [v]})]).astype({"chunk": "Int64", "bucket": "Int32", "part": "Int32"})

    found = rows.where("bucket is not null").select("chunk", "bucket", "words").groupBy("bucket")
    return store.saved(found.applyInPandas(run, "chunk long, bucket int, counts binary, part int, c array<long>, v array<long>"), "totals")


def class_counts(totals: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words of every class, added up in two levels."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [np.sum(np.stack(pdf["c"].to_numpy()), axis=0)], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    rows = totals.where("c is not null").select("part", "c", "v")
    c, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows.groupBy("part").applyInPandas(add, "c array<long>, v array<long>").collect():  # as many as the root of the buckets
        c, v = c + np.array(r["c"]), v + np.array(r["v"])
    return c, v


class Model:
    """Start shares, transitions, and emissions by class (CLASSES x STATES)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(c: np.ndarray, seed: int = 3) -> "Model":
        """States that differ from the class counts by a fixed random factor."""
        emit = (c[:, None] + _SMOOTH) * np.exp(np.random.RandomState(seed).randn(CLASSES, STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        even = np.full(STATES, 1 / STATES)
        return Model(even, move, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(counts: np.ndarray) -> "Model":
        """The model that expected counts (see ``expected``) make likeliest, smoothed."""
        start, move = counts[:STATES] + 0.1, counts[STATES : STATES * (STATES + 1)].reshape(STATES, STATES) + 0.1
        seen = counts[STATES * (STATES + 1) :].reshape(CLASSES, STATES)
        emit = seen + _SMOOTH
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def expected(self, texts: list[np.ndarray]) -> np.ndarray:
        """Expected starts, transitions and emissions over the texts' classes, as one array.

        The texts go forward together, longest first, and the states at the end of every
        STRETCH steps are kept; going back, a stretch is run forward again from there.
        """
        start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        texts = sorted(texts, key=len, reverse=True)
        sizes = np.array([len(x) for x in texts])
        flat, begins = np.concatenate(texts).astype(np.int64), np.cumsum(sizes) - sizes
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts that reach each step
        entries: list[np.ndarray | None] = [None]
        for t in range(0, len(active) - STRETCH, STRETCH):
            entries.append(self._ahead(flat, begins, active, t, t + STRETCH, entries[-1])[0][-1])
        back = np.ones((len(texts), STATES))
        for entry in reversed(entries):
            low = (len(entries) - 1) * STRETCH
            entries.pop()
            high = min(low + STRETCH, len(active))
            ahead, chance, scale, seen = self._ahead(flat, begins, active, low, high, entry)
            for t in range(high - 1, low - 1, -1):
                n, i = active[t], t - low
                weight = ahead[i] * back[:n]
                if t:
                    here = chance[i] * back[:n] / scale[i]
                    move += (ahead[i - 1] if i else entry)[:n].T @ here
                    back[:n] = here @ self.move.T
                else:
                    start += weight.sum(axis=0)
                ahead[i] = weight
            every, weights = np.concatenate(seen), np.concatenate(ahead)
            for k in range(STATES):
                emit[:, k] += np.bincount(every, weights[:, k], minlength=CLASSES)
        return np.concatenate([start, (move * self.move).ravel(), emit.ravel()])

    def _ahead(self, flat: np.ndarray, begins: np.ndarray, active: np.ndarray, low: int, high: int, a: np.ndarray | None) -> tuple[list, list, list, list]:
        """Scaled forward values of the steps from ``low`` to ``high``, with chances, scales and classes; ``a`` has those before."""
        ahead, chance, scale, seen = [], [], [], []
        for t in range(low, high):
            n = active[t]
            seen.append(flat[begins[:n] + t])
            chance.append(self.emit[seen[-1]])
            a = (a[:n] @ self.move if t else self.start) * chance[-1]
            total = a.sum(axis=1, keepdims=True)
            a = a / total
            ahead.append(a)
            scale.append(total)
        return ahead, chance, scale, seen

    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 of each text's exact probability, as a sequence of classes."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        flat, begins = np.concatenate([texts[i] for i in order]).astype(np.int64), np.cumsum(sizes) - sizes
        out = np.zeros(len(texts))
        a = np.broadcast_to(self.start, (len(texts), STATES))
        for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")):
            a = (a[:n] @ self.move if t else a[:n]) * self.emit[flat[begins[:n] + t]]
            total = a.sum(axis=1)
            a /= total[:, None]
            out[:n] += np.log10(total)
        back = np.empty(len(texts))
        back[order] = out
        return back


def fitted(rows: DataFrame, c: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; without any, the smoothed start."""
    texts = rows.where("bucket is null and not held_out and octet_length(classes) > 0")
    model = Model.first(c)
    for _ in range(rounds if c.any() else 0):
        sent = rows.sparkSession.sparkContext.broadcast(model)  # CLASSES x STATES numbers

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts, held, size = 0, [], 0
            for batch in batches:
                for x in batch.column(0):
                    held.append(np.frombuffer(x.as_py(), np.uint16))
                    size += len(held[-1])
                    if size > TOGETHER:
                        counts, held, size = counts + sent.value.expected(held), [], 0
            if held:
                counts = counts + sent.value.expected(held)
            if isinstance(counts, np.ndarray):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["i", "x"])

        counts = np.zeros(STATES * (STATES + 1) + CLASSES * STATES)
        for r in texts.select("classes").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            counts[r["i"]] = r["x"]
        model = Model.from_counts(counts)
    return model


def scored(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Rows where ``held_out`` holds teach nothing; where it is null, it counts as
    false. Null and empty texts are the end token alone. Texts are scored whole; a
    row repeated is counted and scored again. Without training texts every word is
    unknown, and the model is its smoothed start. Scores are log10 of probabilities.
    """
    buckets = max(store.parallelism(docs.sparkSession), store.plan_bytes(docs) >> 23)
    rows = encoded(docs, key, text, held_out, buckets)
    totals = totals_of(rows, buckets)
    c, v = class_counts(totals)
    model = fitted(rows, c, rounds)
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((model, c, v))

    def run(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        model, c, v = sent.value
        n = np.concatenate([np.frombuffer(x, np.int64) for x in counts.sort_values("bucket")["counts"]])
        classes = [np.frombuffer(x, np.uint16) for x in texts["classes"]]
        sizes = np.array([len(x) for x in classes])
        ends = np.cumsum(sizes)
        tokens = np.frombuffer(b"".join(texts["tokens"]), np.uint32)
        flat = np.concatenate(classes).astype(np.int64)
        found = n[tokens]

        def by_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, ends - sizes)

        up = np.log10(found + 1.0)
        return pd.DataFrame({
            "key": texts["key"], "held_out": texts["held_out"], "n_tokens": sizes, "n_known": by_text((found > 0).astype(np.int64)), "train_tokens": int(c.sum()),
            "base_score": by_text(up) - sizes * np.log10(float(c.sum() + v.sum() + 1)),
            "score": by_text(up - np.log10(c + v + 1.0)[flat]) + model.log10(classes),
        })

    texts = rows.where("bucket is null").select("chunk", "key", "held_out", "tokens", "classes")
    counts = totals.where("counts is not null").select(F.col("chunk").alias("of"), "bucket", "counts")
    found = texts.groupBy("chunk").cogroup(counts.groupBy("of")).applyInPandas(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("key", key)
