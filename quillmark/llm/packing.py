"""Packing into fixed windows by order-preserving dynamic programming.

The documents of a block stay in order; a window is a run of their tokens of at
most SIZE. The cost of a window is its padding (none at a power of two), that of a
cut what it truncates: nothing at a document's end, little after a sentence, more
elsewhere. The cheapest chain of windows ending at each cut takes the least of
(cost so far + position) over a sliding range of earlier cuts, which a monotone
queue yields in constant time.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmark.llm.text import Texts, bytes_table, mix, slices
from quillmark.llm.units import UnitIds

SIZE = 2048
END_ID = 1
#: Costs of a cut, in tokens of padding: after a sentence, and inside one.
SENTENCE_CUT, HARD_CUT = 8, 48
#: Cuts inside sentences are tried at multiples of this.
GRID = 256
#: Unpadded windows inside a block are tried from 2**LEAST_POWER tokens on.
LEAST_POWER = 7
_STOP = bytes_table(".!?")
_made: dict[str, UnitIds] = {}
#: Letters of which lower case and composed form are one character each, in any implementation.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įıĲ-ɏ]+").fullmatch
#: Byte-level vocabularies write printable bytes as themselves and the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = dict(zip([b for b in range(256) if b not in _PRINTABLE], range(256, 512)))


def word_ids(path: str) -> UnitIds:
    """The tokenizer's ids of words and of parts of words; no token of it spans two of them.

    It must lower-case, split runs of letters off, and map bytes to characters as
    byte-level vocabularies do.
    """
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merge = tokenizer.model.tokenize

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids, rest = [], []
            for i, raw in enumerate(words):
                # A run of letters that normalisation leaves alone goes straight to the merges.
                if raw.isalpha():
                    ids.append([x.id for x in merge(raw.lower().decode())])
                elif _LATIN(word := raw.decode()):
                    ids.append([x.id for x in merge(word.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))])
                else:
                    ids.append(None)
                    rest.append((i, word))
            for (i, _), made in zip(rest, tokenizer.encode_batch([w for _, w in rest], add_special_tokens=False), strict=True):
                ids[i] = made.ids
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum())), size

        _made[path] = UnitIds(encode, 250_000)
    return _made[path]


def cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """The cheapest chain of windows over ``places`` (ascending, from 0 to the end, gaps of at most ``size``).

    Returns the places where windows end. ``costs`` are those of cutting there.
    The last window may also fall into powers of two, at HARD_CUT for each more.
    """
    at, extra = places.tolist(), costs.tolist()
    last = len(at) - 1
    earlier: list[list[int]] = [[] for _ in at]
    for k in range(LEAST_POWER, int(size).bit_length() - 1):
        found = np.searchsorted(places, places - (1 << k))
        for j in np.flatnonzero((places[np.minimum(found, last)] == places - (1 << k)) & (places >= 1 << k)).tolist():
            earlier[j].append(int(found[j]))
    total, back = [0] * len(at), [0] * len(at)
    queue, head = [0], 0  # cuts by rising total + place
    key = [0] * len(at)
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[head]] < here - size:
            head += 1
        i = queue[head]
        best, via = key[i] + size - here, i
        for i in earlier[j]:
            if total[i] < best:
                best, via = total[i], i
        total[j], back[j] = best + extra[j], via
        key[j] = total[j] + here
        while len(queue) > head and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    ends = [at[last]]
    best, via, split = total[last], back[last], False
    for i in range(last - 1, -1, -1):
        if at[last] - at[i] > size:
            break
        if (cost := total[i] + HARD_CUT * ((at[last] - at[i]).bit_count() - 1)) < best:
            best, via, split = cost, i, True
    if split:
        left, place = at[last] - at[via], at[last]
        while left & (left - 1):
            place -= left & -left
            left &= left - 1
            ends.append(place)
    while via:
        ends.append(at[via])
        via = back[via]
    return ends[::-1]


def _block(texts: Texts, units: UnitIds, end_id: int, size: int) -> dict[str, np.ndarray]:
    words = texts.words(lower=True)
    parted = words.tails()
    starts, word_ends = np.sort(np.concatenate([words.starts, parted])), np.sort(np.concatenate([words.ends, parted]))
    first = np.searchsorted(starts, texts.offsets)
    hashes = texts.spans(starts, word_ends, lower=True)
    angled = np.concatenate([[0], np.cumsum(texts.buf == 60)])
    own = np.flatnonzero(angled[word_ends] > angled[starts])  # special tokens, which case may tell apart
    hashes[own] = mix(texts.spans(starts[own], word_ends[own]) + np.uint64(1))
    spelt = texts.lowered()
    for a, b in zip(starts[own].tolist(), word_ends[own].tolist(), strict=True):
        spelt[a:b] = texts.buf[a:b]
    rows = units.look_up(texts, starts, word_ends, hashes, spelt)
    lengths = np.insert(units.size[rows], first[1:], 1)
    ends = np.cumsum(lengths)  # of words, and of the id that closes each document
    doc_end = ends[first[1:] + np.arange(texts.n)]
    ids = np.empty(int(ends[-1]), np.uint32)
    closing = np.zeros(len(ids), bool)
    closing[doc_end - 1] = True
    ids[closing], ids[~closing] = end_id, units.ids(rows)
    stop = np.insert(_STOP[texts.buf[word_ends - 1]] if len(rows) else np.zeros(0, bool), first[1:], False)
    places = np.unique(np.concatenate([[0], doc_end, ends[stop], np.arange(GRID, len(ids), GRID)]))
    costs = np.full(len(places), HARD_CUT)
    costs[np.searchsorted(places, ends[stop])] = SENTENCE_CUT
    costs[np.searchsorted(places, doc_end)] = 0
    closed = np.array(cuts(places, costs, size), np.int64)
    bounds = np.union1d(closed, doc_end)
    starts = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(doc_end, starts, "right")
    begins = np.concatenate([[0], doc_end[:-1]])
    window = np.searchsorted(closed, starts, "right")
    opened = np.concatenate([[0], closed[:-1]])
    return {"ids": ids, "doc": doc, "from": starts, "to": bounds, "start": starts - begins[doc], "doc_tokens": (doc_end - begins)[doc], "window": window, "offset": starts - opened[window], "windows": len(closed)}


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """The pieces of all documents: (key, start, length, ids, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a vocabulary file for the tokenizers library whose
    tokens do not span white space; it must exist on all executors. ``ids`` holds
    a piece's ids as little-endian unsigned 32-bit numbers. A null or empty text is
    the closing id alone; texts are taken whole, a row repeated is packed again.
    Columns other than key and text are left out. Order is kept within blocks of
    some MB of a partition; windows hold documents of one block.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, held, part = word_ids(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first, n in slices(batch.column(1), 1 << 21):
                made = _block(Texts(batch.column(1).slice(first, n)), units, end_id, size)
                keys = batch.column(0).slice(first, n).take(pa.array(made["doc"]))
                offsets = np.concatenate([made["from"], made["to"][-1:]]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(made["ids"].tobytes())]).cast(pa.binary())
                columns = [keys, pa.array(made["start"]), pa.array(made["to"] - made["from"]), ids, pa.array(made["doc_tokens"]), pa.array((part << 40) + held + made["window"]), pa.array(made["offset"])]
                held += made["windows"]
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
