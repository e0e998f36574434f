"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

Texts fall into units (a run without white space and the space before it, or a
stretch of white space) at places where the splitting pattern must part them. Only
a partition's distinct units go through the pattern, and only their distinct
matches through DuckDB: rows (match, position, token) join the table of merges, a
recursive query contracts each match's leftmost pair of least rank until none is
left, and ordered aggregation yields ids and, from the vocabulary, decoded bytes.
"""

from __future__ import annotations

import base64
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm.text import Texts, mix, slices
from quillmark.llm.units import UnitIds, gathered

#: Matches in one DuckDB query, and matches remembered by a worker.
CHUNK, REMEMBERED = 20_000, 500_000

#: Matches of at most SHORT bytes: a round contracts one pair of each, and their few rounds are kept.
SHORT = 48
_ENCODE_SHORT = """
WITH RECURSIVE word(w, tokens, n) AS (
  SELECT w, list(t ORDER BY p), 0 FROM start GROUP BY w
  UNION ALL
  SELECT word.w, word.tokens[:best.p - 1] || [best.made] || word.tokens[best.p + 2:], n + 1
  FROM word JOIN (
    SELECT w, min((m.made::BIGINT << 32) | p) AS k, (k & 4294967295)::INTEGER AS p, (k >> 32)::INTEGER AS made
    FROM (SELECT w, unnest(tokens) AS l, unnest(tokens[2:]) AS r, unnest(range(1, len(tokens) + 1)) AS p FROM word) pair
    JOIN merges m ON m.l = pair.l AND m.r = pair.r
    GROUP BY w
  ) best ON best.w = word.w
)
SELECT w, tokens AS ids FROM word QUALIFY n = max(n) OVER (PARTITION BY w) ORDER BY w
"""
#: Longer ones: a round contracts every pair of a match that has its least rank, from the left; where that
#: could make a pair of lower rank, only those that stand further from the one before than any
#: token reaches. USING KEY keeps each match's last round alone.
_ENCODE = """
WITH RECURSIVE word(w, tokens) USING KEY (w) AS (
  SELECT w, list(t ORDER BY p) FROM start GROUP BY w
  UNION
  (WITH pair AS (
    SELECT w, unnest(tokens[:-2]) AS l, unnest(tokens[2:]) AS r, unnest(range(1, len(tokens))) AS p FROM word WHERE len(tokens) > 1
  ), found AS (
    SELECT w, p, made, alone FROM pair JOIN merges USING (l, r)
  ), least AS (
    SELECT w, p, made, row_number() OVER (PARTITION BY w ORDER BY p) AS k
    FROM (SELECT *, min(made) OVER (PARTITION BY w) AS low FROM found) WHERE made = low
    QUALIFY NOT alone OR coalesce(p - lag(p) OVER (PARTITION BY w ORDER BY p) > getvariable('widest'), true)
  ), contracted AS (
    SELECT w, p, made FROM least QUALIFY row_number() OVER (PARTITION BY w, p - k ORDER BY p) % 2 = 1
  ), token AS (
    SELECT w, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS p FROM word WHERE w IN (SELECT w FROM contracted)
  )
  SELECT w, list(coalesce(c.made, t) ORDER BY p)
  FROM (SELECT * FROM token ANTI JOIN contracted d ON d.w = token.w AND d.p = token.p - 1) rest LEFT JOIN contracted c USING (w, p)
  GROUP BY w)
)
SELECT w, tokens AS ids FROM word ORDER BY w
"""
_DECODE = """
SELECT i.w, unhex(string_agg(hex(v.piece), '' ORDER BY i.p)) AS piece
FROM given i JOIN vocabulary v ON v.id = i.t GROUP BY i.w ORDER BY i.w
"""


class Codec:
    """A vocabulary of ranks, a splitting pattern, and the DuckDB tables made of them."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # White space as Unicode has it, on which pattern engines agree.
        spelt = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find = regex.compile(spelt).findall
        warnings.filterwarnings("ignore", message="Arrow output on a DB-API result")
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''; SET preserve_insertion_order = false")
        merges = [(self.ranks[x[:i]], self.ranks[x[i:]], made) for x, made in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks]
        l, r, made = np.array(merges, np.int32).T
        lower = np.concatenate([l[made < l], r[made < r]])  # tokens that are part of one with a lower rank
        self._table("merges", {"l": l, "r": r, "made": made, "alone": np.isin(made, lower)})
        self.db.execute(f"SET VARIABLE widest = {max(map(len, self.ranks))}")
        self._table("vocabulary", {"id": np.fromiter(self.ranks.values(), np.int32), "piece": pa.array(self.ranks, pa.binary())})
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _table(self, name: str, columns: dict) -> None:
        held = pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
        self.db.register("held", held)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM held")
        self.db.unregister("held")

    def _rows(self, name: str, flat: np.ndarray, size: np.ndarray) -> None:
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self._table(name, {"w": np.repeat(np.arange(len(size), dtype=np.int32), size), "p": at.astype(np.int32), "t": flat.astype(np.int32)})

    def learn(self, matches: list[str]) -> None:
        """Remember each match as its ids and then its decoded bytes, negated less one, in one array."""
        for i in range(0, len(matches), CHUNK):
            part = matches[i : i + CHUNK]
            raw = [x.encode() for x in part]
            whole = np.fromiter((self.ranks.get(x, -1) for x in raw), np.int32, len(raw))
            merged = np.flatnonzero(whole < 0)  # a match that is a token is that token
            count = np.ones(len(raw), np.int64)
            length = np.fromiter(map(len, raw), np.int64, len(raw))
            made = []
            for query, own in ((_ENCODE_SHORT, merged[length[merged] <= SHORT]), (_ENCODE, merged[length[merged] > SHORT])):
                if len(own):
                    self._rows("start", self.byte[np.frombuffer(b"".join(raw[j] for j in own), np.uint8)], length[own])
                    found = self.db.execute(query).to_arrow_table().column("ids").combine_chunks()
                    count[own] = np.diff(np.asarray(found.offsets))
                    made.append((own, found.flatten().to_numpy()))
            ids = np.empty(int(count.sum()), np.int32)
            ids[np.repeat(whole >= 0, count)] = whole[whole >= 0]
            for own, tokens in made:
                ids[np.repeat(np.isin(np.arange(len(raw)), own), count)] = tokens
            self._rows("given", ids, count)
            back = self.db.execute(_DECODE).to_arrow_table().column("piece").combine_chunks().cast(pa.large_binary())
            _, at, data = back.buffers()
            bounds = np.frombuffer(at, np.int64)[back.offset : back.offset + len(back) + 1]
            decoded = -1 - np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].astype(np.int32)
            both = np.empty(len(ids) + len(decoded), np.int32)
            sizes = np.stack([count, np.diff(bounds)], axis=1)
            first = np.repeat(np.tile([True, False], len(part)), sizes.ravel())
            both[first], both[~first] = ids, decoded
            held = len(self.known)
            self.known.update(zip(part, range(held, held + len(part)), strict=True))
            self.flat, self.size = np.concatenate([self.flat, both]), np.concatenate([self.size, sizes.sum(axis=1)])

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and decoded bytes (see ``learn``) of the units' matches, and the length of each unit's."""
        found = [self.find(u.decode()) for u in units]
        if len(self.known) > REMEMBERED:
            self._clear()
        known = self.known
        if fresh := list({x: None for xs in found for x in xs if x not in known}):
            self.learn(fresh)
        rows = np.fromiter((known[x] for xs in found for x in xs), np.int64)
        ends = np.concatenate([[0], np.cumsum(self.size[rows])])[np.cumsum([0, *map(len, found)])]
        return gathered(self.flat, (np.cumsum(self.size) - self.size)[rows], self.size[rows]), np.diff(ends)


_made: dict[tuple[str, str], tuple[Codec, UnitIds]] = {}


def codec(ranks_path: str, pattern: str) -> UnitIds:
    if (ranks_path, pattern) not in _made:
        own = Codec(ranks_path, pattern)
        _made[ranks_path, pattern] = own, UnitIds(own.encode, 800_000)
    return _made[ranks_path, pattern][1]


def _wide_space(texts: Texts) -> np.ndarray:
    """Whether each text has white space outside ASCII; such a text is one unit."""
    b = texts.buf
    marked = np.zeros(len(b), bool)
    if len(b) > 1:
        a, c = b[:-1], b[1:]
        marked[:-1] = ((a == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE1) & (c == 0x9A)) | ((a == 0xE2) & ((c == 0x80) | (c == 0x81))) | ((a == 0xE3) & (c == 0x80))
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[texts.offsets[1:]] > total[texts.offsets[:-1]]


def units_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of units, ascending and covering all bytes.

    White space before a word gives its last character to the word if that is a
    space; else that character is a unit. What comes before it is one, and so are
    white space at a text's end, and the marks that end a word after a letter.
    """
    words = texts.words(lower=False)
    doc = words.doc()
    lower = texts.offsets[doc]  # where the white space before each word begins
    same = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
    lower[same] = words.ends[same - 1]
    gap = words.starts - lower
    spaced = np.zeros(len(doc), bool)
    spaced[gap > 0] = texts.buf[words.starts[gap > 0] - 1] == 32
    last = words.starts - (gap > 0)
    bounds = [texts.offsets, words.ends, words.tails(), np.where(spaced, last, words.starts), last]
    bounds = np.unique(np.concatenate(bounds))
    whole = _wide_space(texts)
    if whole.any():
        own = np.searchsorted(texts.offsets, bounds, "right") - 1
        inner = whole[np.minimum(own, texts.n - 1)] & (bounds > texts.offsets[np.minimum(own, texts.n - 1)]) & (bounds < texts.offsets[-1])
        bounds = bounds[~inner]
    return bounds[:-1], bounds[1:]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded binary) of every document.

    ``ranks_path`` names a file of base64 tokens and ranks that must exist on all
    executors and hold every single byte; each match of ``pattern`` is encoded by
    itself, without special tokens. A null or empty text has no ids. Texts are
    taken whole, repeated rows alike; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = codec(ranks_path, pattern)
        for batch in batches:
            for first, n in slices(batch.column(1), 1 << 21):
                texts = Texts(batch.column(1).slice(first, n))
                starts, ends = units_of(texts)
                rows = units.look_up(texts, starts, ends, mix(texts.spans(starts, ends) + (ends - starts).astype(np.uint64)))
                both = units.ids(rows)
                size = units.size[rows]
                cut = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, texts.offsets)]
                real = both >= 0
                held = np.concatenate([[0], np.cumsum(real)])[cut].astype(np.int64)
                ids = pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), pa.array(both[real]))
                back = (-1 - both[~real]).astype(np.uint8).tobytes()
                decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((cut - held).tobytes()), pa.py_buffer(back)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ids, decoded], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")
