"""N-gram Jaccard join: a prefix-tree join of globally ordered shingle sets.

Texts become sets of hashed word shingles, in one global order: rare shingles
first, as told by a fixed-size table of counts over all texts, then by hash. Sets
that reach the threshold share l shingles among their first |x| - ceil(t |x|) + l,
so only those are dealt out, by shingle; l grows with the set. Of its lists that
other sets are in too, every set then leaves the longest, fewer than l of the
smallest set it can link with: two linked sets still meet in a list.

Lists are gathered into groups by their leading member, so that the many lists of
one family of near copies become few groups, and each set travels once to each of
its groups, not once a shingle. Within a group the sets stand in a prefix tree,
frequent shingles first, and sets walk it together as queries, carrying the overlap
of shared beginnings down. A subtree is left when what remains on either side is
too short, when its sizes do not fit, or when it lies in the query's component; a
set whose remaining partners are all in its component is not asked at all. Only the
links that join two components leave the task.

A group too large for one task is dealt over several, each with the leading member
in it; after these, the sets outside the group's largest component are compared
with the other parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import store
from quillmark.llm.components import components
from quillmark.llm.text import Texts, mix, shingle_sets, slices
from quillmark.llm.units import gathered

#: The table of counts: 2**CELLS counters, in rows of 2**ROW.
CELLS, ROW = 21, 15
#: One in so many shingles of a set must recur in a candidate's beginning.
SHARE = 10
#: Postings of one list in one block.
LIST_ROWS = 1 << 19
#: Postings in one block of lists; shingles in one block of groups, and in one part of a group.
BLOCK_POSTINGS, BLOCK_SHINGLES, PART_SHINGLES = 1 << 20, 1 << 20, 1 << 20
#: Queries that walk a tree together, and bytes of the table that they walk it with.
QUERIES, TABLE_BYTES = 64, 1 << 25


class _Counts:
    """Counters of hashed values within one task."""

    def __init__(self) -> None:
        self.n = np.zeros(1 << CELLS, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.n += np.bincount((hashes & np.uint64((1 << CELLS) - 1)).astype(np.int64), minlength=1 << CELLS)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for i in range(1 << (CELLS - ROW)):
            part = self.n[i << ROW : (i + 1) << ROW]
            if part.any():
                yield i, zlib.compress(part.astype(np.uint32).tobytes(), 1)


def _summed(df: DataFrame) -> np.ndarray:
    """The sum over all rows (cell int, counts binary): 2**CELLS counters, a fixed size."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, blob in zip(*batch.to_pydict().values(), strict=True):
                part = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.int64)
                held[cell] = held[cell] + part if cell in held else part
        if held:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(held), pa.int32()), "counts": [x.tobytes() for x in held.values()]})

    out = np.zeros(1 << CELLS, np.int64)
    for r in df.repartition(store.parallelism(df.sparkSession), "cell").mapInArrow(add, "cell int, counts binary").collect():
        out[r["cell"] << ROW : (r["cell"] + 1) << ROW] += np.frombuffer(r["counts"], np.int64)
    return out


def set_id(shingles: np.ndarray) -> bytes:
    """A 128-bit name of a set, from sums of its hashes mixed in two ways; equal sets have equal names."""
    first, second = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(shingles * np.uint64(0xDA942042E4DD58B5) + np.uint64(1)).sum(dtype=np.uint64)
    return mix(np.array([first + np.uint64(len(shingles)), second], np.uint64)).tobytes()


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, n in slices(column):
        yield first, shingle_sets(Texts(column.slice(first, n)).words(lower=True), k)


def documents_of(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Saved rows (key, n, set) of all documents, and rows (cell, counts) of the shingles' counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for first, sets in _sets(batch.column(1), k):
                if held := [s for s in sets if len(s)]:
                    counts.add(np.concatenate(held))
                none = [None] * len(sets)
                yield _batch([batch.column(0).slice(first, len(sets)), [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets], none, none])
        cells = list(counts.rows())
        none = [None] * len(cells)
        yield _batch([none, none, none, [c for c, _ in cells], [b for _, b in cells]])

    def _batch(columns: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "n", "set", "cell", "counts"])

    return store.saved(docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "key long, n long, `set` binary, cell int, counts binary"), "sets")


def levels_of(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A coarse rank of every counter, 0 for the ordinary, and the count at which rank 1 begins."""
    mean = counts.mean()
    base = int(mean + 8 * np.sqrt(mean) + 16)
    return np.where(counts < base, 0, 1 + np.floor(np.log2(np.maximum(counts, base) / base))).astype(np.uint8), base


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in global order: by rank, then by hash."""
    rank = levels[(shingles & np.uint64((1 << CELLS) - 1)).astype(np.int64)]
    return shingles[np.argsort(rank, kind="stable")] if rank.any() else shingles


class Threshold:
    """Jaccard similarity of at least ``num`` / ``den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def needed(self, n: int | np.ndarray) -> int | np.ndarray:
        """Shingles that the beginnings of a set of n and of a larger set must share: 1 in SHARE, at least 1."""
        return np.maximum(1, n // SHARE)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + int(self.needed(n))

    def met(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def reachable(self, overlap: int, a: int, b: int) -> bool:
        """Whether so much overlap is enough for sets of a and b shingles."""
        return (self.num + self.den) * overlap >= self.num * (a + b)


#: A shingle of a set, the set's number in the table of names beside it, and how long its list counts as.
POSTING = np.dtype([("token", "u8"), ("set", "u4"), ("size", "u4")])
NAMED = np.dtype([("name", "V16"), ("n", "u4"), ("degree", "u4")])
DEALT = "block int, rows binary, sets binary"


def _spread(base: int) -> np.ndarray:
    """Over how many blocks a list of each rank is dealt."""
    return np.maximum(1, (base << np.arange(64).clip(0, 40)) // LIST_ROWS)


def _packed(rows: np.ndarray, named: np.ndarray, block: np.ndarray) -> pa.Table:
    """Rows (block, rows, sets): the postings of each block, with the names that they refer to."""
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    postings, sets = [], []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=False):
        part = rows[a:z].copy()
        own, part["set"] = np.unique(part["set"], return_inverse=True)
        postings.append(part.tobytes())
        sets.append(named[own].tobytes())
    return pa.table({"block": pa.array(block[first], pa.int32()), "rows": pa.array(postings, pa.binary()), "sets": pa.array(sets, pa.binary())})


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All postings of some packed rows, and the distinct sets that they refer to."""
    rows, names, first = [], [], 0
    for blob, sets in zip(table.column("rows").to_pylist(), table.column("sets").to_pylist(), strict=True):
        part = np.frombuffer(blob, POSTING).copy()
        part["set"] += first
        rows.append(part)
        names.append(np.frombuffer(sets, NAMED))
        first += len(names[-1])
    named, made = np.concatenate(names), np.concatenate(rows)
    half = np.ascontiguousarray(named["name"]).view(np.uint64).reshape(-1, 2)
    order = np.lexsort((half[:, 1], half[:, 0]))
    half = half[order]
    new = np.r_[True, (half[1:] != half[:-1]).any(axis=1)]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    made["set"] = at[made["set"]]
    return made, named[order[new]]


def _names(named: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(named), [None, pa.py_buffer(np.ascontiguousarray(named["name"]).tobytes())]).cast(pa.binary())


def _number(named: np.ndarray) -> np.ndarray:
    """64 bits of every set's name, to deal and to order by."""
    return np.ascontiguousarray(named["name"]).view(np.uint64)[::2]


def postings(docs: DataFrame, text: str, k: int, t: Threshold, counts: np.ndarray, blocks: int) -> DataFrame:
    """Packed rows: the first shingles of every set, dealt by shingle.

    A list that the counts call very long is dealt over several blocks, by set.
    """
    levels, base = levels_of(counts)
    spread = _spread(base)
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2**CELLS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, rows = set(), [], 0
        for batch in batches:
            for _, sets in _sets(batch.column(0), k):
                for s in sets:
                    if not len(s) or (name := set_id(s)) in seen:
                        continue
                    seen.add(name)
                    own = ordered(s, sent.value)[: t.prefix(len(s))]
                    held.append((own, name, len(s)))
                    rows += len(own)
                if rows > 400_000:
                    yield from flush(held)
                    held, rows = [], 0
                if len(seen) > 100_000:
                    seen.clear()
        if held:
            yield from flush(held)

    def flush(held: list) -> list[pa.RecordBatch]:
        named = np.array([(x[1], x[2], 0) for x in held], NAMED)
        made = np.zeros(sum(len(x[0]) for x in held), POSTING)
        made["token"] = np.concatenate([x[0] for x in held])
        made["set"] = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        parts = spread[sent.value[(made["token"] & np.uint64((1 << CELLS) - 1)).astype(np.int64)]].astype(np.uint64)
        salt = _number(named)[made["set"]] % parts
        return _packed(made, named, (mix(made["token"] + salt) % np.uint64(blocks)).astype(np.int64)).to_batches()

    return docs.select(text).mapInArrow(run, DEALT)


def thinned(dealt: DataFrame, t: Threshold, counts: np.ndarray, blocks: int) -> DataFrame:
    """Saved packed rows: the lists of two sets or more, without each set's longest ones; block -1 has the divided lists.

    A set leaves one list less than the smallest set needs that it can link with. In
    the order of list length, what two sets leave out of the lists that both are in
    are the first of these; the larger set leaves more, and that is fewer than the
    smaller one needs, so a list of both remains. The length of a divided list is
    the counts' estimate: any order does that is the same for all sets.
    """
    levels, base = levels_of(counts)
    spread = _spread(base)
    sent = dealt.sparkSession.sparkContext.broadcast(levels)

    def level(rows: np.ndarray) -> np.ndarray:
        return sent.value[(rows["token"] & np.uint64((1 << CELLS) - 1)).astype(np.int64)]

    def lists(table: pa.Table) -> pa.Table:
        rows, named = _unpacked(table)
        rows = rows[np.lexsort((rows["set"], rows["token"]))]
        rows = rows[np.r_[True, (rows["token"][1:] != rows["token"][:-1]) | (rows["set"][1:] != rows["set"][:-1])]]
        first = np.flatnonzero(np.r_[True, rows["token"][1:] != rows["token"][:-1]])
        length = np.diff(np.r_[first, len(rows)])
        own = level(rows)
        rows["size"] = np.where(spread[own] > 1, np.minimum(base << own.astype(np.int64).clip(0, 40), 2**32 - 1), np.repeat(length, length))
        rows = rows[rows["size"] > 1]
        return _packed(rows, named, (_number(named)[rows["set"]] % np.uint64(blocks)).astype(np.int64))

    def kept(table: pa.Table) -> pa.Table:
        rows, named = _unpacked(table)
        rows = rows[np.lexsort((rows["token"], -rows["size"].astype(np.int64), rows["set"]))]
        first = np.flatnonzero(np.r_[True, rows["set"][1:] != rows["set"][:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
        left = t.needed(-(-t.num * named["n"].astype(np.int64) // t.den)) - 1
        rows = rows[place >= left[rows["set"]]]
        named = named.copy()
        named["degree"] = np.bincount(rows["set"], minlength=len(named))
        return _packed(rows, named, np.where(spread[level(rows)] > 1, -1, (mix(rows["token"].copy()) % np.uint64(blocks)).astype(np.int64)))

    return store.saved(dealt.groupBy("block").applyInArrow(lists, DEALT).groupBy("block").applyInArrow(kept, DEALT), "thin")


def members_of(thin: DataFrame, t: Threshold) -> DataFrame:
    """Saved distinct rows (lead, own, n): the sets of every group, those without a partner of fitting size left out.

    A group is the union of the lists that have the same leading member, that with the
    most lists; so sets that share a list share a group.
    """
    def groups(table: pa.Table) -> pa.Table:
        rows, named = _unpacked(table)
        rows = rows[np.lexsort((rows["set"], named["degree"][rows["set"]], rows["token"]))]
        last = np.flatnonzero(np.r_[rows["token"][1:] != rows["token"][:-1], True])
        length = np.diff(np.r_[-1, last])
        lead = np.repeat(rows["set"][last], length).astype(np.int64)
        both = np.unique((lead << 32 | rows["set"])[np.repeat(length, length) > 1])
        return pa.table({"lead": _names(named[both >> 32]), "own": _names(named[both & (2**32 - 1)]), "n": named["n"][both & (2**32 - 1)].astype(np.int64)})

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, named = _unpacked(pa.Table.from_batches([batch.slice(i, 1)]))
                own = named[rows["set"]]
                yield pa.RecordBatch.from_arrays([pa.array(rows["token"].astype(np.int64)), _names(own), pa.array(own["n"].astype(np.int64)), pa.array(own["degree"].astype(np.int64))], ["token", "own", "n", "degree"])

    rows = thin.where("block >= 0").groupBy("block").applyInArrow(groups, "lead binary, own binary, n long")
    hot = thin.where("block < 0").mapInArrow(single, "token long, own binary, n long, degree long")
    lead = hot.groupBy("token").agg(F.max(F.struct("degree", "own")).alias("h")).select("token", F.col("h.own").alias("lead"))
    rows = rows.unionByName(hot.join(lead, "token").select("lead", "own", "n")).distinct()
    # Sizes that fit are at most one band apart; the bands are a little wider than that.
    rows = store.saved(rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(t.den / t.num * 1.001))).cast("int")), "near")
    bands = rows.groupBy("lead", "band").agg(F.count("*").alias("times"))
    near = bands.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).groupBy("lead", "band").agg(F.sum("times").alias("near")).where("near > 1").select("lead", "band")
    out = store.saved(rows.join(near, ["lead", "band"], "left_semi").select("lead", "own", "n"), "members")
    store.dropped(rows)
    return out


class PrefixTree:
    """Sets as paths of a tree that shares equal beginnings, each node a run of shingles.

    Shingles that several of the sets hold come in one order, frequent ones first;
    those of one set alone cannot be shared and count by the set's size only. Nodes
    stand level by level, so all nodes of a level are walked at once.
    """

    def __init__(self, sets: list[np.ndarray]):
        m = len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(m), self.size)
        tokens, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        by = np.lexsort((tokens, -times))
        rank = np.empty(len(tokens), np.int64)
        rank[by] = np.arange(len(tokens))
        self.width = int((times > 1).sum())
        shared = times[at] > 1
        owner, path = owner[shared], rank[at[shared]]
        by = np.lexsort((path, owner))
        path = path[by]
        cut = np.r_[0, np.cumsum(np.bincount(owner, minlength=m))]
        self.paths = [path[cut[i] : cut[i + 1]] for i in range(m)]
        self.order = np.array(sorted(range(m), key=lambda i: self.paths[i].astype(">u4").tobytes()), np.int64)
        self._grow()

    def _grow(self) -> None:
        paths, m = [self.paths[i] for i in self.order], len(self.order)
        depth, parent, lo, hi, end = [0], [-1], [0], [m], []  # the root is node 0
        stack = [0]
        for i in range(m):
            common = 0
            if i:
                a, b = paths[i - 1], paths[i]
                n = min(len(a), len(b))
                off = a[:n] != b[:n]
                first = int(off.argmax()) if n else 0
                common = first if n and off[first] else n
            while depth[stack[-1]] > common:
                node = stack.pop()
                hi[node] = i
                if depth[stack[-1]] < common:
                    depth.append(common)
                    parent.append(stack[-1])
                    lo.append(lo[node])
                    hi.append(m)
                    stack.append(len(depth) - 1)
                parent[node] = stack[-1]
            if depth[stack[-1]] < len(paths[i]):
                depth.append(len(paths[i]))
                parent.append(stack[-1])
                lo.append(i)
                hi.append(m)
                stack.append(len(depth) - 1)
            end.append(stack[-1])
        level, by = [0] * len(depth), sorted(range(len(depth)), key=depth.__getitem__)
        for node in by[1:]:
            level[node] = level[parent[node]] + 1
        by = np.argsort(level, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.lo, self.hi, self.depth = np.array(lo)[by], np.array(hi)[by], np.array(depth)[by]
        self.parent = np.r_[0, place[np.array(parent)[by[1:]]]].astype(np.int64)
        self.levels = np.r_[0, np.cumsum(np.bincount(level))].tolist()
        runs = [paths[a][d:e] for a, d, e in zip(self.lo[1:].tolist(), self.depth[self.parent[1:]].tolist(), self.depth[1:].tolist(), strict=True)]
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.stop = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int64)
        self.start = np.r_[0, self.stop[:-1]]
        self.last = np.r_[0, self.tokens[self.stop[1:] - 1]] if runs else np.zeros(1, np.int64)
        self.end = place[end]
        length = np.array([len(p) for p in paths])
        self.left = self._below(length, np.maximum) - self.depth
        sizes = self.size[self.order]
        self.small, self.large = self._below(sizes, np.minimum), self._below(sizes, np.maximum)

    def _below(self, values: np.ndarray, of: np.ufunc) -> np.ndarray:
        """The least or largest of each node's sets, which stand at its places lo to hi."""
        padded = np.r_[values, values[-1:]]
        return of.reduceat(padded, np.c_[self.lo, self.hi].ravel())[::2]

    def overlaps(self, asked: np.ndarray, label: np.ndarray, t: Threshold) -> np.ndarray:
        """How many shingles each of the sets ``asked`` shares with each set; 0 where a subtree was left early."""
        held = np.zeros((self.width, len(asked)), np.uint8)
        for i, q in enumerate(asked.tolist()):
            held[self.paths[q], i] = 1
        used = held.cumsum(axis=0, dtype=np.int32)
        whole = np.array([len(self.paths[q]) for q in asked.tolist()], np.int64)
        n, own = self.size[asked], label[asked]
        places = label[self.order]
        low, high = self._below(places, np.minimum), self._below(places, np.maximum)
        low[low != high] = -1
        overlap = np.zeros((len(self.lo), len(asked)), np.int32)
        alive = np.zeros(len(self.lo), bool)
        alive[0] = True
        for a, z in zip(self.levels[1:-1], self.levels[2:], strict=True):
            nodes = np.arange(a, z)[alive[self.parent[a:z]]]
            if not len(nodes):
                break
            size = self.stop[nodes] - self.start[nodes]
            run = self.tokens[self.start[a] : self.stop[z - 1]] if len(nodes) == z - a else gathered(self.tokens, self.start[nodes], size)
            now = overlap[self.parent[nodes]] + np.add.reduceat(held[run], np.cumsum(size) - size, axis=0, dtype=np.int32)
            overlap[nodes] = now
            best = now + np.minimum(whole - used[self.last[nodes]], self.left[nodes][:, None])
            small, large = self.small[nodes][:, None], self.large[nodes][:, None]
            open_ = t.reachable(best, n, small) & (t.den * large >= t.num * n) & (t.num * small <= t.den * n) & (low[nodes][:, None] != own)
            alive[nodes] = open_.any(axis=1)
        out = np.zeros((len(asked), len(self.order)), np.int32)
        out[:, self.order] = overlap[self.end].T
        return out


def joining(sets: list[np.ndarray], label: np.ndarray, ask: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
    """Links among ``sets`` that join what is in different components: enough of them that no other link would.

    ``label`` has the component of every set; only links with a set that ``ask`` marks are looked for.
    """
    tree, label, left, out, many = PrefixTree(sets), label.copy(), ask.copy(), [], 2
    most = max(1, min(QUERIES, TABLE_BYTES // max(1, len(tree.tokens) + 4 * tree.width)))
    while left.any():
        waiting = np.flatnonzero(left)
        if ask.all():
            # What has been asked is settled with every other set, so only the waiting ones are partners.
            kinds, times = np.unique(label[waiting], return_counts=True)
            if len(kinds) == 1:
                break
            waiting = waiting[label[waiting] != kinds[times.argmax()]]
        elif (label == label[0]).all():
            break
        asked = waiting[np.argsort(-tree.size[waiting], kind="stable")[: min(many, most)]]
        many *= 4
        shared = tree.overlaps(asked, label, t)
        left[asked] = False
        for i, j in zip(*np.nonzero(t.met(shared, tree.size[asked][:, None], tree.size) & (shared > 0)), strict=True):
            a, b = int(asked[i]), int(j)
            if label[a] != label[b]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def _marked(df: DataFrame) -> np.ndarray:
    """A fixed-size filter of the long column ``key``: bits, of which a key's own is set."""
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            counts.add(mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)))
        cells = list(counts.rows())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in cells], pa.int32()), pa.array([b for _, b in cells], pa.binary())], ["cell", "counts"])

    return np.packbits(_summed(df.select("key").mapInArrow(marks, "cell int, counts binary")) > 0)


def _links(rows: DataFrame, chosen: DataFrame, docs: DataFrame, key: str, text: str, k: int, t: Threshold) -> DataFrame:
    """Saved links (a, b) that join components within each part: rows (lead, part, id, n, component, ask), chosen (set, key, id).

    The sets are made again from the texts of one document each, so that only sets in
    some group travel.
    """
    spark = docs.sparkSession
    total = rows.agg(F.sum("n")).first()[0] or 0
    blocks = max(store.parallelism(spark), int(total) // BLOCK_SHINGLES)
    places = F.collect_list(F.struct("lead", "part", "component", "ask", F.pmod(F.xxhash64("lead", "part"), F.lit(blocks)).cast("int").alias("block")))
    wanted = store.saved(rows.groupBy("id").agg(places.alias("places")).join(chosen, "id"), "wanted")
    sent = spark.sparkContext.broadcast(_marked(wanted))  # spares hashing and moving the other texts; the join below is exact

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            hashed = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64((1 << CELLS) - 1)
            batch = batch.filter(pa.array(bits[hashed.astype(np.int64)]))
            for first, sets in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set", "shingles"])

    def run(table: pa.Table) -> pa.Table:
        lead, part, id_, component, ask = (table.column(c).to_numpy() for c in ("lead", "part", "id", "component", "ask"))
        shingles = table.column("shingles").combine_chunks()
        order = np.lexsort((~ask, id_, part, lead))
        new = np.r_[True, (lead[order][1:] != lead[order][:-1]) | (part[order][1:] != part[order][:-1])]
        found: list[tuple[int, int]] = []
        for at in np.split(order, np.flatnonzero(new)[1:]):
            # A set may stand in a part twice, once as one that asks; and once for every row that repeats its document.
            at = at[np.r_[True, id_[at][1:] != id_[at][:-1]]]
            if len(at) > 1:
                sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in at.tolist()]
                found += [(id_[at[a]], id_[at[b]]) for a, b in joining(sets, np.unique(component[at], return_inverse=True)[1], ask[at], t)]
        both = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    sets = docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(made, "key long, `set` binary, shingles binary")
    dealt = sets.hint("merge").join(wanted, ["key", "set"]).select("id", "shingles", F.explode("places").alias("p")).select("id", "shingles", "p.*")
    out = store.saved(dealt.groupBy("block").applyInArrow(run, "a long, b long"), "links")
    store.dropped(wanted)
    return out


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) of every document; component_id is the least key reachable by links.

    Two documents link when the Jaccard similarity of their sets of k-word shingles
    is at least num / den. A text with fewer words is one shingle; a null, empty or
    blank text has none and links with nothing. Equal sets link, however many
    documents hold them; keys on several rows share a component only if their
    texts do, and each row is returned; rows without a key stand alone, with a null
    component. Shingles go by 64-bit hashes, sets by 128 bits.
    """
    t, spark = Threshold(num, den), docs.sparkSession
    saved = documents_of(docs, key, text, k)
    counts = _summed(saved.where("cell is not null").select("cell", "counts"))
    known = saved.where("n is not null").select("key", "n", "set")
    held = known.where("`set` is not null and key is not null").groupBy("set").agg(F.min("key").alias("key"))
    keyed = docs.where(F.col(key).isNotNull())
    blocks = max(store.parallelism(spark), int(counts.sum()) * (den - num) // den // BLOCK_POSTINGS)
    thin = thinned(postings(keyed, text, k, t, counts, blocks), t, counts, blocks)
    store.tidy(spark)
    members = members_of(thin, t)
    store.dropped(thin)

    chosen = store.saved(members.select(F.col("own").alias("set")).distinct().join(held, "set").withColumn("id", F.monotonically_increasing_id()), "chosen")
    ids = chosen.select("set", "id")
    named = members.join(ids.withColumnRenamed("set", "own"), "own").join(ids.select(F.col("set").alias("lead"), F.col("id").alias("of")), "lead", "left").select(F.coalesce("of", F.xxhash64("lead")).alias("lead"), "id", "n")
    parts = named.groupBy("lead").agg((F.sum("n") / PART_SHINGLES).cast("int").alias("parts"))
    rows = store.saved(named.join(parts, "lead").select("lead", "id", "n", (F.col("parts") + 1).alias("parts"), F.pmod(F.xxhash64("id"), F.col("parts") + 1).cast("int").alias("part")), "dealt")
    store.dropped(members)
    store.tidy(spark)
    # The leading member stands in every part of its group.
    alone = rows.where("id <> lead").select("lead", "id", "n", "part").unionByName(rows.where("id = lead").select("lead", "id", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    links = _links(alone.select("*", F.col("id").alias("component"), F.lit(True).alias("ask")), chosen, keyed, key, text, k, t)
    store.tidy(spark)
    grouped = store.saved(components(links), "components")
    store.dropped(links)
    if rows.where("parts > 1").limit(1).count():
        grouped = _across(rows.where("parts > 1"), grouped, lambda asked: _links(asked, chosen, keyed, key, text, k, t))
    store.dropped(rows)
    store.tidy(spark)

    least = held.join(ids, "set", "left").join(grouped.select(F.col("node").alias("id"), "component"), "id", "left")
    first = least.groupBy(F.coalesce("component", "id").alias("c")).agg(F.min("key").alias("component_id")).where("c is not null")
    by_set = least.withColumn("c", F.coalesce("component", "id")).join(first, "c", "left").select("set", F.coalesce("component_id", "key").alias("component_id"))
    # Rows without a set meet nothing: spread over the partitions by their keys.
    return known.withColumn("set", F.coalesce("set", F.col("key").cast("string").cast("binary"), F.lit(b""))).join(by_set, "set", "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"))


def _across(rows: DataFrame, grouped: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``grouped`` with the links between parts of the divided groups: rows (lead, id, n, parts, part).

    Sets outside a group's largest component are dealt out too, to bundles, and each
    bundle meets each part; a group that is one component by now is done.
    """
    now = rows.join(grouped.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kinds = now.groupBy("lead", "component").agg(F.count("*").alias("times"), F.sum("n").alias("shingles"))
    main = kinds.groupBy("lead").agg(F.max(F.struct("times", "component")).alias("m"), F.sum("shingles").alias("all"), F.max_by("shingles", F.struct("times", "component")).alias("most")).where("`all` > most")
    main = main.select("lead", F.col("m.component").alias("main"), ((F.col("all") - F.col("most")) / PART_SHINGLES + 1).cast("int").alias("bundles"))
    open_ = store.saved(now.join(main, "lead"), "open")
    place = F.col("part") * F.col("bundles") + F.col("bundle")
    asked = open_.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.col("bundles") - 1))).select("lead", place.alias("part"), "id", "n", "component", F.lit(False).alias("ask"))
    asks = open_.where("component <> main").withColumn("bundle", F.pmod(F.xxhash64("id", F.lit(1)), F.col("bundles")).cast("int"))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lead", place.alias("part"), "id", "n", "component", F.lit(True).alias("ask"))
    links = links_of(asked.unionByName(asks))
    out = store.saved(components(links.unionByName(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    store.dropped(open_, links, grouped)
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """One document of each linked group, that with the least key; of rows with equal key and text one stays.

    That is the least by the other columns' JSON. Documents without a key belong to no group and stay.
    """
    extra = linked(docs.where(F.col(key).isNotNull()).select(key, text), key, text, **how).where(F.col("key") != F.col("component_id")).select(F.col("key").alias(key)).distinct()
    kept = docs.join(extra, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    often = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    place = F.row_number().over(Window.partitionBy(f"`{key}`", F.sha2(F.coalesce(text, F.lit("")), 256), F.col(text).isNull()).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    return kept.join(often, key, "left_anti").select(*[f"`{c}`" for c in docs.columns]).unionByName(kept.join(often, key, "left_semi").select(*[f"`{c}`" for c in docs.columns], place.alias("__place")).where("__place = 1").drop("__place"))
