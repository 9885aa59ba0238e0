"""N-gram Jaccard join in the metric space of shingle sets, exact.

Jaccard distance d is a metric, and two documents link when d <= r. Equal sets are one class from the
start (128-bit digests); what follows is about classes, called documents.

Regions: the root pivots are documents. Of each document the rarest shingles are looked at, so many that linked
ones share one of them (all others have distance 1 to each other as far as links go). Each shingle points to the smallest
document that has it so, its pivot, and a document lies in the region of each pivot its shingles point to.
Linked documents share a shingle, so they share a pivot; no region is closed transitively, and
copies, which share most shingles, share few pivots. A shingle that one document alone has leads nowhere and
is dropped; most documents are in no region. (Pivots drawn from all documents tell nothing here: two
texts have distance 1 nearly always, so each window of a pivot would hold the whole table.)

Voronoi: a region picks some of its documents as pivots. Each document is at home with its
nearest pivot, and is replicated to each pivot p with d(x, p) <= d(x, home) + 2r. Cells are split
again: those that are too large for a task by a shuffle, others inside the task. Cells of a few
documents, and those whose windows hold nearly all, are leaves; a leaf too large for a task is a grid of pairs of chunks.

Leaf: pairs are tested on whole sets; the size ratio and |d(x, p) - d(y, p)| <= r for the pivots leave
out what can't link. A pair counts in one cell only: in its smallest common region, and there in
the cell of the smaller home.

Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, n_parts, part_bytes, utf8
from .components import components
from .suffixes import _ddl, _expand, _squeeze, _table

BLOCK, BUCKET = 4_000_000, 12_000_000
PIECE = 1 << 18  # bytes of texts that are hashed at a time
CELL, CELL_BYTES, PIVOTS, ROUNDS = 1500, 16_000_000, 32, 3  # a cell that is larger is split over tasks
LEAF, TASK_BYTES = 24, 8_000_000  # a smaller cell isn't split; cells that a task takes together
BROADCAST_ROWS = 10_000  # of two numbers each
LOW = np.iinfo(np.int64).min
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
_BASE = 0xD1342543DE82EF95
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if _powers[0].size < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, runs of bytes other than white space; A-Z count as a-z."""
    if not raw.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    letter = ~_SPACE[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begins = off[:-1][off[:-1] < raw.size]
    first[begins] = letter[begins]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = letter[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(raw.size)
    total = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: raw.size], out=total[1:])
    h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _GOLD)
    return h, np.searchsorted(off, start, side="right") - 1


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words make one shingle, none an empty set."""
    out: list[np.ndarray] = []
    n, begin = off.size - 1, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + PIECE, side="right")) - 1)
        out += _sets_of_piece(raw[off[begin] : off[end]], off[begin : end + 1] - off[begin], k)
        begin = end
    return out


def _sets_of_piece(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    h, text = words(raw, off)
    count = np.bincount(text, minlength=off.size - 1)
    at = np.cumsum(count) - count
    g = h.copy()
    for step in range(1, k):
        g = mix64(mix64(g[: g.size - 1]) + h[step:]) if g.size > 1 else g[:0]
    out = []
    for a, c in zip(at.tolist(), count.tolist()):
        if c >= k:
            s = np.sort(g[a : a + c - k + 1])
            keep = np.ones(s.size, bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif c:
            x = np.array([c], np.uint64) * _GOLD
            for w in range(a, a + c):
                x = mix64(x + h[w])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_fields = lambda **f: pa.schema(
    [(k, {"i": pa.int32(), "l": pa.int64(), "b": pa.binary(), "a": pa.list_(pa.int64())}[v]) for k, v in f.items()]
)
NAMED = _fields(bucket="i", block="i", kind="i", n="l", a="b", b="b", c="b", d="b", e="b")
ANSWER = _fields(block="i", bucket="i", kind="i", n="l", a="b", b="b", c="b")
SETS = _fields(block="i", row="l", doc_id="l", h="l", n="l", rep="l", least="l", weight="l", tokens="b", shingles="b")
EDGES = _fields(least="l", doc="l", root_least="l", root="l", links="l")


class Block:
    """Sets of a block's texts in the order of their ids; equal sets are one class, of the smallest id."""

    def __init__(self, t: pa.Table, k: int, bits: int, buckets: int):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.hashes = t.column("doc_id").to_numpy(), t.column("h").to_numpy()
        self.rows = (np.int64(t.column("block")[0].as_py()) << 32) + np.arange(len(self.ids))
        self.sets = shingle_sets(*utf8(t.column("text")), k)
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        digest = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in self.sets)
        digest = np.frombuffer(digest, [("high", "<u8"), ("low", "<u8")])
        self.digests, self.first, self.of, self.count = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
        self.digest_edges = np.searchsorted(self._bucket(self.digests["high"], 64, buckets), np.arange(buckets + 1))
        own = [self.sets[i] for i in self.first]
        every = np.concatenate(own) >> np.uint64(64 - bits) if own else np.zeros(0, np.uint64)
        self.keys, self.key_of, self.key_count = np.unique(every, return_inverse=True, return_counts=True)
        self.key_edges = np.searchsorted(self._bucket(self.keys, bits, buckets), np.arange(buckets + 1))
        self.at = np.concatenate([[0], np.cumsum(self.sizes[self.first])])

    @staticmethod
    def _bucket(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
        return ((x >> np.uint64(bits - 30)).astype(np.int64) * buckets) >> 30

    def named(self):
        """(bucket, kind, n, arrays): counts of shingle keys; of digests first row, its id, and count."""
        for b, (x, y) in enumerate(zip(self.key_edges, self.key_edges[1:])):
            if x < y:
                yield b, 0, y - x, (self.keys[x:y], self.key_count[x:y], None, None, None)
        for b, (x, y) in enumerate(zip(self.digest_edges, self.digest_edges[1:])):
            if x < y:
                first = self.first[x:y]
                yield b, 1, y - x, (self.digests["high"][x:y], self.digests["low"][x:y], self.rows[first], self.ids[first], self.count[x:y])


def _summed(t: pa.Table) -> pa.Table:
    """Of each bucket: documents for each key; first row, its id and count for each digest."""
    out: dict[str, list] = {f.name: [] for f in ANSWER}
    for kind in (0, 1):
        rows = t.filter(pc.equal(t.column("kind"), kind)).to_pylist()
        if not rows:
            continue
        a, b, *more = (np.concatenate([_expand(r[c], r["n"]) for r in rows]) for c in ("ab", "abcde")[kind])
        if kind == 0:
            value, of = np.unique(a, return_inverse=True)
            answers = (np.bincount(of, b, value.size).astype(np.int64)[of],)
        else:
            row, doc, count = more
            order = np.lexsort((row, doc, b, a))
            new = np.ones(order.size, bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            group = np.zeros(order.size, np.int64)
            group[order] = np.cumsum(new) - 1
            first = order[new]
            answers = (row[first][group], doc[first][group], np.bincount(group, count).astype(np.int64)[group])
        at = 0
        for r in rows:
            parts = [_squeeze(x[at : at + r["n"]]) for x in answers] + [None, None]
            for name, x in zip(out, (r["block"], r["bucket"], kind, r["n"], *parts)):
                out[name].append(x)
            at += r["n"]
    return _table(out, ANSWER)


def _least_common(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def document_sets(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """SETS for each row: size, class (first row, smallest id, size); tokens and shingles for first rows that may link."""
    src = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    total = src.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks, buckets = n_parts(total, part_bytes(total, BLOCK)), n_parts(total, part_bytes(total, BUCKET))
    bits = min(56, max(34, int(total or 0).bit_length() + 5))  # keys only order shingles by their counts
    src = src.withColumn("h", F.xxhash64("text"))
    src = src.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "h"), F.lit(blocks)).cast("int"))

    def name(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in NAMED}
        block = t.column("block")[0].as_py()
        for b, kind, n, arrays in Block(t, k, bits, buckets).named():
            for c, x in zip(out, (b, block, kind, n, *[None if v is None else _squeeze(v) for v in arrays])):
                out[c].append(x)
        return _table(out, NAMED)

    def choose(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in SETS}
        if t.num_rows:
            number = t.column("block")[0].as_py()
            block = Block(t, k, bits, buckets)
            count = np.ones(block.keys.size, np.int64)
            rep, least, weight = (np.zeros(block.digests.size, np.int64) for _ in range(3))
            for r in answers.to_pylist():
                if r["kind"] == 0:
                    count[block.key_edges[r["bucket"]] : block.key_edges[r["bucket"] + 1]] = _expand(r["a"], r["n"])
                else:
                    at = slice(block.digest_edges[r["bucket"]], block.digest_edges[r["bucket"] + 1])
                    rep[at], least[at], weight[at] = (_expand(r[c], r["n"]) for c in "abc")
            for i, (row, doc, h, n, c) in enumerate(
                zip(block.rows.tolist(), block.ids.tolist(), block.hashes.tolist(), block.sizes.tolist(), block.of.tolist())
            ):
                tokens = shingles = None
                first = rep[c] == row
                if first and n:
                    mine = block.sets[i]
                    often = count[block.key_of[block.at[c] : block.at[c] + n]]
                    window = np.lexsort((mine, often))[: n - int(_least_common(np.int64(n), percent)) + 1]
                    window = window[often[window] > 1]
                    if window.size:
                        tokens, shingles = mine[window].tobytes(), mine.tobytes()
                whose = (int(rep[c]), int(least[c]), int(weight[c])) if n else (row, doc, 1)
                for name_, x in zip(out, (number, row, doc, h, n, *whose, tokens, shingles)):
                    out[name_].append(x)
        return _table(out, SETS)

    by_block = src.groupBy("block")
    answers = by_block.applyInArrow(name, _ddl(NAMED)).groupBy("bucket").applyInArrow(_summed, _ddl(ANSWER))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(choose, _ddl(SETS))


def _explode_tokens(batches):
    for batch in batches:
        tokens = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if tokens:
            docs = np.repeat(batch.column(0).to_numpy(), [x.size for x in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(docs)], ["token", "doc"])


def regions(able: DataFrame) -> DataFrame:
    """(doc, roots): the pivots whose regions a document lies in, ascending; documents in no region are left out."""
    tokens = able.select("doc", "tokens").mapInArrow(lambda it: _explode_tokens(b for b in it), "token long, doc long")
    pivots = tokens.groupBy("token").agg(F.min("doc").alias("root"), F.count("*").alias("n")).where("n > 1").drop("n")
    return tokens.join(pivots, "token").select("doc", "root").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("root")).alias("roots"))


class Space:
    """The documents of a cell, their shingles as small numbers: overlaps with one of them are sums of flags."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        token, of = np.unique(np.concatenate(sets), return_inverse=True)
        self.of = np.split(of, np.cumsum(self.size)[:-1])
        self.flag = np.zeros(token.size, np.int32)
        self.percent, self.r = percent, 1 - percent / 100 + 1e-9

    def flat(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[index]
        return np.concatenate([self.of[i] for i in index.tolist()]), np.cumsum(n) - n

    def common(self, i: int, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Size of the intersection of document ``i`` with each of those in ``flat``."""
        self.flag[self.of[i]] = 1
        out = np.add.reduceat(self.flag[flat], at)
        self.flag[self.of[i]] = 0
        return out

    def distances(self, index: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pivots among the documents of ``index``, each more than 2r from the others, and all distances to them."""
        flat, at = self.flat(index)
        pivots, columns = [], []
        for k in dict.fromkeys(np.linspace(0, index.size - 1, most).astype(int).tolist()):
            if all(c[k] > 2 * self.r for c in columns):
                both = self.common(index[k], flat, at)
                columns.append(1 - both / (self.size[index] + self.size[index[k]] - both))
                pivots.append(index[k])
        return np.array(pivots), np.stack(columns, 1)

    def pairs(self, index: np.ndarray, tests: list, label: np.ndarray | None, depth: int = 0):
        """Yield (i, js): linked pairs of ``index`` that pass the tests; with ``label`` only those between different labels.

        The Voronoi cells of the pivots are joined one by one, each like this one.
        """
        index = index[np.argsort(self.size[index], kind="stable")]
        if label is not None and (label[index] == label[index[0]]).all():
            return
        distance = None
        if index.size > LEAF:
            pivots, distance = self.distances(index, max(2, int(index.size**0.5)))
            near = distance <= distance.min(1)[:, None] + 2 * self.r
            if depth < 12 and pivots.size > 1 and near.sum(0).max() <= 0.7 * index.size:
                home = np.full(self.size.size, -1)
                home[index] = distance.argmin(1)
                for j in range(pivots.size):
                    mine = index[near[:, j]]
                    if mine.size > 1:
                        yield from self.pairs(mine, [*tests, lambda i, js, j=j: np.minimum(home[i], home[js]) == j], label, depth + 1)
                return
        flat, at = self.flat(index)
        ends = np.append(at[1:], flat.size)
        n = self.size[index]
        upto = np.searchsorted(n, n * 100 // self.percent, side="right")
        for k, i in enumerate(index.tolist()):
            low, high = k + 1, int(upto[k])
            if low >= high:
                continue
            js = index[low:high]
            may = np.ones(js.size, bool)
            if distance is not None:
                may = (np.abs(distance[low:high] - distance[k]) <= self.r).all(1)
            if label is not None:
                may &= label[js] != label[i]
            for test in tests:
                if may.any():
                    may[may] = test(i, js[may])
            if not may.any():
                continue
            if may.sum() * 4 < js.size:
                js = js[may]
                both = self.common(i, *self.flat(js))
            else:
                both = self.common(i, flat[at[low] : ends[high - 1]], at[low:high] - at[low])[may]
                js = js[may]
            js = js[100 * both >= self.percent * (self.size[i] + self.size[js] - both)]
            if js.size:
                yield i, js


def _join_cell(t: pa.Table, percent: int, counted: bool) -> tuple:
    """Columns of EDGES for a cell: for each document that links its local root and the weight of what it links to here."""
    least, docs = t.column("least").to_numpy(), t.column("doc").to_numpy()
    weight, sets = t.column("weight").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
    tests, m = [], docs.size
    root, cells, grid = (t.column(c)[0].as_py() for c in ("root", "cells", "grid"))
    # a pair that shares a smaller root meets there
    before: dict[int, list[int]] = {}
    roots = t.column("roots").to_pylist()
    for i, mine in enumerate(roots):
        for x in mine:
            if x >= root:
                break
            before.setdefault(x, []).append(i)
    others = {x: np.array(who) for x, who in before.items() if len(who) > 1}
    if others:
        def first_here(i, js):
            met = np.zeros(m, bool)
            for x in roots[i]:
                if x in others:
                    met[others[x]] = True
            return ~met[js]

        tests.append(first_here)
    if cells:
        parts = np.array(t.column("parts").to_pylist(), np.int64).reshape(m, -1)
        for level, c in enumerate(cells):
            tests.append(lambda i, js, p=parts[:, level], c=c: np.minimum(p[i], p[js]) == c)
    if grid is not None:
        chunk = t.column("chunk").to_numpy()
        tests.append(lambda i, js: (np.minimum(chunk[i], chunk[js]) == grid[0]) & (np.maximum(chunk[i], chunk[js]) == grid[1]))
    label, links, linked = np.arange(m), np.zeros(m, np.int64), np.zeros(m, bool)
    for i, js in Space(sets, percent).pairs(np.arange(m), tests, None if counted else label):
        links[i] += weight[js].sum()
        links[js] += weight[i]
        linked[i] = linked[js] = True
        joined = np.unique(np.append(label[js], label[i]))
        if joined.size > 1:
            label[np.isin(label, joined)] = joined[0]
    return tuple(x[linked] for x in (least, docs, least[label], docs[label], links))


def _leaves(percent: int, counted: bool):
    """Join the cells of a task, one after the other."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("least", "ascending"), ("doc", "ascending")])
        cell = t.column("cell").to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), cell.size]
        got = [_join_cell(t.slice(a, z - a), percent, counted) for a, z in zip(edges, edges[1:]) if z - a > 1]
        columns = [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, np.int64)] * len(EDGES)
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], schema=EDGES)

    return run


MEMBERS = _fields(cell="l", root="l", least="l", doc="l", weight="l", roots="a", shingles="b", cells="a", parts="a", parent="l")


def _assign(percent: int):
    """Give each document its home among the cell's pivots and the cells whose window it lies in."""

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        if not t.num_rows or not p.num_rows:
            return MEMBERS.empty_table()
        p = p.sort_by("doc")
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist() + p.column("shingles").to_pylist()]
        space, m = Space(sets, percent), t.num_rows
        flat, at = space.flat(np.arange(len(sets)))
        columns: list[np.ndarray] = []
        for k in range(m, len(sets)):
            if all(c[k] > 2 * space.r for c in columns):
                both = space.common(k, flat, at)
                columns.append(1 - both / (space.size + space.size[k] - both))
        distance = np.stack(columns, 1)[:m]
        home = distance.argmin(1)
        who, where = np.nonzero(distance <= distance.min(1)[:, None] + 2 * space.r)
        cells, parts, cell = t.column("cells")[0].as_py(), t.column("parts").to_pylist(), t.column("cell")[0].as_py()
        name = [
            int.from_bytes(
                hashlib.blake2b(f"{cell}/{len(cells)}/{j}".encode(), digest_size=8).digest(), "little", signed=True
            ) for j in range(distance.shape[1])
        ]
        out = t.take(pa.array(who))
        new = {
            "cell": pa.array([name[j] for j in where], pa.int64()), "cells": pa.array([cells + [int(j)] for j in where], pa.list_(pa.int64())),
            "parts": pa.array([parts[i] + [int(home[i])] for i in who], pa.list_(pa.int64())), "parent": out.column("size"),
        }
        return pa.table([new[c] if c in new else out.column(c) for c in MEMBERS.names], MEMBERS.names).cast(MEMBERS)

    return run


def split_cells(members: DataFrame, percent: int, cell: int = CELL, pivots: int = PIVOTS, rounds: int = ROUNDS) -> DataFrame:
    """Members (cell, root, least, doc, weight, roots, shingles) with cells, parts, grid, chunk: no cell has more than about 2 * ``cell`` documents or CELL_BYTES."""
    now = members.withColumns({"cells": F.array().cast("array<long>"), "parts": F.array().cast("array<long>"), "parent": F.lit(None).cast("long")})
    done = []
    columns = ["cell", "root", "least", "doc", "weight", "roots", "shingles", "cells", "parts"]
    whole = {"grid": F.lit(None).cast("array<long>"), "chunk": F.lit(0).cast("long")}
    for level in range(rounds + 1):
        sizes = now.groupBy("cell").agg(F.count("*").alias("size"), F.sum(F.octet_length("shingles")).alias("bytes"))
        sizes = sizes.withColumn("of", F.greatest(F.ceil(F.col("size") / cell), F.ceil(F.col("bytes") / CELL_BYTES)))
        sizes = cut(sizes.where("of > 1").drop("bytes"))
        n = sizes.count()
        if not n:
            done.append(now.select(*columns).withColumns(whole))
            break
        # large cells are few: if they are no more than the bound, the members aren't dealt out to find them
        sized = now.join(F.broadcast(sizes) if n <= BROADCAST_ROWS else sizes, "cell", "left")
        large = F.col("size").isNotNull()
        done.append(sized.where(~large).select(*columns).withColumns(whole))
        # stuck: the windows took in nearly everything; then pairs of chunks
        stuck = F.lit(True) if level == rounds else F.col("size") > 0.7 * F.coalesce("parent", F.col("size") * 2)
        grid = sized.where(large & stuck)
        grid = grid.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc"), "of")).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))
        )
        grid = grid.withColumn("grid", F.array(F.least("chunk", "other"), F.greatest("chunk", "other")))
        done.append(grid.withColumn("cell", F.xxhash64("cell", "grid")).select(*columns, "grid", "chunk"))
        if level == rounds:
            break
        rest = sized.where(large & ~stuck).drop("parent")
        order = F.xxhash64(F.lit("pivot"), F.lit(level), "doc")
        found = rest.groupBy("cell", F.pmod(order, F.lit(pivots)).alias("slot")).agg(
            F.min(F.struct(order.alias("o"), "doc", "shingles")).alias("p"), F.max("of").alias("of")
        )
        found = found.select(
            F.col("cell").alias("pivot_cell"), F.col("p.doc").alias("doc"), F.col("p.shingles").alias("shingles"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("pivot_chunk")
        )
        rest = rest.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc"), "of"))
        now = cut(rest.groupBy("cell", "chunk").cogroup(found.groupBy("pivot_cell", "pivot_chunk")).applyInArrow(_assign(percent), _ddl(MEMBERS)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _classes(docs: DataFrame, key: str, text: str, k: int, percent: int, cell: int, counted: bool) -> DataFrame:
    """SETS without tokens and shingles, and for each row: component (its smallest id), head (its first row), links."""
    sets = cut(document_sets(docs, key, text, k, percent))
    able = sets.where("shingles is not null").select("least", F.col("row").alias("doc"), "weight", "tokens", "shingles")
    members = cut(able.drop("tokens").join(regions(able), "doc"))
    total = members.agg(F.sum(F.octet_length("shingles") * F.size("roots"))).first()[0]
    placed = members.withColumn("root", F.explode("roots")).withColumn("cell", F.col("root"))
    tasks = n_parts(total, TASK_BYTES, 8)
    leaves = split_cells(placed, percent, cell).withColumn("task", F.pmod(F.xxhash64(F.lit("task"), "cell"), F.lit(tasks)))
    found = cut(leaves.groupBy("task").applyInArrow(_leaves(percent, counted), _ddl(EDGES)))
    links = found.groupBy("doc").agg(F.sum("links").alias("links"))
    # nodes go by their smallest id, so a component's root has the smallest of all
    roots = components(
        found.select(F.struct("least", "doc").alias("u"), F.struct(F.col("root_least").alias("least"), F.col("root").alias("doc")).alias("v"))
    )
    classes = roots.select(
        F.col("node.doc").alias("doc"), F.col("root.least").alias("component"), F.col("root.doc").alias("head")
    ).join(links, "doc").withColumnRenamed("doc", "rep")
    # a class is asked for once by each block, and told by block: copies of one text don't meet in a task
    rows = sets.drop("tokens", "shingles")
    asked = rows.select("block", "rep").distinct().join(classes, "rep")
    return rows.join(asked, ["block", "rep"], "left").withColumns(
        {"component": F.coalesce("component", "least"), "head": F.coalesce("head", "rep"), "links": F.coalesce("links", F.lit(0).cast("long"))}
    )


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, cell: int = CELL) -> DataFrame:
    """The rows of docs without those that another row of their component stands for: the one with the smallest doc_id.

    Links are between rows, so rows that share a doc_id are judged by their texts. A null id counts as
    the smallest. Rows without words are in no group and all stay. Columns of docs may have any names.
    """
    got = _classes(docs, key, text, k, percent, cell, False)
    got = got.withColumn("stays", (F.col("n") == 0) | (F.col("row") == F.col("head")))
    texts = cut(
        got.groupBy("doc_id", "h").agg(F.max("stays").alias("stays"), F.count_if(F.col("n") > 0).alias("copies")).where("not stays or copies > 1")
    )
    a, b = _free(docs, "_near_id"), _free(docs, "_near_hash")
    rows = docs.withColumns({a: F.coalesce(F.col(key).cast("long"), F.lit(LOW)), b: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    named = texts.toDF(a, b, "stays", "copies").select(a, b, "stays")
    # rows of one id and one text, of which one stays, are few; the others need no grouping
    kept = rows.join(named.select(a, b), [a, b], "left_anti")
    if not named.where("stays").isEmpty():
        kept = kept.unionByName(rows.join(named.where("stays").select(a, b), [a, b], "left_semi").dropDuplicates([a, b]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row.

    Two rows link when ``100 * |A and B| >= percent * |A or B|`` for their sets of k-word shingles.
    component_id is the smallest doc_id reachable by links; n_links counts the rows a row links
    to. Rows without words or text have an empty set and no links. Rows that share a doc_id are
    different rows, and are linked by their texts like others. A null id counts as the smallest but comes back as null (as component too). An empty table gives an
    empty result. Other columns of docs take no part.
    """
    out = _classes(docs, key, text, k, percent, cell, True)
    ident = lambda c: F.when(F.col(c) != F.lit(LOW), F.col(c))
    alone = F.col("n") == 0
    return out.select(
        ident("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), ident("component").alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("weight") - 1 + F.col("links")).cast("long").alias("n_links"),
    )
