"""Exact top-k by inner product over an impact-ordered index, score at a time.

Rows lie in blocks of bounded size. A block's index has posting segments: for a component and a quantised
impact (which of LEVELS quantiles of the block its magnitude lies in) the rows that have it, each
with its whole value. Segments are processed by descending impact for some queries at once; a
posting adds query component * value to its row's accumulator.

After each impact level a row's true score is known up to ``spread``: the largest magnitude of what
hasn't been processed, times the sum of |q|. The rows that can still be members
are those within two spreads of the k-th best accumulator. A query stops only when these are proven to be few, or
after the last level; they are then scored exactly, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts

VALUES = 1 << 20  # components of the rows in a block
QUERIES, AT_ONCE = 2_048, 64
LEVELS = 32
FEW = 64  # rows, or a thirty-second of the block: so many are scored exactly


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component) as long; rows with null, NaN or infinite parts, or a null key, are left out.

    Components from 2^53 on are an error.
    """
    x = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = F.forall("v", lambda c: F.abs(c) < 2**53)
    rows = df.where(good).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.withColumn("v", F.when(F.assert_true(fits, F.lit("component beyond 2^53")).isNull(), F.col("v")))


class Segments:
    """The posting segments of a block of vectors (``values`` with ``offsets``, whole numbers)."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, levels: int = LEVELS):
        self.values, self.offsets, self.size = values, offsets, np.diff(offsets)
        self.n = self.size.size
        rows = np.repeat(np.arange(self.n), self.size)
        component = np.arange(values.size) - np.repeat(offsets[:-1], self.size)
        magnitude = np.abs(values)
        self.largest = int(magnitude.max(initial=0))
        use = np.flatnonzero(values)  # a component of 0 adds nothing
        cuts = np.unique(np.quantile(magnitude[use], np.linspace(0, 1, levels + 1)[1:-1], method="higher")) if use.size else np.zeros(0)
        level = np.searchsorted(cuts, magnitude[use], side="right")
        order = np.lexsort((component[use], -level))
        level, use = level[order], use[order]
        component = component[use]
        self.rows, self.impact = rows[use], values[use].astype(float)[:, None]
        new = np.ones(use.size, bool)
        new[1:] = (level[1:] != level[:-1]) | (component[1:] != component[:-1])
        first = np.flatnonzero(new)
        #: (level, component, begin, end), impacts descending
        self.segments = list(zip(level[first].tolist(), component[first].tolist(), first.tolist(), [*first[1:].tolist(), use.size]))
        #: the largest magnitude of each level
        self.upper = np.zeros(int(level.max(initial=-1)) + 1)
        np.maximum.at(self.upper, level, magnitude[use])
        self.stopped: list[int] = []  # of each query, the levels that were left when it stopped

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers; ends of the longer vector don't count."""
        width = min(int(self.size[rows].max(initial=0)), q.size)
        at = np.arange(width)
        inside = at < self.size[rows][:, None]
        x = self.values[np.where(inside, self.offsets[rows][:, None] + at, 0)] * inside if width else np.zeros((rows.size, 0), np.int64)
        return x @ q[:width]

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row of whole numbers) the k best (ids, scores); rows with the query's own id don't count."""
        mass = np.abs(q).astype(float).sum(1)
        if self.n and float(mass.max(initial=0)) * self.largest >= 2.0**63:
            raise ValueError("scores beyond 64 bits")
        out: list = [None] * len(q)
        few = max(FEW, k, self.n // 32)
        open_ = np.arange(len(q))
        acc = np.zeros((self.n, len(q)))
        qt = q.astype(float).T.copy()
        at = 0
        while open_.size:
            top = self.segments[at][0] if at < len(self.segments) else -1
            while at < len(self.segments) and self.segments[at][0] == top:
                _, j, a, z = self.segments[at]
                if j < qt.shape[0]:
                    acc[self.rows[a:z]] += self.impact[a:z] * qt[j]
                at += 1
            left = self.segments[at][0] + 1 if at < len(self.segments) else 0  # levels not processed
            if left > LEVELS // 2 or left % 2:
                continue  # proofs are looked for after some of the levels
            spread = mass[open_] * ((self.upper[left - 1] if left else 0.0) + 1e-9 * self.largest)
            shown = np.where(ids[:, None] == own[open_], -np.inf, acc)
            least = np.partition(shown, self.n - k, axis=0)[self.n - k] if self.n > k else np.full(open_.size, -np.inf)
            may = (shown >= least - 2 * spread) & (shown > -np.inf)
            ready = np.ones(open_.size, bool) if not left else may.sum(0) <= few
            for c in np.flatnonzero(ready).tolist():
                rows = np.flatnonzero(may[:, c])
                score = self.exact(rows, q[open_[c]])
                best = np.lexsort((ids[rows], -score))[:k]
                out[open_[c]] = (ids[rows][best], score[best])
                self.stopped.append(left)
            if ready.any():
                open_, acc, qt = open_[~ready], acc[:, ~ready].copy(), qt[:, ~ready].copy()
        return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, ties to the smaller vec_id.

    Both tables are (vec_id, v) as ``quantised`` returns. Every query meets every block of rows
    in a grid of (row block, query block) cells; a cell returns k rows a query at most. Scores are whole numbers;
    if they can go beyond 64 bits it is an error. The ends of a longer vector count as if
    the other had zeros there. Each query row is a query of its own, with its own ranks, though another has its
    vec_id; rows with the query's vec_id are no candidates of it, and each other row is one,
    though another has its vec_id. Empty tables give an empty result; fewer than k candidates give all there are.
    """
    queries = queries.select("vec_id", "v", F.monotonically_increasing_id().alias("query_row"))
    count = lambda df: df.agg(F.sum(F.size("v")), F.count("*")).first()
    (n_values, n_rows), (_, n_queries) = count(rows), count(queries)
    nr, nq = n_parts((n_values or 0) + n_rows, VALUES), n_parts(n_queries, QUERIES)

    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        col = t.column("v").combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
        return col.flatten().to_numpy().astype(np.int64), (col.offsets.to_numpy() - col.offsets[0].as_py()).astype(np.int64)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, own, number = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), right.column("query_row").to_numpy()
            segments = Segments(*vectors(left))
            values, offsets = vectors(right)
            size = np.diff(offsets)
            for at in range(0, len(own), AT_ONCE):
                some = size[at : at + AT_ONCE]
                q = np.zeros((some.size, int(some.max(initial=0))), np.int64)
                q[np.arange(q.shape[1]) < some[:, None]] = values[offsets[at] : offsets[at + some.size]]
                for i, (found, scores) in enumerate(segments.search(q, own[at : at + AT_ONCE], ids, k), at):
                    for part, x in zip(parts, (np.full(found.size, own[i]), np.full(found.size, number[i]), found, scores)):
                        part.append(x)
        return pa.table(
            [pa.array(np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64)) for p in parts],
            ["query_id", "query_row", "vec_id", "score"]
        )

    block = lambda c, n: F.pmod(F.xxhash64(F.lit("topk"), c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", F.pmod(F.xxhash64(F.lit("topk"), "vec_id", "v"), F.lit(nr)).cast("int").alias("rb"), each(nq).alias("qb"))
    right = queries.select("vec_id", "query_row", "v", block("query_row", nq).alias("qb"), each(nr).alias("rb"))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(cell, "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
