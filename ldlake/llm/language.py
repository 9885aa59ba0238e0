"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order 3 is kept as counts of 4-byte strings (the shorter
orders are their marginals). Statistics are frozen after learning. A byte costs, in the longest
known context, ``-log2(count / (total + distinct))``; a byte new to that context pays the escape
``-log2(distinct / (total + distinct))`` and is coded in the next shorter context, down to a uniform
byte (method C escapes, no exclusions). The language with the shortest code for the whole text wins.

Code lengths are summed in units of 1/1024 bit, so sums don't depend on the order of addition.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

PAD = 10  # the context before a text: line feeds
UNIT = 1024
SEGMENT = 1 << 16
WINDOW = 1 << 18  # bytes scored at a time, whatever the texts' lengths; a multiple of SEGMENT
LEAST_ROWS = 50
MOST_LANGUAGES = 200  # the model, which is sent to all executors, grows with their number
LETTER = re.compile("[A-Za-z]")


def _grams(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte the 4-byte code of its three predecessors in the text and itself."""
    b = raw.astype(np.uint32)
    code = b.copy()
    for back in (1, 2, 3):
        prev = np.full(b.size, PAD, np.uint32)
        prev[back:] = b[: b.size - back]
        for k in range(back):
            at = off[:-1] + k
            prev[at[at < off[1:]]] = PAD
        code |= prev << np.uint32(8 * back)
    return code


def count_grams(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, code, n): how often each 4-byte string occurs in the texts of each language."""

    def count(batches):
        for batch in batches:
            langs = batch.column(0)
            for value in pc.unique(langs).to_pylist():
                raw, off = utf8(batch.column(1).filter(pc.equal(langs, value)))
                code, n = np.unique(_grams(raw, off), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([value] * code.size, pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "code", "n"]
                )

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The frozen trees of all languages, as look-up tables over what any of them has seen."""

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.langs = langs
        nl = len(langs)
        grams, at = np.unique(code.astype(np.int64), return_inverse=True)
        counts = np.zeros((nl, grams.size))
        np.add.at(counts, (lang, at), n)
        orders = [(grams, counts)]
        for k in (3, 2, 1):
            short, at = np.unique(orders[0][0] & ((1 << 8 * k) - 1), return_inverse=True)
            less = np.zeros((nl, short.size))
            np.add.at(less, (slice(None), at), orders[0][1])
            orders.insert(0, (short, less))
        cost = np.full((nl, 256), 8.0)
        esc_of: list[tuple[np.ndarray, np.ndarray]] = []
        lower_codes, lower = np.arange(256), cost
        for k, (codes, c) in enumerate(orders):
            ctx, at = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.zeros((nl, ctx.size)), np.zeros((nl, ctx.size))
            np.add.at(total, (slice(None), at), c)
            np.add.at(kinds, (slice(None), at), c > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(c / (total + kinds)[:, at])
            below = lower[:, np.searchsorted(lower_codes, codes & ((1 << 8 * max(k, 1)) - 1))]
            mine = np.where(c > 0, seen, esc[:, at] + below)
            esc_of.append((ctx, esc))
            if k == 0:  # dense from here: every byte has a cost
                dense = esc[:, :1] + cost if codes.size else cost
                dense[:, codes] = mine
                lower_codes, lower = np.arange(256), dense
            elif k == 1:
                dense = np.repeat(lower[:, None, :], 256, 1)
                dense[:, ctx, :] += esc[:, :, None]
                dense = dense.reshape(nl, 65536)
                dense[:, codes] = mine
                lower_codes, lower = np.arange(65536), dense
                self.two = dense
            else:
                lower_codes, lower = codes, mine
                if k == 2:
                    self.three_codes, self.three = codes, mine
        self.esc2, self.esc3 = esc_of[2], esc_of[3]
        self._pack(orders[3][0], lower)

    def _pack(self, codes: np.ndarray, cost: np.ndarray) -> None:
        """Tables for the scan: context of three bytes, byte -> row of fixed-point costs, two languages to a word.

        A context is found by its first two bytes, then its third, so the tables hold what was seen, not all that 24 bits can say.
        """
        ctx = np.unique(np.concatenate([self.three_codes, codes >> 8]))
        symbols = np.unique(np.concatenate([ctx & 255, codes & 255]))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[symbols] = np.arange(1, symbols.size + 1)
        self.width = symbols.size + 1
        pairs = np.unique(ctx >> 8)
        self.pair = np.zeros(1 << 16, np.int32)
        self.pair[pairs] = np.arange(1, pairs.size + 1)
        self.context = np.zeros((pairs.size + 1) * self.width, np.int32)
        self.context[self._place(ctx)] = np.arange(1, ctx.size + 1)
        self.row = np.zeros((ctx.size + 1) * self.width, np.int32)
        self.row[self.context[self._place(codes >> 8)] * self.width + self.symbol[codes & 255]] = np.arange(1, codes.size + 1)
        fixed = np.rint(cost * UNIT).astype(np.uint64)
        if fixed.shape[0] % 2:
            fixed = np.vstack([fixed, np.zeros((1, fixed.shape[1]), np.uint64)])
        words = fixed[0::2] | (fixed[1::2] << np.uint64(32))
        self.words = np.hstack([np.zeros((words.shape[0], 1), np.uint64), words])

    def _place(self, ctx: np.ndarray) -> np.ndarray:
        """Where the contexts are in ``context``; it has 0 there for those that aren't known."""
        return self.pair[ctx >> 8] * self.width + self.symbol[ctx & 255]

    def _missed(self, code: np.ndarray) -> np.ndarray:
        """Costs (bytes x languages, fixed point) of what no language has seen in its context of three."""

        def esc(table, ctx):
            if not table[0].size:
                return np.zeros((table[1].shape[0], ctx.size))
            at = np.minimum(np.searchsorted(table[0], ctx), table[0].size - 1)
            return np.where(table[0][at] == ctx, table[1][:, at], 0.0)

        code = code.astype(np.int64)
        cost = esc(self.esc3, code >> 8)
        short = code & 0xFFFFFF
        at = np.minimum(np.searchsorted(self.three_codes, short), self.three_codes.size - 1)
        known = self.three_codes[at] == short
        cost += np.where(known, self.three[:, at], esc(self.esc2, short >> 8) + self.two[:, short & 0xFFFF])
        return np.rint(cost.T * UNIT).astype(np.uint64)

    def _add_window(self, out: np.ndarray, raw: np.ndarray, off: np.ndarray, begin: int, end: int) -> None:
        """Add the costs of the bytes from begin to end to those of their texts; bytes before them are context only."""
        nl, back = len(self.langs), min(3, begin)
        first, last = np.searchsorted(off, begin, side="right") - 1, np.searchsorted(off, end)
        inside = np.clip(off[first : last + 1], begin - back, end) - (begin - back)
        code = _grams(raw[begin - back : end], inside)[back:]
        row = self.row[self.context[self._place(code >> np.uint32(8))] * self.width + self.symbol[raw[begin:end]]]
        # no segment crosses a text or holds so much that half a word could overflow
        heads = off[first:last][off[first:last] < off[first + 1 : last + 1]]
        starts = np.unique(np.concatenate([heads[heads >= begin], np.arange(begin, end, SEGMENT)]))
        owner = np.searchsorted(off, starts, side="right") - 1
        for pair, words in enumerate(self.words):
            sums = np.add.reduceat(words[row], starts - begin)
            for lang, part in ((2 * pair, sums & np.uint64(0xFFFFFFFF)), (2 * pair + 1, sums >> np.uint64(32))):
                if lang < nl:
                    np.add.at(out[:, lang], owner, part.astype(np.int64))
        missed, some = np.flatnonzero(row == 0), max(1, WINDOW // nl)
        for k in range(0, missed.size, some):
            at = missed[k : k + some]
            np.add.at(out, np.searchsorted(off, at + begin, side="right") - 1, self._missed(code[at]).astype(np.int64))

    def code_lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text (row) under each language (column)."""
        nl, n = len(self.langs), off.size - 1
        out = np.zeros((n, nl), np.int64)
        for begin in range(0, raw.size, WINDOW):
            self._add_window(out, raw, off, begin, min(begin + WINDOW, raw.size))
        return out / UNIT


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_bytes: int = 3_000_000) -> tuple | None:
    """Learn from labelled rows; at most about ``max_bytes`` of text a language are used.

    The bound is kept by a seeded hash of the key: a language with more text gives a share of its
    rows, evenly over the table, but of about LEAST_ROWS rows at least, so that none is left out. More than
    MOST_LANGUAGES labels are an error. Other columns take no part, whatever their names. Returns what ``ContextTrees`` needs, or None without any row.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    sums = rows.groupBy(F.col(lang).cast("string")).agg(F.sum(F.octet_length(text)), F.count("*"))
    sizes = sums.limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    rates = F.create_map(*[F.lit(x) for value, size, n in sizes for x in (value, min(1.0, max(max_bytes / size, LEAST_ROWS / n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("ppm"), F.col(key)), F.lit(1 << 30)) < rates[F.col(lang).cast("string")] * (1 << 30))
    got = count_grams(sample, lang, text).toPandas()
    langs = sorted(set(got["lang"]))
    index = {v: i for i, v in enumerate(langs)}
    return langs, got["lang"].map(index).to_numpy(np.int64), got["code"].to_numpy(), got["n"].to_numpy()


_built: dict[str, ContextTrees | None] = {}


def _trees(tag: str, held) -> ContextTrees | None:
    """The trees of a broadcast model, built once in a worker. A function of the module is sent by name, so its tasks
    share the dict; one that is sent whole, as those inside of functions are, brings an empty copy of it for each task."""
    if tag not in _built:
        _built.clear()
        _built[tag] = None if held.value is None else ContextTrees(*held.value)
    return _built[tag]


def identify(docs: DataFrame, model: tuple | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row, from the whole text alone.

    Null text and text without a letter give ``und`` with score 0, as does everything if there is
    no model. Texts of one language only known give score 1. Equal code lengths go to the language
    that sorts first. The score is the winner's posterior under equal priors. No shuffle: rows are
    scored where they are read; other columns may have any names, they aren't touched.
    """
    import uuid

    sc = docs.sparkSession.sparkContext
    held, tag = sc.broadcast(model), uuid.uuid4().hex
    own = keep.index(text) if text in keep and dict(docs.dtypes)[text] == "string" else len(keep)  # where the text is among the columns sent
    more = [F.col(text).cast("string").alias("text")] if own == len(keep) else []
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *more)
    schema = ", ".join(f"k{i} {src.schema[i].dataType.simpleString()}" for i in range(len(keep))) + ", lang_pred string, score double"

    def score(batches):
        trees = _trees(tag, held)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts = batch.column(own)
                raw, off = utf8(texts)
                said = [bool(t) and bool(LETTER.search(t) or any(map(str.isalpha, t))) for t in (x.as_py() for x in texts)]
                if trees is None:
                    pred, prob = ["und"] * len(said), np.zeros(len(said))
                else:
                    bits = trees.code_lengths(raw, off)
                    best = bits.argmin(1)
                    more = bits - bits[np.arange(len(said)), best][:, None]
                    prob = np.where(said, 1 / np.exp2(-np.minimum(more, 1000)).sum(1), 0.0)
                    pred = [trees.langs[k] if s else "und" for k, s in zip(best, said)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(prob)],
                    [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"]
                )
            whole = batch = texts = raw = None  # or they stay while the next batch is read

    out = src.mapInArrow(score, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
