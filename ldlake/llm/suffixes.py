"""Suffix-array deduplication: later copies of long strings go, the first stays.

A position of a text is a copy if its 50-byte string also starts in a document with a smaller id, that
is, if its longest previous factor is at least 50 long. All suffixes of a corpus can't be sorted in one
place, so they are split into classes that are sure to hold equal 50-byte strings together: the
class of a string is the smallest hash among its 24-byte substrings (a minimiser). Neighbouring
strings share a minimiser, so a class holds short fragments of text rather than single strings.

1. Texts are dealt into blocks, by id and text, so that rows of one id or without one don't gather in one. A block names its minimisers; a minimiser in one document only is
   dropped. That answer is one bit for each.
2. A block sends the distinct fragments of the other minimisers, each with the smallest document
   that has it. Where a minimiser has several fragments, their suffixes are sorted (prefix doubling,
   up to 50 bytes), and for each suffix the previous and the next smaller document in suffix order give its
   longest previous factor. The answer is a bit for each of the fragment's positions.
3. The block removes what is covered.

Texts are shuffled once (the three passes share the exchange); all else are compressed arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, n_parts, part_bytes, utf8

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams in a string
BLOCK, BUCKET = 4_000_000, 8_000_000
FRAGMENTS_AT_ONCE = 1 << 15
PIECE, SORTED = 1 << 15, 1 << 18  # bytes at a time: hashed in a cache's size, and sorted
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width``."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: x.size - step], x[step:])
        have += step
    return x


def _minimisers(raw: np.ndarray) -> np.ndarray:
    """For each start of a string: (40 bits of the smallest gram hash) << 24 | position of the leftmost such gram."""
    h1 = _TABLE[raw]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    key = mix64(h16[:-8] * _power(8) + h8[16:])
    key &= np.uint64(0xFFFFFFFFFF000000)
    key |= np.arange(key.size, dtype=np.uint64)
    return _minimum(key, SPAN)


def runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, hash): maximal runs of string starts with one minimiser, within texts."""
    parts: list[tuple] = []
    n = raw.size - LENGTH + 1
    step = np.zeros(raw.size + 1, np.int32)
    long = np.diff(off) >= LENGTH
    np.add.at(step, off[:-1][long], 1)
    np.add.at(step, off[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(step[:-1]) > 0
    for begin in range(0, max(n, 0), PIECE):
        end = min(n, begin + PIECE)
        key = _minimisers(raw[begin : end + LENGTH - 1])
        ok = inside[begin:end]
        new = np.ones(key.size, bool)
        new[1:] = (key[1:] != key[:-1]) | ~ok[:-1]
        last = np.ones(key.size, bool)
        last[:-1] = new[1:] | ~ok[1:]
        first = np.flatnonzero(new & ok)
        # smallest hashes crowd near 0: hashed again, they spread over the buckets
        parts.append((first + begin, np.flatnonzero(last & ok) + begin, mix64(key[first] >> np.uint64(24)) >> np.uint64(24)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value (-1: none), by jumping over what isn't smaller."""
    prev = np.arange(-1, values.size - 1)
    todo = np.flatnonzero((prev >= 0) & (values[np.maximum(prev, 0)] >= values))
    while todo.size:
        prev[todo] = prev[prev[todo]]
        at = prev[todo]
        todo = todo[(at >= 0) & (values[np.maximum(at, 0)] >= values[todo])]
    return prev


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of each position by the ``length`` bytes from there, for positions with so many (prefix doubling from eight)."""
    have = 1
    key = text.astype(np.uint64)
    while have < 8:
        key = (key[: key.size - have] << np.uint64(8 * have)) | key[have:]
        have *= 2
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while have < length:
        step = min(have, length - have)
        pair = (rank[: rank.size - step] << 32) | rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64)
        have += step
    return rank


def copies(text: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True for the starts whose ``length`` bytes also start in a smaller document.

    Starts are put into suffix order; previous and next smaller document there are each start's
    candidates for its longest previous factor, which is ``length`` or more if one has its rank.
    """
    if not starts.size:
        return np.zeros(0, bool)
    rank = suffix_ranks(text, length)[starts]
    order = np.argsort(rank, kind="stable")
    r, d = rank[order], docs[order]
    before = previous_smaller(d)
    after = d.size - 1 - previous_smaller(d[::-1])[::-1]
    hit = (before >= 0) & (r[np.maximum(before, 0)] == r)
    hit |= (after < d.size) & (r[np.minimum(after, d.size - 1)] == r)
    out = np.zeros(starts.size, bool)
    out[order] = hit
    return out


def _squeeze(x: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed: sorted or small ones take little."""
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _table(columns: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Block:
    """The texts of a block in the order of their ids, and their runs."""

    def __init__(self, t: pa.Table, buckets: int):
        self.t = t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = t.column("doc_id").to_numpy()
        self.raw, self.off = utf8(t.column("text"))
        self.first, self.last, h = runs(self.raw, self.off)
        self.doc = self.ids[np.searchsorted(self.off, self.first, side="right") - 1]
        self.hashes, self.of = np.unique(h, return_inverse=True)
        self.bucket = (self.hashes.astype(np.int64) * buckets) >> 40
        self.edges = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def named(self, block: int):
        """For each bucket (bucket, hashes << 1 | in several documents)."""
        low = np.full(self.hashes.size, np.iinfo(np.int64).max)
        high = np.full(self.hashes.size, np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.doc)
        np.maximum.at(high, self.of, self.doc)
        value = (self.hashes.astype(np.int64) << 1) | (low < high)
        for b, (x, y) in enumerate(zip(self.edges, self.edges[1:])):
            if x < y:
                yield b, value[x:y]

    def shared(self, answers: dict[int, bytes]) -> None:
        """Keep the runs whose minimiser is in several documents, and number their fragments."""
        keep = np.zeros(self.hashes.size, bool)
        for b, bits in answers.items():
            x, y = self.edges[b], self.edges[b + 1]
            keep[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        use = np.flatnonzero(keep[self.of])
        use = use[np.argsort(self.of[use], kind="stable")]  # by hash, so by bucket
        self.first, self.last, self.doc, self.of = self.first[use], self.last[use], self.doc[use], self.of[use]
        data, number = self.raw.tobytes(), {}
        self.fragment = np.fromiter(
            (number.setdefault(data[s:e], len(number)) for s, e in zip(self.first.tolist(), (self.last + LENGTH).tolist())), np.int64,
            use.size
        )
        self.content = list(number)
        self.least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.fragment, self.doc)
        hash_of = np.zeros(len(number), np.int64)
        hash_of[self.fragment] = self.hashes[self.of]
        self.hash_of = hash_of
        self.fragment_edges = np.searchsorted((hash_of * (len(self.edges) - 1)) >> 40, np.arange(len(self.edges)))

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """True for each byte that goes."""
        bits = np.zeros(len(self.content), np.int64)
        for b, data in answers.items():
            x, y = self.fragment_edges[b], self.fragment_edges[b + 1]
            bits[x:y] = _expand(data, y - x)
        bits = np.where(self.doc > self.least[self.fragment], (1 << SPAN) - 1, bits[self.fragment])
        count = self.last - self.first + 1
        run = np.repeat(np.arange(count.size), count)
        place = np.arange(run.size) - np.repeat(np.cumsum(count) - count, count)
        hit = (bits[run] >> place) & 1 == 1
        starts = self.first[run[hit]] + place[hit]
        gone = np.zeros(self.raw.size + 1, bool)
        gone[starts] = True
        last = np.where(gone, np.arange(gone.size), -LENGTH)  # the last hit at or before each byte
        return (np.arange(gone.size) - np.maximum.accumulate(last) < LENGTH)[:-1]


NAMED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("bits", pa.binary())])
FRAGMENTS = pa.schema(
    [
        ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("size", pa.int64()), ("hashes", pa.binary()),
        ("lengths", pa.binary()), ("docs", pa.binary()), ("text", pa.binary())
    ]
)
_TYPES = {"int32": "int", "int64": "long", "double": "double", "list<item: int64>": "array<long>", "list<element: int64>": "array<long>"}
_ddl = lambda s: ", ".join(f"{f.name} {_TYPES.get(str(f.type), str(f.type))}" for f in s)


def _answers(t: pa.Table, kind: int) -> dict[int, bytes]:
    t = t.filter(pc.equal(t.column("kind"), kind))
    return dict(zip(t.column("bucket").to_pylist(), t.column("bits").to_pylist()))


def _several(t: pa.Table) -> pa.Table:
    """Of each bucket: which hashes are in several documents."""
    out: dict[str, list] = {f.name: [] for f in ANSWER}
    values = [_expand(h, n) for h, n in zip(t.column("hashes").to_pylist(), t.column("n").to_pylist())]
    every = np.concatenate(values)
    every.sort()
    new = np.ones(every.size, bool)
    new[1:] = every[1:] >> 1 != every[:-1] >> 1
    at = np.flatnonzero(new)
    shared = (np.diff(np.append(at, every.size)) > 1) | (every[np.append(at[1:], every.size) - 1] & 1 == 1)
    hashes = every[at] >> 1
    for block, bucket, v in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), values):
        for name, x in zip(out, (block, bucket, 0, np.packbits(shared[np.searchsorted(hashes, v >> 1)]).tobytes())):
            out[name].append(x)
    return _table(out, ANSWER)


def _copied_bits(text: bytes, ends: np.ndarray, lengths: np.ndarray, docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each fragment (of whole minimisers) the positions that are copies of one in a smaller document."""
    # equal fragments of several blocks are one, of the smallest document
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(text[e - n : e], len(number)) for e, n in zip(ends.tolist(), lengths.tolist())), np.int64, ends.size)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, docs)
    hash_of, end_of, length_of = (np.zeros(len(number), np.int64) for _ in range(3))
    hash_of[of], end_of[of], length_of[of] = hashes, ends, lengths
    bits = np.zeros(len(number), np.int64)
    # minimisers with several fragments, some whole ones at a time
    order = np.argsort(hash_of, kind="stable")
    h = hash_of[order]
    same = np.zeros(h.size, bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= h[:-1] == h[1:]
    order, h = order[same], h[same]
    size = np.cumsum(length_of[order])
    raw = np.frombuffer(text, np.uint8)
    begin = 0
    while begin < order.size:
        end = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SORTED, side="right"))
        end = int(np.searchsorted(h, h[min(max(end, begin + 1), h.size) - 1], side="right"))
        part = order[begin:end]
        n = length_of[part]
        at = np.repeat(end_of[part] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
        count = n - LENGTH + 1
        who = np.repeat(np.arange(part.size), count)
        place = np.arange(who.size) - np.repeat(np.cumsum(count) - count, count)
        hit = copies(raw[at], (np.cumsum(n) - n)[who] + place, least[part][who])
        np.bitwise_or.at(bits, part[who[hit]], np.int64(1) << place[hit])
        begin = end
    return np.where(docs > least[of], (1 << SPAN) - 1, bits[of])


def _previous_factors(t: pa.Table) -> pa.Table:
    """Of each bucket: for each fragment of each block the positions that are copies from outside the block."""
    t = t.sort_by("block")
    sizes = t.column("n").to_pylist()
    hashes, lengths, docs = (np.concatenate([_expand(x, n) for x, n in zip(t.column(c).to_pylist(), sizes)]) for c in ("hashes", "lengths", "docs"))
    text = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(t.column("text").to_pylist(), t.column("size").to_pylist()))
    ends = np.cumsum(lengths)
    order = np.argsort(hashes, kind="stable")
    by_hash = hashes[order]
    found = np.zeros(hashes.size, np.int64)
    begin = 0
    while begin < order.size:  # whole minimisers, some fragments at a time
        end = int(np.searchsorted(by_hash, by_hash[min(begin + FRAGMENTS_AT_ONCE, order.size) - 1], side="right"))
        part = order[begin:end]
        found[part] = _copied_bits(text, ends[part], lengths[part], docs[part], hashes[part])
        begin = end
    out: dict[str, list] = {f.name: [] for f in ANSWER}
    at = 0
    for block, bucket, n in zip(t.column("block").to_pylist(), t.column("bucket").to_pylist(), sizes):
        for name, x in zip(out, (block, bucket, 1, _squeeze(found[at : at + n]))):
            out[name].append(x)
        at += n
    return _table(out, ANSWER)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept][, carried]) for each row.

    Each byte covered by a 50-byte string that also starts in a document with a smaller id is removed;
    strings are judged on the input. ``spans`` has begin and end of the maximal removed runs. Null
    text is empty; a null id counts as the smallest; rows with the same id don't remove from
    each other. ``keep_text`` adds what is left, decoded; bytes of characters cut in half are dropped.
    The columns in ``carry`` come along under their names. An empty table gives an empty result.
    """
    low = np.iinfo(np.int64).min
    src = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    )
    total = src.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks, buckets = n_parts(total, part_bytes(total, BLOCK)), n_parts(total, part_bytes(total, BUCKET))
    src = src.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "text"), F.lit(blocks)).cast("int"))

    def name(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in NAMED}
        block = t.column("block")[0].as_py()
        for b, value in Block(t, buckets).named(block):
            for k, x in zip(out, (b, block, value.size, _squeeze(value))):
                out[k].append(x)
        return _table(out, NAMED)

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in FRAGMENTS}
        if t.num_rows and answers.num_rows:
            number = t.column("block")[0].as_py()
            block = Block(t, buckets)
            block.shared(_answers(answers, 0))
            edges = block.fragment_edges
            for b, (x, y) in enumerate(zip(edges, edges[1:])):
                if x < y:
                    body = b"".join(block.content[x:y])
                    lengths = np.fromiter(map(len, block.content[x:y]), np.int64, y - x)
                    for k, v in zip(
                        out,
                        (
                            b, number, y - x, len(body), _squeeze(block.hash_of[x:y]), _squeeze(lengths), _squeeze(block.least[x:y]),
                            pa.compress(body, codec="zstd", asbytes=True)
                        )
                    ):
                        out[k].append(v)
        return _table(out, FRAGMENTS)

    result = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
            ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), *([("kept", pa.string())] if keep_text else [])
        ]
    )

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in result}
        if t.num_rows:
            block = Block(t, buckets)
            gone = np.zeros(block.raw.size, bool)
            if answers.num_rows:
                block.shared(_answers(answers, 0))
                gone = block.removed(_answers(answers, 1))
            for doc, a, z in zip(block.ids.tolist(), block.off[:-1].tolist(), block.off[1:].tolist()):
                mine = gone[a:z]
                turns = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                kept = (block.raw[a:z][~mine] if turns.size else block.raw[a:z]).tobytes()
                row = (
                    None if doc == low else doc, z - a, int(mine.sum()), turns.size // 2, hashlib.sha256(kept).hexdigest(), turns,
                    kept.decode("utf-8", "ignore") if keep_text else None
                )
                for k, v in zip(out, row):
                    out[k].append(v)
        done = _table(out, result)
        for i in range(len(carry)):
            column = block.t.column(f"c{i}") if t.num_rows else pa.chunked_array([], t.schema.field(f"c{i}").type)
            done = done.append_column(f"c{i}", column)
        return done

    by_block = src.groupBy("block")
    several = by_block.applyInArrow(name, _ddl(NAMED)).groupBy("bucket").applyInArrow(_several, _ddl(ANSWER))
    fragments = by_block.cogroup(several.groupBy("block")).applyInArrow(send, _ddl(FRAGMENTS))
    factors = fragments.groupBy("bucket").applyInArrow(_previous_factors, _ddl(ANSWER))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept string" * keep_text
    ddl += "".join(f", c{i} {src.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    out = by_block.cogroup(several.unionByName(factors).groupBy("block")).applyInArrow(finish, ddl)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
