"""Document fingerprints by a randomised edit embedding.

A text walks over shared random bits: at output step i the character under the pointer is written,
and the pointer moves on if the bit that belongs to (i, class of the character) is set. Texts at a
small edit distance fall back into step soon after each edit, so their outputs are at a small Hamming
distance. A fingerprint keeps the output at random steps (bit sampling) of two scales, that of the
text's own length and the next smaller one, so texts within about a factor of two can be compared.

Near duplicates are found by banding: texts whose fingerprints agree in a band of samples are candidates, whose
whole fingerprints are then compared.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_parts, part_bytes
from .suffixes import _ddl, _expand, _squeeze, _table

CLASSES, PERIOD, SAMPLES = 64, 1 << 16, 128
TEXT_PARTITION, MOST_PARTS = 24_000_000, 2_000_000  # bytes of text in a part; parts, whose sixteen bytes each are broadcast
BUCKET = 5_000  # texts whose bands meet in a bucket, about; up to 20 times as many in large tables
CHUNK = 512  # fingerprints of a bucket that meet those of another chunk in a tile
LEAST, BANDS, WIDTH = 0.5, 14, 7  # likeness of texts that have nothing in common stays below 0.3
AT_ONCE, FEW = 1 << 22, 16  # characters that walk together; texts of a batch that are walked one by one
LOW, NONE = np.iinfo(np.int64).min, 1 << 61  # stand for a null key, and for no key; keys lie between -NONE and NONE


def _walk_table(seed: int) -> np.ndarray:
    """For each class and step (periodic), how far the output gets until the pointer moves."""
    bits = np.random.default_rng(20240229 + seed).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    jump = np.zeros((CLASSES, PERIOD), np.uint8)
    for c in range(CLASSES):
        ones = np.flatnonzero(bits[c])
        nxt = np.append(ones, ones[0] + PERIOD)[np.searchsorted(ones, np.arange(PERIOD))]
        jump[c] = nxt - np.arange(PERIOD) + 1
    return jump


_tables: dict[int, tuple[np.ndarray, np.ndarray, list[bytes]]] = {}


def _tables_of(seed: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    if seed not in _tables:
        jump = _walk_table(seed)
        _tables[seed] = jump.ravel(), np.random.default_rng(7919 + seed).random(SAMPLES), [row.tobytes() for row in jump]
    return _tables[seed]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def walks(texts: list[np.ndarray], starts: list[int], seed: int = 0) -> list[np.ndarray]:
    """Output steps at which each character of each text begins, if the text begins at its start.

    All texts take a step at a time, one character each; those few that are much longer go on alone.
    """
    jump, _, rows = _tables_of(seed)
    m, mask = len(texts), PERIOD - 1
    size = np.fromiter(map(len, texts), np.int64, m)
    off = np.cumsum(size) - size
    classes = ((np.concatenate([*texts, np.zeros(0, np.uint32)]) * np.uint32(2654435769)) >> np.uint32(26)).astype(np.int32) << 16
    order = np.argsort(-size, kind="stable")
    o, b, n = off[order], (off + np.arange(m))[order], size[order]
    at = np.asarray(starts, np.int32)[order]
    begin = np.zeros(int(size.sum()) + m, np.int32)
    begin[b] = at
    step, active = 0, int((n > 0).sum())
    while active > FEW:
        here, there, i = o[:active], b[:active], at[:active]
        for step in range(step, int(n[active - 1])):
            i += jump[classes[here + step] + (i & mask)]
            begin[there + step + 1] = i
        step = int(n[active - 1])
        active = int((n > step).sum())
    for k in range(active):
        rest = (classes[o[k] + step : o[k] + n[k]] >> 16).astype(np.uint8).tobytes()
        begin[b[k] + step : b[k] + n[k] + 1] = np.fromiter(
            accumulate(rest, lambda i, c: i + rows[c][i & mask], initial=int(at[k])), np.int32, len(rest) + 1
        )
    ends = off + np.arange(m)
    return [begin[e : e + k + 1] for e, k in zip(ends.tolist(), size.tolist())]


def batches(sizes: list[int]):
    """(begin, end) of texts that walk together."""
    begin = total = 0
    for k, n in enumerate(sizes):
        if k > begin and total + n > AT_ONCE:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def fingerprints(texts: list[str], seed: int = 0) -> list[str]:
    out: list[str] = []
    for a, z in batches(list(map(len, texts))):
        points = [code_points(t) for t in texts[a:z]]
        out += [sampled(p, w, seed) for p, w in zip(points, walks(points, [0] * len(points), seed))]
    return out


def sampled(points: np.ndarray, begin: np.ndarray, seed: int = 0) -> str:
    """The fingerprint: scale, then one byte for each sampled step of that scale and of the next smaller."""
    places = _tables_of(seed)[1]
    scale = max(6, int(2 * points.size).bit_length())
    out = bytes([scale])
    for s in (scale, scale - 1):
        at = np.searchsorted(begin, (places * (1 << s)).astype(begin.dtype), side="right") - 1
        inside = at < points.size
        value = np.zeros(SAMPLES, np.uint32)
        if points.size:
            value[inside] = 1 + ((points[at[inside]] * np.uint32(2246822519)) >> np.uint32(16)) % np.uint32(255)
        out += value.astype(np.uint8).tobytes()
    return out.hex()


def fingerprint(text: str, seed: int = 0) -> str:
    return fingerprints([text], seed)[0]


def likeness(one: str, two: str) -> float:
    """Share of equal samples among those that lie in either text, on the larger scale both have; equal texts have 1."""
    if one == two:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (one, two))
    parts = {0: ((1, 1),), 1: ((2, 1),), -1: ((1, 2),)}.get(int(a[0]) - int(b[0]), ())
    same = either = 0
    for i, j in parts:
        x, y = (v[1 + SAMPLES * (k - 1) : 1 + SAMPLES * k] for v, k in ((a, i), (b, j)))
        inside = (x > 0) | (y > 0)
        either += int(inside.sum())
        same += int(((x == y) & inside).sum())
    return same / either if either else 0.0


def in_parts(docs: DataFrame, key: str, text: str, target: int) -> tuple[DataFrame, int]:
    """(part, extra, doc_id, h, text) with parts of ascending (doc_id, hash of the text), and the number of parts.

    The row that begins a part comes once more, as ``extra``, with the part before it, which it follows (the
    first of all with the last part). Parts are cut at keys that a range sort of ids alone gives; the cuts, sixteen bytes for each
    ``target`` bytes of text, are broadcast.
    """
    src = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LOW)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    src = src.withColumn("h", F.xxhash64("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0]
    n = min(MOST_PARTS, n_parts(total, target))
    ids = src.select("doc_id", "h").repartitionByRange(n, "doc_id", "h")
    firsts = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.*")
    heads = sorted({(r["doc_id"], r["h"]) for r in firsts.collect()})  # at most MOST_PARTS
    n = max(1, len(heads))
    if n == 1:
        return src.select(F.lit(0).alias("part"), F.lit(0).alias("extra"), "doc_id", "h", "text"), 1
    held = src.sparkSession.sparkContext.broadcast(np.array(heads, np.int64))

    @F.pandas_udf("array<int>")
    def place(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        first, second = held.value[:, 0], held.value[:, 1]
        x, y = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        low, high = np.searchsorted(first, x, "left"), np.searchsorted(first, x, "right")
        part = low - 1
        for k in np.flatnonzero(low < high).tolist():  # a cut goes through this id
            part[k] = low[k] - 1 + np.searchsorted(second[low[k] : high[k]], y[k], "right")
        begins = (first[part] == x) & (second[part] == y)
        return pd.Series([[p, p - 1 if p else n - 1] if b else [p] for p, b in zip(part.tolist(), begins.tolist())])

    rows = src.select(F.posexplode(place("doc_id", "h")).alias("extra", "part"), "doc_id", "h", "text")
    return rows.select("part", "extra", "doc_id", "h", "text"), n


def band_keys(fp: str, bands: int = BANDS, width: int = WIDTH) -> list[int]:
    """64-bit names of a fingerprint's bands on both scales; a band wholly beyond the text says nothing and has none."""
    raw, out = bytes.fromhex(fp), []
    for s in (0, 1):
        for b in range(bands):
            part = raw[1 + SAMPLES * s + b * width :][:width]
            if any(part):
                out.append(int.from_bytes(hashlib.blake2b(bytes([raw[0] - s, b]) + part, digest_size=8).digest(), "little", signed=True))
    return out


NAMED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("band", pa.binary()), ("first", pa.binary())])
ANSWER = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("heads", pa.binary()), ("id", pa.int64()), ("fp", pa.binary())])
ASKED = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("fp", pa.binary())])


class Part:
    """The texts of a part in order, and their different fingerprints with their bands; ``first`` is a fingerprint's smallest id here."""

    def __init__(self, t: pa.Table, buckets: int):
        t = t.sort_by([("extra", "ascending"), ("doc_id", "ascending"), ("h", "ascending"), ("text", "ascending")])
        own = t.filter(pc.equal(t.column("extra"), 0))
        self.ids, self.texts = own.column("doc_id").to_pylist(), own.column("text").to_pylist()
        self.prints = fingerprints(self.texts)
        classes: dict[str, int] = {}
        self.of = [classes.setdefault(f, len(classes)) for f in self.prints]
        self.fps = list(classes)
        self.first = np.full(len(self.fps), NONE)
        known = np.array(self.ids, np.int64) != LOW
        np.minimum.at(self.first, np.array(self.of, np.int64)[known], np.array(self.ids, np.int64)[known])
        keys = [band_keys(f) for f in self.fps]
        band = np.array([k for ks in keys for k in ks], np.int64)
        who = np.repeat(np.arange(len(keys)), [len(ks) for ks in keys])
        order = np.argsort(band.view(np.uint64), kind="stable")
        self.band, self.who = band[order], who[order]
        self.edges = np.searchsorted(((self.band.view(np.uint64) >> np.uint64(34)).astype(np.int64) * buckets) >> 30, np.arange(buckets + 1))

    def named(self):
        """(bucket, n, bands, smallest ids)."""
        for b, (x, y) in enumerate(zip(self.edges, self.edges[1:])):
            if x < y:
                yield b, y - x, self.band[x:y], self.first[self.who[x:y]]

    def heads(self, answers: list[dict]) -> tuple[dict[int, int], set[int]]:
        """For each fingerprint the earlier head that it shares most bands with (ties: the smaller id), and the fingerprints that are heads themselves."""
        head, shared = self.first[self.who], np.zeros(self.band.size, bool)
        for r in answers:
            if r["heads"] is not None:
                at = slice(self.edges[r["bucket"]], self.edges[r["bucket"] + 1])
                told = _expand(r["heads"], r["n"])
                shared[at], head[at] = told & 1, head[at] - (told >> 1)
        own = head == self.first[self.who]
        best: dict[int, tuple] = {}
        pairs, count = np.unique(np.stack([self.who[~own], head[~own]], 1), axis=0, return_counts=True)
        for (k, h), n in zip(pairs.tolist(), count.tolist()):
            best[k] = max(best.get(k, (0, 0)), (n, -h))
        return {k: -h for k, (_, h) in best.items()}, set(self.who[own & shared].tolist())


def _met(t: pa.Table) -> pa.Table:
    """Of each bucket, for each band of each part: how much smaller the smallest id of all is, doubled, and one if others have the band."""
    out: dict[str, list] = {f.name: [] for f in ANSWER}
    rows = t.to_pylist()
    band, first = (np.concatenate([_expand(r[c], r["n"]) for r in rows]) for c in ("band", "first"))
    value, of, count = np.unique(band, return_inverse=True, return_counts=True)
    least = np.full(value.size, np.iinfo(np.int64).max)
    np.minimum.at(least, of, first)
    told = ((first - least[of]) << 1) | (count[of] > 1)
    at = 0
    for r in rows:
        for name, x in zip(out, (r["part"], r["bucket"], r["n"], _squeeze(told[at : at + r["n"]]), None, None)):
            out[name].append(x)
        at += r["n"]
    return _table(out, ANSWER)


def _told(t: pa.Table) -> pa.Table:
    """The fingerprints of heads for the parts that ask for them; of several of one key the smallest."""
    out: dict[str, list] = {f.name: [] for f in ANSWER}
    prints: dict[int, bytes] = {}
    rows = t.select(["part", "id", "fp"]).to_pylist()
    for r in rows:
        if r["fp"] is not None:
            prints[r["id"]] = min(r["fp"], prints.get(r["id"], r["fp"]))
    for r in rows:
        if r["fp"] is None and r["id"] in prints:
            for name, x in zip(out, (r["part"], None, None, None, r["id"], prints[r["id"]])):
                out[name].append(x)
    return _table(out, ANSWER)


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TEXT_PARTITION, least: float = LEAST) -> DataFrame:
    """Fingerprints of each text, of its edited text, their likeness, and an earlier near duplicate; one row for each row.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the
    next text by ascending key; the last is followed by the first. A single document follows itself.
    Null text is empty, and two empty texts have likeness 1. Rows with a null key come first; rows of equal keys go by
    a hash of their text.

    A band's head is the smallest key whose text has the band. ``near_id`` is, of the heads of a text's bands that are smaller than its
    own first copy's key, the one with most of its bands (ties: the smaller) if the likeness of its whole fingerprint,
    ``near_likeness``, is ``least`` or more; else both are null. Of several texts of one key the smallest fingerprint speaks; texts without a key are no heads.
    A text that is an exact copy gets what the first of its copies in its part gets, or that one's key.
    Texts are shuffled once, which the three passes share; a part asks once for each head. Other columns of docs take no part.
    """
    rows, parts = in_parts(docs, key, text, target)
    n = docs.count()
    buckets = n_parts(n, part_bytes(4000 * n, BUCKET, 20))

    def name(t: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in NAMED}
        number = t.column("part")[0].as_py()
        for b, n, band, first in Part(t, buckets).named():
            for c, x in zip(out, (b, number, n, _squeeze(band), _squeeze(first))):
                out[c].append(x)
        return _table(out, NAMED)

    def ask(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in ASKED}
        if t.num_rows:
            number, part = t.column("part")[0].as_py(), Part(t, buckets)
            best, heads = part.heads(answers.to_pylist())
            found = [(number, h, None) for h in sorted(set(best.values()))] + [(number, int(part.first[k]), bytes.fromhex(part.fps[k])) for k in sorted(heads)]
            for c, x in zip(out, zip(*found)) if found else ():
                out[c] += x
        return _table(out, ASKED)

    result = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("near_id", pa.int64()), ("near_likeness", pa.float64()),
    ])

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in result}
        if t.num_rows:
            part, answers = Part(t, buckets), answers.to_pylist()
            prints_of = {r["id"]: r["fp"].hex() for r in answers if r["fp"] is not None}
            near: dict[int, tuple] = {}
            for k, h in part.heads(answers)[0].items():
                like = likeness(part.fps[k], prints_of[h]) if h in prints_of else 0.0
                if like >= least:
                    near[k] = (h, like)
            extra = t.filter(pc.equal(t.column("extra"), 1)).column("text").to_pylist() if parts > 1 else []
            follower = extra[0] if extra else part.texts[0]
            nexts = [*part.texts[1:], follower]
            prints = [*part.prints[1:], fingerprint(follower) if extra else part.prints[0]]
            for a, z in batches([len(x) + len(x) // 4 for x in part.texts]):
                points = [code_points(x) for x in part.texts[a:z]]
                own = walks(points, [0] * len(points))
                lent = [code_points(y[: len(x) // 4]) for x, y in zip(part.texts[a:z], nexts[a:z])]
                places = [x.size - x.size // 4 for x in points]
                tails = walks(lent, [int(w[c]) for w, c in zip(own, places)])
                for k, p, w, more, c, tail in zip(range(a, z), points, own, lent, places, tails):
                    f, doc, kind = part.prints[k], part.ids[k], part.of[k]
                    edited = sampled(np.concatenate([p[:c], more]), np.concatenate([w[:c], tail])) if c < p.size else f
                    body = part.texts[k][:c].encode() + nexts[k][: p.size // 4].encode()
                    first = int(part.first[kind])
                    at = near.get(kind, (first, 1.0) if first < doc else (None, None))
                    row = (
                        None if doc == LOW else doc, p.size, hashlib.sha256(body).hexdigest(), f, edited, likeness(f, edited),
                        likeness(f, prints[k]), *at
                    )
                    for column, x in zip(out, row):
                        out[column].append(x)
        return _table(out, result)

    by_part = rows.groupBy("part")
    answers = by_part.applyInArrow(name, _ddl(NAMED)).groupBy("bucket").applyInArrow(_met, _ddl(ANSWER))
    asked = by_part.cogroup(answers.groupBy("part")).applyInArrow(ask, _ddl(ASKED))
    told = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")).applyInArrow(_told, _ddl(ANSWER))
    return by_part.cogroup(answers.unionByName(told).groupBy("part")).applyInArrow(finish, _ddl(result))


def near_pairs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = 16, width: int = 6, walks: int = 3
) -> DataFrame:
    """(a, b, likeness), a < b: bit-sampled banding, then verification by the fingerprints; the best of several walks.

    An edit can throw one walk out of step for long, rarely several. A band is ``width`` samples of
    one scale. All pairs of different fingerprints that share a band are compared: equal fingerprints
    are one, and a large bucket is cut to chunks, each two of which meet in a tile, so no task holds a
    bucket. Comparing costs the square of the different fingerprints of a bucket; the pairs of equal
    texts are only made at the end, all of them. Null text is empty; empty texts have no band and
    are in no pair, nor are rows with a null key or two rows of one key.
    """
    found = None
    for seed in range(walks):
        more = _pairs_of_walk(docs, key, text, least, bands, width, seed)
        found = more if found is None else found.unionByName(more)
    return found.groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def _likeness_to(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``likeness`` of a fingerprint (as bytes) and each row of others that differ from it."""
    step = int(one[0]) - many[:, 0].astype(int)
    x, y = (np.where((step == s)[:, None], v[..., 1 + SAMPLES :], v[..., 1 : 1 + SAMPLES]) for s, v in ((1, one), (-1, many)))
    inside = (x > 0) | (y > 0)
    either = inside.sum(1)
    return np.where(np.abs(step) <= 1, ((x == y) & inside).sum(1) / np.maximum(either, 1), 0.0)


def _pairs_of_walk(docs: DataFrame, key: str, text: str, least: float, bands: int, width: int, seed: int) -> DataFrame:
    @F.pandas_udf("string")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(s.tolist(), seed))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["chunk", "fp"])
        raw = np.frombuffer(bytes.fromhex("".join(tile["fp"])), np.uint8).reshape(len(tile), -1)
        names = tile["fp"].to_numpy()
        low, high = tile[["i", "j"]].iloc[0]
        n = int((tile["chunk"] == low).sum())
        out = []
        for k in range(n):
            begin = k + 1 if low == high else n
            like = _likeness_to(raw[k], raw[begin:])
            out += [(*sorted((names[k], names[begin + m])), like[m]) for m in np.flatnonzero(like >= least)]
        return pd.DataFrame(out, columns=["f", "g", "likeness"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("id is not null")
    prints = cut(rows.select("id", fp("t").alias("fp")).distinct())
    scale = F.conv(F.substring("fp", 1, 2), 16, 10).cast("int")
    own = [
        F.concat(
            scale - F.lit(s), F.lit(f"/{b}/"), F.substring("fp", 3 + 2 * (SAMPLES * s + b * width), 2 * width)
        ) for s in (0, 1) for b in range(bands)
    ]
    classes = prints.groupBy("fp").agg(F.count("*").alias("copies"))
    banded = classes.withColumn("band", F.explode(F.array(*own))).where(~F.col("band").rlike("/0*$"))  # a band wholly beyond the text says nothing
    copies = banded.where("copies > 1").select(F.col("fp").alias("f"), F.col("fp").alias("g"), F.lit(1.0).alias("likeness")).distinct()
    sizes = banded.groupBy("band").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("k"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = banded.select("fp", "band").join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    met = met.select("fp", "band", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    tiles = met.groupBy("band", "i", "j").applyInPandas(
        compare, "f string, g string, likeness double"
    ).groupBy("f", "g").agg(F.first("likeness").alias("likeness"))
    links = tiles.unionByName(copies).join(prints.toDF("a", "f"), "f").join(prints.toDF("b", "g"), "g")
    return links.where("f <> g and a <> b or f = g and a < b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"
    ).distinct()
