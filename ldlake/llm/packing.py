"""Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a set of bins (groups of pieces). Crossover injects the other parent's best filled
bins whole, drops every bin that holds one of the injected pieces, and places the displaced pieces
by best fit, largest first. Mutation empties the worst bins and some others.

Pieces are dealt into shards of bounded size, and each shard is packed by several islands. An island is a
population of its own with its own seed, evolved in a task of its own. After each epoch an island's
elite, its best chromosome, migrates by a keyed shuffle to the next island of the ring, where it
takes the place of the worst. At least one generation runs in every epoch; the lower bound on the number of bins only
ends an epoch early after that. The best chromosome of a shard's islands is taken. Bins
that stay far from full in some shard are opened once more, and their pieces are packed together.
"""

from __future__ import annotations

import bisect
import json
import random
import re
import zlib
from array import array
from codecs import charmap_decode

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SIZE = 2048
SHARD = 12_000  # pieces
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 5, 6
MOST_TASKS = 20_000  # an epoch is cut into; each takes as many islands as there are then
#: Characters for which the standard library's classes split as the tokenizer's pattern does.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n\r -~{LETTERS}¡¿«»°€‘’“”–—…]*")
SPLIT = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


#: Byte-level models spell a byte as one character: itself if it is printed in Latin-1, else one from 256 on.
UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SPELLED = "".join(chr(256 + UNPRINTED.index(b) if b in UNPRINTED else b) for b in range(256))


class Words(dict):
    """Ids of a pre-token as little-endian bytes; filled on demand, emptied when it grows beyond a bound."""

    MOST = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parts = json.load(f)
        first = parts.get("pre_tokenizer") or {}
        #: Whether texts are split by the pattern of SPLIT and spelled byte by byte, and nothing else is done to them.
        self.by_words = not parts.get("normalizer") and (
            first.get("type"), first.get("add_prefix_space"), first.get("use_regex", True)
        ) == ("ByteLevel", False, True) and parts["model"].get("type", "BPE") == "BPE"
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        spelled = charmap_decode(word.encode(), "strict", SPELLED)[0]
        ids = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The text's ids. BPE never crosses pre-tokens, so a text is the sum of its pre-tokens; odd characters go the long way."""
        if not self.by_words or "<|" in text or not PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > self.MOST:
            self.clear()
        return b"".join(map(self.__getitem__, SPLIT.findall(text)))


_words: dict[str, Words] = {}


def tokenised_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): ids of the whole text, then id 0, cut into pieces.

    Documents of at most ``size`` ids stay whole; longer ones are cut into ``size`` ids, the first
    piece takes the remainder. Null text is empty, a single id 0. ``tokenizer`` is a file that is
    present on every executor.
    """
    def pieces(batches):
        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        words = _words[tokenizer]
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() for x in batch.column(2))):
                ids = words.ids(body or "") + b"\0\0\0\0"
                n = len(ids) // 4
                begin, end, piece = 0, n % size or min(n, size), 0
                while begin < n:
                    for c, v in zip(out, (doc, row, piece, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end]))):
                        c.append(v)
                    begin, end, piece = end, end + size, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, batch.schema.field(0).type if i == 0 else pa.int64()) for i, c in enumerate(out)],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            )
        words.clear()  # they are the task's own, and would stay in the worker until its garbage is collected

    src = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(pieces, f"doc_id {src.schema[0].dataType.simpleString()}, row long, piece long, start long, length long, ids_crc32 long")


class Space:
    """Open bins by their free room; the tightest that fits is found by bisection over the rooms in use."""

    def __init__(self, size: int):
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.rooms: list[int] = []

    def put(self, room: int, bin_: int) -> None:
        if room:
            if not self.by_room[room]:
                bisect.insort(self.rooms, room)
            self.by_room[room].append(bin_)

    def take(self, length: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms.pop(at)
        return room, bin_


def best_fit(bins: list[list[int]], loose: list[int], lengths: list[int], size: int) -> list[list[int]]:
    """Place the loose pieces, largest first, each in the bin it fills best."""
    space = Space(size)
    for b, items in enumerate(bins):
        space.put(size - sum(lengths[i] for i in items), b)
    for i in sorted(loose, key=lengths.__getitem__, reverse=True):
        found = space.take(lengths[i])
        if found is None:
            found = (size, len(bins))
            bins.append([])
        bins[found[1]].append(i)
        space.put(found[0] - lengths[i], found[1])
    return bins


def fitness(bins: list[list[int]], lengths: list[int], size: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are uneven: full ones, and few with room."""
    return -len(bins), sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins)


def crossover(one: list[list[int]], two: list[list[int]], lengths: list[int], size: int, rng: random.Random, share: float) -> list[list[int]]:
    """Inject bins of ``two`` that are filled best; what they hold leaves ``one``."""
    full = sorted(two, key=lambda b: (-sum(lengths[i] for i in b), rng.random()))
    injected = [list(b) for b in full[: max(1, int(len(full) * share))]]
    taken = {i for b in injected for i in b}
    kept, loose = injected, []
    for b in one:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    return best_fit(kept, loose, lengths, size)


def mutated(bins: list[list[int]], lengths: list[int], size: int, rng: random.Random) -> list[list[int]]:
    """Empty the least filled bins and as many others, and place their pieces by best fit."""
    few = max(1, len(bins) // 50)
    order = sorted(range(len(bins)), key=lambda b: sum(lengths[i] for i in bins[b]))
    opened = {*order[:few], *rng.sample(range(len(bins)), min(few, len(bins)))}
    loose = [i for b in opened for i in bins[b]]
    return best_fit([list(b) for k, b in enumerate(bins) if k not in opened], loose, lengths, size)


def founders(lengths: list[int], size: int, rng: random.Random, population: int = POPULATION) -> list[list[list[int]]]:
    """The first population: best fit, and best fit around pieces that were drawn to open bins."""
    n = range(len(lengths))
    pool = [best_fit([], list(n), lengths, size)]
    for _ in range(population - 1):
        seeds = rng.sample(n, len(lengths) // 4)
        pool.append(best_fit([[i] for i in seeds], sorted(set(n) - set(seeds)), lengths, size))
    return pool


def evolve(
    pool: list[list[list[int]]], lengths: list[int], size: int, rng: random.Random, generations: int = GENERATIONS
) -> tuple[list[list[list[int]]], int]:
    """The population after some generations, best first, and how many there were: one at least, less than asked for where the bound is met."""
    worth = lambda b: fitness(b, lengths, size)
    least, done = -(-sum(lengths) // size), 0
    pool = sorted(pool, key=worth, reverse=True)
    while done < generations:
        a, b = pool[0], pool[rng.randrange(1, len(pool))] if len(pool) > 1 else pool[0]
        child = max((crossover(a, b, lengths, size, rng, 0.3), crossover(b, a, lengths, size, rng, 0.5)), key=worth)
        pool[-1] = max((child, mutated(child, lengths, size, rng)), key=worth)
        pool.sort(key=worth, reverse=True)
        done += 1
        if len(pool[0]) <= least:
            break
    return pool, done


def _packed(bins: list[list[int]], n: int) -> bytes:
    """A chromosome as bytes: the bin of each piece."""
    of = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        of[items] = b
    return pa.compress(of.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> list[list[int]]:
    of = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.int32)
    out: list[list[int]] = [[] for _ in range(int(of.max(initial=-1)) + 1)]
    for i, b in enumerate(of.tolist()):
        out[b].append(i)
    return out


STATE = "shard long, island int, lengths binary, pool array<binary>, elite boolean, bins int, fill double, generations int, migrants int"


def _epoch(epoch: int, islands: int, size: int, seed: int, population: int, generations: int):
    """One epoch of one island: newcomers take the places of the worst, generations run, the elite leaves for the next island."""

    def run(state: pd.DataFrame) -> pd.DataFrame:
        own = state[~state["elite"]].iloc[0]
        shard, island = int(own["shard"]), int(own["island"])
        lengths = np.frombuffer(own["lengths"], np.int32).tolist()
        rng = random.Random(f"{seed}/{epoch}/{shard}/{island}")
        pool = [_unpacked(x, len(lengths)) for x in own["pool"]] or founders(lengths, size, rng, population)
        come = [_unpacked(x, len(lengths)) for row in state[state["elite"]]["pool"] for x in row]
        pool = pool[: max(1, len(pool) - len(come))] + come
        pool, done = evolve(pool, lengths, size, rng, generations)
        bins, fill = len(pool[0]), fitness(pool[0], lengths, size)[1]
        packed = [_packed(b, len(lengths)) for b in pool]
        out = [(shard, island, own["lengths"], packed, False, bins, fill, int(own["generations"]) + done, int(own["migrants"]) + len(come))]
        if islands > 1:
            out.append((shard, (island + 1) % islands, b"", packed[:1], True, bins, fill, 0, 0))
        return pd.DataFrame(out, columns=list(state.columns))

    return run


def evolved(
    pieces: DataFrame, size: int = SIZE, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION,
    generations: int = GENERATIONS, seed: int = 7, tasks: int | None = None
) -> DataFrame:
    """The islands' last states (STATE; the best chromosome comes first in ``pool``) for pieces (shard, row, piece, length) shorter than ``size``."""

    def start(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame.sort_values(["row", "piece"])["length"].to_numpy(np.int32).tobytes()
        return pd.DataFrame({"shard": frame["shard"].iloc[0], "lengths": [lengths]})

    first = pieces.select("shard", "row", "piece", "length").groupBy("shard").applyInPandas(start, "shard long, lengths binary")
    state = first.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("pool"), F.lit(False).alias("elite"),
        F.lit(0).alias("bins"), F.lit(0.0).alias("fill"), F.lit(0).alias("generations"), F.lit(0).alias("migrants"),
    )
    for epoch in range(epochs):
        if tasks:  # states are small but their work isn't, so they mustn't be put together by size
            state = state.repartition(tasks, "shard", "island")
        state = state.groupBy("shard", "island").applyInPandas(_epoch(epoch, islands, size, seed, population, generations), STATE)
    return state.where("not elite")


def _place(level: int, last: bool, size: int, full: float):
    """sequence_id and offset of a shard's pieces by its best chromosome; a full piece is a sequence; -1 for pieces of bins that are opened again."""

    def run(frame: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "piece"]).reset_index(drop=True)
        lengths = frame["length"].tolist()
        tag = int(frame.pop("shard").iloc[0])
        loose = [i for i, x in enumerate(lengths) if x < size]
        bins = [[i] for i, x in enumerate(lengths) if x >= size]
        if loose:
            bins += [[loose[i] for i in b] for b in _unpacked(best["best"].iloc[0], len(loose))]
        name, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, items in enumerate(bins):
            at = 0
            keep = last or sum(lengths[i] for i in items) >= full * size
            for i in items:
                name[i] = (level << 60) + (tag << 20) + b if keep else -1
                offset[i] = at
                at += lengths[i]
        return frame.assign(sequence_id=name, offset=offset)

    return run


def pack(pieces: DataFrame, size: int = SIZE, shard: int = SHARD, levels: int = 2, full: float = 0.98, seed: int = 7) -> DataFrame:
    """Add sequence_id and offset to pieces (row, piece, length and any other columns).

    Pieces are dealt by a seeded hash over shards of about ``shard`` pieces, whose number follows the
    input. Bins filled to less than ``full`` are opened after each level but the last, and their pieces
    are dealt again. Lengths must lie in 1..size; no piece is dropped. Columns named shard, sequence_id
    or offset are replaced. An empty table gives an empty result.
    """
    rest, settled = cut(pieces.drop("shard", "sequence_id", "offset")), []
    schema = rest.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"
    for level in range(levels):
        n = rest.count()
        if not n:
            break
        shards = -(-n // shard)
        last = level == levels - 1 or shards == 1
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + level), "row", "piece"), F.lit(shards)))
        tasks = min(MOST_TASKS, -(-shards * ISLANDS // 2))
        islands = evolved(dealt.where(F.col("length") < size), size, seed=seed + level, tasks=tasks)
        best = islands.groupBy("shard").agg(F.max_by(F.element_at("pool", 1), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best"))
        done = cut(dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_place(level, last, size, full), schema))
        settled.append(done.where("sequence_id >= 0"))
        if last:
            break
        rest = done.where("sequence_id < 0").drop("sequence_id", "offset")
    if not settled:
        return rest.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """One row for each piece of each document: where its ids lie and in which sequence they are."""
    got = pack(tokenised_pieces(docs, tokenizer, size=size), size)
    return got.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
