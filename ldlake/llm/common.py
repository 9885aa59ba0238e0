"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, fresh_dir, remove, shared_dir  # noqa: F401  used by the operators


def utf8(array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of an Arrow string array and its n + 1 offsets; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_binary()), b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def n_parts(total_bytes: int | None, target: int, least: int = 1) -> int:
    """How many parts of about ``target`` bytes the total makes; grows with the input without a cap."""
    return max(least, -(-int(total_bytes or 0) // target))


def part_bytes(total_bytes: int | None, unit: int, most: int = 4) -> int:
    """Size of blocks and buckets: ``unit`` up to 1 GB, then growing with the root of the input, to ``most`` times as much.

    Between b blocks and k buckets go up to b * k arrays; larger parts keep those from getting tiny.
    """
    return int(unit * min(float(most), max(1.0, (int(total_bytes or 0) / 1e9) ** 0.5)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's text leaves 2 modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
