"""Bloom bit arrays that are built by tasks and merged by segment; their size has a fixed bound."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that are set for a key.
PROBES = 3
#: Bits a key is given, and the bounds of an array's size in bits (powers of two; the upper one is 64 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29
#: Bytes of a segment.
SEGMENT = 1 << 17


def bits_for(keys: int) -> int:
    """Array size for so many keys; beyond the bound more keys only raise the share of false suspects."""
    return int(min(MOST_BITS, max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(1, keys) * BITS_A_KEY))))))


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, PROBES) bit positions of 64-bit hashes by double hashing."""
    a, b = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) & np.uint64(bits - 1)


class TwoFilters:
    """Once-seen and twice-seen bit arrays; merging two pairs moves every bit that both saw once to twice-seen."""

    def __init__(self, bits: int) -> None:
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of one task: repeats among them, and keys that once-seen already holds, are seen twice."""
        hashes, counts = np.unique(hashes, return_counts=True)
        at = probes(hashes, self.bits)
        known = (self.once[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
        self._set(self.once, at)
        self._set(self.twice, at[known | (counts > 1)])

    @staticmethod
    def _set(array: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(array, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def seen(array: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the array; later probes only look at what earlier ones left."""
    left, step, mask = np.arange(len(hashes)), hashes >> np.uint64(32) | np.uint64(1), np.uint64(bits - 1)
    at = hashes & np.uint64(0xFFFFFFFF)
    for _ in range(PROBES):
        place = at & mask
        hit = (array[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        left, step, at = left[hit], step[hit], at[hit] + step[hit]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def twice_seen(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The twice-seen array over the keys that `hashes` draws from `rows`; its size is bits / 8 bytes whatever the rows."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TwoFilters(bits)
        for batch in batches:
            own.add(hashes(batch))
        for k in range(0, bits // 8, SEGMENT):
            once, twice = own.once[k : k + SEGMENT], own.twice[k : k + SEGMENT]
            if once.any():
                packed = [zlib.compress(x.tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k // SEGMENT], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["segment", "once", "twice"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.zeros(0, np.uint8)
        for a, b in zip(frame["once"], frame["twice"], strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, twice = (once | a, twice | b | once & a) if len(once) else (a, b)
        return pd.DataFrame({"segment": [frame["segment"].iloc[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})

    merged = rows.mapInArrow(build, "segment int, once binary, twice binary").groupBy("segment").applyInPandas(merge, "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", F.col("twice")).collect():  # bits / 8 bytes at most
        part = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)
        out[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(part)] = part
    return out
