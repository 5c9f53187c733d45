"""Batch data source of fixed-record plate scans: a header record, then records of 39 32-bit integers.

The header's words 34 to 38 must be -1. Those bits look alike in both byte orders, so files are big-endian as published
unless the option byteorder says little. Plain files are split by record ranges; gzip ones
are read whole by one task in record batches. A file that ends inside a record is an error.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Words of a record, bytes, and where the sentinel words stand.
WORDS, RECORD, SENTINEL = 39, 156, slice(34, 39)
#: Records of a partition.
SPLIT = 250_000


class PlateScanError(ValueError):
    """A file that isn't a plate scan or ends early."""


def check_header(header: bytes) -> None:
    if len(header) != RECORD or (np.frombuffer(header, ">i4")[SENTINEL] != -1).any():
        raise PlateScanError("the header record's sentinel words aren't -1")


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int | None) -> None:
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.order = "<" if options.get("byteorder", "big") == "little" else ">"

    def partitions(self) -> list[_Range]:
        import os

        out = []
        for path in self.paths:
            if path.endswith(".gz"):
                out.append(_Range(path, 0, None))
                continue
            size = os.path.getsize(path)
            if size % RECORD:
                raise PlateScanError(f"{path} ends inside a record")
            n = size // RECORD - 1
            out += [_Range(path, k, min(SPLIT, n - k)) for k in range(0, n, SPLIT)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rb") as file:
            check_header(file.read(RECORD))
            if partition.count is not None:
                file.seek(RECORD * (partition.first + 1))
            left, at = partition.count, partition.first
            while left is None or left > 0:
                data = file.read(RECORD * min(50_000, left if left is not None else 50_000))
                if not data:
                    break
                if len(data) % RECORD:
                    raise PlateScanError(f"{partition.path} ends inside a record")
                table = np.frombuffer(data, f"{self.order}i4").reshape(-1, WORDS).astype("=i4")
                columns = [pa.array(np.arange(at, at + len(table))), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(table)), *columns], ["file", "record", *(f"w{k:02d}" for k in range(WORDS))])
                at += len(table)
                left = left - len(table) if left is not None else None


class PlateScanSource(DataSource):
    """spark.dataSource.register(PlateScanSource); spark.read.format("platescan").option("paths", "a,b.gz").load()"""

    @classmethod
    def name(cls) -> str:
        return "platescan"

    def schema(self) -> str:
        return "file string, record long, " + ", ".join(f"w{k:02d} int" for k in range(WORDS))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
