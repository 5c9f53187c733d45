"""Batch data source of FITS binary tables: the extension LDAC_OBJECTS if there is one, else the first table.

Headers are read in blocks of 2880 bytes; columns of one value become columns, vectors become arrays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Block size and the format's type letters.
BLOCK = 2_880
LETTERS = {"B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "L": ("S1", "string"), "A": ("S", "string")}


class FitsError(ValueError):
    """A file without a readable table."""


def _header(file) -> dict[str, str] | None:
    cards: dict[str, str] = {}
    while True:
        block = file.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            if card.startswith("END") and not card[3:].strip():
                return cards
            if card[8:10] == "= ":
                value = card[10:].split("/")[0].strip() if "'" not in card[10:] else card[10:].split("'")[1].strip()
                cards[card[:8].strip()] = value


def tables(file) -> Iterator[tuple[dict[str, str], int]]:
    """(header, first data byte) of every binary table."""
    while (cards := _header(file)) is not None:
        axes = [int(cards.get(f"NAXIS{k + 1}", 0)) for k in range(int(cards.get("NAXIS", 0)))]
        size = int(np.prod(axes)) * abs(int(cards.get("BITPIX", 8))) // 8 if axes else 0
        size += int(cards.get("PCOUNT", 0))
        start = file.tell()
        if cards.get("XTENSION") == "BINTABLE":
            yield cards, start
        file.seek(start + -(-size // BLOCK) * BLOCK)


def chosen(path: str) -> tuple[dict[str, str], int]:
    with open(path, "rb") as file:
        found = [*tables(file)]
    if not found:
        raise FitsError(f"{path} has no binary table")
    return next((t for t in found if t[0].get("EXTNAME") == "LDAC_OBJECTS"), found[0])


def layout(cards: dict[str, str]) -> list[tuple[str, str, int]]:
    """(name, type letter, repeat) of the columns."""
    out = []
    for k in range(1, int(cards["TFIELDS"]) + 1):
        m = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
        if m[2] not in LETTERS:
            raise FitsError(f"column type {m[2]} isn't known")
        out.append((cards.get(f"TTYPE{k}", f"c{k}"), m[2], int(m[1] or 1)))
    return out


def _record(columns: list[tuple[str, str, int]]) -> np.dtype:
    return np.dtype([(n, f"S{r}" if a == "A" else LETTERS[a][0], () if a == "A" or r == 1 else (r,)) for n, a, r in columns])


class _Rows(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[_Rows]:
        return [_Rows(p) for p in self.paths]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        cards, start = chosen(partition.path)
        columns = layout(cards)
        kind, n = _record(columns), int(cards["NAXIS2"])
        with open(partition.path, "rb") as file:
            file.seek(start)
            for at in range(0, n, 20_000):
                rows = np.frombuffer(file.read(kind.itemsize * min(20_000, n - at)), kind)
                arrays = [pa.array([partition.path] * len(rows))]
                for name, letter, repeat in columns:
                    x = rows[name]
                    if letter in "AL":
                        arrays.append(pa.array([v.decode("ascii", "replace").strip() for v in x.ravel()]))
                    else:
                        x = x.astype("i2" if letter == "B" else x.dtype.newbyteorder("="))
                        arrays.append(pa.array(x) if repeat == 1 else pa.array(x.tolist(), pa.list_(pa.from_numpy_dtype(x.dtype))))
                yield pa.RecordBatch.from_arrays(arrays, ["file", *(c[0] for c in columns)])


class LdacSource(DataSource):
    """spark.dataSource.register(LdacSource); spark.read.format("ldac").option("paths", "a.fits,b.fits").load()"""

    @classmethod
    def name(cls) -> str:
        return "ldac"

    def schema(self) -> str:
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]
        columns = layout(chosen(paths[0])[0])
        return "file string, " + ", ".join(f"`{n}` {LETTERS[a][1] if r == 1 or a == 'A' else f'array<{LETTERS[a][1]}>'}" for n, a, r in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)
