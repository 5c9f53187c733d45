"""Language identification by compression: the language whose zstandard dictionary shrinks a text most.

Fitting draws a bounded sample of labelled rows: up to `pieces_a_language` documents of each language, chosen by hash of
the id, and SAMPLE_DOCS over all languages. A piece of PIECE bytes from somewhere in each of them goes into the language's
raw-content dictionary, which holds the whole sample. Scoring compresses every whole
text, chunk by chunk, once with each dictionary and adds up the sizes.

Defined cases: a null text or one without any letter is `und` with score 0; without any labelled row every text is
`und`; equal sizes go to the language first in order; a narrow relative margin sets `rejected`. Rows are scored one by
one, so repeated rows and ids repeat; extra columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import bounded, fold, table

#: Documents that all dictionaries together are fitted on, at most.
SAMPLE_DOCS = 8_192
#: Documents that one language's dictionary is made of, at most, and bytes of the piece of each.
PIECES, PIECE = 128, 256
DICTIONARY = PIECES * (PIECE + 1)
#: Bytes that are compressed at a time.
CHUNK = 1_024
#: Compression level, and the shortest match: short words must be found in a dictionary.
LEVEL, MATCH = 5, 4
#: The same for a second look at texts with a narrow margin: short and repetitive ones mostly.
CLOSE_LEVEL, CLOSE_MATCH = 12, 3
#: A best language that saves a smaller share of the second best's size is rejected.
MARGIN = 0.001
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Dictionaries by language; the compressors are made anew in each worker."""

    dictionaries: dict[str, bytes]
    _made: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_made": {}}

    def _compressors(self, level: int, match: int) -> list:
        if level not in self._made:
            found = self._made[level] = []
            how = zstandard.ZstdCompressionParameters.from_level(level, source_size=CHUNK, dict_size=DICTIONARY, min_match=match, write_content_size=False, write_checksum=False, write_dict_id=False)
            for name, raw in sorted(self.dictionaries.items()):
                shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(compression_params=how)
                found.append((name, zstandard.ZstdCompressor(dict_data=shared, compression_params=how)))
        return self._made[level]

    def sizes(self, text: str, level: int = LEVEL, match: int = MATCH) -> list[tuple[str, int]]:
        """(language, compressed bytes of the whole text), smallest first."""
        chunks = [*pieces(text)]
        return sorted(((name, sum(len(c.compress(x)) for x in chunks)) for name, c in self._compressors(level, match)), key=lambda x: (x[1], x[0]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, relative margin of the best over the second best size)."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        order = self.sizes(text)
        if _margin(order) < MARGIN:
            order = self.sizes(text, CLOSE_LEVEL, CLOSE_MATCH)
        score = 1 / sum(2.0 ** -min(60.0, (size - order[0][1]) / 4) for _, size in order)
        return order[0][0], score, _margin(order)


def _margin(order: list[tuple[str, int]]) -> float:
    return (order[1][1] - order[0][1]) / order[1][1] if len(order) > 1 else 1.0


#: ASCII letters in lower case; every other ASCII byte ends a word.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Words of letters in lower case between single spaces, UTF-8: digits and signs tell no language."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def pieces(text: str) -> Iterator[bytes]:
    """The whole normal text in pieces of CHUNK bytes."""
    raw = normal(text)
    for at in range(0, max(1, len(raw)), CHUNK):
        yield raw[at : at + CHUNK]


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", pieces_a_language: int = PIECES) -> LanguageModel:
    """Dictionaries from the rows of `docs` that `train` accepts; ids only spread the sample."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    langs = rows.select("lang").distinct().count()
    slots = max(1, min(pieces_a_language, SAMPLE_DOCS // max(1, langs)))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")

    def piece(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = normal(text.as_py())
                at = h // 8_192 % max(1, len(raw) - PIECE + 1)
                at = raw.rfind(b" ", 0, at + 1) + 1  # whole words from here on
                found.append(raw[at : at + PIECE])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["lang", "h", "piece"])

    chosen = rows.join(bounded(picks, max(SAMPLE_DOCS, langs) + 1), ["lang", "h"], "left_semi").mapInArrow(piece, "lang string, h long, piece binary")
    # rows that repeat an id give one piece, so no more than the picks come to the driver
    sample = chosen.groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    by_lang: dict[str, list] = {}
    for row in sorted(sample, key=lambda r: r["h"]):
        by_lang.setdefault(row["lang"], []).append(bytes(row["piece"]))
    joined = {lang: b" ".join(dict.fromkeys(found)) for lang, found in by_lang.items()}
    return LanguageModel({lang: raw for lang, raw in joined.items() if len(raw) >= 8})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            langs, scores, margins = ([x[k] for x in found] for k in range(3))
            low = [a == UNKNOWN or b < margin for a, _, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(low, pa.bool_())], ["id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose language isn't rejected."""
    where = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(where)]
            yield batch.filter(pa.array([a != UNKNOWN and b >= margin for a, _, b in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame) -> LanguageModel:
    """The model of the contract: rows whose crc32(doc_id) mod 3 isn't 1 teach."""
    return fit(docs, fold("doc_id", 3) != 1)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, trained(docs))
    return found.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
