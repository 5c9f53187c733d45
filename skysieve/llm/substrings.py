r"""Removal of word sequences that repeat from earlier documents, by relative Lempel-Ziv parsing against indexed blocks.

Words are `[^\x20\x09-\x0D]+`. A window is `width` consecutive words of one document; a word goes when a window covers
it whose word sequence also starts in a document with a smaller id. Windows are judged on the input.

A window's key is the least hash of its word groups of GRAM words, so it depends on the words of the window alone, and a
document is cut into pieces: runs of windows that share a key, about five each. All windows equal to one of a piece have
that piece's key, hence a document need not meet the reference as a whole: each piece is factored against the one block
that holds every reference piece of its key, and no other block can hold a factor of it.

Plan: (1) one map-side-combined aggregate finds the keys that two documents share, with their smallest id and whether
all their pieces are alike; pieces of other keys have no partner and stop here. (2) Pieces meet those keys in a salted
join. Where all pieces of a key are alike, the whole piece of every later document is one factor. (3) The other pieces
fetch their words, equal ones collapse to one row with the smallest id, and a block, which is a bounded share of the keys,
is indexed by windows and parsed greedily: from each place the longest factor of an earlier document (of its SOURCES earliest ones) is taken, and the
next place is the first window that reaches over the factor's end, so windows across factor boundaries are checked too.
Factors of `width` words or more become spans; later documents of an equal piece take it whole. A key with over MOST
pieces has no block of its own size: its windows are dealt by all their words instead. (4) Spans meet the documents, and
the words that are left are joined by one space.

Words count as equal when their 64-bit codes are, and pieces when key and signature, 128 bits in all, are.

Defined cases: a null or empty text has no words and becomes empty; ids are long integers; a null id comes after all ids, so such
a row loses what documents with ids hold, and nothing is removed for its sake; rows that repeat an id don't remove each
other's words; a document's own repeats stay. Other columns pass unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from skysieve.llm.common import release, salted_lookup, stored, table

WIDTH, GRAM = 13, 5
#: Distinct pieces of a block, about; pieces that a key may have before its windows are dealt apart; bytes of a word that is coded byte by byte.
BLOCK, MOST, LONG = 20_000, 100_000, 128
#: Earliest sources that a factor is followed along. A factor that another source would carry on ends sooner; the windows over
#: its end are looked up anyway, so no word is lost.
SOURCES = 16
_LAST = (1 << 63) - 1
_BASE, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x2545F4914F6CDD1B)


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # bytes.split cuts at exactly \x20 and \x09-\x0D


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 64 random bits for every byte.
_BYTES = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b]), 11) for b in range(256)), ">u8").astype(np.uint64)


def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): 64-bit codes of all words of a binary column, row after row, and the words of each row.

    A code is a polynomial of the word's random byte values, all words a byte at a time; words over LONG bytes take XXH64.
    """
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # rows begin here
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.nonzero(starts)[0], np.nonzero(ends)[0] + 1
    lengths, out = ends - starts, (ends - starts).astype(np.uint64)
    live = np.arange(len(starts))
    for k in range(int(min(LONG, lengths.max(initial=0)))):
        live = live[lengths[live] > k]
        out[live] = out[live] * _STEP + _BYTES[data[starts[live] + k]]
    for k in np.nonzero(lengths > LONG)[0].tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), 11)
    return _mixed(out), np.bincount(np.searchsorted(offsets[1:], starts, side="right"), minlength=len(column))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _BASE
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` consecutive codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _BASE + codes[k : n + k]
    return _mixed(out)


class Pieces:
    """The pieces of a batch of documents: document, first word, number of windows, key and signature of each."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, width: int) -> None:
        ends = np.cumsum(lengths)
        self.codes, self.offsets = codes, ends - lengths
        whole = grams(codes, width)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.nonzero(owner[: len(whole)] == owner[width - 1 :])[0] if len(whole) else np.empty(0, np.int64)
        small, reach = grams(codes, min(GRAM, width)), width - min(GRAM, width) + 1
        least = small[: len(whole)].copy()
        for k in range(1, reach):
            np.minimum(least, small[k : len(whole) + k], out=least)
        keys, owner = least[at], owner[at]
        first = np.ones(len(at), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        begin = np.nonzero(first)[0]
        self.doc, self.key, self.n = owner[begin], keys[begin].view(np.int64), np.diff(np.append(begin, len(at)))
        self.start = at[begin] - self.offsets[self.doc] if len(begin) else np.empty(0, np.int64)
        self.sig = np.add.reduceat(_mixed(whole[at] ^ _MIX), begin).view(np.int64) if len(begin) else np.empty(0, np.int64)

    def words(self, begin: np.ndarray, length: np.ndarray) -> pa.Array:
        """Binary array of the codes of each run of words (places in the batch)."""
        ends = np.cumsum(length)
        at = np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.concatenate(([0], ends)).astype(np.int64) * 8
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.codes[at].tobytes())])


def pieces(docs: DataFrame, width: int) -> DataFrame:
    """(key, sig, ord, tag, start, n) of every piece of `docs` (ord, tag, text binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Pieces(*codes_of(batch.column(2)), width)
            ords, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.key), pa.array(found.sig), pa.array(ords[found.doc], pa.int64()), pa.array(tags[found.doc], pa.int32()), pa.array(found.start, pa.int32()), pa.array(found.n, pa.int32())],
                ["key", "sig", "ord", "tag", "start", "n"],
            )

    return docs.mapInArrow(run, "key long, sig long, ord long, tag int, start int, n int")


class Reference:
    """A block of pieces (arrays of word codes) with the smallest id of each, indexed by windows."""

    def __init__(self, found: list[np.ndarray], owners: np.ndarray, width: int) -> None:
        self.width, self.found, self.owners = width, found, owners
        lengths = np.array([len(x) for x in found], np.int64)
        self.words, self.ends = np.concatenate(found), np.cumsum(lengths)
        self.begins = self.ends - lengths
        home = np.repeat(np.arange(len(found)), lengths)
        hashes = grams(self.words, width)
        at = np.nonzero(home[: len(hashes)] == home[width - 1 :])[0]
        order = at[np.lexsort((owners[home[at]], hashes[at]))]  # by window, then by id
        first = np.ones(len(order), bool)
        first[1:] = hashes[order[1:]] != hashes[order[:-1]]
        group = np.cumsum(first) - 1
        self.places, self.owner_at = order, owners[home[order]]
        self.from_, self.to = np.nonzero(first)[0], np.append(np.nonzero(first)[0][1:], len(order))
        self.group = np.full(len(self.words), -1, np.int64)
        self.group[order] = group
        self.least = np.full(len(self.words), _LAST, np.int64)  # smallest id that holds the window at a place
        self.least[order] = self.owner_at[self.from_][group]
        self.end_at = self.ends[home]

    def hits(self) -> np.ndarray:
        """The pieces that hold a window of an earlier id."""
        n = np.array([len(x) for x in self.found], np.int64)
        return np.nonzero(np.minimum.reduceat(self.least, self.begins) < self.owners)[0] if len(n) else n

    def parse(self, piece: int) -> list[tuple[int, int]]:
        """(first word, words) of the piece's factors of at least `width` words that earlier ids hold, greedily."""
        begin, end, mine, out = int(self.begins[piece]), int(self.ends[piece]), self.owners[piece], []
        i = begin
        while i <= end - self.width:
            if self.least[i] >= mine:
                i += 1
                continue
            g = self.group[i]
            few = slice(self.from_[g], min(self.to[g], self.from_[g] + SOURCES))  # in order of ids
            places, length = self.places[few][self.owner_at[few] < mine], self.width
            while i + length < end:
                inside = places[places + length < self.end_at[places]]
                longer = inside[self.words[inside + length] == self.words[i + length]]
                if not len(longer):
                    break
                places, length = longer, length + 1
            out.append((i - begin, length))
            i += length - self.width + 1  # the first window that reaches over the factor's end
        return out


def _spans(block: pd.DataFrame, width: int) -> pd.DataFrame:
    """(key, sig, first, spans): the factors of each distinct piece of a block, at its first owner."""
    block = block.sort_values(["first", "key", "sig"])
    found = [np.frombuffer(x, np.uint64) for x in block["codes"]]
    reference = Reference(found, block["first"].to_numpy(np.int64), width)
    spans: list[list[tuple[int, int]]] = [[] for _ in found]
    for k in reference.hits().tolist():
        spans[k] = reference.parse(k)
    return pd.DataFrame({"key": block["key"], "sig": block["sig"], "first": block["first"], "words": [len(x) for x in found], "spans": spans})


def _words(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, sig, ord, tag, start, codes) of the wanted pieces (ord, tag, starts, apart): their words, from the texts;
    where `apart` is set, each window of the piece is a piece of its own, under a key of all its words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Pieces(*codes_of(batch.column(2)), width)
            ords, tags, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            starts, apart = asked.flatten().field("start").to_numpy(), asked.flatten().field("apart").to_numpy(zero_copy_only=False)
            place = found.offsets[found.doc] + found.start  # ascends, as the places of the batch do
            piece = np.searchsorted(place, found.offsets[row] + starts)
            for chosen, alone in ((piece[~apart], False), (piece[apart], True)):
                begin, n, key, sig, doc = place[chosen], found.n[chosen], found.key[chosen], found.sig[chosen], found.doc[chosen]
                if alone:  # every window is a piece, under a key of all its words
                    doc = np.repeat(doc, n)
                    begin = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    whole = grams(found.codes, width)
                    key = (whole[begin] if len(begin) else np.empty(0, np.uint64)).view(np.int64)
                    sig, n = _mixed(key.view(np.uint64) ^ _MIX).view(np.int64), np.ones(len(begin), np.int64)
                for a in range(0, len(begin), 50_000):
                    part = slice(a, a + 50_000)
                    columns = [pa.array(key[part]), pa.array(sig[part]), pa.array(ords[doc[part]]), pa.array(tags[doc[part]]), pa.array((begin[part] - found.offsets[doc[part]]).astype(np.int32)), found.words(begin[part], n[part] + width - 1).cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "sig", "ord", "tag", "start", "codes"])

    met = docs.join(wanted.hint("merge"), ["ord", "tag"]).select("ord", "tag", "text", "starts")
    return met.mapInArrow(run, "key long, sig long, ord long, tag int, start int, codes binary")


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(ord, tag, spans): the spans, as first word and words in turn, of every document of (ord, tag, text) that has any."""
    spark, cut = docs.sparkSession, pieces(docs, width)
    by_key = cut.groupBy("key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("sig").alias("s"), F.max("sig").alias("t"), F.count("*").alias("k"))
    shared = stored(by_key.where("lo < hi").select("key", F.col("lo").alias("first"), (F.col("s") != F.col("t")).alias("mixed"), "k"), "keys")
    release(spark)
    total = shared.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    met = salted_lookup(cut.select("key", "ord", "tag", "start", "n"), shared, ["key"], "k", total, F.col("ord"))
    hits = stored(met.where(F.col("first").isNotNull() & (F.col("mixed") | (F.col("ord") > F.col("first")))).drop("first"), "hits")
    release(spark)
    alike = hits.where("NOT mixed").select("ord", "tag", F.array(F.col("start"), F.col("n") + F.lit(width - 1)).alias("span"))
    asked = hits.where("mixed").groupBy("ord", "tag").agg(F.collect_set(F.struct("start", (F.col("k") > MOST).alias("apart"))).alias("starts"))
    apart = stored(_words(docs, asked, width), "words")
    release(spark)
    distinct = stored(apart.groupBy("key", "sig").agg(F.min("ord").alias("first"), F.min("codes").alias("codes"), F.count("*").alias("k")), "distinct")
    n = max(1, -(-distinct.count() // BLOCK))
    parsed = distinct.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n))).groupBy("block").applyInPandas(lambda b: _spans(b, width), "key long, sig long, first long, words int, spans array<array<int>>")
    parsed = parsed.join(distinct.select("key", "sig", "k"), ["key", "sig"])
    lookup = stored(parsed, "factors")
    release(spark)
    rows = salted_lookup(apart.select("key", "sig", "ord", "tag", "start"), lookup, ["key", "sig"], "k", apart.count(), F.col("ord"))
    whole = F.array(F.col("start"), F.col("words"))
    own = F.transform("spans", lambda x: F.array(F.col("start") + x[0], x[1]))
    found = F.when(F.col("ord") > F.col("first"), F.array(whole)).otherwise(own)
    parts = rows.select("ord", "tag", F.explode(found).alias("span"))
    return stored(alike.unionByName(parts).groupBy("ord", "tag").agg(F.flatten(F.collect_set("span")).alias("spans")), "spans")


def rewrite(text: bytes | None, spans: list[int] | None) -> tuple[int, int, bytes]:
    """(words, removed words, the other words joined by one space)."""
    words = words_of(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for a, n in zip(spans[::2], spans[1::2], strict=True):
        keep[a : a + n] = False
    return len(words), int(len(words) - keep.sum()), b" ".join([words[k] for k in np.nonzero(keep)[0].tolist()])


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Columns `row` (all of docs) and `kept`: a struct of n_words, n_removed and the remaining text."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("ord"), F.hash(text).alias("tag"), text.cast("binary").alias("text"))
    spans = repeats(rows.select("ord", "tag", "text"), width)
    schema = StructType([rows.schema["row"], StructField("kept", DataType.fromDDL("n_words long, n_removed long, text string"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rewrite(x.as_py(), s.as_py()) for x, s in zip(batch.column(1), batch.column(2), strict=True)]
            kept = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].decode() for x in found], pa.string())], ["n_words", "n_removed", "text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["row", "kept"])

    met = rows.join(spans.hint("merge"), ["ord", "tag"], "left").select("row", "text", "spans")
    return met.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """`docs`, all columns, with `text_col` reduced to the words that no earlier document repeats in a window."""
    done = strip_repeats(docs, id_col, text_col, width)
    return done.select(*[(F.col("kept.text") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = strip_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("row.doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (s) WHERE firsts.first < doc_id),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
