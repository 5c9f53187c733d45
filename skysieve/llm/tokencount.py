"""Edit-aware token counts: a kept segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern; byte-pair merges never cross them, so a document's tokens are
the sum over its pre-tokens, each encoded once a worker and remembered. Leaves of a document's tree hold LEAF pre-tokens
with their characters and tokens; inner nodes hold the sums.

`build` encodes every document once and stores the trees, one row a document: text, characters and tokens of each
pre-token, pre-tokens of each leaf and the sums of all nodes. `apply_edits` takes stored trees and edits and returns
trees in the same form, so a later run starts from them: nothing is encoded but what edits touch. An edit descends by
character sums to the first leaf it touches, goes back over the context that the pattern's look-ahead needs, cuts and
encodes anew only until a new boundary falls on an old one behind the edit, and renews the sums on the way up. Counts
after edits equal a fresh count of the edited text.

The vocabulary file is read where the driver runs and travels in the closure; its path is a parameter.

Defined cases: null and empty texts have 0 tokens; an edit's span is cut to the text (offsets past its end append); a
null replacement deletes; edits of a document apply in order of `seq`, each to the text as edited so far; edits of
unknown documents play no part; without edits the counts before and after agree; repeated rows repeat, each with all
edits of its id; extra columns play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import bounded, stored, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf, and characters that the pattern looks ahead.
LEAF, AHEAD = 64, 3
#: Pre-tokens that a worker remembers.
KNOWN = 500_000


class Counter(dict):
    """Tokens of single pre-tokens, remembered by pre-token; a copy that travels remembers nothing."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        super().__init__()
        self.vocabulary, self.pattern = vocabulary, pattern
        self._encoding = self._cut = None

    def __reduce__(self) -> tuple:
        return Counter, (self.vocabulary, self.pattern)

    def _ready(self) -> None:
        if self._encoding is None:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.vocabulary.splitlines()) if a}
            self._encoding = tiktoken.Encoding("counts", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            self._cut = regex.compile(self.pattern)

    def __missing__(self, piece: str) -> int:
        self._ready()
        n = len(self._encoding._encode_single_piece(piece)) if len(piece) < 1 << 16 else len(self._encoding.encode_ordinary(piece))
        if len(self) < KNOWN:
            self[piece] = n
        return n

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; they join to the text again."""
        self._ready()
        return self._cut.findall(text)

    def stream(self, text: str, at: int) -> Iterator[str]:
        """Pre-tokens from a boundary on."""
        self._ready()
        return (m.group() for m in self._cut.finditer(text, at))

    def total(self, text: str) -> int:
        """A fresh count of a whole text."""
        return sum(map(self.__getitem__, self.cut(text)))


class Leaf:
    """Text, and the characters and tokens of its pre-tokens as arrays."""

    __slots__ = ("counts", "lengths", "text")

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.text, self.lengths, self.counts = text, lengths, counts


def _sums(leaves: list[int], width: int) -> list[int]:
    """Sums of all nodes of a tree of `width` leaves; node k has children 2k and 2k + 1, node 1 is the root."""
    out = np.zeros(2 * width, np.int64)
    out[width : width + len(leaves)] = leaves
    while width > 1:
        out[width // 2 : width] = out[width : 2 * width].reshape(-1, 2).sum(1)
        width //= 2
    return out.tolist()


class SegmentTree:
    """Pre-tokens of one text under sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        self._plant(self._fresh(text))
        self.encoded = self.fresh

    @classmethod
    def load(cls, text: str, lengths: np.ndarray, counts: np.ndarray, leaves: list[int], chars: list[int], tokens: list[int], counter: Counter) -> SegmentTree:
        """A stored tree; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded, tree.fresh, tree.leaves = counter, 0, 0, []
        tree.width, tree.chars, tree.tokens = len(chars) // 2, chars, tokens
        at = char = 0
        for i, n in enumerate(leaves):
            end = char + chars[tree.width + i]
            tree.leaves.append(Leaf(text[char:end], lengths[at : at + n], counts[at : at + n]))
            at, char = at + n, end
        return tree

    @staticmethod
    def _leaves(text: str, lengths: np.ndarray, counts: np.ndarray, share: int = LEAF) -> list[Leaf]:
        ends = [0, *np.cumsum(lengths, dtype=np.int64)[share - 1 :: share].tolist(), len(text)]
        return [Leaf(text[ends[i] : ends[i + 1]], lengths[k : k + share], counts[k : k + share]) for i, k in enumerate(range(0, len(lengths), share))]

    def _fresh(self, text: str) -> list[Leaf]:
        pieces = self.counter.cut(text)
        self.fresh = len(pieces)
        lengths, counts = (np.fromiter(map(f, pieces), np.int32, len(pieces)) for f in (len, self.counter.__getitem__))
        return self._leaves(text, lengths, counts)

    def _plant(self, leaves: list[Leaf]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = _sums([len(x.text) for x in leaves], self.width), _sums([int(x.counts.sum()) for x in leaves], self.width)

    @property
    def text(self) -> str:
        return "".join(x.text for x in self.leaves)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def locate(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a character offset; the last leaf for the text's end."""
        node, start = 1, 0
        while node < self.width:
            left = 2 * node
            if offset < start + self.chars[left] or not self.chars[left + 1]:
                node = left
            else:
                start += self.chars[left]
                node = left + 1
        return min(node - self.width, max(0, len(self.leaves) - 1)), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) and count anew what that may change."""
        start = max(0, min(start, self.chars[1]))
        end = max(start, min(end, self.chars[1]))
        if not self.leaves:
            self._plant(self._fresh(new))
            self.encoded += self.fresh
            return
        first, at = self.locate(max(0, start - AHEAD))
        if first and at + AHEAD > start - 1:  # the context reaches into the leaf before
            first -= 1
            at -= len(self.leaves[first].text)
        stop = min(len(self.leaves), self.locate(end)[0] + 2)
        found = None
        while found is None:  # the leaves that were looked at didn't do: look at twice as many
            found = self._cut_anew(first, stop, at, start, end, new)
            stop, last = min(len(self.leaves), 2 * stop - first), stop
        text, lengths, counts = found
        self.encoded += self.fresh
        made = self._leaves(text, lengths, counts)
        if len(made) != last - first and made and len(lengths) <= 2 * LEAF * (last - first):
            # about as many pre-tokens as before: the same leaves share them, so no node moves
            made = self._leaves(text, lengths, counts, -(-len(lengths) // (last - first)))
            made += [Leaf("", *[np.empty(0, np.int32)] * 2)] * (last - first - len(made))
        if len(made) == last - first:
            self.leaves[first:last] = made
            self._renew(first, last)
        else:
            self._plant(self.leaves[:first] + made + self.leaves[last:])

    def _cut_anew(self, first: int, stop: int, base: int, start: int, end: int, new: str) -> tuple[str, np.ndarray, np.ndarray] | None:
        """Text, lengths and counts of leaves [first, stop), which begin at character `base`, after the edit; None if the
        new boundaries don't fall on old ones before their end."""
        old = "".join(x.text for x in self.leaves[first:stop])
        lengths, known = (np.concatenate([getattr(x, name) for x in self.leaves[first:stop]]) for name in ("lengths", "counts"))
        bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        start, end, whole = start - base, end - base, stop == len(self.leaves)
        text, shift = old[:start] + new + old[end:], len(new) - (end - start)
        k, m = max(0, int(np.searchsorted(bounds, start - AHEAD, "right")) - 1), int(np.searchsorted(bounds, end))
        later = {b + shift: i for i, b in enumerate(bounds[m:].tolist(), m)}  # old boundaries that move along behind the edit
        position = begin = int(bounds[k])
        sizes, counts, rest = [], [], len(lengths)
        for piece in self.counter.stream(text, position):
            if position >= start + len(new) and position > begin and position in later:
                rest = later[position]
                break
            if not whole and position + len(piece) + AHEAD > len(text):
                self.encoded += len(sizes)  # a try that doesn't do has encoded them too
                return None  # what follows may change this piece
            sizes.append(len(piece))
            counts.append(self.counter[piece])
            position += len(piece)
        else:
            if not whole:
                self.encoded += len(sizes)
                return None
        self.fresh = len(sizes)
        return text, np.concatenate((lengths[:k], np.array(sizes, np.int32), lengths[rest:])), np.concatenate((known[:k], np.array(counts, np.int32), known[rest:]))

    def _renew(self, first: int, last: int) -> None:
        """Sums of leaves [first, last) and of every node above them."""
        for i in range(first, last):
            self.chars[self.width + i], self.tokens[self.width + i] = len(self.leaves[i].text), int(self.leaves[i].counts.sum())
        low, high = (self.width + first) // 2, (self.width + last - 1) // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2


def load(path: str = VOCABULARY) -> Counter:
    """A counter for the vocabulary of ranks at `path`."""
    with open(path, "rb") as file:
        return Counter(file.read())


#: Columns of a stored tree, after its id.
TREE = {"text": pa.string(), **dict.fromkeys(("lengths", "counts", "leaves"), pa.list_(pa.int32())), **dict.fromkeys(("chars", "tokens"), pa.list_(pa.int64())), "n_pretokens": pa.int64(), "n_tokens": pa.int64(), "n_reencoded": pa.int64()}
_TREE_DDL = "text string, lengths array<int>, counts array<int>, leaves array<int>, chars array<long>, tokens array<long>, n_pretokens long, n_tokens long, n_reencoded long"


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _rows(ids: pa.Array, trees: Iterable[SegmentTree], more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch of stored trees; n_reencoded counts what has been encoded since the tree was loaded."""
    cols: dict[str, list] = {k: [] for k in TREE}
    none = [np.empty(0, np.int32)]
    for tree in trees:
        lengths, counts = (np.concatenate([getattr(x, name) for x in tree.leaves] or none) for name in ("lengths", "counts"))
        row = (tree.text, lengths, counts, [len(x.lengths) for x in tree.leaves], tree.chars, tree.tokens, len(lengths), tree.total, tree.encoded)
        for k, v in zip(TREE, row, strict=True):
            cols[k].append(v)
    made = [_lists(cols[k], t.value_type) if pa.types.is_list(t) else pa.array(cols[k], t) for k, t in TREE.items()]
    return pa.RecordBatch.from_arrays([ids, *made, *more], ["id", *TREE, *names])


def _loaded(batch: pa.RecordBatch, counter: Counter) -> Iterator[SegmentTree]:
    """The trees of a batch of stored rows after the edits in its column `edits`."""
    flat = {k: (batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy(zero_copy_only=False)) for k in ("lengths", "counts")}
    texts, leaves, chars, tokens, edits = (batch.column(k) for k in ("text", "leaves", "chars", "tokens", "edits"))
    for i in range(len(batch)):
        lengths, counts = (v[at[i] : at[i + 1]] for at, v in flat.values())
        tree = SegmentTree.load(texts[i].as_py(), lengths, counts, leaves[i].as_py(), chars[i].as_py(), tokens[i].as_py(), counter)
        for e in edits[i].as_py() or ():
            if e is not None:
                tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
        yield tree


def build(docs: DataFrame, counter: Counter, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """The stored trees of every row, encoded in full once (n_reencoded says so); column `edits` goes along if named."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = f", edits {docs.schema[edits_col].dataType.simpleString()}" if edits_col else ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column(0), (SegmentTree(x.as_py() or "", counter) for x in batch.column(1)), batch.columns[2:], batch.schema.names[2:])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(edits_col).alias("edits")] if edits_col else []))
    return stored(rows.mapInArrow(run, f"id {kind}, {_TREE_DDL}{more}"), "trees")


def apply_edits(trees: DataFrame, counter: Counter) -> DataFrame:
    """Stored trees after their `edits`, an array of struct<start, end, replacement> in order of application.

    n_reencoded is the number of pre-tokens that were encoded for that."""
    kind = trees.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column(0), _loaded(batch, counter), [], [])

    return trees.select("id", *TREE, "edits").mapInArrow(run, f"id {kind}, {_TREE_DDL}")


def count_edits(docs: DataFrame, counter: Counter, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id, n_tokens, n_tokens_after, n_pretokens, n_reencoded): trees are built and stored, then edited as stored."""
    trees = build(docs, counter, id_col, text_col, edits_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = [(tree.total, tree.encoded) for tree in _loaded(batch, counter)]
            totals, fresh = (pa.array([x[k] for x in after], pa.int64()) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), totals, batch.column("n_pretokens"), fresh], ["id", "n_tokens", "n_tokens_after", "n_pretokens", "n_reencoded"])

    return trees.select("id", *TREE, "edits").mapInArrow(run, f"id {kind}, n_tokens long, n_tokens_after long, n_pretokens long, n_reencoded long")


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` (or trees) with column edits, gathered from a table (id, seq, start, end, replacement); few edits travel to
    the rows, many by a merge join."""
    each = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
    return docs.join(bounded(each, 20_000), id_col, "left")


def standard_edits(text: str, key: str):
    """Three edits of every document: an insertion in its middle, a deletion in its first and a replacement in its last part."""
    n, h = F.coalesce(F.length(text), F.lit(0)), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(97)).cast("int")
    one = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), c.alias("replacement"))
    return F.array(
        one(F.floor(n / 2), F.floor(n / 2), F.concat(F.lit(" inserted "), h.cast("string"), F.lit(" words"))),
        one(F.floor(n / 5), F.floor(n / 5) + h % 40, F.lit("")),
        one(F.floor(n * 4 / 5), F.floor(n * 4 / 5) + 7, F.lit("'re new\n\n  text")),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("edits", standard_edits("text", "doc_id"))
    return count_edits(docs, load()).withColumnRenamed("id", "doc_id")
