"""SimHash fingerprints and exact near-duplicate groups through vantage-point shards.

A fingerprint is 64 bits: bit b is set when more than half of a document's shingle hashes have it set. Documents link
when their fingerprints differ in at most `max_bits` bits; groups are the connected components of those links.

Plan: (1) fingerprints in one pass, Arrow in, narrow rows out; (2) equal fingerprints collapse to one row by a
map-side-combined aggregate, so thousands of copies cost one row; (3) a vantage-point tree, fitted on a bounded sample
of distinct fingerprints, deals every fingerprint to one owning shard, and, as a query, to each further shard whose
region its ball of radius `max_bits` meets (triangle bounds d <= mu + r and d > mu - r), so every pair is seen whole
in the owner's shard; (4) inside a shard the same recursion goes on down to small blocks that are compared bit by bit,
and a local union-find keeps a spanning forest instead of all pairs; (5) components over the forests by label
propagation between stored tables.

Null texts, empty texts and texts without a word have fingerprint zero and link like any other. Repeated rows and
repeated ids are separate rows with the same component. Rows with a null id link like any other, but a component's number
is the smallest id that isn't null, and null where it has none. Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysieve.llm.common import salted_lookup, stored

SEED = 42
#: Fingerprints of the sample that the top of the tree is fitted on.
SAMPLE = 32_768
#: Owned fingerprints that a shard should hold.
SHARD = 4_096
#: Links that one task may contract (16 MB); more are contracted by joins between stored tables.
LOCAL_LINKS = 1_000_000
#: A block of owners x visitors of this size is compared bit by bit.
BLOCK = 1 << 20
_BITS = np.array([[i >> (7 - k) & 1 for k in range(8)] for i in range(256)], dtype=np.uint8)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of every `width`-word shingle of an A-Z lower-cased text, as big-endian unsigned integers."""
    words = text.lower().translate(_SPACES).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return np.empty(0, ">u8")
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= width:
        return np.frombuffer(digest(joined, SEED), ">u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8")


_SPACES = bytes(32 if c in (32, 9, 10, 11, 12, 13) else c for c in range(256))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits of the hashes; a tie gives 0."""
    n = len(hashes)
    if not n:
        return 0
    raw, total = hashes.view(np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for at in range(0, n, 8_160):  # blocks of at most 255 rows of 32 sum in single bytes
        bits = np.unpackbits(raw[at : at + 8_160], axis=1)
        whole = len(bits) // 32 * 32
        if whole:
            total += bits[:whole].reshape(-1, 32 * 64).sum(0, dtype=np.uint8 if whole <= 8_160 else np.int64).reshape(32, 64).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row; the bits of fp are the unsigned fingerprint's."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if pa.types.is_string(batch.column(1).type) else batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(shingle_hashes(x.as_py(), width)) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


class VantageTree:
    """Top of a vantage-point tree. Node k has children 2k+1 (d <= mu) and 2k+2 (d > mu); the last level are shards."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth, self.points, self.radii = depth, np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 64, np.int64)
        parts = [np.unique(sample)]
        for node in range((1 << depth) - 1):
            mine = parts[node]
            if len(mine) > 1:
                self.points[node] = mine[len(mine) // 3]
                far = np.bitwise_count(mine ^ self.points[node])
                self.radii[node] = _split(far)
                parts += [mine[far <= self.radii[node]], mine[far > self.radii[node]]]
            else:
                parts += [mine, mine[:0]]

    def shards(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) for every shard whose region a ball of `radius` about the row's fingerprint meets."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            far = np.bitwise_count(fps[rows] ^ self.points[nodes]).astype(np.int64)
            near, beyond = far <= self.radii[nodes] + radius, far > self.radii[nodes] - radius
            rows, nodes = np.concatenate((rows[near], rows[beyond])), np.concatenate((2 * nodes[near] + 1, 2 * nodes[beyond] + 2))
        return rows, nodes - ((1 << self.depth) - 1)


def _split(far: np.ndarray) -> int:
    """The distance that halves a set best; below the largest one unless all are equal."""
    counts = np.cumsum(np.bincount(far, minlength=65))
    return int(np.argmin(np.abs(2 * counts[: far.max()] - len(far)))) if far.max() > far.min() else int(far.max())


def shard_links(fps: np.ndarray, owned: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links between owned fingerprints and any other of the shard."""
    parent, forest = np.arange(len(fps)), []
    stack = [(np.nonzero(owned)[0], np.arange(len(fps)))]
    while stack:
        mine, all_ = stack.pop()
        if not len(mine) or not len(all_):
            continue
        if len(mine) * len(all_) > BLOCK:
            point = fps[mine[len(mine) // 3]]
            near, far = np.bitwise_count(fps[mine] ^ point).astype(np.int64), np.bitwise_count(fps[all_] ^ point).astype(np.int64)
            mu = _split(near)
            parts = [(mine[near <= mu], all_[far <= mu + radius]), (mine[near > mu], all_[far > mu - radius])]
            if sum(len(a) * len(b) for a, b in parts) < 0.9 * len(mine) * len(all_):
                stack += parts
                continue
        step = max(1, BLOCK // len(all_))
        for at in range(0, len(mine), step):
            close = np.bitwise_count(fps[mine[at : at + step], None] ^ fps[None, all_]) <= radius
            for i in np.nonzero(np.count_nonzero(close, axis=1) > 1)[0].tolist():
                me, others = int(mine[at + i]), all_[close[i]]
                root = int(_roots(parent, np.array([me]))[0])
                found, first = np.unique(_roots(parent, others), return_index=True)
                for other, k in zip(found.tolist(), first.tolist(), strict=True):
                    if other != root:
                        parent[other] = root
                        forest.append((me, int(others[k])))
    return forest


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Roots of union-find nodes, which point at them from now on."""
    out = parent[nodes]
    while ((up := parent[out]) != out).any():
        out = up
    parent[nodes] = out
    return out


def near_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): a forest a shard over the distinct fingerprints in column fp, whose components are those of all links."""
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = int(np.clip(np.ceil(np.log2(max(1, distinct.count()) / SHARD)), 0, np.log2(SAMPLE) - 3))
    tree = VantageTree(sample, depth)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, shards = tree.shards(fps, max_bits)
            own_rows, own_shards = tree.shards(fps, 0)
            home = np.empty(len(fps), np.int64)
            home[own_rows] = own_shards
            yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(fps[rows].view(np.int64)), pa.array(home[rows] == shards)], ["shard", "fp", "own"])

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        fps = frame["fp"].to_numpy(np.int64)
        pairs = shard_links(fps.view(np.uint64), frame["own"].to_numpy(bool), max_bits)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": fps[at[:, 0]], "b": fps[at[:, 1]]})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, own boolean")
    return stored(dealt.groupBy("shard").applyInPandas(links, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest reachable node of every node that has a link; alternating star contraction.

    Each round replaces a node's links by links to its smallest neighbour; it ends when all links point at a root.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    before = _shape(edges)
    if before[0] <= LOCAL_LINKS:
        return edges.repartition(1).mapInArrow(_contract, "node long, root long")
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = salted_lookup(both, least, ["u"], "n", 2 * before[0], F.col("v")).where(F.col("v") > F.col("u"))
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = salted_lookup(large, down, ["u"], "n", large.count(), F.col("v"))
        small = small.select("m", F.explode(F.array("u", "v")).alias("u")).select("u", F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct(), "edges")
        after = _shape(edges)
        if before == after:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest reachable node of a bounded number of links, by label spreading and pointer jumping."""
    table = pa.Table.from_batches([*batches], pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ends = np.concatenate([table.column(0).to_numpy(), table.column(1).to_numpy()])
    nodes, codes = np.unique(ends, return_inverse=True)
    u, v, label = codes[: len(table)], codes[len(table) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["node", "root"])


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component): every row with its fingerprint and the smallest id reachable over links."""
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct, max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("k"))
    nodes, total = distinct.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lookup = stored(salted_lookup(rooted, lowest, ["root"], "k", nodes, F.col("fp")).select("fp", "n", "component"), "components")
    return salted_lookup(fps, lookup, ["fp"], "n", total, F.col("id")).select("id", "fp", "component")
