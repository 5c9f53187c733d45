"""Near copies by Jaccard similarity of word shingles, on top of the SimHash search.

Two texts of similarity 0.8 differ in about ten of 64 fingerprint bits, too far for a vantage-point tree to prune at any
useful radius (distances between unrelated texts spread over only four bits around 32). So the tree's links within
MAX_BITS serve as one source of candidates, and banded minimum hashes as the other: BANDS permutations of the shingle
hashes, each keyed by its LEAST smallest values, meet at similarity s with probability 1 - (1 - s^LEAST)^BANDS, 0.9993
at 0.8. That holds for large sets only, so pairs with a set below SHORT shingles meet by an exact prefix filter: of two
sets of similarity s, each of n has a common one among its n - ceil(s n) + 1 smallest shingles. Every candidate is then
verified on the whole shingle sets.

Plan: equal shingle sets collapse first. Keys with at most ALL_PAIRS members give all pairs. Members of larger keys go
with their shingle sets to blocks of about BLOCK shingles, and a block gives a forest of the links between its
components, so no pair becomes a row. A key is settled when all its members are in one component; keys come in TURNS,
and what one turn links is settled in the next. Keys of more than one block that aren't settled then have every member
outside the key's largest component compared with every other member, over pairs of blocks. So each pair of a key is
either verified or in one component already. Counting is map-side combined and hot keys are salted. Shingle sets are
only made for documents that have a candidate.

Defined cases: null and empty texts have the empty set and are copies of each other; texts shorter than a shingle are
one shingle; of a group the smallest id stays, of its rows of one text one; rows of an id with different texts are
different documents, and where they are copies of each other one of them stays; an empty table gives an empty table;
rows with a null id are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from skysieve.llm.common import bounded, drop_ids, salted_lookup, stored
from skysieve.llm.simhash import components, fingerprint, near_links, shingle_hashes

WIDTH, SIMILARITY, MAX_BITS = 5, 0.8, 2
BANDS, LEAST = 24, 6
#: Sets of fewer shingles find their partners by prefixes alone.
SHORT = 30
ALL_PAIRS = 24
#: Shingles of a block of a large key, about.
BLOCK = 1 << 18
#: Sixths of the large keys that are taken together.
TURNS = ((0,), (1, 2), (3, 4, 5))
#: Copies of a hot lookup row that carries a shingle set.
SPREAD = 64

_rng = np.random.default_rng(7)
_A, _B = _rng.integers(1, 1 << 63, BANDS, np.uint64) | np.uint64(1), _rng.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width).astype(np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each permutation: hash of its smallest values."""
    if not len(found):
        return []
    mixed = found[:, None] * _A + _B
    mixed ^= mixed >> np.uint64(31)
    k = min(LEAST, len(found))
    low = np.sort(np.partition(mixed, k - 1, axis=0)[:k], axis=0)
    return [xxhash.xxh64_intdigest(np.ascontiguousarray(low[:, b]).tobytes(), b) - (1 << 63) for b in range(BANDS)]


def candidate_keys(found: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Keys of a sorted set: its prefix if a partner may be short, its bands if it isn't short itself."""
    n, keys = len(found), []
    if n * similarity <= SHORT:
        prefix = found[: n - math.ceil(similarity * n - 1e-9) + 1]
        keys = [xxhash.xxh64_intdigest(x.tobytes(), BANDS) - (1 << 63) for x in prefix]
    return keys if n < SHORT else keys + bands(found)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, same binary, fp, n, keys): digest of the shingle set, fingerprint, set size and candidate keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, fps, sizes, keys = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                found = np.unique(hashes.astype(np.uint64))
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                fps.append(fingerprint(hashes))
                sizes.append(len(found))
                keys.append(candidate_keys(found, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["id", "same", "fp", "n", "keys"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, f"id {kind}, same binary, fp long, n int, keys array<long>"), "sketches")


def shingle_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, members binary) of the distinct ids `wanted`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x.as_py(), width).tobytes() for x in batch.column(1)], pa.binary())], ["id", "members"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(bounded(wanted), "id", "left_semi")
    return stored(rows.mapInArrow(sets, f"id {kind}, members binary").dropDuplicates(["id"]), "sets")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the similarity."""
    pairs = stored(pairs.where("a < b").distinct(), "pairs")
    found = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, id_col, text_col, width)
    kind = pairs.schema["a"].dataType.simpleString()
    total = pairs.count()
    for side in ("a", "b"):
        uses = pairs.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("uses"))
        lookup = uses.join(found, "id").select(F.col("id").alias(side), "uses", F.col("members").alias(f"m_{side}"))
        pairs = salted_lookup(pairs, lookup, [side], "uses", total, F.xxhash64("a", "b"), SPREAD).drop("uses")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py() or b"", np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.select("a", "b", "m_a", "m_b").mapInArrow(check, f"a {kind}, b {kind}"), "links")


def block_links(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest of the links between components, over all pairs of a block of (not empty) sets.

    A member that has been compared with all others is done; once all others are in one component, no pair is left.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max() + 1, np.int32)
    label, left, out = np.unique(roots, return_inverse=True)[1], np.ones(len(sets), bool), []
    while True:
        rest = np.nonzero(left & (label != np.bincount(label[left]).argmax()))[0]
        if not len(rest):
            return out
        x = rest[0]
        mine = codes[starts[x] : starts[x] + sizes[x]]
        mark[mine] = 1
        both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
        mark[mine] = 0
        near = np.nonzero((both >= similarity * (sizes + sizes[x] - both) - 1e-9) & (label != label[x]))[0]
        joined, first = np.unique(label[near], return_index=True)
        out += [(ids[x], ids[y]) for y in near[first]]
        label[np.isin(label, joined)] = label[x]
        left[x] = False


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, key, root, major, weight, minor) of the members of keys with several components.

    `major` is the root of the key's largest component, `weight` the shingles of the key and `minor` those outside it.
    """
    known = bounded(roots.select(F.col("node").alias("id"), "root"))
    named = stored(members.join(known, "id", "left").select("id", "n", "key", F.coalesce("root", "id").alias("root")), "named")
    parts = named.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    keys = parts.groupBy("key").agg(F.sum("c").alias("k"), F.sum("w").alias("weight"), F.max(F.struct("c", "w", "root")).alias("top"), F.count("*").alias("several")).where("several > 1")
    keys = keys.select("key", "k", "weight", (F.col("weight") - F.col("top.w")).alias("minor"), F.col("top.root").alias("major"))
    found = salted_lookup(named, keys, ["key"], "k", named.count(), F.col("id")).where(F.col("k").isNotNull())
    return stored(found.select("id", "key", "root", "major", "weight", "minor"), "unsettled")


def linked(placed: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between the components of each block (key, i, j) of `placed`."""
    kind = placed.schema["id"].dataType.simpleString()

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("id")
        ids = frame["id"].to_numpy()
        found = block_links(ids, frame["root"].to_numpy(), [np.frombuffer(x, np.uint64) for x in frame["members"]], similarity)
        at = np.array(found, ids.dtype).reshape(-1, 2)
        return pd.DataFrame({"a": at[:, 0], "b": at[:, 1]})

    sets = shingle_sets(placed.select("id").distinct(), docs, id_col, text_col, width)
    return stored(placed.join(sets, "id").groupBy("key", "i", "j").applyInPandas(links, f"a {kind}, b {kind}"), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, root): every id with a smaller member in its group, and the group's smallest id."""
    sketch = sketches(docs, id_col, text_col, width, similarity)
    firsts = sketch.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    firsts = stored(firsts, "firsts")
    one = sketch.join(firsts.select(F.col("first").alias("id"), F.col("same").alias("own")), "id").where(F.col("same") == F.col("own"))
    one = stored(one.select("id", "fp", "n", "keys").dropDuplicates(["id"]), "representatives")

    # candidates within MAX_BITS: a forest over distinct fingerprints, and equal fingerprints with their smallest id
    by_fp = one.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("k"))
    number = one.count()
    near = near_links(by_fp.select("fp"), max_bits)
    low = by_fp.select("fp", "low")
    close = near.join(low.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = salted_lookup(one.select("id", "fp"), by_fp, ["fp"], "k", number, F.col("id")).where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    pairs = close.unionByName(equal)

    rows = one.select("id", "n", F.explode("keys").alias("key"))
    total = rows.count()
    stats = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    joined = stored(salted_lookup(rows, stats, ["key"], "k", total, F.col("id")).where(F.col("k").isNotNull()), "members")
    few, many = joined.where(F.col("k") <= ALL_PAIRS), joined.where(F.col("k") > ALL_PAIRS).select("id", "n", "key")
    lists = few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    each = lists.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), x["n"].alias("n_a"), y["n"].alias("n_b")))))).alias("p")).select("p.*")
    each = each.where(F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b") - 1e-9).select("a", "b")
    roots = stored(components(verified(pairs.unionByName(each), docs, id_col, text_col, width, similarity)), "roots")

    def contracted(placed: DataFrame) -> DataFrame:
        # what is known so far enters as its contracted links
        new = linked(placed, docs, id_col, text_col, width, similarity)
        return stored(components(new.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))), "roots")

    spot, blocks = F.xxhash64("id", "key"), F.ceil(F.col("weight") / BLOCK)
    for turn in TURNS:
        rest = unsettled(many.where(F.pmod("key", F.lit(6)).isin(*turn)), roots)
        if not rest.isEmpty():
            roots = contracted(rest.select("id", "root", "key", F.pmod(spot, blocks).alias("i"), F.lit(0).cast("long").alias("j")))
    rest = unsettled(many, roots).where(F.col("weight") > BLOCK)
    if not rest.isEmpty():
        across = F.ceil(F.col("minor") / BLOCK)
        every = rest.select("id", "root", "key", F.explode(F.sequence(F.lit(0).cast("long"), across - 1)).alias("i"), F.pmod(spot, blocks).alias("j"))
        minor = rest.where("root <> major").select("id", "root", "key", F.pmod(spot, across).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
        roots = contracted(every.unionByName(minor))

    copies = salted_lookup(sketch.select("id", "same"), firsts, ["same"], "copies", sketch.count(), F.xxhash64("id")).select("id", "first")
    lookup = bounded(roots.select(F.col("node").alias("first"), "root"))
    return copies.join(lookup, "first", "left").select("id", F.coalesce("root", "first").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns as they are, with one document of each group: the one with the smallest id."""
    number = isinstance(docs.schema[id_col].dataType, IntegralType)
    repeated = stored(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("__k")).where("__k > 1").select(id_col), "repeated")
    if not number or not repeated.isEmpty():
        return _keep_one_row(docs, repeated, id_col, text_col, width, similarity)
    found = groups(docs, id_col, text_col, width, similarity)
    gone = stored(found.where("root < id").select(F.col("id").alias(id_col)).distinct(), "copies")
    return drop_ids(docs, gone, id_col)


def _keep_one_row(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, width: int, similarity: float) -> DataFrame:
    """`keep_one` where ids repeat: decides on numbers of the distinct (id, text), not on ids."""
    again = docs.join(bounded(repeated), id_col, "left_semi").dropDuplicates([id_col, text_col])
    once = docs.join(bounded(repeated), id_col, "left_anti")
    rows = stored(once.unionByName(again).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = stored(groups(rows.where(F.col(id_col).isNotNull()), "__row", text_col, width, similarity), "groups")
    # the smallest id of a group stays, of its texts the one of the smallest digest
    order = rows.where(F.col(id_col).isNotNull()).select(F.col("__row").alias("id"), F.struct(F.col(id_col).alias("doc"), F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256).alias("text"), F.col("__row").alias("row")).alias("rank"))
    ranked = stored(found.join(order, "id").select("id", "root", "rank"), "ranked")
    first = ranked.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("id"))
    gone = stored(ranked.select("id").join(bounded(first), "id", "left_anti").withColumnRenamed("id", "__row"), "copies")
    return drop_ids(rows, gone, "__row").select(docs.columns)
