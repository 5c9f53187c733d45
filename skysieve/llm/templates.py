r"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts are cut into words; a number, a unit beside a number and a name (a capitalised word inside a sentence) become
slots <num>, <unit> and <name>, every other word its lower-cased letters. Windows of WINDOW template words (for
shorter items: the whole item) of the benchmark are hashed; documents' windows join them on the hash. Windows of fewer
than LITERALS literal words are left out unless the item has no other. Matches of a document and an item on one
alignment must fill slots consistently: an item's slot value always meets the same document value; that catches
re-parameterised questions, and leaves alone texts that only share a frame. An item counts as found when its consistent
windows cover at least COVERAGE of all its windows (those of several alignments together only where their slot values
agree too, else the best alignment's), or, on absolute evidence, when one alignment matches RUN template
words without a gap, or the words of its matched windows are RUN at least and COVERAGE of its words: a passage of a long
item matches few of its windows, and one edited word breaks eight of them. Only windows of enough literals are evidence.

Pass one over the documents tests window hashes against a Bloom array of the benchmark's (bounded size), so only likely
matches leave the task; the hash join then is exact. Whole texts are read, no window is skipped.

Defined cases: null or empty texts and texts without words match nothing; an item without words is never found; a
document that repeats an item counts once; rows that repeat an id are one document with the windows of all its rows;
rows with a null id match nothing and are kept by `clean`; extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.bloom import bits_for, probes, seen
from skysieve.llm.common import bounded, drop_ids, stored, table

WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Template words that are evidence by themselves.
RUN = 13
#: Share of an alignment's slot values that must be met by one document value each.
CONSISTENT = 0.8
#: Characters that are coded at a time.
SLICE = 500_000

# Words that are numbers, and units.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("% $ € £ mm cm m km inch inches ft feet foot yard yards mile miles g kg mg lb lbs oz ton tons l ml litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros pound pounds percent degree degrees mph kmh v w kw".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[%$€£]|[.!?:;\n]")
_STOPS = frozenset(".!?:;\n")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"


def template(text: str | None) -> tuple[list[str], list[str]]:
    """(template words, slot values; "" where the word is literal)."""
    parts, values = [], []
    start, number = True, False  # at a sentence's start; after a number
    for word in _WORD.findall(text or ""):
        if word in _STOPS:
            start, number = True, False
            continue
        low = word.lower()
        if word[0].isdigit() or low in NUMBER_WORDS:
            parts.append(NUM)
            values.append(low)
            number = True
        elif low in UNITS and (number or word in "%$€£"):
            parts.append(UNIT)
            values.append(low)
            number = False
        else:
            named = not start and len(word) > 1 and word[0].isupper() and word[1:].islower()
            parts.append(NAME if named else low)
            values.append(low if named else "")
            number = False
        start = False
    return parts, values


_MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]
_STOP, _NAMED, _UNIT, _SIGN, _NUMBER = 1, 2, 4, 8, 16


def _code(part: str) -> int:
    return xxhash.xxh64_intdigest(part)


class Coder(dict):
    """Codes of the template words of many texts at once; blank-separated tokens are taken apart once and remembered."""

    #: Tokens that are remembered.
    MOST = 100_000

    def __init__(self) -> None:
        super().__init__()
        self.first, self.count, self.codes, self.flags = [], [], [], []

    def __missing__(self, token: str) -> int:
        self.first.append(len(self.codes))
        for word in _WORD.findall(token):
            if word in _STOPS:
                code, flag = 0, _STOP
            else:
                low = word.lower()
                if word[0].isdigit() or low in NUMBER_WORDS:
                    code, flag = _code(NUM), _NUMBER
                else:
                    code, flag = _code(low), _NAMED if len(word) > 1 and word[0].isupper() and word[1:].islower() else 0
                    if low in UNITS:
                        flag |= _SIGN if word in "%$€£" else _UNIT
            self.codes.append(code)
            self.flags.append(flag)
        self.count.append(len(self.codes) - self.first[-1])
        self[token] = number = len(self)
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all template words, number of the text of each)."""
        if len(self) > self.MOST:
            self.clear()
            self.__init__()
        split = [(t or "").replace("\n", " \n ").split(" ") for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        count, flags, codes = np.array(self.count, np.int64), np.array(self.flags, np.uint8), np.array(self.codes, np.uint64)
        n = count[ids]
        ends = np.cumsum(n)
        at = np.repeat(np.array(self.first, np.int64)[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        flag, code, owner = flags[at], codes[at], np.repeat(np.repeat(np.arange(len(texts)), lengths), n)
        fresh = np.ones(len(at), bool)
        fresh[1:] = owner[1:] != owner[:-1]
        before = np.zeros(len(at), np.uint8)
        before[1:] = flag[:-1]
        before[fresh] = _STOP
        unit = (flag & _SIGN > 0) | (flag & _UNIT > 0) & (before & _NUMBER > 0)
        code[(flag & _NAMED > 0) & (before & _STOP == 0)] = _code(NAME)
        code[unit] = _code(UNIT)
        words = flag & _STOP == 0
        return code[words], owner[words]


def _codes(parts: list[str]) -> np.ndarray:
    return np.array([_code(p) for p in parts], np.uint64)


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += codes[k : k + n] * _MIX[k]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width)


def item_windows(text: str | None, width: int = WINDOW, literals: int = LITERALS) -> list[tuple[int, int, int, list[str], int]]:
    """(hash, width, position, slot values of the window, words of the item or 0 if it lacks literals) of an item."""
    parts, values = template(text)
    if not parts:
        return []
    width = min(width, len(parts))
    hashes = windows(_codes(parts), width)
    solid = np.array([v == "" for v in values])
    enough = [i for i in range(len(hashes)) if solid[i : i + width].sum() >= literals]
    words = len(parts) if enough else 0
    return [(int(hashes[i].view(np.int64)), width, i, [v for v in values[i : i + width] if v], words) for i in enough or range(len(hashes))]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item, h, w, pos, slots, words, windows) with the item's number of words and of windows."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x, len(found)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for found in [item_windows(t.as_py(), width)] for x in found]
            types = (batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["item", "h", "w", "pos", "slots", "words", "windows"])

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, f"item {kind}, h long, w int, pos int, slots array<string>, words int, windows int"), "windows")


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """Bloom array over the hashes of benchmark windows, built from their distinct bit positions."""
    out = np.zeros(bits // 8, np.uint8)
    batch: list[int] = []
    for row in found.select("h").distinct().toLocalIterator():
        batch.append(row[0])
        if len(batch) == 100_000:
            _mark(out, bits, batch)
            batch = []
    _mark(out, bits, batch)
    return out


def _mark(out: np.ndarray, bits: int, hashes: list[int]) -> None:
    at = probes(np.array(hashes, np.int64).view(np.uint64), bits)
    np.bitwise_or.at(out, (at >> np.uint64(3)).ravel(), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)).ravel())


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(id, item, n_windows, n_matched, coverage, n_slots, slots_changed) of the items that documents contain."""
    items = benchmark_windows(benchmark, item_col, "text", width)
    widths = sorted(r[0] for r in items.select("w").distinct().collect())  # at most `width` numbers
    bits = bits_for(items.count())
    array = docs.sparkSession.sparkContext.broadcast(_filter(items, bits))
    kind = docs.schema[id_col].dataType.simpleString()

    def hits(coder: Coder, ids: list, texts: list[str | None]) -> list[tuple]:
        codes, owner = coder.encode(texts)
        starts, out = np.searchsorted(owner, np.arange(len(texts))), []
        for w in widths:
            hashes = windows(codes, w)
            at = np.nonzero(seen(array.value, bits, hashes))[0]
            at = at[owner[at] == owner[at + w - 1]]
            for text in np.unique(owner[at]).tolist():
                _, values = template(texts[text])
                for i in at[owner[at] == text].tolist():
                    place = i - int(starts[text])
                    out.append((ids[text], int(hashes[i].view(np.int64)), place, [v for v in values[place : place + w] if v]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            types = (batch.column(0).type, pa.int64(), pa.int32(), pa.list_(pa.string()))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.cumsum([len(t or "") + 1 for t in texts])
            cuts = [0, *np.searchsorted(ends, np.arange(SLICE, ends[-1] if len(ends) else 0, SLICE)).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    out = hits(coder, ids[a:b], texts[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["id", "h", "at", "values"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    likely = rows.mapInArrow(run, f"id {kind}, h long, at int, values array<string>")
    met = likely.join(bounded(items), "h").where(F.size("values") == F.size("slots"))
    pairs = F.collect_set(F.arrays_zip("slots", "values"))
    aligned = met.groupBy("id", "item", (F.col("at") - F.col("pos")).alias("shift")).agg(F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(pairs)).alias("filled"), F.first("windows").alias("windows"), F.first("words").alias("words"), F.first("w").alias("w"))
    keys = F.size(F.array_distinct(F.transform("filled", lambda x: x["slots"])))
    aligned = aligned.where(F.size("filled") * CONSISTENT <= keys).withColumn("changed", F.exists("filled", lambda x: x["slots"] != x["values"]))
    # word positions that the windows of an alignment cover, and the longest run of them
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("w") - 1))))
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state, p):
        run = F.when(p == state["last"] + 1, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    aligned = aligned.withColumn("covered", F.array_sort(covered)).withColumn("run", F.aggregate("covered", zero, step, lambda state: state["best"]))
    found = aligned.groupBy("id", "item").agg(
        F.first("windows").alias("n_windows"),
        F.first("words").alias("words"),
        F.max("run").alias("run"),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("all_covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("all_matched"),
        F.max(F.size("covered")).alias("one_covered"),
        F.max(F.size("places")).alias("one_matched"),
        F.array_distinct(F.flatten(F.collect_list("filled"))).alias("all_filled"),
        F.max(F.size("filled")).alias("n_slots"),
        F.bool_and("changed").alias("slots_changed"),
    )
    # alignments that contradict each other don't add up
    agree = F.size("all_filled") * CONSISTENT <= F.size(F.array_distinct(F.transform("all_filled", lambda x: x["slots"])))
    found = found.withColumns({"n_matched": F.when(agree, F.col("all_matched")).otherwise(F.col("one_matched")), "n_covered": F.when(agree, F.col("all_covered")).otherwise(F.col("one_covered"))})
    found = found.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    absolute = (F.col("words") > 0) & ((F.col("run") >= RUN) | (F.col("n_covered") >= RUN) & (F.col("n_covered") >= F.lit(coverage) * F.col("words")))
    return found.where((F.col("coverage") >= coverage) | absolute).select("id", "item", "n_windows", "n_matched", "n_slots", "slots_changed", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that contain no item, all columns as they are."""
    found = stored(matches(docs, benchmark, id_col).select(F.col("id").alias(id_col)).distinct(), "leaks")
    return drop_ids(docs, found, id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_matched", "coverage", "n_slots", "slots_changed")
