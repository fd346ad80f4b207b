"""Benchmark decontamination as a prefix-filtered set join.

An item's windows of ``window`` words are sets of word shingles that have to be
contained in a document in full, so by the prefix filter one shingle per window is
enough to find every place that may hold it: the window's rarest, by how often the
documents have it.

1. One scan of the documents keeps, around each shingle that some item may have (a bit
   filter of fixed size), the words that a window through it could cover: a *segment*.
   All later steps work on segments only.
2. Item shingles are counted in the segments and ordered by rarity; each window takes
   its rarest shingle as its prefix.  Windows in a row that take the same one are one
   *prefix*: the shingle, its place in the item, and the words that those windows span.
3. Places of prefix shingles in segments, each with the words around it, are joined to
   prefixes on the shingle.  A place has to leave as many words on either side as some
   window needs there: the length and positional bounds, part of the join's condition.
4. What is left is an alignment: a place in a document beside a place in an item.  Only
   the windows of that prefix, at that alignment, are compared word by word.

The bit filters have a bounded size whatever the benchmark's size is; false positives
cost a comparison and change nothing.  Neither table is broadcast by this module, and a
passage shared by a third of all documents is a skewed inner join on one shingle, which
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .suffix_dedup import views
from .words import ALNUM, Words, groups, shingle_names

_U = np.uint64
#: Bits of a filter: 16 per shingle or more, up to a fixed bound of what is broadcast (32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_SLICE = 1 << 16


class BitFilter:
    """A set of shingle names with false positives only."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, names: np.ndarray) -> np.ndarray:
        out = np.ones(len(names), bool)
        for at in _bit_places(names, 8 * len(self.bits)):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _bit_places(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each name; size is a power of two."""
    return (names & _U(size - 1)).astype(np.int64), ((names >> _U(32)) & _U(size - 1)).astype(np.int64)


def make_filter(names: DataFrame) -> BitFilter:
    """Fold a column ``name`` of longs into a filter; at most MOST_BITS / 8 bytes come to the driver."""
    size = LEAST_BITS
    wanted = 16 * names.count()
    while size < min(wanted, MOST_BITS):
        size *= 2

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _bit_places(batch.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(found, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = [i for i in range(0, len(found), _SLICE) if found[i : i + _SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([found[i : i + _SLICE].tobytes() for i in used], pa.binary())], names=["at", "bits"])

    def union(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"at": t.column("at")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    kind = "at long, bits binary"
    out = np.zeros(size // 8, np.uint8)
    for row in names.select("name").mapInArrow(slices, kind).groupBy("at").applyInArrow(union, kind).toLocalIterator():
        out[row["at"] : row["at"] + _SLICE] = np.frombuffer(row["bits"], np.uint8)
    return BitFilter(out)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, words) with the words joined by spaces; items without words fall away."""
    for batch in batches:
        rows, words = [], []
        for numbers, texts in groups(views(batch.column(2))):
            w = Words(numbers, texts, ALNUM)
            for i, lo, hi in w.runs():
                rows.append(i)
                words.append(w.string(lo, hi))
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)), pa.array(words, pa.string())], names=["item", "item_id", "words"])


def _names_of(words: str) -> np.ndarray:
    return Words([0], [np.frombuffer(words.encode(), np.uint8)], ALNUM).names


def _sizes(n: int, window: int, shingle: int) -> tuple[int, int]:
    """Window and shingle length of an item of n words."""
    length = min(window, n)
    return length, min(shingle, length)


def _item_shingles(window: int, shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = _names_of(words)
                size = _sizes(len(names), window, shingle)[1]
                own = shingle_names(names, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(np.arange(len(own))), pa.array(np.full(len(own), size)), pa.array(own.view(np.int64))], names=["item", "at", "size", "name"])

    return scan


def _found(w: Words, sizes: list[int], have: BitFilter) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per shingle size, where shingles that the filter has begin, and their names."""
    out = []
    for size in sizes:
        names = shingle_names(w.names, size)
        at = np.flatnonzero(have.has(names))
        at = at[w.text[at] == w.text[at + size - 1]]
        out.append((size, at, names[at]))
    return out


def _segments(sizes: list[int], window: int, known):
    """Per document: its words counted, and the segments around shingles that the filter has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, row = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            segs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for numbers, texts in groups(views(batch.column(1))):
                w = Words(numbers, texts, ALNUM)
                change = np.zeros(len(w.names) + 1, np.int32)
                for size, at, _ in _found(w, sizes, have):
                    np.add.at(change, np.maximum(at - (window - size), 0), 1)
                    np.add.at(change, np.minimum(at + window, len(w.names)), -1)
                reach = np.cumsum(change[:-1]) > 0
                for i, lo, hi in w.runs():
                    counts[i] = hi - lo
                    if reach[lo:hi].any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], reach[lo:hi], [False]]).view(np.int8))).tolist()
                        segs[i] = [{"start": a, "words": w.string(lo + a, lo + b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column(0), pa.array(counts), pa.array(segs, kind)], names=["row", "doc_id", "n_words", "segments"])
            row += batch.num_rows

    return scan


def _segment_counts(sizes: list[int], known):
    """Shingles of segments that the filter has, counted per batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [np.empty(0, np.uint64)]
            for segs in batch.column(0).to_pylist():
                raw = [np.frombuffer(x["words"].encode(), np.uint8) for x in segs]
                names += [x for _, _, x in _found(Words(list(range(len(raw))), raw, ALNUM), sizes, known.value)]
            flat, n = np.unique(np.concatenate(names), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(n)], names=["name", "n"])

    return scan


def _places(sizes: list[int], window: int, known):
    """Places of shingles that the filter has: (name, row, at, left, right, around).

    at: the shingle's first word in the document; left and right: how many words are
    at hand before and behind it; around: those words and the shingle's.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = [np.frombuffer(x["words"].encode(), np.uint8) for x in segs]
                w = Words(list(range(len(raw))), raw, ALNUM)
                bounds = np.searchsorted(w.text, np.arange(len(raw) + 1))
                for size, at, names in _found(w, sizes, known.value):
                    for i, name in zip(at.tolist(), names.view(np.int64).tolist(), strict=True):
                        seg = int(w.text[i])
                        lo, hi = max(int(bounds[seg]), i - (window - size)), min(int(bounds[seg + 1]), i + window)
                        out.append((name, row, segs[seg]["start"] + i - int(bounds[seg]), i - lo, hi - i - size, w.string(lo, hi)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [*[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["name", "row", "at", "left", "right", "around"])

    return scan


_PREFIX = "name long, item_id string, size long, length long, place long, first long, last long, span string"


def _prefixes(window: int, shingle: int):
    """Prefixes of an item; windows with a shingle that the documents lack have none.

    place: the rarest shingle's; first and last: the windows that take it begin from
    there to there; span: their words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_id, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own, item = _names_of(words), words.split(" ")
                length, size = _sizes(len(own), window, shingle)
                tokens = shingle_names(own, size)
                n = np.zeros(len(tokens), np.int64)
                for x in counts:
                    n[x["at"]] = x["n"]
                each = np.lib.stride_tricks.sliding_window_view(np.arange(len(tokens)), length - size + 1)
                order = np.empty(len(tokens), np.int64)
                order[np.lexsort((tokens, n))] = np.arange(len(tokens))
                picked = each[np.arange(len(each)), order[each].argmin(axis=1)]
                begin = np.flatnonzero(n[each].min(axis=1) > 0)
                runs = np.split(begin, np.flatnonzero((np.diff(begin) > 1) | (np.diff(picked[begin]) != 0)) + 1) if len(begin) else []
                for run in runs:
                    first, last, place = int(run[0]), int(run[-1]), int(picked[run[0]])
                    out.append((int(tokens[place].view(np.int64)), item_id, size, length, place, first, last, " ".join(item[first : last + length])))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split(" ")[0] for x in _PREFIX.split(", ")])

    return scan


def aligned(around: list[str], at: int, left: int, right: int, span: list[str], size: int, length: int, place: int, first: int, last: int) -> list[int]:
    """Document positions at which a prefix's windows begin at this alignment.

    Only windows for which the words at hand reach are compared.
    """
    lo, hi = max(first, place - left), min(last, place + size + right - length)
    out = []
    for begin in range(lo, hi + 1):
        here = left - (place - begin)
        if around[here : here + length] == span[begin - first : begin - first + length]:
            out.append(at - (place - begin))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments to (row, item_id, begin, length) of the windows that occur."""
    for batch in batches:
        rows, ids, begins, lengths = [], [], [], []
        for row, at, left, right, around, item_id, size, length, place, first, last, span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for begin in aligned(around.split(" "), at, left, right, span.split(" "), size, length, place, first, last):
                rows.append(row)
                ids.append(item_id)
                begins.append(begin)
                lengths.append(length)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.string()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64())], names=["row", "item_id", "begin", "length"])


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5
) -> DataFrame:
    """Words of documents that lie in an occurrence of a window of a benchmark item.

    A-Z are lower-cased; words are runs of digits, a-z and everything beyond ASCII.
    A window is ``window`` consecutive item words; an item of fewer words, but not
    none, is one window.  Returns per document: doc_id, n_words, item_ids (distinct
    ids as strings, sorted, of items with an occurring window) and hit_words (sorted
    positions of the words hit).

    Defined cases: null and empty texts have no words; items without words match
    nothing; an item without id still hits words but is not listed; items with
    equal ids count once; rows with equal doc_ids are judged one by one; if either
    table is empty nothing is hit; other columns of the inputs are ignored.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    shingle = min(shingle, window)
    bench = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    bench = shared.write_and_read(bench.mapInArrow(_item_words, "item long, item_id string, words string"), "items")
    tokens = shared.write_and_read(bench.select("item", "words").mapInArrow(_item_shingles(window, shingle), "item long, at long, size long, name long"), "item-shingles")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect())  # 1 to shingle

    known = spark.sparkContext.broadcast(make_filter(tokens))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_text}`").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    seen = shared.write_and_read(rows.mapInArrow(_segments(sizes, window, known), f"row long, doc_id {id_type}, n_words long, segments array<struct<start: long, words: string>>"), "segments")
    segments = seen.where(F.size("segments") > 0).select("row", "segments")

    rarity = segments.select("segments").mapInArrow(_segment_counts(sizes, known), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counted = tokens.join(rarity, "name").groupBy("item").agg(F.collect_list(F.struct("at", "n")).alias("counts"))
    prefixes = shared.write_and_read(bench.join(counted, "item").select("item_id", "words", "counts").mapInArrow(_prefixes(window, shingle), _PREFIX), "prefixes")

    chosen = spark.sparkContext.broadcast(make_filter(prefixes))
    places = segments.mapInArrow(_places(sizes, window, chosen), "name long, row long, at long, left long, right long, around string")
    found = shared.write_and_read(alignments(places, prefixes).mapInArrow(_verify, "row long, item_id string, begin long, length long"), "windows")
    ids = found.where("item_id IS NOT NULL").select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    covered = F.transform(F.collect_list(F.struct("begin", "length")), lambda x: F.sequence(x["begin"], x["begin"] + x["length"] - 1))
    words = found.select("row", "begin", "length").distinct().groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(covered))).alias("hit_words"))
    empty = F.array()
    return seen.select("row", "doc_id", "n_words").join(words, "row", "left").join(ids, "row", "left").select(
        "doc_id", "n_words", F.coalesce("item_ids", empty.cast("array<string>")).alias("item_ids"), F.coalesce("hit_words", empty.cast("array<bigint>")).alias("hit_words")
    )


def alignments(places: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Places beside prefixes of the same shingle, where the words at hand reach as far as some window needs.

    Both are shuffled, so that a task doesn't need two Python workers at once.
    """
    low = F.greatest("first", F.col("place") - F.col("left"))
    high = F.least("last", F.col("place") + F.col("size") + F.col("right") - F.col("length"))
    return places.join(prefixes.hint("merge"), "name").where(low <= high).select("row", "at", "left", "right", "around", "item_id", "size", "length", "place", "first", "last", "span")
