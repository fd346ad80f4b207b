"""Suffix deduplication over a whole corpus, blockwise with a difference cover.

Suffixes are only compared by their first ``width`` bytes, so two of them are "tied"
exactly if they start the same string of that length.  The construction follows
blockwise suffix sorting with a difference cover, with names in place of bytes:

1. *Cover sample.*  Positions ``p`` of a text with ``p mod PERIOD`` in ``COVER`` are
   sampled.  For any two suffixes there is one shift below the period that takes both
   to sampled positions.  Each sampled block of ``width - PERIOD + 1`` bytes gets a rank:
   a hash of its content and the fact whether another sample has the same.  Blocks that
   share a hash by chance only cost work.
2. *Ties.*  Two equal suffixes have a common cover sample inside their first ``width``
   bytes.  A suffix all of whose samples have ranks of their own can't tie with another
   one; it never leaves its executor.
3. *Blocks.*  The remaining suffixes are dealt into buckets by name, and one bucket at a
   time is sorted (name, then document order); all but the first of a run start
   earlier elsewhere.

Bytes aren't sorted: sent with each cover sample they would be 156 bytes for every
seventh tied position, and a block that a third of all rows hold, between different
neighbours, would be one task's work.  A name is two polynomials of the string modulo
2**61 - 1, at places drawn anew for every run, the second folded to 32 bits.  Whatever
the texts are, two different strings share a name with a probability below 2**-84.

Only hashes move through shuffles; bits come back to the scans as side files.  Exact
copies of a text are settled first by their SHA-256, so a group of copies of any size
costs one row per copy.  Within a chunk of text every name is sent once, so a string
that a third of all rows share adds one name per chunk.
"""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A perfect difference set, every residue mod 57 is a difference of two members.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of text hashed at a time; bounds the memory of a task, long documents are cut (with overlap).
CHUNK_BYTES = 1_000_000
CHUNK_DOCS = 60_000
#: Names sorted at a time in a reduce task, and buckets that a task sorts one after another.
BUCKET_NAMES = 750_000
BUCKETS_IN_TASK = 4

_U = np.uint64
DEALT_ANEW = "the input was dealt out anew between two scans; write it before this operator"
_SEED = 11
_PRIME = (1 << 61) - 1


@lru_cache(maxsize=4)
def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random letters, and the powers of an odd base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(seed)
    letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 2**61, dtype=np.uint64)) * 8 + 5
    out = []
    for x in (base, pow(base, -1, 2**64)):
        powers = np.full(size, x, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return letters, *out


class Names:
    """64-bit names of substrings of one byte array, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, seed: int = _SEED):
        size = 1 << max(20, int(len(data)).bit_length())
        letters, powers, self.inverse = _tables(seed, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        out = self.sums[starts + length] - self.sums[starts]
        out *= self.inverse[starts]
        out ^= out >> _U(31)
        out *= _U(0x94D049BB133111EB)
        out ^= out >> _U(29)
        return out


def times(a: np.ndarray, b: int) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    high, low, bh, bl = a >> _U(31), a & _U(0x7FFFFFFF), _U(b >> 31), _U(b & 0x7FFFFFFF)
    middle = high * bl + low * bh
    out = high * (bh + bh) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + low * bl
    return _reduced(out)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def polynomials(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """Of each string of ``width`` bytes: the polynomial with its bytes (plus 1) as coefficients, modulo 2**61 - 1.

    Strings of powers of two are put together from halves, and the width from those.
    """
    part, size, out, done = data.astype(np.uint64) + _U(1), 1, None, 0
    while True:
        if width & size:
            rest = part[done:] if out is not None else part
            n = len(data) - done - size + 1
            out = rest[:n].copy() if out is None else _reduced(times(out[:n], pow(base, size, _PRIME)) + rest[:n])
            done += size
        if 2 * size > width:
            return out
        part = _reduced(times(part[:-size], pow(base, size, _PRIME)) + part[size:])
        size *= 2


@dataclass(frozen=True)
class Secret:
    """What names are made with; drawn for a run."""

    bases: tuple[int, int]
    odd: int

    @classmethod
    def drawn(cls) -> Secret:
        return cls((1 + secrets.randbelow(_PRIME - 1), 1 + secrets.randbelow(_PRIME - 1)), secrets.randbits(63) * 2 + 1)

    def names(self, data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of the strings that start there, in 61 (leading) and 32 bits; only bytes that these cover are looked at."""
        if not len(starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        change = np.zeros(len(data) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + width, -1)
        covered = np.cumsum(change[:-1]) > 0
        at = (np.cumsum(covered) - 1)[starts]
        few = data[covered]
        first, second = (polynomials(few, width, base)[at] for base in self.bases)
        return first << _U(3), ((second * _U(self.odd)) >> _U(32)).astype(np.uint32)


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted numbers, all first bytes first: these compress well."""
    size = values.dtype.itemsize
    return np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, size)[:, size - width :].T).tobytes()


def unplanes(raw: bytes, width: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], size), np.uint8)
    out[:, size - width :] = rows.T
    return out.view(np.dtype(kind).newbyteorder(">")).reshape(-1).astype(kind)


@dataclass
class Chunk:
    """Pieces of texts, laid end to end in document order."""

    number: int
    data: np.ndarray
    bounds: np.ndarray  # offsets of the pieces in data
    rows: np.ndarray  # row of the partition that a piece belongs to
    ids: np.ndarray  # document order key of that row
    starts: np.ndarray  # where the piece starts in its text


def chunks(batch: pa.RecordBatch, first_row: int, number: int, skip: Skipped, width: int) -> Iterator[Chunk]:
    """Cut one Arrow batch of (id, text) rows into chunks; skip: rows to leave out.

    Both numbers count through a partition, so two scans of it agree on them.
    """
    held: list[tuple[int, int, int, np.ndarray]] = []
    held_bytes = 0

    def flush() -> Chunk:
        nonlocal held, held_bytes, number
        held.sort(key=lambda x: (x[1], x[0], x[2]))
        out = Chunk(
            number,
            np.concatenate([x[3] for x in held]),
            np.concatenate([[0], np.cumsum([len(x[3]) for x in held])]).astype(np.int64),
            np.array([x[0] for x in held], np.int64),
            np.array([x[1] for x in held], np.int64),
            np.array([x[2] for x in held], np.int64),
        )
        held, held_bytes, number = [], 0, number + 1
        return out

    ids = order_keys(batch.column(0))
    for i, view in enumerate(views(batch.column(1))):
        if first_row + i in skip:
            skip.check(first_row + i, view)
            continue
        if len(view) < width:
            continue
        for at in range(0, len(view) - width + 1, CHUNK_BYTES):
            piece = view[at : at + CHUNK_BYTES + width - 1]
            if held and (held_bytes + len(piece) > CHUNK_BYTES or len(held) >= CHUNK_DOCS):
                yield flush()
            held.append((first_row + i, int(ids[i]), at, piece))
            held_bytes += len(piece)
    if held:
        yield flush()


def order_keys(ids: pa.Array) -> np.ndarray:
    """Document order: by id, those without one first."""
    return ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def views(texts: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text; null counts as empty."""
    empty = np.empty(0, np.uint8)
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid and x.as_buffer().size else empty for x in texts]


def cover_sample(c: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover sample in a chunk, and the names of their blocks."""
    block = width - PERIOD + 1
    sizes = np.diff(c.bounds)
    spread = np.zeros(PERIOD, bool)
    spread[list(COVER)] = True
    at = np.arange(len(c.data))
    where = np.flatnonzero(spread[(at - np.repeat(c.bounds[:-1] - c.starts, sizes)) % PERIOD])
    where = where[where + block <= c.bounds[1:][np.searchsorted(c.bounds, where, "right") - 1]]
    return where, Names(c.data).at(where, block)


def tied_windows(c: Chunk, where: np.ndarray, shared_rank: np.ndarray, width: int) -> np.ndarray:
    """Which windows hold a cover sample with a rank that others share."""
    common = where[shared_rank]
    change = np.zeros(len(c.data) + 2, np.int32)
    np.add.at(change, np.maximum(common - (PERIOD - 1), 0), 1)
    np.add.at(change, common + 1, -1)
    tied = np.cumsum(change[: len(c.data)]) > 0
    tied &= np.arange(len(c.data)) + width <= np.repeat(c.bounds[1:], np.diff(c.bounds))
    return tied


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    return (((names >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def sample_keys(names: np.ndarray, n: int) -> np.ndarray:
    """Bucket and 40 more bits of a sample's name."""
    return (_bucket(names, n) << 40) | (names & _U(2**40 - 1)).astype(np.int64)


def distinct_windows(c: Chunk, starts: np.ndarray, width: int, secret: Secret):
    """A chunk's distinct windows: their names in order, the first start of each, and which starts are later ones."""
    first, second = secret.names(c.data, starts, width)
    order = np.argsort(first)
    f, s = first[order], second[order]
    if np.any((f[1:] == f[:-1]) & (s[1:] != s[:-1])):
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    begin = np.flatnonzero(new)
    head = np.minimum.reduceat(order, begin) if len(begin) else np.empty(0, np.int64)
    later = np.ones(len(starts), bool)
    later[head] = False
    return f[begin], s[begin], head, later


def _spans(buckets: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = (np.flatnonzero(np.diff(buckets)) + 1).tolist()
    return ((lo, hi) for lo, hi in zip([0, *edges], [*edges, len(buckets)], strict=True) if hi > lo)


Bits = dict[int, tuple[np.ndarray, int]]


def _side_bits(side: pa.Table | None) -> dict[int, Bits]:
    out: dict[int, Bits] = {}
    if side is not None:
        for chunk, bucket, bits, mark in zip(*(side.column(x).to_pylist() for x in ("chunk", "bucket", "bits", "mark")), strict=True):
            out.setdefault(chunk, {})[bucket] = np.frombuffer(bits, np.uint8), mark
    return out


def _mark_of(names: np.ndarray) -> int:
    """A checksum of names, by which a scan knows that bits are for the names that it has."""
    return int(np.add.reduce(names, dtype=np.uint64) & _U(2**62 - 1))


def _returned(buckets: np.ndarray, bits: Bits, names: np.ndarray | None = None) -> np.ndarray:
    """Bits of a chunk's names, which are sorted by bucket."""
    out = np.zeros(len(buckets), bool)
    for lo, hi in _spans(buckets):
        back, mark = bits.get(int(buckets[lo]), (None, 0))
        if back is None or len(back) != (hi - lo + 7) // 8 or names is not None and mark != _mark_of(names[lo:hi]):
            raise RuntimeError(DEALT_ANEW)
        out[lo:hi] = np.unpackbits(back, count=hi - lo).astype(bool)
    return out


class Skipped(dict):
    """The rows of a partition that are copies of earlier ones, with their checksums."""

    def __init__(self, skip_dir: str, pid: int):
        side = shared.read_side(skip_dir, pid)
        super().__init__(zip(side.column("row").to_pylist(), side.column("crc").to_pylist(), strict=True) if side is not None else ())

    def check(self, row: int, text: np.ndarray) -> None:
        if zlib.crc32(text) != self[row]:
            raise RuntimeError(DEALT_ANEW)


def _sample_rows(skip_dir: str, width: int, n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        skip, row, number = Skipped(skip_dir, pid), 0, 0
        for batch in batches:
            for c in chunks(batch, row, number, skip, width):
                number = c.number + 1
                keys = np.unique(sample_keys(cover_sample(c, width)[1], n))
                yield from _rows(pid, c.number, keys >> 40, lambda lo, hi, keys=keys: (planes(keys[lo:hi].view(np.uint64), 5),))
            row += batch.num_rows

    return scan


def _rows(pid: int, chunk: int, buckets: np.ndarray, blobs) -> Iterator[pa.RecordBatch]:
    rows = [(int(buckets[lo]), pid, chunk, *blobs(lo, hi)) for lo, hi in _spans(buckets)]
    if rows:
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * (len(rows[0]) - 3)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "pid", "chunk", *(f"b{i}" for i in range(len(kinds) - 3))])


def _back(t: pa.Table, bits: list[bytes], counts: list[int], marks: list[int]) -> pa.Table:
    return pa.table({"pid": t.column("pid"), "chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary()), "n": pa.array(counts, pa.int64()), "mark": pa.array(marks, pa.int64())})


def _shared_names(t: pa.Table) -> pa.Table:
    """Which names of a bucket more than one chunk has sent."""
    parts = [unplanes(x, 5, np.uint64) for x in t.column("b0").to_pylist()]
    names = np.concatenate(parts)
    names.sort()
    twice = np.unique(names[1:][names[1:] == names[:-1]])
    bits, counts = [], []
    for x in parts:  # sorted, like twice
        at = np.searchsorted(x, twice)
        at[at == len(x)] = 0
        flag = np.zeros(len(x), bool)
        flag[at[x[at] == twice]] = True
        bits.append(np.packbits(flag).tobytes())
        counts.append(int(flag.sum()))
    return _back(t, bits, counts, [_mark_of(x) for x in parts])


def _window_rows(skip_dir: str, rank_dir: str, width: int, n: int, m: int, secret: Secret):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        skip, row, number = Skipped(skip_dir, pid), 0, 0
        ranks = _side_bits(shared.read_side(rank_dir, pid))
        for batch in batches:
            for c in chunks(batch, row, number, skip, width):
                number = c.number + 1
                where, names = cover_sample(c, width)
                keys, inner, counts = np.unique(sample_keys(names, n), return_inverse=True, return_counts=True)
                tied = tied_windows(c, where, (_returned(keys >> 40, ranks.get(c.number, {}), (keys & (2**40 - 1)).view(np.uint64)) | (counts > 1))[inner], width)
                starts = np.flatnonzero(tied)
                first, second, head, _ = distinct_windows(c, starts, width, secret)
                piece = np.searchsorted(c.bounds, starts[head], "right") - 1

                def blobs(lo: int, hi: int, c=c, piece=piece, first=first, second=second) -> tuple[bytes, ...]:
                    used, inner = np.unique(piece[lo:hi], return_inverse=True)
                    place = np.stack([c.ids[used], c.rows[used], c.starts[used]]).astype(np.int64)
                    return planes(first[lo:hi], 8), second[lo:hi].tobytes(), inner.astype(np.uint16).tobytes(), place.tobytes()

                # the mask goes with the names, in a bucket of its own, so that the last scan need not find it again
                own = -1 - ((pid << 32) | c.number)
                yield from _rows(pid, c.number, np.array([own]), lambda lo, hi, tied=tied: (np.packbits(tied).tobytes(), b"", b"", b""))
                yield from _rows(pid, c.number, _bucket(first, m), blobs)
            row += batch.num_rows

    return scan


def _sort_bucket(t: pa.Table) -> pa.Table:
    """Sort one suffix bucket; tell each chunk which of its windows start earlier elsewhere."""
    if t.column("bucket")[0].as_py() < 0:
        return _back(t, t.column("b0").to_pylist(), [0] * t.num_rows, [0] * t.num_rows)
    firsts = [unplanes(x, 8, np.uint64) for x in t.column("b0").to_pylist()]
    seconds = [np.frombuffer(x, np.uint32) for x in t.column("b1").to_pylist()]
    inner = [np.frombuffer(x, np.uint16) for x in t.column("b2").to_pylist()]
    tables = [np.frombuffer(x, np.int64).reshape(3, -1) for x in t.column("b3").to_pylist()]
    sizes = [x.shape[1] for x in tables]
    pid = np.repeat(t.column("pid").to_numpy(), sizes)
    ids, rows, starts = np.concatenate(tables, axis=1)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((starts, rows, pid, ids))] = np.arange(len(ids))
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.concatenate([rank[b + x.astype(np.int64)] for b, x in zip(base.tolist(), inner, strict=True)])
    f, s = np.concatenate(firsts), np.concatenate(seconds)
    order = np.lexsort((place, s, f))
    fo, so = f[order], s[order]
    later = np.zeros(len(order), bool)
    later[order[1:]] = (fo[1:] == fo[:-1]) & (so[1:] == so[:-1])
    parts = np.split(later, np.cumsum([len(x) for x in firsts])[:-1])
    return _back(t, [np.packbits(x).tobytes() for x in parts], [int(x.sum()) for x in parts], [_mark_of(x) for x in firsts])


def _cut(skip_dir: str, later_dir: str, width: int, m: int, keep: bool, secret: Secret):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        skip, row, number = Skipped(skip_dir, pid), 0, 0
        back = _side_bits(shared.read_side(later_dir, pid))
        for batch in batches:
            texts, masks = views(batch.column(1)), {}
            for c in chunks(batch, row, number, skip, width):
                number = c.number + 1
                bits = back.get(c.number, {})
                tied = _returned(np.full(len(c.data), -1 - ((pid << 32) | c.number)), bits)
                starts = np.flatnonzero(tied)
                first, _, head, later = distinct_windows(c, starts, width, secret)
                later[head] = _returned(_bucket(first, m), bits, first)
                _mark(c, starts[later], width, texts, masks, row)
            yield _results(batch, texts, masks, skip, row, width, keep)
            row += batch.num_rows

    return scan


def _mark(c: Chunk, starts: np.ndarray, width: int, texts: list[np.ndarray], masks: dict[int, np.ndarray], row: int) -> None:
    """Mark the bytes that windows with these starts cover."""
    if not len(starts):
        return
    change = np.zeros(len(c.data) + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    for p in np.unique(np.searchsorted(c.bounds, starts, "right") - 1).tolist():
        i = int(c.rows[p]) - row
        part = covered[c.bounds[p] : c.bounds[p + 1]]
        mask = masks.setdefault(i, np.zeros(len(texts[i]), bool))
        at = int(c.starts[p])
        mask[at : at + len(part)] |= part


def _results(batch: pa.RecordBatch, texts: list[np.ndarray], masks: dict[int, np.ndarray], skip: Skipped, row: int, width: int, keep: bool) -> pa.RecordBatch:
    sizes, removed, spans, digests, kept = [], [], [], [], []
    for i, text in enumerate(texts):
        mask, left = masks.get(i), text
        if row + i in skip and len(text) >= width:
            mask = np.ones(len(text), bool)
        gone = runs = 0
        if mask is not None:
            gone = int(mask.sum())
            runs = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            left = text[~mask]
        sizes.append(len(text))
        removed.append(gone)
        spans.append(runs)
        raw = left.tobytes()
        digests.append(hashlib.sha256(raw).hexdigest())
        kept.append(raw if keep else None)
    columns = {"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    if keep:
        columns["kept"] = pa.array(kept, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket over a number of tasks that grows with the buckets, so that what a task reads doesn't."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-buckets // BUCKETS_IN_TASK)), "bucket")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts earlier.

    Earlier means in a row with a smaller id, or in the same row at an earlier
    start; overlapping starts count, and all strings are judged on the input.

    Returns per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``keep_bytes``, the remaining bytes as ``kept`` (binary:
    a cut may fall inside a character).

    Defined cases: a null text counts as empty; a text shorter than ``width`` is
    kept whole; rows without id come first; rows with equal ids stand in the order
    of the input's partitions; an empty table gives no rows; other columns of the
    input are ignored.  The input has to give the same rows in the same partitions
    each time it is read, as files do; a difference that would spoil the result
    raises an error.
    """
    if width < PERIOD + 7:
        raise ValueError(f"width has to be {PERIOD + 7} or more")
    spark = df.sparkSession
    shared.prepare(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    text = F.coalesce("text", F.lit(""))
    keys = shared.write_and_read(
        rows.select(
            F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
            F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.octet_length(text).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "suffix-keys",
    )
    place = F.struct("id", "pid", "row")
    groups = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).where("copies > 1").drop("copies")
    groups = shared.write_and_read(groups, "suffix-groups")  # a plain table, so that a hot digest's join can be split
    skip_dir = shared.work_dir(spark, "suffix-copies")
    shared.write_side(keys.join(groups, "digest").where(place != F.col("first")).select("pid", "row", "crc"), skip_dir)

    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = 1 + int(total * len(COVER) / PERIOD / BUCKET_NAMES)
    sent = "bucket long, pid long, chunk long, b0 binary"
    back = "pid long, chunk long, bucket long, bits binary, n long, mark long"
    rank_dir = shared.work_dir(spark, "suffix-ranks")
    names = rows.mapInArrow(_sample_rows(skip_dir, width, n), sent)
    shared.write_side(_dealt(names, n).groupBy("bucket").applyInArrow(_shared_names, back), rank_dir)

    common = spark.read.schema(back).parquet(rank_dir).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if total >= width else 0
    m = 1 + int(common * PERIOD / len(COVER) / BUCKET_NAMES)
    later_dir, secret = shared.work_dir(spark, "suffix-later"), Secret.drawn()
    windows = rows.mapInArrow(_window_rows(skip_dir, rank_dir, width, n, m, secret), sent + ", b1 binary, b2 binary, b3 binary")
    shared.write_side(_dealt(windows, m).groupBy("bucket").applyInArrow(_sort_bucket, back), later_dir)

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return rows.mapInArrow(_cut(skip_dir, later_dir, width, m, keep_bytes, secret), out)
