"""SimHash near-duplicates with a bit-sliced comparison.

Candidates come from the pigeonhole principle: fingerprints that differ in at
most ``radius`` of ``blocks`` bit blocks agree on at least ``blocks - radius`` of
them, so each fingerprint goes to one bucket per choice of that many blocks and
no link is lost.  Within a bucket, fingerprints lie in lanes of 64: bit ``b`` of
all 64 is one word, a plane.  A query is compared with a whole lane block plane
by plane; the 64 distances are kept in carry-save counters (one word per binary
digit), and a lane block is abandoned once all its distances exceed the radius.

A bucket gives back a spanning forest, not its pairs.  Equal fingerprints are one
vertex from the start, so a group of copies of any size adds no work, and what is
near a bucket's pivot isn't compared with each other.  Buckets beyond ``TILE``
members are cut into tiles, and each pair of tiles is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components
from .words import mix

_U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Members of a bucket compared in one task before it is cut into tiles.
TILE = 8192
#: (query, lane block) rows compared at once; bounds memory.
ROWS = 32_768
#: Planes between two looks at which lane blocks to abandon.
STRIDE = 8


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of lower-cased UTF-8 bytes, repeats included; fewer words make one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(size, len(words))
    begins = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(begins, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begins))


def fingerprint(text: bytes, size: int, seed: int, wide: int = 1, distinct: bool = False) -> np.ndarray:
    """SimHash in ``wide`` 64-bit words, 0 without words; repeated shingles count once if ``distinct``."""
    hashes = shingle_hashes(text, size, seed)
    return majority(np.unique(hashes) if distinct else hashes, wide)


def majority(hashes: np.ndarray, wide: int = 1) -> np.ndarray:
    """Bits that are set in over half of the hashes; words after the first take rehashed ones."""
    if not len(hashes):
        return np.zeros(wide, np.uint64)
    counts = np.zeros(64 * wide, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        each = np.stack([part, *(mix(part * _U(2 * i + 1) + _U(i)) for i in range(1, wide))], axis=1)
        counts += np.unpackbits(each.astype(">u8").view(np.uint8).reshape(-1, 8 * wide), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _fingerprints(size: int, seed: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(_bytes(x), size, seed)[0] for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return scan


def lanes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of one-word fingerprints: [lane block, bit], lane i of a block is bit i of its words."""
    padded = np.zeros((len(prints) + 63) // 64 * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    turned = np.ascontiguousarray(bits.reshape(-1, 64, 64).transpose(0, 2, 1))
    return np.packbits(turned, axis=2, bitorder="little").reshape(-1, 64, 8).view(np.uint64)[:, :, 0]


def near_lanes(queries: np.ndarray, planes: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows (query words, lane block): the rows with a near lane, and a word with those lanes set.

    Distances are counted by carry-save addition in a few words; a lane whose
    counter reaches radius + 1 is marked as beyond, for good.
    """
    digits = (radius + 1).bit_length()
    live = np.arange(len(queries))
    counters = [np.zeros(len(queries), np.uint64) for _ in range(digits)]
    beyond = np.zeros(len(queries), np.uint64)
    full = ~_U(0)
    for bit in range(64 * queries.shape[1]):
        carry = planes[blocks[live], bit] ^ (_U(0) - ((queries[live, bit >> 6] >> _U(bit & 63)) & _U(1)))
        for d in range(digits):
            counters[d], carry = counters[d] ^ carry, counters[d] & carry
        beyond |= carry
        if bit >= radius:
            over = np.full(len(live), full)
            for d in range(digits):  # the counter equals radius + 1
                over &= counters[d] if (radius + 1) >> d & 1 else ~counters[d]
            beyond |= over
            if bit % STRIDE == STRIDE - 1:
                stay = beyond != full
                if not stay.all():
                    live, beyond, counters = live[stay], beyond[stay], [c[stay] for c in counters]
                    if not len(live):
                        break
    return live, ~beyond


def forest(prints: np.ndarray, members: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of many buckets at once, as pairs of rows (row, root of its class).

    prints: [row, word]; members: bucket number of each row, in order; left and
    right: whether a row is a query, and whether queries are compared with it.
    The first row to be compared with is a bucket's pivot: rows near it are one class
    at once, and only pairs with another row than those are looked at.
    """
    label = np.arange(len(prints))
    r = np.flatnonzero(right)
    if not len(r):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(members[r], members)
    pivot = r[np.minimum(at, len(r) - 1)]
    near = members[pivot] == members
    near[near] = np.bitwise_count(prints[near] ^ prints[pivot[near]]).sum(axis=1) <= radius
    _unite(label, np.flatnonzero(near), pivot[near])
    _compare(label, prints, members, left & ~near, right, radius)
    _compare(label, prints, members, left & near, right & ~near, radius)
    away = np.flatnonzero(label != np.arange(len(prints)))
    return away, label[away]


def _compare(label: np.ndarray, prints: np.ndarray, members: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> None:
    """Compare all queries with all other rows of their bucket, by bit planes, and merge the classes of near ones."""
    r = np.flatnonzero(right)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(members[r])) + 1, [len(r)]])
    lane_of, spans = [], {}
    for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if hi > lo:
            spans[int(members[r[lo]])] = (len(lane_of), -(-(hi - lo) // 64))
            for at in range(lo, hi, 64):
                own = np.full(64, -1)
                own[: min(64, hi - at)] = r[at : min(at + 64, hi)]
                lane_of.append(own)
    queries = np.flatnonzero(left)
    if not lane_of or not len(queries):
        return
    lane_of = np.stack(lane_of)
    first = np.array([spans.get(int(b), (0, 0))[0] for b in members[queries]], np.int64)
    count = np.array([spans.get(int(b), (0, 0))[1] for b in members[queries]], np.int64)
    done = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, int(done[-1]), ROWS):
        row = np.arange(lo, min(lo + ROWS, int(done[-1])))
        q = np.searchsorted(done, row, "right") - 1
        block = first[q] + row - done[q]
        used, block_row = np.unique(block, return_inverse=True)
        flat = lane_of[used].reshape(-1)
        planes = np.concatenate([lanes(np.where(flat >= 0, prints[flat, w], _U(0))) for w in range(prints.shape[1])], axis=1)
        live, near = near_lanes(prints[queries[q]], planes, block_row, radius)
        if len(live):
            hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            a, lane = np.nonzero(hit)
            b = lane_of[block[live[a]], lane]
            _unite(label, queries[q[live[a]]][b >= 0], b[b >= 0])


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge classes; labels always point to the smallest member."""
    keep = i != j
    i, j = i[keep], j[keep]
    while len(i):
        a, b = label[i], label[j]
        if not (a != b).any():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label[:] = nxt


def _buckets(radius: int, wide: int):
    """Links in sorted (key, pair, side, vertex, fingerprint words...) rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((4 + wide, 0), np.int64)
        for batch, last in _with_last(batches):
            t = rest if batch is None else np.concatenate([rest, np.stack([batch.column(i).to_numpy() for i in range(4 + wide)])], axis=1)
            if not t.shape[1]:
                continue
            group = np.concatenate([[0], np.cumsum((np.diff(t[0]) != 0) | (np.diff(t[1]) != 0))])
            cut = t.shape[1] if last else int(np.searchsorted(group, group[-1]))
            rest, t, group = t[:, cut:], t[:, :cut], group[:cut]
            alone = np.bincount(group, minlength=1)[group] < 2
            t, group = t[:, ~alone], group[~alone]
            if t.shape[1]:
                side = t[2]
                i, j = forest(np.ascontiguousarray(t[4:].T).view(np.uint64), group, (side & 1).astype(bool), (side & 2).astype(bool), radius)
                yield pa.RecordBatch.from_arrays([pa.array(t[3][i]), pa.array(t[3][j])], names=["u", "v"])

    return scan


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, bool]]:
    for batch in batches:
        yield batch, False
    yield None, True


def bucket_keys(fp: Column, blocks: int, match: int) -> Column:
    """One long per choice of ``match`` of the blocks: the choice and the bits of those blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    width = [hi - lo for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), match)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def dealt(rows: DataFrame, weight: Column, tile: int) -> DataFrame:
    """Rows (key, label, ...) with ``pair`` and ``side``: the pairs of tiles in which they are compared.

    Within a key only rows of different labels have to meet.  Rows of a key's
    heaviest label lie in tiles of their own, which don't meet each other; all other
    tiles meet each other and those.  A tile has a weight of about ``tile``; a key
    within that is one pair, and a key of one label is left out.  side: bit 1, the
    row is a query; bit 2, queries are compared with it.
    """
    by_label = rows.groupBy("key", "label").agg(F.sum(weight).alias("w"))
    keys = by_label.groupBy("key").agg(F.sum("w").alias("all"), F.max("w").alias("top"), F.max_by("label", F.struct("w", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    tiles = lambda w: F.when(F.col("all") <= tile, 0).otherwise(F.ceil(w / tile)).cast("long")
    plan = keys.where("labels > 1").select("key", "main", tiles(F.col("top")).alias("tp"), F.greatest(tiles(F.col("all") - F.col("top")), F.lit(1)).alias("tr"))
    plan = shared.write_and_read(plan, "tiles")  # a plain table, so that a hot key's join can be split
    main = (F.col("label") == F.col("main")) & (F.col("tp") > 0)
    hash_of = F.xxhash64("vertex")
    own = F.pmod(hash_of, F.col("tr"))
    entry = lambda pair, side: F.struct(pair.cast("long").alias("pair"), F.lit(side).cast("long").alias("side") if isinstance(side, int) else side.cast("long").alias("side"))
    base = F.col("tr") * F.col("tr")
    met_by_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tr") - 1), lambda j: entry(base + F.pmod(hash_of, F.greatest(F.col("tp"), F.lit(1))) * F.col("tr") + j, 2))
    rest = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tr") - 1),
        lambda j: entry(F.least(j, own) * F.col("tr") + F.greatest(j, own), F.when(j == own, 3).when(own < j, 1).otherwise(2)),
    )
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("tp"), F.lit(1)) - 1), lambda i: entry(base + i * F.col("tr") + own, 1))
    pairs = F.when(main, met_by_rest).otherwise(F.when(F.col("tp") > 0, F.concat(rest, to_main)).otherwise(rest))
    return rows.join(plan, "key").select(*(f"`{c}`" for c in rows.columns), F.explode(pairs).alias("x")).select(*(f"`{c}`" for c in rows.columns), "x.pair", "x.side")


def distance(a: list[str], b: list[str]) -> Column:
    """Differing bits of two fingerprints, given the columns of their words."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))


def bucket_links(keyed: DataFrame, radius: int, words: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) of rows (key, vertex, words...): a spanning forest of each bucket's links.

    A bucket beyond TILE members isn't compared pair by pair: its rows are first
    linked to one of them, and then only rows that are in different components meet,
    in tiles.  sizes: (key, count), if known.
    """
    large = (keyed.groupBy("key").count() if sizes is None else sizes).where(F.col("count") > TILE).select("key")
    large = shared.write_and_read(large, "large")
    plain = keyed.select("key", F.lit(0).cast("long").alias("pair"), F.lit(3).cast("long").alias("side"), "vertex", *words)
    first = None
    if not large.isEmpty():
        hot = shared.write_and_read(keyed.join(large, "key"), "hot")
        pivots = hot.groupBy("key").agg(F.min_by(F.struct(F.col("vertex").alias("other"), *(F.col(w).alias(f"p_{w}") for w in words)), F.xxhash64("vertex")).alias("p")).select("key", "p.*")
        pivots = shared.write_and_read(pivots, "pivots")
        near = distance(words, [f"p_{w}" for w in words]) <= radius
        first = shared.write_and_read(hot.join(pivots, "key").where(near & (F.col("vertex") != F.col("other"))).select(F.col("vertex").alias("u"), F.col("other").alias("v")), "hot-links")
        labels = shared.write_and_read(components(first), "hot-labels")
        labelled = hot.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
        plain = plain.join(large, "key", "left_anti").unionByName(dealt(labelled, F.lit(1), TILE).select(plain.columns))
    rows = plain.repartition("key", "pair").sortWithinPartitions("key", "pair")
    links = rows.mapInArrow(_buckets(radius, len(words)), "u long, v long")
    return links if first is None else links.unionByName(first)


def near_links(prints: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose classes are those of all pairs within the radius."""
    match = blocks - radius
    if match < 1:
        raise ValueError("more blocks than differing bits are needed")
    keyed = prints.select(F.explode(bucket_keys(F.col("fp"), blocks, match)).alias("key"), F.col("fp").alias("vertex"), F.col("fp").alias("w0"))
    return bucket_links(keyed, radius, ["w0"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) per row; null and wordless texts have fingerprint zero."""
    shared.prepare(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int = 6, seed: int = 42) -> DataFrame:
    """Fingerprint and component of every row.

    Returns doc_id, fingerprint (16 lowercase hex digits), component_id: the
    smallest id among all rows that links of at most ``radius`` differing bits reach.

    Defined cases: null, empty and wordless texts have fingerprint zero and are
    linked like any other; fewer words than ``shingle`` make one shingle; equal
    texts and repeated rows share a fingerprint and so a component; rows without
    id keep a null id, and a component of only such rows has a null component_id;
    an empty table gives no rows; other columns of the input are ignored.
    """
    docs = shared.write_and_read(fingerprints(df, id_col, text_col, shingle, seed), "prints")
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = shared.write_and_read(components(near_links(least.select("fp"), radius, blocks)), "labels")
    known = least.join(labels.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = known.groupBy("label").agg(F.min("least").alias("component_id"))
    owner = known.join(roots, "label").select("fp", "component_id")
    return docs.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest id; all columns are returned.

    Two rows are linked if the sets of their word shingles have at least this Jaccard
    similarity, and a group is what links reach.  Wide fingerprints propose links, and
    each is checked exactly (``near_groups``).

    Each row is judged by its own text under a number written with the input, so
    ids may be null or repeated.  Null ids come before all others, and of equal ids
    in a group the smallest hash of the text stays.  Null, empty and wordless texts
    are alike.
    """
    from .near_groups import groups

    shared.prepare(df.sparkSession)
    numbered, own = shared.number_rows(df)
    text = F.col(f"`{text_col}`").cast("string")
    labels = shared.write_and_read(groups(numbered.select(F.col(own).alias("own"), text.alias("text")), shingle, similarity, seed), "groups")
    several = shared.write_and_read(labels.groupBy("label").count().where("count > 1").select("label"), "several")  # a plain table, so that a hot group's join can be split
    ids = numbered.select(F.col(own).alias("own"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    members = shared.write_and_read(labels.join(several, "label").join(ids, "own").select("label", "id", "tie", "own"), "members")
    first = members.groupBy("label").agg(F.min(F.struct("id", "tie", "own")).alias("first")).select(F.col("first.own").alias("own"))
    going = members.select("own").join(first, "own", "left_anti").withColumnRenamed("own", own)
    return shared.without(numbered, own, going).select(*(f"`{c}`" for c in df.columns))
