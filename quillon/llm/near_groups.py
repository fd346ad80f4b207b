"""Groups of rows whose shingle sets have a Jaccard similarity of at least a bound.

Rows of equal sets are one vertex.  Two sets that are similar enough share one of
the first ``prefix_length`` elements of each in any common order of all elements
(the prefix filter); the order here puts elements that are frequent in all rows
last, so that few sets meet.  Those that share such an element are a bucket, in
which wide SimHash fingerprints are compared bit-sliced (``simhash.bucket_links``):
what is within ``RADIUS`` is a candidate link, and its components are candidate
groups.  A similar pair differs by more with a probability below 1e-4.

Within a candidate group links are exact: whole sets are compared, but not all pairs
of a large group.  First all members are compared with the one that is nearest to
the group's majority fingerprint (an original among its edited copies), a few times;
after that only members of different components meet, in tiles, and a pair of tiles
gives back a spanning forest.  So no link between components is left out, and what
is sent doesn't grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting, shared, simhash
from .components import components
from .decontaminate import make_filter
from .simhash import majority, shingle_hashes

_U = np.uint64
#: Counters of elements' hashes, for the order.
COUNTERS = 1 << 21
#: Words of a fingerprint, and differing bits of a candidate link: similar sets of four and five elements differ in 48 of 256 on average, larger ones in 39 or fewer.
WIDE, RADIUS = 4, 72
WORDS = [f"w{i}" for i in range(WIDE)]
#: Elements (hashes of eight bytes) in a tile, elements of a group from which its members are first compared with the nearest to its majority, and how often.
TILE_ELEMENTS, TURNS = 500_000, 2


def _sets(column: pa.Array, size: int, seed: int) -> Iterator[np.ndarray]:
    for x in column:
        yield np.unique(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", size, seed))


def prefix_length(n: int, similarity: float) -> int:
    """Elements of a set of n of which a similar set must have one among its own."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def _slots(s: np.ndarray) -> np.ndarray:
    return (s & _U(COUNTERS - 1)).astype(np.int64)


_DIGESTS = "own long, d0 long, d1 long, n int, " + ", ".join(f"{w} long" for w in WORDS)


def _digests(size: int, seed: int):
    """(own, text) to (own, d0, d1, n, words...): 128 bits of the set, its size and fingerprint.

    A task's last rows have no own: they are (at, counts), how often its rows have the elements' hashes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        names = [x.split(" ")[0] for x in _DIGESTS.split(", ")] + ["at", "counts"]
        for batch in batches:
            digests, sizes, prints = [], [], [np.empty((0, WIDE), np.uint64)]
            for s in _sets(batch.column(1), size, seed):
                np.add.at(counts, _slots(s), 1)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                prints.append(majority(s, WIDE)[None])
            pair, wide = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.concatenate(prints).view(np.int64)
            columns = [pair[:, 0], pair[:, 1], np.array(sizes, np.int32), *wide.T]
            rest = [pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x)) for x in columns), *rest], names=names)
        used, packed = fitting.slices(counts)
        none = [pa.nulls(len(used), pa.int32() if n == "n" else pa.int64()) for n in names[:-2]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int64()), pa.array(packed, pa.binary())], names=names)

    return scan


def _prefixes(known, copies: str, similarity: float, size: int, seed: int):
    """(own, text) to (element, vertex): the prefix of each set, of rows that aren't marked as copies."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.Marked(copies)
        for batch in batches:
            batch = batch.filter(pa.array(~marked.has(batch.column(0).to_numpy())))
            chosen, lengths = [np.empty(0, np.uint64)], []
            for s in _sets(batch.column(1), size, seed):
                k = prefix_length(len(s), similarity) if len(s) else 0
                chosen.append(s[np.argsort(known.value[_slots(s)], kind="stable")[:k]])
                lengths.append(k)
            vertices = np.repeat(batch.column(0).to_numpy(), np.array(lengths, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(vertices)], names=["element", "vertex"])

    return scan


def _known_sets(wanted: str, size: int, seed: int):
    """(own, text) to (vertex, set) of the rows that are marked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.Marked(wanted)
        for batch in batches:
            few = batch.filter(pa.array(marked.has(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([few.column(0), pa.array([s.tobytes() for s in _sets(few.column(1), size, seed)], pa.binary())], names=["vertex", "set"])

    return scan


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words...) to (key, members, ones): members and set bits by place, of each key in a batch."""
    for batch in batches:
        key, inner = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        wide = np.stack([batch.column(1 + i).to_numpy() for i in range(WIDE)], axis=1).view(np.uint64)
        ones = np.zeros((len(key), 64 * WIDE), np.int64)
        np.add.at(ones, inner, np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(-1, 8 * WIDE), axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(inner, minlength=len(key))), pa.array([x.tobytes() for x in ones], pa.binary())], names=["key", "members", "ones"])


def _majority(t: pa.Table) -> pa.Table:
    """The majority fingerprint of a key, from sums of ``_bits``."""
    ones = np.sum([np.frombuffer(x, np.int64) for x in t.column("ones").to_pylist()], axis=0)
    wide = np.packbits(2 * ones > sum(t.column("members").to_pylist())).view(">u8").astype(np.uint64).view(np.int64)
    return pa.table({"key": t.column("key")[:1], **{f"m{i}": pa.array([wide[i]], pa.int64()) for i in range(WIDE)}})


def nearest_to_majority(rows: DataFrame) -> DataFrame:
    """(key, pivot): of rows (key, vertex, words...) the vertex nearest to each key's majority; sums are made before a shuffle."""
    kind = "key long, members long, ones binary"
    centres = rows.select("key", *WORDS).mapInArrow(_bits, kind).groupBy("key").applyInArrow(_majority, "key long, " + ", ".join(f"m{i} long" for i in range(WIDE)))
    centres = shared.write_and_read(centres, "centres")  # a plain table, so that a hot key's join can be split
    off = simhash.distance(WORDS, [f"m{i}" for i in range(WIDE)])
    return rows.join(centres, "key").groupBy("key").agg(F.min_by("vertex", F.struct(off, F.col("vertex"))).alias("pivot"))


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def _alike(similarity: float):
    """(u, v, set, set) to (u, v) of the pairs that are similar."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [jaccard(_array(a), _array(b)) >= similarity for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(like, pa.bool_()))

    return scan


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def links(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that join classes: of similar sets of queries (left) and others (right), enough to connect all.

    labels: classes that are known already; pairs within a class aren't looked at.
    """
    label = np.unique(labels, return_inverse=True)[1]
    others = [j for j in np.flatnonzero(right).tolist() if len(sets[j])]
    if not others:
        return []
    sizes = np.array([len(sets[j]) for j in others])
    elements, flat = np.unique(np.concatenate([sets[j] for j in others]), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    other = np.array(others)
    out = []
    for i in np.flatnonzero(left).tolist():
        s = sets[i]
        if not len(s) or (label[other] == label[i]).all():
            continue
        at = np.minimum(np.searchsorted(elements, s), len(elements) - 1)
        there = np.zeros(len(elements), np.int32)
        there[at[elements[at] == s]] = 1
        both = np.add.reduceat(there[flat], begin)
        for j in other[both >= similarity * (sizes + len(s) - both) - 1e-9].tolist():
            if label[i] != label[j] and jaccard(s, sets[j]) >= similarity:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _tile_links(similarity: float):
    """Links in sorted (key, pair, side, vertex, label, set) rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(t: pa.Table) -> pa.RecordBatch:
            key, pair, side, vertex, label = (t.column(i).to_numpy() for i in range(5))
            sets = [_array(x) for x in t.column(5)]
            edges = (np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1).tolist()
            u, v = [], []
            for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
                for i, j in links(sets[lo:hi], label[lo:hi], (side[lo:hi] & 1) > 0, (side[lo:hi] & 2) > 0, similarity):
                    u.append(vertex[lo + i])
                    v.append(vertex[lo + j])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            key, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(pair) != 0)]))[-1]) if batch.num_rows else 0
            if held and batch.num_rows and (key[0], pair[0]) != (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()):
                yield found(pa.Table.from_batches(held))
                held = []
            if last:  # the batch's last pair may go on in the next
                yield found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            if batch.num_rows:
                held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    return scan


def _met_again(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column(0).to_numpy().view(np.uint64))))

    return scan


def candidate_groups(rows: DataFrame, vertices: DataFrame, frequencies: np.ndarray, copies: str, shingle: int, similarity: float, seed: int) -> DataFrame:
    """(vertex, label) of the vertices (vertex, words...) that have candidate links."""
    sc = rows.sparkSession.sparkContext
    weights = sc.broadcast(frequencies)
    kind = "element long, vertex long"
    prefixes = shared.write_and_read(rows.select("own", "text").mapInArrow(_prefixes(weights, copies, similarity, shingle, seed), kind), "prefixes")
    sizes = shared.write_and_read(prefixes.groupBy(F.col("element").alias("key")).count().where("count > 1"), "sizes")
    again = sc.broadcast(make_filter(sizes.select(F.col("key").alias("name"))))  # elements that pass by mistake are alone and make no pair
    meeting = shared.write_and_read(prefixes.mapInArrow(_met_again(again), kind), "meeting")
    keyed = meeting.join(vertices, "vertex").select(F.col("element").alias("key"), "vertex", *WORDS)
    return shared.write_and_read(components(simhash.bucket_links(keyed, RADIUS, WORDS, sizes)), "candidates")


def exact_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) of the members (key, vertex, n, words...) of candidate groups, whose components are those of all links."""
    a, b = sets.toDF("u", "left"), sets.toDF("v", "right")
    found = labels = None
    hub_groups = members.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") > TILE_ELEMENTS).select("key")
    rest = shared.write_and_read(members.join(hub_groups, "key"), "rest")
    for turn in range(TURNS):
        if rest.isEmpty():
            break
        pivots = shared.write_and_read(nearest_to_majority(rest).join(b.withColumnRenamed("v", "pivot"), "pivot"), "pivots")
        pairs = rest.select("key", "vertex").join(a, F.col("vertex") == F.col("u")).join(pivots, "key").where(F.col("u") != F.col("pivot"))
        near = shared.write_and_read(pairs.select("u", F.col("pivot").alias("v"), "left", "right").mapInArrow(_alike(similarity), "u long, v long"), "hub-links")
        found = near if found is None else found.unionByName(near)
        linked = near.select(F.col("u").alias("vertex")).unionByName(pivots.select(F.col("pivot").alias("vertex"))).distinct()
        rest = shared.write_and_read(rest.join(linked, "vertex", "left_anti"), "rest")
    if found is not None:
        labels = shared.write_and_read(components(found), "hub-labels")
    slim = members.select("key", "vertex", "n")
    labelled = slim.withColumn("label", F.col("vertex")) if labels is None else slim.join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
    met = simhash.dealt(labelled, F.col("n"), TILE_ELEMENTS).join(sets, "vertex").select("key", "pair", "side", "vertex", "label", "set")
    new = met.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_tile_links(similarity), "u long, v long")
    new = shared.write_and_read(new, "links")
    return new if found is None else new.unionByName(found)


def groups(rows: DataFrame, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """(own, label) of every row (own long, text): rows of a group have one label, the smallest own of a vertex.

    own must be unique, and the same whenever rows is read.  Texts without words are alike.
    """
    spark = rows.sparkSession
    written = shared.write_and_read(rows.mapInArrow(_digests(shingle, seed), f"{_DIGESTS}, {fitting.COUNTS}"), "digests")
    prints = written.where("own IS NOT NULL").drop("at", "counts")
    frequencies = np.minimum(fitting.counters(written.where("own IS NULL").select("at", "counts"), COUNTERS), 2**32 - 1).astype(np.uint32)  # of all rows
    alike = prints.groupBy("d0", "d1").agg(F.count(F.lit(1)).alias("copies"), F.min("own").alias("vertex")).where("copies > 1").drop("copies")
    alike = shared.write_and_read(alike, "alike")  # a plain table, so that a hot set's join can be split
    owned = shared.write_and_read(prints.join(alike, ["d0", "d1"], "left").select("own", F.coalesce("vertex", "own").alias("vertex"), "n", *WORDS), "vertices")
    copies = shared.mark_rows(spark, owned.where("own <> vertex").select("own"))
    vertices = owned.where("own = vertex").select("vertex", "n", *WORDS)

    candidates = candidate_groups(rows, vertices.drop("n"), frequencies, copies, shingle, similarity, seed)
    members = shared.write_and_read(vertices.join(candidates.withColumnRenamed("label", "key"), "vertex"), "members")
    wanted = shared.mark_rows(spark, members.select("vertex"))
    sets = shared.write_and_read(rows.select("own", "text").mapInArrow(_known_sets(wanted, shingle, seed), "vertex long, set binary"), "sets")
    labels = shared.write_and_read(components(exact_links(members, sets, similarity)), "labels")
    return owned.select("own", "vertex").join(labels, "vertex", "left").select("own", F.coalesce("label", "vertex").alias("label"))
