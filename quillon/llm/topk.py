"""Exact top-k search by inner product, in tiles.

Vectors are packed into shards (candidates) and tiles (queries): a row of either is
one block of a matrix, with the numbers of its rows beside it, by which a query's own
row is told from others of the same id.  A task holds one file of tiles, with the best
so far of each of its queries, and streams a stretch of the shards past it from the
shared folder: each (tile, shard) pair is one matrix product and a partial selection.
Only the short lists leave a task.  There are few stretches (as many as keep all cores
busy), so what is shuffled is a few lists for each query; a tile's lists are merged as
a tree, a group of lists at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Queries in a tile, tiles that a task holds, candidates in a product, shards in a file, and lists merged by one task of the tree.
TILE = 512
TILES_HELD = 32
SHARD = 4096
SHARDS_IN_FILE = 16
FAN_IN = 32
_BLOCK = "dim long, rows binary, ids binary, vectors binary"
_LISTS = "tile string, part long, row binary, query binary, ids binary, scores binary"
Lists = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # query's row and id, candidate's id, score


def quantise(column: pa.Array, scale: float = 64.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vectors are complete, and those vectors as floor(scale * x)."""
    rows, found = [], []
    for i, x in enumerate(column):
        v = x.values if x.is_valid else None
        if v is None or len(v) == 0 or v.null_count:
            continue
        d = np.floor(scale * v.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(d).all():
            rows.append(i)
            found.append(d)
    return np.array(rows, np.int64), found


class Packer:
    """Gathers (row, id, vector) into blocks of vectors of the same length."""

    def __init__(self, size: int):
        self.size = size
        self.held: dict[int, tuple[list[int], list[int], list[np.ndarray]]] = {}

    def add(self, row: int, id_: int, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = self.held.setdefault(len(vector), ([], [], []))
        for held, x in zip(block, (row, id_, vector), strict=True):
            held.append(x)
        if len(block[0]) == self.size:
            yield self._block(len(vector), *self.held.pop(len(vector)))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for dim, block in self.held.items():
            yield self._block(dim, *block)

    @staticmethod
    def _block(dim: int, rows: list[int], ids: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(rows, np.int64), np.array(ids, np.int64), np.stack(vectors))]
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), *blobs], names=["dim", "rows", "ids", "vectors"])


def _shards(size: int, scale: float):
    """Blocks of (id, vector) rows, numbered as they come."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, row = Packer(size), TaskContext.get().partitionId() << shared.ROW_BITS
        for batch in batches:
            rows, vectors = quantise(batch.column(1), scale)
            for i, id_, v in zip(rows.tolist(), batch.column(0).take(pa.array(rows)).to_pylist(), vectors, strict=True):
                yield from packer.add(row + i, id_, v)
            row += batch.num_rows
        yield from packer.rest()

    return scan


def unpack(dim: int, rows: bytes, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def _asked(every: int):
    """Blocks to (dim, row, id, vector) rows of the queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, ids, m = unpack(dim, *block)
                at = np.flatnonzero(ids % every == 0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids[at]), pa.array([x.tobytes() for x in m[at]], pa.binary())], names=["row", "id", "vector"])

    return scan


def _tiles(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size)
        for batch in batches:
            for row, id_, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from packer.add(row, id_, np.frombuffer(v, np.float64))
        yield from packer.rest()

    return scan


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-valued rows: in single or double floats while every sum is exact, else in integers."""
    bound = a.shape[1] * max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0))
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in b]
    out = [[sum(x * y for x, y in zip(q, c, strict=True)) for c in whole] for q in ([int(x) for x in row] for row in a)]
    return np.array(np.clip(np.array(out, object), -(2**63), 2**63 - 1), np.int64)


def best(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best (score, then smaller id) candidates, its own row left out, as flat (query, id, score)."""
    allowed = rows[None, :] != own[:, None]
    n = scores.shape[1]
    if n > k + 1:
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        least = np.partition(masked, n - k, axis=1)[:, n - k]  # the k-th best; ties with it all stay for now
        allowed &= scores >= least[:, None]
    row, col = np.nonzero(allowed)
    keep = first_k(row, ids[col], scores[row, col], k)
    return row[keep], ids[col][keep], scores[row, col][keep]


def first_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, in order of query, score and id."""
    order = np.lexsort((ids, ~scores, query))  # ~x falls as x grows, without overflow
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k]


def _blocks_of(fs: pafs.FileSystem, name: str) -> Iterator[dict]:
    """The blocks of a file, one in memory at a time."""
    with fs.open_input_file(name) as file:
        for rows in pq.ParquetFile(file).iter_batches(batch_size=1):
            yield rows.to_pylist()[0]


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, inner = shared.open_fs(path)
    return fs, sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.path.endswith(".parquet"))


def _search(tile_dir: str, shard_dir: str, stretches: int, k: int):
    """(number) to lists: the number names a file of tiles and a stretch of shards."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, tile_files = _files(tile_dir)
        _, shard_files = _files(shard_dir)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file, stretch = divmod(number, stretches)
                tiles = [(b["dim"], *unpack(b["dim"], b["rows"], b["ids"], b["vectors"])) for b in _blocks_of(fs, tile_files[file])]
                found: list[list[tuple[np.ndarray, ...]]] = [[(np.empty(0, np.int64),) * 3] for _ in tiles]
                for name in shard_files[stretch::stretches]:
                    for block in _blocks_of(fs, name):
                        rows, ids, m = unpack(block["dim"], block["rows"], block["ids"], block["vectors"])
                        for held, (dim, own, _, q) in zip(found, tiles, strict=True):
                            if dim == block["dim"]:
                                both = [np.concatenate(x) for x in zip(*held, best(product(q, m), rows, ids, own, k), strict=True)]
                                keep = first_k(*both, k)
                                held[:] = [tuple(x[keep] for x in both)]
                for i, (held, (_, own, own_ids, _)) in enumerate(zip(found, tiles, strict=True)):
                    query, ids, scores = held[0]
                    yield _lists(f"{file}/{i}", stretch, (own[query], own_ids[query], ids, scores))

    return scan


def _lists(tile: str, part: int, lists: Lists) -> pa.RecordBatch:
    blobs = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in lists]
    return pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([part], pa.int64()), *blobs], names=["tile", "part", "row", "query", "ids", "scores"])


def _merge(k: int, last: bool):
    def merge(t: pa.Table) -> pa.Table:
        row, query, ids, scores = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("row", "query", "ids", "scores"))
        keep = first_k(row, ids, scores, k)
        row, query, ids, scores = (x[keep] for x in (row, query, ids, scores))
        if last:
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            return pa.table({"query_id": query, "rank": pa.array(rank, pa.int32()), "vec_id": ids, "score": scores})
        return pa.Table.from_batches([_lists(t.column("tile")[0].as_py(), t.column("group")[0].as_py(), (row, query, ids, scores))])

    return merge


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, every: int = 20) -> DataFrame:
    """The k highest integer inner products of every query with all other rows.

    Queries are the rows whose id is divisible by ``every``.  Components become
    floor(scale * x); ties go to the smaller id.  Returns query_id, rank (from 1),
    vec_id, score; a query with fewer other rows gets all of them.

    Defined cases: vectors that are null or empty or hold null or non-finite
    components take no part, nor do rows without id; vectors of another length than
    the query's aren't compared with it; only the query's own row isn't its
    candidate, so of rows that repeat an id each is a candidate, each is a query of
    its own where the id is one, and they find each other; an empty table gives no
    rows; other columns are ignored; scores beyond 64 bits are clipped.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    shard_dir, tile_dir = shared.work_dir(spark, "shards"), shared.work_dir(spark, "tiles")
    rows.mapInArrow(_shards(SHARD, scale), _BLOCK).write.option("maxRecordsPerFile", SHARDS_IN_FILE).parquet(shard_dir)
    asked = shared.write_and_read(spark.read.schema(_BLOCK).parquet(shard_dir).mapInArrow(_asked(every), "row long, id long, vector binary"), "queries")
    queries = asked.count()
    asked.repartition(max(1, -(-queries // (TILE * TILES_HELD))), "row").mapInArrow(_tiles(TILE), _BLOCK).write.option("maxRecordsPerFile", TILES_HELD).parquet(tile_dir)

    tile_files, shard_files = len(_files(tile_dir)[1]), len(_files(shard_dir)[1])
    stretches = max(1, min(shard_files, -(-2 * spark.sparkContext.defaultParallelism // max(tile_files, 1))))
    tasks = spark.range(0, tile_files * stretches if queries else 0, 1, max(1, tile_files * stretches))
    lists, left = tasks.mapInArrow(_search(tile_dir, shard_dir, stretches, k), _LISTS), stretches
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        lists = lists.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(left))).groupBy("tile", "group").applyInArrow(_merge(k, False), _LISTS)
    return lists.groupBy("tile").applyInArrow(_merge(k, True), "query_id long, rank int, vec_id long, score long")
