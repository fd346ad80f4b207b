"""Sums over all rows that fits need: counters, and regressions by Newton steps.

Nothing is fitted on a selection of rows, and no row comes to the driver: tasks send
sums, of bounded size however many rows there are.  Sums of fractions are made of whole
multiples of 2**-BITS, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import make_filter

#: Counters that travel together; fractional bits of summed numbers.
SLICE, BITS = 1 << 16, 28
#: Rows whose numbers are in memory at once.
ROWS = 256
#: Newton steps at most, the step at which they end, and lengths tried of a step, each a quarter of the one before.
STEPS, TOLERANCE, LENGTHS = 60, 1e-6, 6
COUNTS = "at long, counts binary"


def labelled(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts (doc_id long, text) joined to rows (doc_id long, ...); only texts that may have a row are shuffled."""
    name = F.xxhash64("doc_id").alias("name")
    known = texts.sparkSession.sparkContext.broadcast(make_filter(rows.select(name)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.has(batch.column(0).to_numpy().view(np.uint64)))).select([1, 2])

    few = texts.select(name, "doc_id", "text").mapInArrow(scan, "doc_id long, text string")
    return few.join(rows.hint("merge"), "doc_id")  # by the same plan, whatever the sizes are


def slices(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Where the slices of an array of counters begin that aren't all zero, and their bytes, compressed."""
    packer = zstandard.ZstdCompressor(level=1)
    used = [i for i in range(0, len(counts), SLICE) if counts[i : i + SLICE].any()]
    return used, [packer.compress(counts[i : i + SLICE].astype(np.int64).tobytes()) for i in used]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, totals = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.frombuffer(unpack.decompress(x), np.int64)
            totals[at] = totals[at] + found if at in totals else found
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["at", "counts"])


def counters(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of all counters in rows (at, counts) of ``slices``; tasks add them as they come."""
    out = np.zeros(size, np.int64)
    for r in rows.repartition("at").mapInArrow(_added, COUNTS).toLocalIterator():  # size numbers
        x = np.frombuffer(r["counts"], np.int64)
        out[r["at"] : r["at"] + len(x)] = x
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    x = np.rint(x * 2.0**BITS)
    if not (np.abs(x).sum(axis=0) < 2.0**55).all():  # 39 parts of a batch of 10,000 rows fit 64 bits
        raise OverflowError("sums of a batch are out of range")
    return x.astype(np.int64).sum(axis=0)


def sums(rows: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what measure gives, a line of numbers for each row of a batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = sum(_whole(measure(batch.slice(lo, ROWS))) for lo in range(0, batch.num_rows, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x)], names=["at", "x"])

    found = {r["at"]: int(r["x"]) for r in rows.mapInArrow(scan, "at long, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    return np.array([found[i] for i in range(len(found))], float) / 2.0**BITS


def _losses(x: np.ndarray, y: np.ndarray, w: np.ndarray, trials: list[np.ndarray]) -> np.ndarray:
    """Weighted log loss, gradient and curvature of each row at each trial, in one line."""
    out = []
    for b in trials:
        z = x @ b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        k, at = b.shape[1], np.arange(len(x))
        off = p.copy()
        off[at, y] -= 1
        bend = p[:, :, None] * (np.eye(k) - p[:, None, :])
        loss = np.log(np.exp(z).sum(axis=1)) - z[at, y]
        slope = x[:, :, None] * off[:, None, :]
        curve = np.einsum("ni,nj,nab->niajb", x, x, bend)
        out += [(w * loss)[:, None], w[:, None] * slope.reshape(len(x), -1), w[:, None] * curve.reshape(len(x), -1)]
    return np.concatenate(out, axis=1)


def softmax(rows: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], weights: np.ndarray, inputs: int, ridge: float) -> np.ndarray:
    """Softmax regression over all rows: (inputs x classes), the ridge's optimum.

    read: a batch's inputs and classes; weights: of a row of each class.
    """
    k = len(weights)
    m = inputs * k

    def passed(trials: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def measure(batch: pa.RecordBatch) -> np.ndarray:
            x, y = read(batch)
            return _losses(x, y, weights[y], trials)

        lines = sums(rows, measure).reshape(len(trials), -1)
        return [(r[0] + ridge / 2 * (b**2).sum(), r[1 : 1 + m] + ridge * b.reshape(-1), r[1 + m :].reshape(m, m) + ridge * np.eye(m)) for r, b in zip(lines, trials, strict=True)]

    now = np.zeros((inputs, k))
    value, slope, curve = passed([now])[0]
    for _ in range(STEPS):
        step = -np.linalg.solve(curve, slope).reshape(now.shape)
        if np.abs(step).max() < TOLERANCE:
            break
        trials = [now + step / 4**i for i in range(LENGTHS)]
        found = passed(trials)
        best = int(np.argmin([f[0] for f in found]))
        if not found[best][0] < value:
            break
        now, (value, slope, curve) = trials[best], found[best]
    return now
