"""Mixing by soft membership: document rates whose expected domain totals match targets.

A classifier fitted on a labelled table gives each document a posterior over
domains.  Rates bring the expected tokens of each domain (rate x tokens x posterior,
summed over documents) as near to its target as can be, and of all such rates they
are nearest to 1, where a document weighs as its tokens.  Such rates are 1 plus a
weighted sum of the posterior, cut at 0 and the top rate, with one weight per domain:
the multipliers.  Documents of equal posterior have equal rates: with posteriors
rounded to 1/GRID, steps run over the distinct posteriors and their token sums.

The multipliers are found by gradient steps of the least-squares problem, scaled by
its curvature (Newton's) and followed by the projection onto the allowed rates, which
end only where the condition of optimality holds and raise if it can't be met: steps
that aren't scaled hardly move the rates of rare domains.  A pass over the sums gives a handful
of numbers; the rates themselves are never gathered, every task works them out from
the multipliers.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fitting, shared
from .suffix_dedup import views
from .words import NON_SPACE, Words, groups

#: Word buckets of the classifier.
BUCKETS = 1 << 16
#: Posteriors are multiples of 1/GRID, so there are no more distinct ones than the ways to deal GRID parts to the domains.
GRID = 128
#: Newton steps at most for a weight of nearness, the distance from optimality (in shares of all tokens) at which they end, and lengths tried of a step, each a quarter of the one before.
STEPS = 200
TOLERANCE = 1e-8
LENGTHS = 24
#: Weight in the end of the rates' distance from 1 against the totals' distance from their targets.
NEARNESS = 1e-10
_LOG = logging.getLogger(__name__)


@dataclass
class Domains:
    """Weights of word buckets per domain, and the calibration of their sums."""

    names: list[str]
    weights: np.ndarray | None = None
    slopes: np.ndarray | None = None
    prior: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posteriors(self, sums: np.ndarray) -> np.ndarray:
        if self.slopes is None:
            return np.tile(self.prior, (len(sums), 1))
        z = _design(sums) @ self.slopes
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _design(sums: np.ndarray) -> np.ndarray:
    """Calibration inputs from (domain sums..., distinct words) rows."""
    s, n = sums[:, :-1], np.sqrt(1 + sums[:, -1:])
    return np.concatenate([np.ones((len(sums), 1)), np.clip(s, -60, 60) / 10, s / n], axis=1)


def rounded(p: np.ndarray) -> np.ndarray:
    """Posteriors as whole numbers that sum to GRID, by largest remainders."""
    whole = np.floor(p * GRID).astype(np.int64)
    order = np.argsort(whole - p * GRID, axis=1, kind="stable")
    short = GRID - whole.sum(axis=1)
    np.put_along_axis(whole, order, np.take_along_axis(whole, order, axis=1) + (np.arange(p.shape[1]) < short[:, None]), axis=1)
    return whole


def _word_buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts: numbers and word counts, and distinct (text << 16 | bucket)."""
    for numbers, texts in groups(views(column)):
        w = Words(numbers, texts, NON_SPACE)
        yield np.array(numbers), np.bincount(w.text - numbers[0], minlength=len(numbers)), np.unique((w.text << 16) | (w.names & np.uint64(BUCKETS - 1)).astype(np.int64))


def _count_buckets(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs = np.zeros((k, BUCKETS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            domain = batch.column(1).to_numpy()
            docs += np.bincount(domain, minlength=k)
            for _, _, pairs in _word_buckets(batch.column(0)):
                np.add.at(found, (domain[pairs >> 16], pairs & (BUCKETS - 1)), 1)
        at, packed = fitting.slices(found.reshape(-1))
        last, sizes = fitting.slices(docs)
        yield pa.RecordBatch.from_arrays([pa.array(at + [k * BUCKETS for _ in last], pa.int64()), pa.array(packed + sizes, pa.binary())], names=["at", "counts"])

    return scan


def _sums(model: Domains, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(domain sums..., distinct words) and the number of words of each text."""
    k = len(model.names)
    out, words = np.zeros((len(column), k + 1)), np.zeros(len(column), np.int64)
    for numbers, counts, pairs in _word_buckets(column):
        words[numbers] = counts
        if model.weights is not None and len(pairs):
            text, bucket = pairs >> 16, pairs & (BUCKETS - 1)
            begin = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
            out[text[begin], :k] = np.add.reduceat(model.weights[:, bucket], begin, axis=1).T
            out[text[begin], k] = np.diff(np.concatenate([begin, [len(text)]]))
    return out, words


def _measure(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, _ = _sums(known.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["domain", "sums"])

    return scan


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return _design(np.stack(batch.column(1).to_numpy(zero_copy_only=False))), batch.column(0).to_numpy()


def fit_domains(docs: DataFrame, labelled: DataFrame, names: list[str]) -> Domains:
    """Fit on all documents that have labelled (doc_id, domain) rows.

    One half, by a hash of the id, gives the word weights, the other the calibration
    (both give both where a half lacks a domain), weighted to the domains' shares of the
    labelled table.  Unknown and null domains are left out.  Where fewer than two domains have
    documents, all posteriors are the labelled table's smoothed shares.  Word buckets
    that fewer than four documents have, and those whose weight is below 1
    in all ways, say too little and have weight 0.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    k = len(names)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int") - 1
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("domain")).where("doc_id IS NOT NULL AND domain >= 0")
    shares = np.ones(k)
    for r in rows.groupBy("domain").count().collect():  # one row per domain
        shares[r["domain"]] += r["count"]
    prior = shares / shares.sum()
    path = shared.work_dir(spark, "labelled")
    texts = fitting.labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), rows.distinct())
    texts = shared.write_and_read(texts.select("text", "domain", shared.halved("doc_id").alias("first")), "labelled", path)
    there = np.zeros((2, k), np.int64)
    for r in texts.groupBy("first", "domain").count().collect():  # two rows per domain
        there[int(r["first"]), r["domain"]] = r["count"]
    if (there.sum(axis=0) > 0).sum() < 2:
        return Domains(names, prior=prior)
    halves = ("first", "NOT first") if ((there > 0) == (there.sum(axis=0) > 0)).all() else ("true", "true")

    found = fitting.counters(texts.where(halves[0]).select("text", "domain").mapInArrow(_count_buckets(k), fitting.COUNTS), k * BUCKETS + k)
    counts, n = found[: k * BUCKETS].reshape(k, BUCKETS).astype(float), found[k * BUCKETS :].astype(float)
    rest, rest_n = counts.sum(axis=0) - counts, n.sum() - n
    weights = np.log((counts + 0.5) / (n[:, None] + 1)) - np.log((rest + 0.5) / (rest_n[:, None] + 1))
    weights[(np.abs(weights) < 1) | (counts.sum(axis=0) < 4)] = 0
    model = Domains(names, np.clip(weights, -4, 4), prior=prior)
    known = spark.sparkContext.broadcast(model)
    seen = shared.write_and_read(texts.where(halves[1]).select("text", "domain").mapInArrow(_measure(known), "domain int, sums array<double>"), "measured")
    used = there[0] if halves[1] == "NOT first" else there.sum(axis=0)
    slopes = fitting.softmax(seen, _read, prior / np.maximum(1, used) * used.sum(), 2 * k + 1, ridge=0.1)
    shared.free([path])
    model.slopes = slopes
    return model


def _posterior_rows(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, words = _sums(known.value, batch.column(1))
            p = rounded(known.value.posteriors(sums)) if batch.num_rows else np.empty((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(p.tolist(), pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "cell"])

    return scan


@dataclass
class Rates:
    """Multipliers of the rates, and the share of all tokens by which each domain misses its target."""

    multipliers: np.ndarray
    missed: np.ndarray


def replay(p: np.ndarray, fitted: Rates, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates of these posteriors, and what they are before they are cut."""
    free = 1 + p @ fitted.multipliers
    return np.clip(free, 0, top), free


def measured(p: np.ndarray, tokens: np.ndarray, multipliers: np.ndarray, top: float) -> np.ndarray:
    """Domain totals, their derivatives, and the function of which totals are the gradient, in one row."""
    rate, free = replay(p, Rates(multipliers, multipliers), top)
    moves = (free >= 0) & (free <= top)  # rates begin at 1, which may be the top
    slope = p[moves].T @ (tokens[moves][:, None] * p[moves])
    return np.concatenate([(tokens * rate) @ p, slope.reshape(-1), [tokens @ (rate * free - rate * rate / 2)]])


def _totals(trials: list[np.ndarray], top: float, size: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.array(batch.column(0).to_pylist(), float)
                p /= p.sum(axis=1, keepdims=True)
                found = np.concatenate([measured(p, batch.column(1).to_numpy() / size, x, top) for x in trials])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(found)], names=["at", "x"])

    return scan


def solve(measure: Callable[[list[np.ndarray]], np.ndarray], targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Multipliers at which totals and targets (shares of all tokens) are nearest; measure gives a row for each trial.

    The weight of nearness to 1 falls to NEARNESS by tenths, each solution being the
    start of the next.
    """
    k = len(targets)
    now = np.zeros(k)
    row = measure([now])[0]
    for near in 10.0 ** np.arange(-1, np.log10(NEARNESS) - 0.5, -1):
        for _ in range(steps):
            off = row[:k] + near * now - targets
            if np.abs(off).max() <= tolerance + 1e-15 * np.abs(now).max():
                break
            step = -np.linalg.solve(row[k:-1].reshape(k, k) + near * np.eye(k), off)
            trials = [now + step / 4**i for i in range(LENGTHS)]
            rows = measure(trials)
            offs = np.array([np.abs(r[:k] + near * x - targets).max() for r, x in zip(rows, trials, strict=True)])
            values = np.array([r[-1] + near / 2 * x @ x - targets @ x for r, x in [(row, now), *zip(rows, trials, strict=True)]])
            best = int(values[1:].argmin())
            if offs[0] <= tolerance or not values[1 + best] < values[0]:  # where values can't tell, what is off decides
                best = int(offs.argmin())
                if offs[best] >= np.abs(off).max():
                    break
            now, row = trials[best], rows[best]
    off = np.abs(row[:k] + NEARNESS * now - targets).max()
    if off > tolerance + 1e-15 * np.abs(now).max():
        raise RuntimeError(f"rates did not settle: totals are off by {off:.1e} of all tokens")
    return Rates(now, targets - row[:k])


def fit_rates(cells: DataFrame, targets: np.ndarray, top: float = float("inf"), steps: int = STEPS, tolerance: float = TOLERANCE) -> Rates:
    """Multipliers that give the rates; cells: (cell, tokens) with one row per distinct posterior."""
    k = len(targets)
    size = max(1.0, float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]))

    def measure(trials: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(trials) * (k + k * k + 1))
        for r in cells.mapInArrow(_totals(trials, top, size), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"]
        return out.reshape(len(trials), -1)

    return solve(measure, targets / size, steps, tolerance)


def _rate_rows(fitted, top):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rate = replay(np.array(batch.column(2).to_pylist()) / GRID, fitted, top)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return scan


def _fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float, top: float, keep: str | None = None):
    """Rows (row's id, tokens, cell), the classifier's broadcast, and the rates' multipliers."""
    spark = docs.sparkSession
    names = list(weights)
    known = spark.sparkContext.broadcast(fit_domains(docs, labelled, names))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rated = shared.write_and_read(rows.mapInArrow(_posterior_rows(known), f"doc_id {id_type}, n_tokens long, cell array<long>"), "posteriors")
    cells = shared.write_and_read(rated.groupBy("cell").agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = np.array([weights[n] for n in names], float)
    if keep is not None and total:
        at = names.index(keep)
        own = cells.agg(F.sum(F.col("cell")[at] / GRID * F.col("tokens"))).first()[0]
        budget = max(budget, own / total / (share[at] / share.sum()))
    fitted = fit_rates(cells, share / share.sum() * budget * total, top)
    for name, missed in zip(names, fitted.missed, strict=True):
        if abs(missed) > 1e-6:
            _LOG.warning("domain %s: target beyond reach, missed by %.2g of all tokens", name, missed)
    return rated, known, fitted


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float = 1.0, top: float = float("inf")) -> DataFrame:
    """Nonnegative rates (at most ``top``) so that expected domain tokens match ``weights``.

    weights: target share of each domain, of ``budget`` times the documents' tokens
    (words between white space).  Returns doc_id, n_tokens, cell (posterior in units
    of 1/GRID, in the order of ``weights``) and rate: how often the document is to
    be taken, on average.

    Defined cases: a text without words has no tokens and the rate of its posterior;
    targets beyond reach give the nearest totals and a logged warning; equal texts have equal rates;
    repeated rows are rated one by one; null ids stay null; an empty table gives no
    rows; other columns are ignored.
    """
    rated, _, fitted = _fitted(docs, labelled, weights, budget, top)
    return rated.mapInArrow(_rate_rows(fitted, top), f"doc_id {rated.schema['doc_id'].dataType.simpleString()}, n_tokens long, cell array<long>, rate double")


def _chosen(known, fitted, at: int, id_at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = rounded(known.value.posteriors(_sums(known.value, batch.column(at))[0])) / GRID
            rate = replay(p, fitted, 1.0)[0]
            keys = (str(i).encode() if i is not None else t for i, t in zip(batch.column(id_at).to_pylist(), views(batch.column(at)), strict=True))
            draw = np.array([xxhash.xxh64_intdigest(k) / 2**64 for k in keys])
            yield batch.filter(pa.array(draw < rate))

    return scan


def choose(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], keep: str | None = None) -> DataFrame:
    """The input's rows, all columns, taken with a probability of their rate, which is 1 at most.

    The draw is a hash of doc_id, of the text for rows without one, so a row's fate
    doesn't change between runs and equal ids have equal draws.  A text without words
    has the rate of its posterior; an empty table gives no rows.  A domain whose target is beyond its tokens keeps all documents that are surely its;
    for the domain ``keep`` all targets are raised until its target is no less than
    its tokens, so that none of those documents is lost.
    """
    _, known, fitted = _fitted(docs, labelled, weights, 1.0, 1.0, keep)
    return docs.mapInArrow(_chosen(known, fitted, docs.columns.index("text"), docs.columns.index("doc_id")), docs.schema)


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labelled table: clean, toxic or low."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))


#: Target shares of the registered query and of the pipeline.
TARGETS = {"clean": 0.95, "toxic": 0.04, "low": 0.01}
