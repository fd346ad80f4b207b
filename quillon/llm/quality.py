"""Quality classifier by compression.

One zstandard dictionary is built from text labelled good and one from text
labelled bad.  A text is compressed with both, piece by piece so that the whole
text is judged against the dictionaries and not only its start.  The difference
of the compressed sizes, normalised by the text's size, is calibrated to a
probability by a logistic curve whose slope may depend on how far the text
compresses at all (repetitive text shrinks with either dictionary).

All labelled documents are fitted on, whole: one half gives the dictionaries, the other
the calibration.  All pieces of a class's texts are dealt into groups that a task can
train on (those of a long text to many, so that it isn't a group's only subject); each
group's best segments are an equal share of the dictionary's content, as with the
epochs of zstandard's own training.  The entropy tables before the content are those of
a group too, of several the ones with which the half's texts are smallest in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fitting, shared

#: Bytes of text that a group is to have, at least and about; bytes of a segment, entropy tables that are tried.
LEAST_BYTES, GROUP_BYTES, SEGMENT, TRIED = 1 << 18, 8 << 20, 256, 8
#: Bytes compressed at a time, bytes of a dictionary, compression level.
PIECE = 4096
DICT_BYTES = 112_640
LEVEL = 3
#: What ends a trained dictionary's entropy tables: the repeated offsets it begins with.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
#: Bytes added to a text's size, so that tiny texts don't make extreme ratios.
EXTRA = 32


@dataclass
class Model:
    """Dictionaries (bad, good) and the calibration; constant where a class is missing."""

    dictionaries: tuple[bytes, bytes] | None
    raw: tuple[bool, bool] = (False, False)
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    constant: float = 0.5

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of the good class from (bad size, good size, text size) rows."""
        if self.weights is None:
            return np.full(len(sizes), self.constant)
        z = (features(sizes, self.low, self.high) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def features(sizes: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Normalised difference, rate, and their product; held within what the calibration has seen."""
    size = sizes[:, 2] + EXTRA
    both = np.stack([(sizes[:, 0] - sizes[:, 1]) / size, np.minimum(sizes[:, 0], sizes[:, 1]) / size], axis=1)
    if low is not None:
        both = np.clip(both, low, high)
    return np.concatenate([both, both[:, :1] * both[:, 1:]], axis=1)


def build_dictionary(samples: list[bytes]) -> tuple[bytes, bytes]:
    """Entropy tables and content of a trained dictionary; no tables and the samples themselves where there are too few to train on."""
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-DICT_BYTES:]
    at = trained.index(OFFSETS) + len(OFFSETS)
    return trained[:at], trained[at:]


def _compressor(raw: bool, content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dealt(groups: dict[int, int]):
    """(label, doc_id, text) to (label, at, key, piece): each piece of a text and its group; groups: how many, by label."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ats, keys, pieces = [], [], [], []
            for label, doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = x.as_buffer().to_pybytes()
                for i in range(0, len(text), PIECE):
                    key = xxhash.xxh64_intdigest(f"{doc} {i}")
                    labels.append(label)
                    ats.append(key % groups[label])
                    keys.append(key >> 1)
                    pieces.append(text[i : i + PIECE])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(ats, pa.int64()), pa.array(keys, pa.int64()), pa.array(pieces, pa.binary())], names=["label", "at", "key", "piece"])

    return scan


def _group(share: dict[int, int]):
    """A group's pieces to (label, at, tables, content); share: bytes of content by label."""

    def train(t: pa.Table) -> pa.Table:
        label = t.column("label")[0].as_py()
        tables, content = build_dictionary([x for _, x in sorted(zip(t.column("key").to_pylist(), t.column("piece").to_pylist(), strict=True))])
        return pa.table({"label": t.column("label")[:1], "at": t.column("at")[:1], "tables": pa.array([tables], pa.binary()), "content": pa.array([content[-share[label] :]], pa.binary())})  # the best are last

    return train


def _tried(known):
    """(label, text) to (label, at, size): bytes of the texts, compressed with each dictionary of their label."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {label: [_compressor(False, d) for d in found] for label, found in known.value.items()}
        for batch in batches:
            total = {(label, i): 0 for label in by for i in range(len(by[label]))}
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = memoryview(x.as_buffer())
                for at in range(0, len(text), PIECE):
                    for i, c in enumerate(by.get(label, ())):
                        total[label, i] += len(c.compress(text[at : at + PIECE]))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["label", "at", "size"])

    return scan


def build_dictionaries(texts: DataFrame, sizes: dict[int, int]) -> list[tuple[bytes, bool]]:
    """Dictionary and whether it is raw content, of labels 0 and 1, from all texts (label, doc_id, text); sizes: bytes by label."""
    most = max(1, min(-(-max(sizes.values()) // GROUP_BYTES), DICT_BYTES // SEGMENT))
    groups = {label: max(1, min(most, size // LEAST_BYTES)) for label, size in sizes.items()}
    share = {label: DICT_BYTES // n for label, n in groups.items()}
    dealt = texts.select("label", "doc_id", "text").mapInArrow(_dealt(groups), "label int, at long, key long, piece binary")
    found = sorted(tuple(r) for r in dealt.groupBy("label", "at").applyInArrow(_group(share), "label int, at long, tables binary, content binary").collect())  # DICT_BYTES of content
    content = {label: b"".join(r[3] for r in found if r[0] == label) for label in (0, 1)}
    choice = {label: [bytes(r[2]) + content[label] for r in found if r[0] == label and r[2]][:TRIED] for label in (0, 1)}
    best = {0: 0, 1: 0}
    several = {label: c for label, c in choice.items() if len(c) > 1}
    if several:
        known = texts.sparkSession.sparkContext.broadcast(several)
        tried = texts.select("label", "text").mapInArrow(_tried(known), "label int, at int, size long").groupBy("label", "at").agg(F.sum("size").alias("size")).collect()
        best |= {label: min((r["size"], r["at"]) for r in tried if r["label"] == label)[1] for label in several}
    return [(choice[label][best[label]], False) if choice[label] else (content[label], True) for label in (0, 1)]


class Sizer:
    def __init__(self, model: Model):
        self.by = [_compressor(raw, content) for raw, content in zip(model.raw, model.dictionaries, strict=True)]

    def __call__(self, text: memoryview) -> tuple[int, int, int]:
        bad = good = 0
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE]
            bad += len(self.by[0].compress(part))
            good += len(self.by[1].compress(part))
        return bad, good, len(text)


def _sizes(model, column: pa.Array) -> np.ndarray:
    if model.dictionaries is None:
        return np.zeros((len(column), 3))
    sizer = Sizer(model)
    return np.array([sizer(memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")) for x in column], float).reshape(-1, 3)


def _measure(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _sizes(known.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, i]) for i in range(3))], names=["label", "bad", "good", "size"])

    return scan


def _score(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = known.value.scores(_sizes(known.value, batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return scan


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _line(batch: pa.RecordBatch) -> np.ndarray:
    return features(np.stack([batch.column(i).to_numpy() for i in range(1, 4)], axis=1))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _line(batch)[:, :2]
            yield pa.RecordBatch.from_arrays([pa.array(range(2), pa.int64()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["at", "low", "high"])


def calibrate(model: Model, seen: DataFrame) -> None:
    """Set the model's calibration from all rows (label, bad, good, size)."""
    n = seen.count()
    ends = sorted(tuple(r) for r in seen.mapInArrow(_ranges, "at long, low double, high double").groupBy("at").agg(F.min("low"), F.max("high")).collect())
    model.low, model.high = np.array([r[1] for r in ends]), np.array([r[2] for r in ends])
    mean = fitting.sums(seen, _line) / n
    model.mean, model.scale = mean, np.sqrt(fitting.sums(seen, lambda batch: (_line(batch) - mean) ** 2) / n) + 1e-9
    scale = model.scale

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.ones((batch.num_rows, 1)), (_line(batch) - mean) / scale], axis=1), batch.column(0).to_numpy()

    b = fitting.softmax(seen, read, np.ones(2), 4, ridge=0.02)  # of two classes: twice the ridge of their difference
    model.weights = b[:, 1] - b[:, 0]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled documents that aren't held out, on their whole texts.

    One half of them, by a hash of the id, gives the dictionaries, the other the
    calibration; both give both where a half lacks a class.
    Rows without id or label aren't used.  Without documents of both classes the
    score is the same for all texts: the smoothed share of the good class.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    constant = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    path = shared.work_dir(spark, "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = fitting.labelled(texts, rows.distinct())
    texts = shared.write_and_read(texts.select("label", "doc_id", "text", shared.halved("doc_id").alias("first")), "labelled", path)
    there = {(r["first"], r["label"]): r["size"] for r in texts.groupBy("first", "label").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    both = {v: sum(there.get((half, v), 0) for half in (True, False)) for v in (0, 1)}
    if not all(both.values()):
        return Model(None, constant=constant)
    whole = all(there.get((half, v)) for half in (True, False) for v in (0, 1))
    sizes = {v: there[True, v] for v in (0, 1)} if whole else both
    built = build_dictionaries(texts.where("first" if whole else "true"), sizes)
    model = Model((built[0][0], built[1][0]), (built[0][1], built[1][1]), constant=constant)

    kind = "label int, bad double, good double, size double"
    measured = texts.where("NOT first" if whole else "true").select("label", "text").mapInArrow(_measure(spark.sparkContext.broadcast(model)), kind)
    calibrate(model, shared.write_and_read(measured, "measured"))
    shared.free([path])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns but the text's, and ``score`` (0 to 1, higher: label 1 likelier) of the whole text.

    Defined cases: null counts as empty, and empty texts get the score of size
    zero; equal texts have equal scores; an empty table gives no rows; a column of
    the input named score is replaced.
    """
    spark = df.sparkSession
    shared.prepare(spark)
    name = shared.quiet_column(df, "text")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (text_col, "score")]
    rows = df.select(*rest, F.col(f"`{text_col}`").cast("string").alias(name))
    kind = rows.drop(name).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), kind)


def _accepted(known, at: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.value.scores(_sizes(known.value, batch.column(at))) >= least))

    return scan


def keep_good(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input's rows, all columns, whose score is ``least`` or more."""
    shared.prepare(df.sparkSession)
    return df.mapInArrow(_accepted(df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col), least), df.schema)
