"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone: no ring, no
table.  When a shard is appended, a key either stays or moves into the new shard.

Slots are row numbers within shards without sorting a shard in one task: rows are
range-partitioned by key, numbered within each (partition, shard), and shifted by
the counts of the partitions before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import shared

#: Fixed value: the generator's multiplier in the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        key = key * MULTIPLIER + np.uint64(1)
        step = np.float64(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump = ((out[live] + 1) * step).astype(np.int64)
        stay = jump < shards
        live, key = live[stay], key[stay]
        out[live] = jump[stay]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a long key; null keys are in the shard of key 0."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).astype("int64").to_numpy().view(np.uint64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0)))


def key_of_text(key: Column) -> Column:
    """A long key for keys of other types."""
    return F.xxhash64(key.cast("string"))


def _number(shards: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            order = np.argsort(shard, kind="stable")
            ordered = shard[order]
            begin = np.searchsorted(ordered, np.arange(shards))
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - begin[ordered] + seen[ordered]
            seen += np.bincount(shard, minlength=shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), pid, np.int32)), pa.array(local)], names=[*batch.schema.names, *names])

    return scan


def with_slots(rows: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, in the order of these columns.

    rows need an int column ``shard``; rows that tie in ``order`` get slots in the
    order of the input.
    """
    shared.prepare(rows.sparkSession)
    tie, pid, local, n, base = shared.quiet_columns(rows, "tie", "pid", "local", "n", "base")
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    kind = StructType([*ranged.schema.fields, StructField(pid, IntegerType()), StructField(local, LongType())])
    numbered = shared.write_and_read(ranged.mapInArrow(_number(shards, [pid, local]), kind), "slots")
    counts = numbered.groupBy(pid, "shard").agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("shard").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(counts.select(pid, "shard", before.alias(base)), [pid, "shard"]).withColumn("slot", F.col(base) + F.col(local)).drop(pid, local, base)


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows into shards by the law ``key``: id and shard count decide.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard,
    slot (gapless from 0 per shard, by id) and grown_shard (with one more shard).

    Defined cases: a null text has size 1 and the checksum of the empty text; rows
    without id are in the shard of id 0 and come first in it; equal ids are in the
    same shard and get slots of their own; an empty table gives no rows; other
    columns of the input are ignored.
    """
    shared.prepare(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    out = with_slots(rows, shards, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
