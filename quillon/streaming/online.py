"""Streams: encoding of arriving vectors, and running hit rates of arriving predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quantizer
from ..schema import IdSpec


def encode_stream(vectors: DataFrame, codebook: DataFrame, spec: IdSpec) -> DataFrame:
    """Codes of arriving vectors; the kernel is the batch one, no state is kept."""
    return quantizer.encode(vectors, codebook, spec)


def running_hits(judged: DataFrame) -> DataFrame:
    """Counts and rates so far of rows with hit_at_1 and hit_at_10; one row, updated as rows arrive."""
    return judged.agg(F.count(F.lit(1)).alias("total"), F.avg(F.col("hit_at_1").cast("double")).alias("hit_at_1"), F.avg(F.col("hit_at_10").cast("double")).alias("hit_at_10"))


def windowed_hits(judged: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same per window of event time; later rows than the watermark are left out."""
    hit = F.avg(F.col("hit_at_1").cast("double"))
    return judged.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("total"), hit.alias("hit_at_1")).select("w.start", "w.end", "total", "hit_at_1")
