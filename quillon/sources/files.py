"""Readers and writers: JSON lines, code tables, result documents.

Positions are part of the data here (documents and questions are paired by them), so
readers add ``ord``: the row's gapless position over all files, in the order of the
files' names and of the lines in each, however Spark packs files into partitions.
Records can keep all their keys as a map (``record``), so that keys which no schema
names, and nulls that stand in the file, are still there when they are written again.
"""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import quiet_columns
from ..schema import RESULTS

log = logging.getLogger("quillon")


def with_ord(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add gapless positions to rows as they come from files; rows aren't moved.

    Rows are counted per block of a file (what one task has read of it), and a block's
    rows are shifted by the counts of the blocks before it, by file name and first
    byte: a row per block.  Rows that come from no file are in the order of the
    partitions.
    """
    file, start, pid, row, n, base = quiet_columns(df, "file", "start", "pid", "row", "n", "base")
    block = [file, start, pid]
    local = df.select("*", F.input_file_name().alias(file), F.input_file_block_start().alias(start), F.spark_partition_id().alias(pid), F.monotonically_increasing_id().alias(row))
    counts = local.groupBy(*block).agg(F.count(F.lit(1)).alias(n), F.min(row).alias(base))
    before = F.sum(n).over(Window.orderBy(*block)) - F.col(n)
    shift = counts.select(*block, (before - F.col(base)).alias(base))
    return local.join(shift, block).withColumn(name, F.col(base) + F.col(row)).select(*(f"`{c}`" for c in df.columns), name)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, ord): the lines of text files, but blank ones."""
    return with_ord(spark.read.text(path).where(F.trim("value") != ""))


def record_of(line: Column) -> Column:
    """All keys of a JSON object, nulls and nested values included; a line that is no object raises."""
    return F.from_json(line, "map<string,variant>", {"mode": "FAILFAST"})


def with_key(record: Column, key: str, value: Column) -> Column:
    """A record with a key set to a string (or null); all other keys stay as they are."""
    return F.map_concat(F.map_filter(record, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("string").cast("variant")))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, ordered: bool = True, records: bool = False) -> DataFrame:
    """JSON lines with a declared schema, no inference pass; malformed lines raise.

    ``ordered`` adds ``ord``, ``records`` the column ``record`` of all keys.
    """
    lines = read_lines(spark, path) if ordered else spark.read.text(path).where(F.trim("value") != "")
    more = [F.col("ord")] * ordered + [record_of(F.col("value")).alias("record")] * records
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), *more).select("r.*", *(["ord"] * ordered + ["record"] * records))


def read_jsonl_with_keys(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """JSON lines plus ``keys``: the keys that are present, null values included, and ``ord``."""
    return read_jsonl(spark, path, schema, records=True).withColumn("keys", F.map_keys("record")).drop("record")


def read_codes(spark: SparkSession, path: str, subspaces: int) -> DataFrame:
    """A header-less table of integer codes: (ord, codes), in the order of the lines. One row is fine; lines of another length raise."""
    codes = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("int"))
    wrong = F.raise_error(F.concat(F.lit(f"{subspaces} codes are wanted, not "), F.col("value"))).cast("array<int>")
    return read_lines(spark, path).select("ord", F.when(F.size(codes) == subspaces, codes).otherwise(wrong).alias("codes"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of a result document, one row each."""
    return spark.read.schema(RESULTS).option("multiLine", True).json(path).select(F.posexplode("predictions").alias("ord", "p")).select("ord", "p.*")


def write_jsonl(df: DataFrame, path: str, order_by: str | None = None, nulls: bool = True) -> None:
    """JSON lines in UTF-8; null fields are written as such unless ``nulls`` is false."""
    if order_by:
        df = df.orderBy(order_by).drop(order_by)
    df.write.mode("errorifexists").option("ignoreNullFields", not nulls).json(path)


def write_codes(df: DataFrame, path: str, subspaces: int) -> None:
    """Codes as a header-less table, in the order of ``ord``."""
    df.orderBy("ord").select(*(F.col("codes")[m].alias(f"c{m}") for m in range(subspaces))).write.csv(path)


def write_records(df: DataFrame, path: str, order: list[str], by: str | None = None) -> None:
    """The column ``record`` as JSON lines, all keys and nulls included, in this order.

    ``by`` names a column with one folder of lines per value.
    """
    rows = df.orderBy(*([by] * (by is not None) + order)).select(*[by] * (by is not None), F.to_json("record", {"ignoreNullFields": "false"}).alias("value"))
    (rows.write.partitionBy(by) if by else rows.write).text(path)


def write_results(summary: DataFrame, path: str) -> None:
    """A result document (one row with nested predictions)."""
    summary.write.option("ignoreNullFields", False).json(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the session's shared folder; in local mode without one, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark resolves it to."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def reuse_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read a materialised result, or compute it, write it and read it."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(name: str, df: DataFrame, rows: int = 20) -> None:
    """Log the first rows of a (small) result."""
    for row in df.limit(rows).collect():
        log.info("%s %s", name, row.asDict())
