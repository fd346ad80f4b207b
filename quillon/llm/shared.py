"""Plumbing shared by the operators: tables, shared folders, side files.

A *side file* carries a small per-partition fact (bits, flags) from a reduce
step back to a later scan of the same input.  It is written by Spark under the
folder that the session names in ``spark.checkpoint.dir`` and read by the scan
task itself, so the texts never travel through a shuffle and a retried task on
another executor finds the same file.
"""

from __future__ import annotations

import atexit
import os
import sys
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_MADE: list[str] = []
#: Bytes of an Arrow batch, in place of Spark's default of 64 MB: a batch lies in memory several times.
BATCH_BYTES = 2 << 20
#: Bits of a row's number below the number of its partition, as Spark's increasing ids have them.
ROW_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> str:
    """Make workers able to import this package, keep their memory low; return the shared folder.

    Arrow batches are limited to BATCH_BYTES where the session has Spark's default,
    and workers give freed Arrow memory back.  The folder is the session's
    ``spark.checkpoint.dir``; where that is unset, one is chosen in local mode, and any
    other master is refused, since its machines share no temporary folder.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if ROOT not in sys.path:
        sys.path.append(ROOT)
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = f"file:///tmp/checkpoints/quillon-{uuid.uuid4().hex[:12]}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def work_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared folder, removed when the driver exits."""
    path = f"{prepare(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder given as URI or plain path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def made() -> list[str]:
    """The folders that are there now, for ``free``."""
    return list(_MADE)


def free(paths: list[str]) -> None:
    """Remove folders that no later step reads."""
    for path in paths:
        try:
            fs, inner = open_fs(path)
            fs.delete_dir(inner)
        except Exception:  # the folder may be gone, or its store out of reach
            pass
        if path in _MADE:
            _MADE.remove(path)


@atexit.register
def _clean() -> None:
    free(made())


def halved(doc_id: str) -> Column:
    """Whether a row is in the first half of a table, by a hash of its id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0


def write_side(df: DataFrame, path: str) -> None:
    """Write rows with a column ``pid`` so that each scan task can read its own."""
    df.repartition("pid").write.partitionBy("pid").parquet(path)


def read_side(path: str, pid: int) -> pa.Table | None:
    """The rows of one partition; None where there are none.  A missing path is an error."""
    fs, inner = open_fs(path)
    folder = f"{inner}/pid={pid}"
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        if fs.get_file_info(inner).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"{path}: side files are out of reach")
        return None
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")]
    parts = [pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)]
    return pa.concat_tables(parts) if parts else None


def write_and_read(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder."""
    spark = df.sparkSession
    path = path or work_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.parquet(path)


def number_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number of their own, and the name of the numbers' column.

    The numbers stay with the rows however the table is dealt out later.
    """
    own = quiet_column(df, "own")
    return write_and_read(df.withColumn(own, F.monotonically_increasing_id()), "numbered"), own


def mark_rows(spark: SparkSession, own: DataFrame) -> str:
    """Write the numbers in a table's only column as side files; return their folder."""
    path, x = work_dir(spark, "marked"), F.col(f"`{own.columns[0]}`")
    write_side(own.select(F.shiftright(x, ROW_BITS).alias("pid"), x.alias("own")), path)
    return path


class Marked:
    """Tells which numbers ``mark_rows`` wrote; holds those of one partition at a time."""

    def __init__(self, path: str):
        self.path, self.pid, self.known = path, None, np.empty(0, np.int64)

    def has(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(len(own), bool)
        for pid in np.unique(own >> ROW_BITS).tolist():
            if pid != self.pid:
                side = read_side(self.path, pid)
                self.pid, self.known = pid, np.empty(0, np.int64) if side is None else side.column("own").to_numpy()
            here = own >> ROW_BITS == pid
            out[here] = np.isin(own[here], self.known)
        return out


def without(df: DataFrame, own: str, gone: DataFrame) -> DataFrame:
    """df's rows but those whose number (column ``own``) is in gone, a table of that one column.

    Each scan task reads the numbers that belong to its rows, so no row is shuffled.
    """
    path, at = mark_rows(df.sparkSession, gone), df.columns.index(own)

    def scan(batches):
        marked = Marked(path)
        for batch in batches:
            yield batch.filter(pa.array(~marked.has(batch.column(at).to_numpy())))

    return df.mapInArrow(scan, df.schema)


def quiet_column(df: DataFrame, stem: str) -> str:
    """A column name that the input doesn't use."""
    return quiet_columns(df, stem)[0]


def quiet_columns(df: DataFrame, *stems: str) -> list[str]:
    """Column names that the input doesn't use, each another."""
    used, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out
