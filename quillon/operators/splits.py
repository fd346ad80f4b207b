"""Train, test and held-out splits of documents and their questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import quiet_columns


def pair(docs: DataFrame, queries: DataFrame, key: str = "text_id") -> DataFrame:
    """Give each question the ``doc_id`` of the document at its position (``ord``).

    Both tables need the same positions and, at each, the same key; else an error
    is raised when the rows are used.
    """
    own, doc_id, there = quiet_columns(queries, "key", "doc_id", "there")
    d = docs.select("ord", F.col(key).alias(own), F.col("doc_id").alias(doc_id), F.lit(True).alias(there))
    both = queries.drop("doc_id").join(d, "ord", "full_outer")
    wrong = F.col(there).isNull() | ~F.col(key).eqNullSafe(F.col(own))
    said = F.raise_error(F.concat(F.lit("documents and questions differ at position "), F.col("ord").cast("string")))
    return both.withColumn("doc_id", F.when(wrong, said.cast("string")).otherwise(F.col(doc_id))).drop(own, doc_id, there)


def check_lengths(docs: DataFrame, queries: DataFrame) -> int:
    """The common number of rows; two numbers come to the driver."""
    n, m = docs.count(), queries.count()
    if n != m:
        raise ValueError(f"{n} documents but {m} questions")
    return n


def cut_points(n: int, test_tenths: int = 2, icl_tenths: int = 1) -> tuple[int, int, int]:
    """(end of train documents, end of train questions, end of test questions), in whole numbers."""
    docs = n * (10 - icl_tenths) // 10
    train = n * (10 - test_tenths - icl_tenths) // 10
    return docs, train, train + n * test_tenths // 10


def document_split(ord_: Column, cuts: tuple[int, int, int]) -> Column:
    return F.when(ord_ < cuts[0], "train").otherwise("icl_test")


def question_split(ord_: Column, cuts: tuple[int, int, int]) -> Column:
    return F.when(ord_ < cuts[1], "train").when(ord_ < cuts[2], "test").otherwise("icl_test")


def split(docs: DataFrame, queries: DataFrame, test_tenths: int = 2, icl_tenths: int = 1, key: str = "text_id") -> DataFrame:
    """All rows with ``split`` and ``kind`` (document or query), by position.

    Training holds the first documents and questions, test later questions about
    documents that training has, and icl_test the last documents with theirs.
    """
    cuts = cut_points(check_lengths(docs, queries), test_tenths, icl_tenths)
    d = docs.withColumns({"kind": F.lit("document"), "split": document_split(F.col("ord"), cuts)})
    q = pair(docs, queries, key).withColumns({"kind": F.lit("query"), "split": question_split(F.col("ord"), cuts)})
    return d.unionByName(q, allowMissingColumns=True)


def position_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("ord") >= start) & (F.col("ord") < end))


def head(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by position; none or 0 is all, negative leaves off as many at the end."""
    if not n:
        return df
    return df.where(F.col("ord") < (n if n > 0 else df.count() + n))


def validation_split(df: DataFrame, key: str, per_cent: float) -> DataFrame:
    """Add ``validation``: a share of rows by a hash of their key, the same in every run."""
    return df.withColumn("validation", F.pmod(F.xxhash64(key), F.lit(10_000)) < int(per_cent * 100))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed pseudo-random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
