"""From items and questions to split files and chat records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, splits
from ..schema import ITEM, QUERY
from ..sources import files


def split_records(items: DataFrame, queries: DataFrame, test_tenths: int = 2, icl_tenths: int = 1) -> DataFrame:
    """Split rows whose ``record`` holds all their keys, questions with the ``doc_id`` that they got."""
    rows = splits.split(items, queries, test_tenths, icl_tenths)
    named = F.when(F.col("kind") == "query", files.with_key(F.col("record"), "doc_id", F.col("doc_id"))).otherwise(F.col("record"))
    return rows.withColumn("record", named)


def assemble(spark: SparkSession, items_path: str, queries_path: str, out_path: str, test_tenths: int = 2, icl_tenths: int = 1) -> DataFrame:
    """Split items and questions, write each split (documents first, by position), return the rows.

    Keys that no schema names and explicit nulls are written as they were read.
    """
    items, queries = (files.read_jsonl(spark, path, schema, records=True) for path, schema in ((items_path, ITEM), (queries_path, QUERY)))
    rows = split_records(items, queries, test_tenths, icl_tenths)
    files.write_records(rows, out_path, ["kind", "ord"], by="split")
    return rows


def chat_records(spark: SparkSession, split_path: str, out_path: str) -> None:
    """Two-turn chat records of a split's rows, in their order."""
    rows = files.read_jsonl(spark, split_path, ITEM)
    files.write_jsonl(chat.to_chat(rows, keep=("ord",)), out_path, order_by="ord")
