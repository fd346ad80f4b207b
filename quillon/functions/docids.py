"""Codes to ids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SEMANTIC_TOKEN, TOKEN_START

# Fixed value: how a level and its code are written.
TOKEN = "<|d%d_%d|>"
PADDED_TOKEN = "<|d%d_%03d|>"


def semantic_docid(codes: Column, separator: str = " ") -> Column:
    """``<|d0_7|> <|d1_123|>``: one token per level."""
    return F.array_join(F.transform(codes, lambda c, m: F.format_string(TOKEN, m, c)), separator)


def padded_docid(codes: Column) -> Column:
    """``<|d0_007|><|d1_123|>``: three digits or more, no separator."""
    return F.array_join(F.transform(codes, lambda c, m: F.format_string(PADDED_TOKEN, m, c)), "")


def docid_tokens(doc_id: Column) -> Column:
    return F.regexp_extract_all(doc_id, F.lit(SEMANTIC_TOKEN), F.lit(0))


def docid_codes(doc_id: Column) -> Column:
    """The codes of a semantic id, level by level."""
    return F.transform(docid_tokens(doc_id), lambda t: F.regexp_extract(t, r"_(\d+)", 1).cast("int"))


def is_semantic(tokens: Column) -> Column:
    """Whether a vocabulary holds semantic tokens."""
    return F.exists(tokens, lambda t: t.startswith(TOKEN_START))


def vocabulary(spark: SparkSession, levels: int = 4, codes: int = 256) -> DataFrame:
    """All tokens of an id vocabulary: (lvl, code, token)."""
    both = spark.range(levels * codes).select((F.col("id") / codes).cast("int").alias("lvl"), (F.col("id") % codes).cast("int").alias("code"))
    return both.withColumn("token", F.format_string(TOKEN, "lvl", "code"))
