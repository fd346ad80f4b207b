"""From items and their vectors to items with unique semantic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collisions, quantizer
from ..schema import ITEM, IdSpec
from ..sources import files


def assign(vectors: DataFrame, codebook: DataFrame, spec: IdSpec, order: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(order, codes, id_codes, doc_id) of vectors; join what else is needed by ``order``."""
    return collisions.with_docid(collisions.disambiguate(quantizer.encode(vectors, codebook, spec, vector_col).select(order, "codes"), order))


def attach(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items with the ``doc_id`` of their position; positions that only one side has fall away.

    The ``record`` of an item, if there, gets the id too and keeps its other keys.
    """
    both = items.drop("doc_id").join(ids.select("ord", "doc_id"), "ord")
    return both.withColumn("record", files.with_key(F.col("record"), "doc_id", F.col("doc_id"))) if "record" in items.columns else both


def generate(spark: SparkSession, items_path: str, codes_path: str, out_path: str, encode_items, codebook: DataFrame, spec: IdSpec) -> DataFrame:
    """Read items, encode them (or reuse the codes written before), and write them with ids.

    ``encode_items`` maps the items (with ``ord``) to (ord, embedding) rows; text
    encoders live outside.  Items are written with all keys that they were read with,
    nulls included, in their order.
    """
    items = files.read_jsonl(spark, items_path, ITEM, records=True)
    codes = files.reuse_or_compute(spark, codes_path, lambda: quantizer.encode(encode_items(items), codebook, spec).select("ord", "codes"))
    done = attach(items, collisions.with_docid(collisions.disambiguate(codes, "ord")))
    files.write_records(done, out_path, ["ord"])
    return done


def report(ids: DataFrame, spec: IdSpec) -> DataFrame:
    """One row: tokens used, ids that needed an ordinal, total."""
    tokens = collisions.id_tokens(ids).agg(F.count(F.lit(1)).alias("tokens_used"))
    return collisions.disambiguated_count(ids, spec.subspaces).join(tokens)
