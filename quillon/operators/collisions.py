"""Ids that several documents share: ordinals, statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.docids import semantic_docid, vocabulary
from .quantizer import code_usage

#: Positions per block when ordinals are counted; a huge group spans many blocks.
BLOCK = 1_000_000


def disambiguate(encoded: DataFrame, order: str, codes: str = "codes", block: int = BLOCK) -> DataFrame:
    """Add ``id_codes``: codes, and for colliding rows their ordinal (from 0, by ``order``) as one more level.

    ``order`` is a long that is unique and not negative.  Rows are numbered within
    (codes, block of positions) and shifted by the counts of earlier blocks, so a
    group that holds a third of all rows is not one task's work.
    """
    slim = encoded.select(order, codes).withColumn("__block", F.coalesce(F.floor(F.col(order) / block), F.lit(0)))  # never null, as codes
    local = F.row_number().over(Window.partitionBy(codes, "__block").orderBy(order)) - 1
    numbered = slim.withColumn("__local", local)
    # from the same rows as above, so that one exchange (and one evaluation of the codes) serves both
    blocks = numbered.groupBy(codes, "__block").agg((F.max("__local") + 1).alias("__n"))
    of_code = Window.partitionBy(codes)
    before = Window.partitionBy(codes).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(codes, "__block", F.sum("__n").over(of_code).alias("__size"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ordinal = (F.col("__base") + F.col("__local")).cast("int")
    own = F.when(F.col("__size") > 1, F.concat(F.col(codes), F.array(ordinal))).otherwise(F.col(codes))
    done = numbered.join(shifts, [codes, "__block"]).select(order, codes, own.alias("id_codes"))
    if set(encoded.columns) == {order, codes}:
        return done
    return encoded.join(done.drop(codes), order)


def collision_groups(encoded: DataFrame, order: str, codes: str = "codes") -> DataFrame:
    """(codes, n, members): the sorted positions of each group of two or more."""
    groups = encoded.groupBy(codes).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(order)).alias("members"))
    return groups.where("n > 1")


def ambiguity_stats(encoded: DataFrame, codes: str = "codes") -> DataFrame:
    """One row: documents, distinct ids, largest group (1 if empty), documents per id."""
    sizes = encoded.groupBy(codes).agg(F.count(F.lit(1)).alias("n"))
    docs, unique = F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.count(F.lit(1)).cast("long")
    return sizes.agg(docs.alias("num_docs"), unique.alias("num_unique_docids"), F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("max_docs_sharing_one_docid"), (docs / F.greatest(unique, F.lit(1))).alias("avg_docs_per_docid"))


def subspace_usage(encoded: DataFrame, subspaces: int, codes_per_subspace: int) -> DataFrame:
    """Per subspace: used codes, their share, largest and smallest cluster among used codes."""
    usage = code_usage(encoded, subspaces)
    used = F.count(F.lit(1))
    return usage.groupBy(F.col("m").alias("subspace")).agg(used.cast("long").alias("used_codes"), (used / codes_per_subspace).alias("fraction_used"), F.max("n").cast("long").alias("max_cluster_size"), F.min("n").cast("long").alias("min_cluster_size"))


def full_stats(encoded: DataFrame, subspaces: int, codes_per_subspace: int) -> DataFrame:
    """The nested statistics record; an empty input gives zeros and no subspaces."""
    each = subspace_usage(encoded, subspaces, codes_per_subspace).agg(F.array_sort(F.collect_list(F.struct("subspace", "used_codes", "fraction_used", "max_cluster_size", "min_cluster_size"))).alias("per_subspace_usage"))
    return ambiguity_stats(encoded).join(each)  # both are one row


def id_tokens(ids: DataFrame, id_codes: str = "id_codes") -> DataFrame:
    """Distinct (lvl, code) that ids use."""
    return ids.select(F.posexplode(id_codes).alias("lvl", "code")).distinct()


def disambiguated_count(ids: DataFrame, subspaces: int, id_codes: str = "id_codes") -> DataFrame:
    """One row: how many ids needed an ordinal (all members of a colliding group)."""
    return ids.agg(F.count_if(F.size(id_codes) > subspaces).alias("needing_disambiguation"), F.count(F.lit(1)).alias("total"))


def missing_from_vocabulary(ids: DataFrame, levels: int, codes: int, id_codes: str = "id_codes") -> DataFrame:
    """Used (lvl, code) pairs that the vocabulary lacks."""
    return id_tokens(ids, id_codes).join(vocabulary(ids.sparkSession, levels, codes).select("lvl", "code"), ["lvl", "code"], "left_anti")


def with_docid(ids: DataFrame, id_codes: str = "id_codes") -> DataFrame:
    """Add (or overwrite) ``doc_id``, the semantic id string."""
    return ids.withColumn("doc_id", semantic_docid(F.col(id_codes)))
