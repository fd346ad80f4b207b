"""The set of valid ids as relations: trie edges and nodes, masks, catalog filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a row as one to index.
INDEXING = "indexing"
DOCUMENT = "document"


def is_indexing(keys: Column, operation: Column, text: Column) -> Column:
    """Whether a record belongs to the catalog.

    A record that has the key ``operation`` (even null) is judged by its value, any
    other by whether its text is ``document`` up to the first colon.
    """
    has = F.array_contains(keys, "operation")
    return F.coalesce(F.when(has, operation == INDEXING).otherwise(F.split(text, ":")[0] == DOCUMENT), F.lit(False))


def edges(ids: DataFrame, codes: str = "id_codes") -> DataFrame:
    """Distinct (prefix, token, lvl) edges; ids that repeat add nothing."""
    c = F.col(codes)
    steps = F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(F.slice(c, 1, i - 1).alias("prefix"), F.element_at(c, i).alias("token"), (i - 1).cast("int").alias("lvl")))
    return ids.where(F.size(c) > 0).select(F.inline(steps)).distinct()


def nodes(ids: DataFrame, codes: str = "id_codes") -> DataFrame:
    """(node, lvl, is_end, children): every prefix, whether an id ends there, and its number of children."""
    e = edges(ids, codes)
    children = e.groupBy(F.col("prefix").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.lit(False).alias("is_end"))
    ends = ids.select(F.col(codes).alias("node")).distinct().withColumns({"children": F.lit(0).cast("long"), "is_end": F.lit(True)})
    both = children.unionByName(ends).groupBy("node").agg(F.sum("children").alias("children"), F.max("is_end").alias("is_end"))
    return both.select("node", F.size("node").alias("lvl"), "is_end", "children")


def allowed(prefixes: DataFrame, trie: DataFrame, prefix: str = "prefix") -> DataFrame:
    """The mask of each generated prefix: (prefix, token), with a null token for end-of-id.

    An inner node allows its children only, a leaf or an unknown prefix only the end.
    """
    e = trie.select(F.col("prefix").alias("__from"), "token")
    return prefixes.select(F.col(prefix).alias("prefix")).distinct().join(e, F.col("prefix") == F.col("__from"), "left").select("prefix", "token")


def valid_prefixes(prefixes: DataFrame, trie: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Prefixes that lead to a node (the empty one does if there is any edge or nothing at all)."""
    reached = trie.select(F.concat(F.col("prefix"), F.array("token")).alias("__node")).unionByName(trie.select(F.col("prefix").alias("__node"))).distinct()
    return prefixes.join(reached, F.col(prefix) == F.col("__node"), "left_semi")


def violations(ids: DataFrame, codes: str = "id_codes") -> DataFrame:
    """Ids that are strict prefixes of others; the mask could never end on them."""
    inner = edges(ids, codes).select(F.col("prefix").alias("__node")).distinct()
    return ids.join(inner, F.col(codes) == F.col("__node"), "left_semi").select(codes).distinct()
