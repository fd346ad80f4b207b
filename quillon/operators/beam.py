"""Beam search over a trie of valid ids, all queries at once.

A scorer is a table (query, lvl, token, s): the additive score of a token at a
level, or one with ``prefix`` in place of ``lvl`` when scores depend on what was
generated.  Each level is an equi-join to the trie's edges, a join to the scores
and a per-query cut; finished beams (at leaves) are carried along unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import IdSpec

NUM_BEAMS = 10
#: A level's edges are broadcast only if the code count proves that there are no more than this.
MOST_EDGES = 65_536


def quantizer_scores(queries: DataFrame, codebook: DataFrame, spec: IdSpec, query_id: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The default scorer: minus the squared distance of the query's part to each codeword."""
    from .quantizer import subspace_rows

    parts = subspace_rows(queries, spec, query_id, vector_col).join(F.broadcast(codebook), "m")  # subspaces x codes rows
    return parts.select(F.col(query_id).alias("query"), F.col("m").alias("lvl"), F.col("code").alias("token"), (-V.squared_distance(F.col("x"), F.col("centroid"))).alias("s"))


def step(beams: DataFrame, trie: DataFrame, scores: DataFrame, lvl: int, num_beams: int, codes: int | None = None) -> DataFrame:
    """One level: extend by allowed tokens, add scores, keep the best of each query.

    With ``codes`` (codes of a level at most), the edges of the first levels have a
    proven bound and are broadcast: there, all queries share a few prefixes, and a
    shuffle would bring them together.
    """
    here = trie.where(F.col("lvl") == lvl).select(F.col("prefix").alias("ids"), "token")
    if codes is not None and codes ** (lvl + 1) <= MOST_EDGES:
        here = F.broadcast(here)
    grown = beams.join(here, "ids", "left")
    if "prefix" in scores.columns:
        by = scores.select("query", F.col("prefix").alias("ids"), "token", "s")
        scored = grown.join(by, ["query", "ids", "token"], "left")
    else:
        scored = grown.join(scores.where(F.col("lvl") == lvl).select("query", "token", "s"), ["query", "token"], "left")
    grow = F.when(F.col("token").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("token")))
    out = scored.select("query", grow.alias("ids"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "ids"))
    return out.withColumn("rank", place).where(F.col("rank") <= num_beams)


def search(queries: DataFrame, trie: DataFrame, scores: DataFrame, levels: int, num_beams: int = NUM_BEAMS, query_id: str = "vec_id", cut: Callable[[DataFrame], DataFrame] | None = None, codes: int | None = None) -> DataFrame:
    """(query, rank, ids, score): the best valid ids of each query, ties to the smaller id.

    ``levels`` is the length of the longest id, so the plan has that many joins;
    ``cut`` may cut the lineage after a level, as ``checkpoint`` does.  ``codes``
    bounds the codes of all levels but the last, whose ordinals have no bound.
    """
    beams = queries.select(F.col(query_id).alias("query"), F.array().cast("array<int>").alias("ids"), F.lit(0.0).alias("score"))
    for lvl in range(levels):
        beams = step(beams.select("query", "ids", "score"), trie, scores, lvl, num_beams, codes if lvl < levels - 1 else None)
        if cut is not None:
            beams = cut(beams)
    return beams.select("query", "rank", "ids", "score")


def collect_beams(beams: DataFrame, text: str = "doc_id") -> DataFrame:
    """(query, beams): ranked ids of each query as an array."""
    grouped = beams.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", text))).alias("all"))
    return grouped.select("query", F.transform("all", lambda x: x[text]).alias("beams"))


def check_beams(beams: DataFrame) -> DataFrame:
    """Raise where a query has exactly one beam, which evaluation takes for a wrong set-up."""
    return beams.withColumn("beams", F.when(F.size("beams") == 1, F.raise_error(F.lit("a single beam was generated")).cast("array<string>")).otherwise(F.col("beams")))
