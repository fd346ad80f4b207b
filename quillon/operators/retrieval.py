"""Dense and lexical retrieval with several query texts (beams) per question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

PER_BEAM = 5
TOP_K = 5
#: Vectors in a block of queries, and of catalog rows.
BLOCK, CATALOG_BLOCK = 4096, 65_536
#: Distinct asked terms that are broadcast at most.
MOST_TERMS = 1_000_000
# The parameters of the lexical score.
K1, B, FLOOR = 1.5, 0.75, 0.25


def merge(found: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(qid, doc, score, rk): positive scores, the best per document over beams, the top_k of each question."""
    best = found.where("score > 0").groupBy("qid", "doc").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    return best.withColumn("rk", place).where(F.col("rk") <= top_k)


def per_beam_top(found: DataFrame, n: int = PER_BEAM) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid", "beam").orderBy(F.desc("score"), "doc"))
    return found.withColumn("r", place).where(F.col("r") <= n).drop("r")


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf[["a", "b"]].to_numpy(np.int64)
    m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "dim": [m.shape[1]], "ids": [ids.tobytes()], "m": [m.tobytes()]})


def _blocks(df: DataFrame, a: str, b: str, v: str, n: int) -> DataFrame:
    """Vectors of a length packed into n blocks by a hash of their ids; null and empty ones fall away."""
    rows = df.where(F.size(v) > 0).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(v).cast("array<double>").alias("v"))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("a", "b"), F.lit(n)), "dim": F.size("v")})
    return rows.groupBy("block", "dim").applyInPandas(_pack, "block long, dim long, ids binary, m binary")


def _to_each(blocks: DataFrame, n: int) -> DataFrame:
    """Every block beside each number below n."""
    return blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def _products(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, qi, qm, ci, cm in zip(pdf["dim"], pdf["qi"], pdf["qm"], pdf["ids"], pdf["m"], strict=True):
                q, c = np.frombuffer(qm).reshape(-1, dim), np.frombuffer(cm).reshape(-1, dim)
                beams, docs = np.frombuffer(qi, np.int64).reshape(-1, 2), np.frombuffer(ci, np.int64).reshape(-1, 2)[:, 0]
                for at in range(0, len(q), 128):  # bounds the products in memory
                    s = np.round(q[at : at + 128] @ c.T, 9)
                    keep = s >= (np.partition(s, -n, axis=1)[:, -n, None] if s.shape[1] > n else -np.inf)
                    i, j = np.nonzero(keep)
                    own = beams[at : at + 128]
                    yield pd.DataFrame({"qid": own[i, 0], "beam": own[i, 1], "doc": docs[j], "score": s[i, j]})

    return run


def dense_retrieve(queries: DataFrame, catalog: DataFrame, top_k: int = TOP_K, per_beam: int = PER_BEAM) -> DataFrame:
    """Dense retrieval of questions with several vectors each.

    queries: (qid, beam, v); catalog: (doc, v); all long ids.  Products are taken block
    by block, and only the best of a pair of blocks leave it.  Each block of one side is
    sent to every block of the other, on the side where that moves fewer vectors.
    Scores are rounded to nine places, ties go to the smaller document; a catalog with
    fewer rows than asked for gives them all; vectors of different lengths aren't
    compared, null and empty ones take no part.
    """
    n_queries, n_docs = queries.count(), catalog.count()
    query_blocks, doc_blocks = max(1, -(-n_queries // BLOCK)), max(1, -(-n_docs // CATALOG_BLOCK))
    q = _blocks(queries, "qid", "beam", "v", query_blocks).withColumnsRenamed({"ids": "qi", "m": "qm"})
    c = _blocks(catalog, "doc", "doc", "v", doc_blocks)
    if n_queries * doc_blocks <= n_docs * query_blocks:
        q = _to_each(q, doc_blocks)
    else:
        c = _to_each(c, query_blocks)
    found = q.join(c, ["block", "dim"]).select("dim", "qi", "qm", "ids", "m").mapInPandas(_products(per_beam), "qid long, beam long, doc long, score double")
    return merge(per_beam_top(found, per_beam), top_k)


def document_frequencies(catalog: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): distinct words of each row, counted before they are shuffled."""
    return catalog.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_counts(catalog: DataFrame, asked: DataFrame | None = None, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, term, f, dl): postings with the document's length; with ``asked`` (term), of those terms only."""
    w = words(F.col(text))
    split = catalog.select(F.col(doc).alias("doc"), w.alias("w")).select("doc", F.size("w").alias("dl"), "w")  # once a row, not once a word
    found = split.select("doc", "dl", F.explode("w").alias("term"))
    if asked is not None:
        found = found.join(asked, "term", "left_semi")
    return found.groupBy("doc", "term", "dl").agg(F.count(F.lit(1)).alias("f"))


def lexical_retrieve(queries: DataFrame, catalog: DataFrame, top_k: int = TOP_K, per_beam: int = PER_BEAM) -> DataFrame:
    """Okapi BM25 retrieval: (qid, doc, score, rk).

    queries: (qid, beam, text); catalog: (doc, text).  Terms in more than half of
    the documents get FLOOR times the mean inverse frequency.  Document frequencies are
    counted per row, and postings are made only for terms that some query has; these are
    broadcast up to MOST_TERMS.  A frequent term's postings are a skewed inner join.
    """
    lengths = catalog.select(F.size(words(F.col("text"))).alias("dl"))
    size = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    df = document_frequencies(catalog).join(F.broadcast(size)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    asked = queries.select("qid", "beam", F.explode(words(F.col("text"))).alias("term")).groupBy("qid", "beam", "term").agg(F.count(F.lit(1)).alias("qf"))
    terms = asked.select("term").distinct()
    if terms.count() <= MOST_TERMS:
        terms = F.broadcast(terms)
    mean = df.agg(F.avg("idf").alias("mean"))  # one row
    idf = F.when(F.col("idf") < 0, FLOOR * F.col("mean")).otherwise(F.col("idf"))
    weights = df.join(terms, "term", "left_semi").join(F.broadcast(mean)).select("term", idf.alias("idf"), "avgdl")
    f = F.col("f")
    gain = F.col("qf") * F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = asked.join(weights, "term").join(term_counts(catalog, terms), "term").groupBy("qid", "beam", "doc").agg(F.round(F.sum(gain), 9).alias("score"))
    return merge(per_beam_top(scored, per_beam), top_k)
