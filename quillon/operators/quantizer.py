"""Product quantizer: codes of vectors, their reconstruction, usage and entropy.

A codebook is a table (m, code, centroid).  Its size is subspaces x codes rows,
both fixed by the IdSpec, so it is collected (within a checked bound) for the
Arrow kernel and broadcast for the relational form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import IdSpec

#: A codebook holds at most this many numbers; beyond it, encoding is refused rather than broadcast.
MOST_NUMBERS = 16_000_000
# Fixed value: keeps the logarithm of an unused code finite.
EPSILON = 1e-10


def subspace_rows(df: DataFrame, spec: IdSpec, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, m, x): the parts of each vector; vectors of another dimension raise."""
    v = V.doubles(F.col(vector_col))
    checked = F.when(F.size(v) == spec.dim, v).otherwise(F.raise_error(F.lit(f"vectors need {spec.dim} components")).cast("array<double>"))
    return df.select(F.col(id_col), F.inline(V.subvectors(checked, spec.subspaces, spec.width)))


def codebook_from_vectors(df: DataFrame, spec: IdSpec, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A codebook whose code k is the vector with id k."""
    first = df.where((F.col(id_col) >= 0) & (F.col(id_col) < spec.codes))
    return subspace_rows(first, spec, id_col, vector_col).select("m", F.col(id_col).cast("int").alias("code"), F.col("x").alias("centroid"))


def codebook_array(codebook: DataFrame, spec: IdSpec) -> np.ndarray:
    """[m, code, component]; codes that the table lacks are infinitely far."""
    if spec.codes * spec.dim > MOST_NUMBERS:
        raise ValueError("the codebook is beyond the bound for broadcasting")
    out = np.full((spec.subspaces, spec.codes, spec.width), np.inf)
    for r in codebook.limit(spec.subspaces * spec.codes + 1).collect():
        out[r["m"], r["code"]] = r["centroid"]
    return out


def nearest(book: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Nearest code per subspace, the lowest at ties; x: [row, m, component]."""
    out = np.empty(x.shape[:2], np.int32)
    for m in range(book.shape[0]):
        for at in range(0, len(x), 1024):  # bounds the distance table
            d = ((x[at : at + 1024, m, None, :] - book[m][None]) ** 2).sum(axis=2)
            out[at : at + 1024, m] = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
    return out


def encode(df: DataFrame, codebook: DataFrame, spec: IdSpec, vector_col: str = "embedding", normalise: bool = False, rotation: np.ndarray | None = None) -> DataFrame:
    """Add ``codes``: the nearest centroid (as stored) of each subspace, by an Arrow kernel.

    A null vector has no codes (an empty array); one of another dimension raises.
    """
    book = df.sparkSession.sparkContext.broadcast(codebook_array(codebook, spec))
    turn = None if rotation is None else df.sparkSession.sparkContext.broadcast(np.asarray(rotation, float))

    @F.pandas_udf("array<int>")
    def codes(v: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(v)  # a list: a Series takes an array of one code for the code
        there = v.notna().to_numpy()
        if there.any():
            if wrong := {len(x) for x in v[there]} - {spec.dim}:
                raise ValueError(f"vectors need {spec.dim} components, not {min(wrong)}")
            x = preprocess(np.stack(v[there].to_numpy()).astype(np.float64), normalise, None if turn is None else turn.value)
            found = nearest(book.value, x.reshape(len(x), spec.subspaces, spec.width))
            for i, codes in zip(np.flatnonzero(there).tolist(), found, strict=True):
                out[i] = codes
        return pd.Series(out, dtype=object)

    # never null, so that a later join doesn't add a filter that evaluates the kernel once more
    return df.withColumn("codes", F.coalesce(codes(F.col(vector_col)), F.array().cast("array<int>")))


def preprocess(x: np.ndarray, normalise: bool, rotation: np.ndarray | None) -> np.ndarray:
    """L2 normalisation, then rotation (rows times the transposed matrix)."""
    if normalise:
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), V.TINY)
    return x if rotation is None else x @ rotation.T


def random_rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode_relational(df: DataFrame, codebook: DataFrame, spec: IdSpec, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, codes) by a join and a minimum; for small codebooks, all in the JVM."""
    best = (
        subspace_rows(df, spec, id_col, vector_col).join(F.broadcast(codebook), "m")
        .groupBy(id_col, "m").agg(F.min(F.struct(V.squared_distance(F.col("x"), F.col("centroid")).alias("d"), "code"))["code"].alias("code"))
    )
    return best.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "code"))), lambda x: x["code"]).alias("codes"))


def gumbel(seed: int, *keys: Column) -> Column:
    """Gumbel noise by a hash of the keys: it doesn't depend on how rows are partitioned, and repeats."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.ln(-F.ln(u))


def assignments(df: DataFrame, codebook: DataFrame, spec: IdSpec, temperature: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", normalise_codewords: bool = True, seed: int | None = None) -> DataFrame:
    """Soft assignment: (id, m, code, p), a softmax over -distance / temperature squared, with a seed over Gumbel noise / temperature more.

    The temperature counts twice: once in the logits and once in the softmax.
    """
    if normalise_codewords:
        codebook = codebook.withColumn("centroid", V.l2_normalised(F.col("centroid")))
    logit = -V.squared_distance(F.col("x"), F.col("centroid")) / (temperature * temperature)
    if seed is not None:
        logit = logit + gumbel(seed, F.col(id_col), F.col("m"), F.col("code")) / temperature
    logits = subspace_rows(df, spec, id_col, vector_col).join(F.broadcast(codebook), "m").select(id_col, "m", "code", logit.alias("l"))
    each = logits.groupBy(id_col, "m").agg(F.max("l").alias("top"), F.collect_list(F.struct("code", "l")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x["l"] - F.col("top")))
    return each.select(id_col, "m", F.inline(F.transform("all", lambda x: F.struct(x["code"].alias("code"), (F.exp(x["l"] - F.col("top")) / total).alias("p")))))


def forward(df: DataFrame, codebook: DataFrame, spec: IdSpec, temperature: float = 1.0, hard: bool = False, seed: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, codes, quantized): the likeliest code per subspace, the lowest at ties, and the mixture of normalised codewords.

    ``hard`` takes the likeliest codeword alone; with a seed, codes are sampled.  An
    empty table gives no rows.
    """
    soft = assignments(df, codebook, spec, temperature, id_col, vector_col, seed=seed)
    book = codebook.select("m", "code", V.l2_normalised(F.col("centroid")).alias("w"))
    parts = soft.join(F.broadcast(book), ["m", "code"]).groupBy(id_col, "m").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "code", "w"))).alias("all"))
    none = F.array_repeat(F.lit(0.0), spec.width)
    mixed = F.aggregate("all", none, lambda s, x: F.zip_with(s, x["w"], lambda a, b: a - x["q"] * b))
    best = F.col("all")[0]
    one = parts.select(id_col, F.struct("m", best["code"].alias("code"), (best["w"] if hard else mixed).alias("v")).alias("part"))
    rows = one.groupBy(id_col).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return rows.select(id_col, F.transform("parts", lambda x: x["code"]).alias("codes"), F.flatten(F.transform("parts", lambda x: x["v"])).alias("quantized"))


def refine_codebook(df: DataFrame, codebook: DataFrame, spec: IdSpec, steps: int = 1, vector_col: str = "embedding") -> DataFrame:
    """Move every codeword to the mean of all the subvectors whose nearest it is, ``steps`` times.

    Codewords that nothing is nearest to stay; null vectors are left out.  A step
    reads the whole table once and shuffles partial means; the codebook, within its
    checked bound, comes to the driver.
    """
    for _ in range(steps):
        parts = encode(df, codebook, spec, vector_col).select("codes", V.doubles(F.col(vector_col)).alias("x")).where(F.size("codes") > 0)
        paired = parts.select(F.inline(F.zip_with(V.subvectors(F.col("x"), spec.subspaces, spec.width), "codes", lambda p, c: F.struct(p["m"].alias("m"), c.alias("code"), p["x"].alias("v")))))
        means = paired.groupBy("m", "code").agg(F.array(*(F.avg(F.col("v")[i]) for i in range(spec.width))).alias("mean"))
        moved = codebook.join(means, ["m", "code"], "left").select("m", "code", F.coalesce("mean", "centroid").alias("centroid"))
        rows = moved.limit(spec.subspaces * spec.codes).collect()
        codebook = df.sparkSession.createDataFrame(rows, "m int, code int, centroid array<double>")
    return codebook


def reconstruct(encoded: DataFrame, codebook: DataFrame, spec: IdSpec) -> DataFrame:
    """Add ``quantized``: the centroids of each row's codes, laid end to end."""
    book = codebook_array(codebook, spec)
    literal = F.array(*(F.array(*(F.array(*map(F.lit, map(float, book[m, c]))) for c in range(spec.codes))) for m in range(spec.subspaces))) if spec.codes * spec.dim <= 4096 else None
    if literal is not None:
        return encoded.withColumn("quantized", F.flatten(F.transform("codes", lambda c, m: literal[m][c])))
    shared = encoded.sparkSession.sparkContext.broadcast(book)

    @F.pandas_udf("array<double>")
    def looked_up(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: np.concatenate([shared.value[m, x] for m, x in enumerate(c)]))

    return encoded.withColumn("quantized", looked_up("codes"))


def mean_squared_error(encoded: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: the mean over all components."""
    total = F.sum(V.squared_distance(V.doubles(F.col(vector_col)), F.col("quantized")))
    return encoded.agg((total / F.sum(F.size("quantized"))).alias("mse"))


def code_usage(encoded: DataFrame, subspaces: int) -> DataFrame:
    """(m, code, n) of hard codes."""
    return encoded.select(F.posexplode("codes").alias("m", "code")).where(F.col("m") < subspaces).groupBy("m", "code").agg(F.count(F.lit(1)).alias("n"))


def usage_entropy(usage: DataFrame, share: Column | None = None) -> DataFrame:
    """One row ``diversity_loss``: minus the mean over subspaces of the entropy of mean code usage.

    usage: (m, code, n) or any weight n of a code; unused codes add nothing.
    """
    totals = usage.groupBy("m").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    each = usage.join(F.broadcast(totals), "m").groupBy("m").agg((-F.sum(p * F.ln(p + EPSILON))).alias("entropy"))  # totals: one row per subspace
    return each.agg((-F.avg("entropy")).alias("diversity_loss"))


def kmeans_codebook(df: DataFrame, spec: IdSpec, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 12_800, seeds: tuple[int, ...] = tuple(range(42, 52)), normalise: bool = False) -> DataFrame:
    """A codebook by k-means per subspace on a bounded sample, the best of several seeds.

    The sample is the rows with the smallest hashes of their id, so it doesn't
    depend on how rows are partitioned.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    picked = df.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    if normalise:
        picked = picked.withColumn(vector_col, V.l2_normalised(V.doubles(F.col(vector_col))))
    parts = subspace_rows(picked, spec, id_col, vector_col).select(id_col, "m", array_to_vector("x").alias("features")).cache()
    rows: list[tuple[int, int, list[float]]] = []
    for m in range(spec.subspaces):
        own = parts.where(F.col("m") == m)
        fitted = min((KMeans(k=spec.codes, seed=s, maxIter=20).fit(own) for s in seeds), key=lambda f: f.summary.trainingCost)
        rows += [(m, c, [float(x) for x in v]) for c, v in enumerate(fitted.clusterCenters())]
    parts.unpersist()
    return df.sparkSession.createDataFrame(rows, "m int, code int, centroid array<double>")
