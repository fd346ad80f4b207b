"""Ranking metrics: hits, reciprocal rank and discounted gain at k, and running rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import quiet_columns
from ..functions.text import strip

METRICS = ("hits", "mrr", "ndcg")


def gain(metric: str, position: Column, k: Column) -> Column:
    """The metric of one query; position 0 means that the golden id isn't there."""
    value = {"hits": F.lit(1.0), "mrr": F.lit(1.0) / position, "ndcg": F.lit(1.0) / F.log2(position + 1)}[metric]
    return F.when((position >= 1) & (position <= k), value).otherwise(F.lit(0.0))


def first_rank(beams: Column, golden: Column) -> Column:
    """1-based place of the golden id, 0 if absent; repeated ids count by their first place."""
    return F.coalesce(F.array_position(beams, golden), F.lit(0))


def metrics(df: DataFrame, ks: tuple[int, ...] = (1, 10), beams: str = "beams", golden: str = "golden", check: bool = True) -> DataFrame:
    """(metric, k, value): means over all rows, compared as they are; empty input gives no rows.

    One pass: the means and the count come to the driver as one row.  With ``check``,
    a k beyond the number of queries raises, as the definition asks.
    """
    place = df.select(first_rank(F.col(beams), F.col(golden)).alias("p"))
    each = [(m, k) for m in METRICS for k in ks]
    found = place.agg(F.count(F.lit(1)).alias("n"), *(F.avg(gain(m, F.col("p"), F.lit(k))).alias(f"{m}@{k}") for m, k in each)).first()
    if check and max(ks) > found["n"]:
        raise ValueError(f"k = {max(ks)} is more than the number of queries")
    rows = [(m, k, found[f"{m}@{k}"]) for m, k in each if found["n"]]
    return df.sparkSession.createDataFrame(rows, "metric string, k int, value double")


def hits(df: DataFrame, beams: str = "beams", golden: str = "golden", deep: int = 10) -> DataFrame:
    """Add hit_at_1 and hit_at_10 on stripped strings."""
    clean = F.transform(F.col(beams), strip)
    gold = strip(F.col(golden).cast("string"))
    return df.withColumns({"hit_at_1": F.coalesce(F.get(clean, F.lit(0)) == gold, F.lit(False)), "hit_at_10": F.coalesce(F.array_contains(F.slice(clean, 1, deep), gold), F.lit(False))})


def hit_summary(df: DataFrame) -> DataFrame:
    """One row: ratios, counts and the total; ratios are null for no rows."""
    one = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    return df.agg(F.avg(F.col("hit_at_1").cast("double")).alias("hit_at_1"), F.avg(F.col("hit_at_10").cast("double")).alias("hit_at_10"), one("hit_at_1").alias("hit_at_1_count"), one("hit_at_10").alias("hit_at_10_count"), F.count(F.lit(1)).alias("total"))


def running_rates(df: DataFrame, order: str, values: dict[str, Column], block: int = 1_000_000) -> DataFrame:
    """Add the means of the values over all rows up to each row, by a unique long ``order`` that is not negative.

    Sums run within blocks of positions and are shifted by those of earlier blocks:
    the one ordered window over everything has a row per block.
    """
    at, count, base, *used = quiet_columns(df, "block", "count", "base", *(f"v{i}" for i in range(3 * len(values))))
    value, total, shift = (used[i :: 3] for i in range(3))
    rows = df.withColumns({at: F.floor(F.col(order) / block), **{v: x.cast("double") for v, x in zip(value, values.values(), strict=True)}})
    blocks = rows.groupBy(at).agg(F.count(F.lit(1)).alias(base), *(F.sum(v).alias(s) for v, s in zip(value, shift, strict=True)))
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(at, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in [base, *shift]))
    here = Window.partitionBy(at).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({count: F.count(F.lit(1)).over(here), **{t: F.sum(v).over(here) for v, t in zip(value, total, strict=True)}})
    done = ((F.col(s) + F.col(t)) / (F.col(base) + F.col(count)) for s, t in zip(shift, total, strict=True))
    return summed.join(shifts, at).select(*(f"`{c}`" for c in df.columns), *(x.alias(name) for name, x in zip(values, done, strict=True)))


def running_rate(df: DataFrame, order: str, value: str, name: str = "rate", block: int = 1_000_000) -> DataFrame:
    """Add the mean of ``value`` over all rows up to each row; see ``running_rates``."""
    return running_rates(df, order, {name: F.col(value)}, block)


def prediction_rows(df: DataFrame, text: str = "question", golden: str = "golden", beams: str = "beams") -> DataFrame:
    """Prediction records of rows that ``hits`` has judged."""
    return df.select(F.col(text).alias("text"), strip(F.col(golden).cast("string")).alias("true_docid"), F.transform(F.col(beams), strip).alias("predicted_docid"), "hit_at_1", "hit_at_10")


def result_document(predictions: DataFrame) -> DataFrame:
    """One row: the summary with all predictions nested; only for small result files, one row has to hold them."""
    return hit_summary(predictions).join(predictions.agg(F.collect_list(F.struct("text", "true_docid", "predicted_docid", "hit_at_1", "hit_at_10")).alias("predictions")))
