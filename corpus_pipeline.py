"""The training-data pipeline over ``documents``: five stages, each written and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; all but the last return the columns of ``documents``, those with clashing
names included.  In all stages null texts count as empty, long texts are taken whole,
ids may be null or repeated, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import mixing, quality, sharding, shared, simhash
from quillon.llm.decontaminate import find_contamination


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score below 0.5) go.

    Null and empty texts have the score of size zero; equal texts have equal fates; a
    label of a null id is not used.
    """
    model = quality.fit(docs, shared.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    The row of the smallest id stays, null before all; null, empty and wordless texts are
    one group; of rows that repeat one stays, as they are each other's copies.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go.

    Rows are judged one by one, whatever their ids; texts without words stay, and an
    empty benchmark removes nothing.
    """
    shared.prepare(spark)
    numbered, row = shared.number_rows(docs)  # ids may be null or repeated
    found = find_contamination(numbered.select(row, "text"), shared.table(spark, sf_dir, "benchmark"), doc_id=row, window=10)
    hit = found.where(F.size("hit_words") > 0).select(F.col("doc_id").alias(row))
    return shared.without(numbered, row, hit).select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with their rate, at most 1, so that clean, toxic and low domains near their target weights; no surely clean one goes.

    Equal ids have equal draws, rows without id are drawn by their text; without labels
    all stay that the domains' equal shares let stay.
    """
    return mixing.choose(docs, mixing.quality_domains(shared.table(spark, sf_dir, "labels")), mixing.TARGETS, keep="clean")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards by jump consistent hashing of the id; null ids are in the shard of id 0, each row has a slot of its own."""
    return sharding.assign_shards(docs, shards=16)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: The classifiers and the fingerprints can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs, last = shared.table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        before, path = shared.made(), shared.work_dir(spark, "stage")
        docs = shared.write_and_read(stage(spark, docs, sf_dir), "stage", path)
        shared.free([x for x in shared.made() if x not in before and x != path] + last)  # nothing after reads them
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
