"""Evaluate constrained generation on a test set in one plan, metrics included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_docid, question
from ..operators import beam, chat, metrics, splits


def test_questions(items: DataFrame, max_samples: int | None = None) -> DataFrame:
    """(ord, question, golden) of test items in either form, with the prefix that evaluation adds."""
    return chat.question_and_answer(splits.head(items, max_samples)).select("ord", question(F.col("question")).alias("question"), "golden")


def judge(tests: DataFrame, generated: DataFrame) -> DataFrame:
    """Join generated (query, rank, text) rows to tests by ``ord``, clean them, and judge hits and running rates.

    A test without any generated text counts as missed, with no beams.
    """
    cleaned = generated.withColumn("doc_id", clean_docid(F.col("text")))
    beams = beam.check_beams(beam.collect_beams(cleaned)).withColumnRenamed("query", "ord")
    answered = tests.join(beams, "ord", "left").withColumn("beams", F.coalesce("beams", F.array().cast("array<string>")))
    return metrics.running_rates(metrics.hits(answered), "ord", {"running_hit_at_1": F.col("hit_at_1").cast("double"), "running_hit_at_10": F.col("hit_at_10").cast("double")})


def evaluate(tests: DataFrame, generated: DataFrame, ks: tuple[int, ...] = (1, 10), table: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(result document, metrics in long form).

    table: where to write the judged predictions, a row each; both results are then
    made from it, so that nothing is generated or judged twice.
    """
    judged = judge(tests, generated)
    if table is not None:
        judged.write.parquet(table)
        judged = tests.sparkSession.read.parquet(table)
    return metrics.result_document(metrics.prediction_rows(judged)), metrics.metrics(judged, ks)
