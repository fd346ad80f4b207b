"""Command line: ``python -m quillon.cli {ids,split,chat,infer,evaluate,metrics} ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("quillon")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon")
    sub = p.add_subparsers(dest="command", required=True)
    ids = sub.add_parser("ids", help="items with semantic ids, from vectors of the same positions")
    ids.add_argument("--items", "--all_items_path", required=True, help="JSON lines")
    ids.add_argument("--vectors", required=True, help="Parquet of (ord, embedding)")
    ids.add_argument("--codes", "--semid_code_path", required=True, help="where codes are kept, and reused if there")
    ids.add_argument("--out", required=True)
    ids.add_argument("--dim", type=int, default=64)
    ids.add_argument("--subspaces", type=int, default=4)
    ids.add_argument("--codes-per-subspace", type=int, default=256)
    split = sub.add_parser("split", help="documents and questions to train, test and icl_test")
    split.add_argument("--items", required=True)
    split.add_argument("--queries", required=True)
    split.add_argument("--out", required=True)
    chat = sub.add_parser("chat", help="rows of a split to chat records")
    chat.add_argument("--input", "--input_path", required=True)
    chat.add_argument("--dataset_name", help="accepted, not used")
    chat.add_argument("--out", required=True)
    infer = sub.add_parser("infer", help="ids for one question (--input, which wins) or for a test file (--evaluate)")
    infer.add_argument("--train_file", required=True, help="JSON lines whose indexed rows are the valid ids")
    infer.add_argument("--scores", required=True, help="Parquet of (prompt, lvl, token, s): a language model's scores")
    infer.add_argument("--input", help="the question")
    infer.add_argument("--evaluate", action="store_true")
    infer.add_argument("--test_file", help="JSON lines, flat or chat records")
    infer.add_argument("--max_samples", type=int)
    infer.add_argument("--output_file", help="result document; if it is there, only its metrics are worked out")
    evaluate = sub.add_parser("evaluate", help="judge generated texts of test items")
    evaluate.add_argument("--tests", required=True, help="JSON lines, flat or chat records")
    evaluate.add_argument("--generated", required=True, help="Parquet of (query, rank, text)")
    evaluate.add_argument("--max-samples", type=int)
    evaluate.add_argument("--out", required=True)
    metrics = sub.add_parser("metrics", help="metrics of a result document")
    metrics.add_argument("--results", required=True)
    metrics.add_argument("--k", type=int, nargs="+", default=[1, 10])
    return p


def _evaluate(spark: SparkSession, tests: DataFrame, generated: DataFrame, out: str) -> DataFrame:
    """Write the judged rows (beside ``out``) and the result document; metrics with as large a k as there are tests."""
    from .operators.metrics import metrics, prediction_rows, result_document
    from .plans.evaluation import judge
    from .sources.files import write_results

    judge(tests, generated).write.parquet(f"{out.rstrip('/')}_rows")
    judged = spark.read.parquet(f"{out.rstrip('/')}_rows")
    write_results(result_document(prediction_rows(judged)), out)
    return metrics(judged, check=False)


def _metrics(spark: SparkSession, path: str, ks: list[int]) -> None:
    from .operators.metrics import metrics
    from .sources.files import read_results

    rows = read_results(spark, path).withColumnsRenamed({"predicted_docid": "beams", "true_docid": "golden"})
    metrics(rows, tuple(ks)).show()


def _infer(spark: SparkSession, args: argparse.Namespace) -> int:
    from .functions.docids import docid_codes
    from .operators import trie
    from .plans.evaluation import test_questions
    from .plans.generation import generate_ids
    from .schema import ITEM, TEST_ITEM
    from .sources.files import path_exists, read_jsonl, read_jsonl_with_keys

    if args.input is None and not args.evaluate:
        log.error("one of --input and --evaluate is needed")
        return 1
    if args.input is None and args.output_file and path_exists(spark, args.output_file):
        _metrics(spark, args.output_file, [1, 10])
        return 0
    items = read_jsonl_with_keys(spark, args.train_file, ITEM)
    ids = items.where(trie.is_indexing(F.col("keys"), F.col("operation"), F.col("text"))).select(docid_codes(F.col("doc_id")).alias("id_codes"))
    levels = ids.agg(F.coalesce(F.max(F.size("id_codes")), F.lit(0))).first()[0]
    scores = spark.read.parquet(args.scores)
    scorer = lambda asked: asked.join(scores, "prompt").drop("prompt")
    if args.input is not None:
        found = generate_ids(spark.createDataFrame([(0, args.input)], "query long, text string"), trie.edges(ids), scorer, levels)
        for r in found.orderBy("rank").select("doc_id").collect():  # as many as beams
            print(r["doc_id"])
        return 0
    tests = test_questions(read_jsonl(spark, args.test_file, TEST_ITEM), args.max_samples)
    found = generate_ids(tests.select(F.col("ord").alias("query"), F.col("question").alias("text")), trie.edges(ids), scorer, levels)
    _evaluate(spark, tests, found.select("query", "rank", "text"), args.output_file).show()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "ids":
        from .operators.quantizer import kmeans_codebook
        from .plans.semantic_ids import generate
        from .schema import IdSpec

        spec, vectors = IdSpec(args.dim, args.subspaces, args.codes_per_subspace), spark.read.parquet(args.vectors)
        generate(spark, args.items, args.codes, args.out, lambda _: vectors, kmeans_codebook(vectors, spec, "ord"), spec)
    elif args.command == "infer":
        return _infer(spark, args)
    elif args.command == "evaluate":
        from .plans.evaluation import test_questions
        from .schema import TEST_ITEM
        from .sources.files import read_jsonl

        _evaluate(spark, test_questions(read_jsonl(spark, args.tests, TEST_ITEM), args.max_samples), spark.read.parquet(args.generated), args.out).show()
    elif args.command == "split":
        from .plans.datasets import assemble

        assemble(spark, args.items, args.queries, args.out)
    elif args.command == "chat":
        from .plans.datasets import chat_records

        chat_records(spark, args.input, args.out)
    else:
        _metrics(spark, args.results, args.k)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
