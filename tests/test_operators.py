"""Hand-computed rows for each operator, and properties."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions import docids, text, vectors
from quillon.operators import beam, chat, collisions, metrics, quantizer, retrieval, splits, trie
from quillon.plans import datasets, evaluation, semantic_ids
from quillon.schema import CHAT, ITEM, TEST_ITEM, IdSpec
from quillon.sources import files
from quillon.streaming import online


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("<|d0_1|> <|d1_2|><|im_end|>", "<|d0_1|> <|d1_2|>"),
        ("<think>x</think> <|d0_1|>", ""),
        ("<think>x</think>42", "42"),
        ("<think> open <|d0_1|>", "<|d0_1|>"),
        ("<|42|>", "42"),
        ("<|d_bad|> ", "<|d_bad|>"),
        ("   7 </s>", "7"),
        ("", ""),
    ],
)
def test_clean_docid(spark, raw, cleaned):
    assert one(spark, text.clean_docid(F.col("s")), s=raw) == cleaned


def test_text_projections(spark):
    assert one(spark, text.document_text(F.col("s")), s="document: a: b") == " a"
    assert one(spark, text.document_text(F.col("s")), s="none") is None
    assert one(spark, text.embedding_text("data/amazon-NQ", F.col("s"), F.col("d")), s="a:b", d="desc") == "desc"
    with pytest.raises(ValueError):
        text.embedding_text("other", F.col("s"))
    assert one(spark, text.chat_prompt(text.question(F.col("s"))), s="q?") == "<|im_start|>user\nquestion: q?<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, text.words(F.col("s")), s=" The  CAT\tsat ") == ["the", "cat", "sat"]
    assert one(spark, text.words(F.col("s")), s=" ") == []


def test_docid_strings(spark):
    df = spark.createDataFrame([([7, 1234],)], "codes array<int>")
    row = df.select(docids.semantic_docid(F.col("codes")).alias("a"), docids.padded_docid(F.col("codes")).alias("b")).first()
    assert row["a"] == "<|d0_7|> <|d1_1234|>"
    assert row["b"] == "<|d0_007|><|d1_1234|>"
    back = spark.createDataFrame([(row["a"],)], "s string").select(docids.docid_codes(F.col("s")).alias("c")).first()["c"]
    assert back == [7, 1234]
    assert spark.createDataFrame([(["a", "<|d0_1|>"],), (["b"],)], "t array<string>").select(docids.is_semantic(F.col("t")).alias("x")).collect() == [(True,), (False,)]
    assert docids.vocabulary(spark, 4, 256).select("token").distinct().count() == 1024


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.dot(F.col("a"), F.col("b")).alias("dot"), vectors.squared_distance(F.col("a"), F.col("b")).alias("d"), vectors.l2_normalised(F.col("a")).alias("n")).collect()
    assert [r["dot"] for r in rows] == [7.0, 0.0]
    assert [r["d"] for r in rows] == [13.0, 5.0]
    assert rows[0]["n"] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0]


SPEC = IdSpec(dim=4, subspaces=2, codes=3)


@pytest.fixture
def coded(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    book = quantizer.codebook_from_vectors(df, SPEC)
    return df, book, np.array([v for _, v in data])


def test_encoding_agrees_with_brute_force(coded):
    df, book, x = coded
    parts = x.reshape(60, 2, 2)
    expected = {i: [int(((parts[i, m] - parts[:3, m]) ** 2).sum(axis=1).argmin()) for m in range(2)] for i in range(60)}
    assert {r["vec_id"]: r["codes"] for r in quantizer.encode(df, book, SPEC).collect()} == expected
    assert {r["vec_id"]: r["codes"] for r in quantizer.encode_relational(df, book, SPEC).collect()} == expected


def test_encoding_ties_take_the_lowest_code():
    book = np.array([[[1.0], [1.0], [0.0]]])
    assert quantizer.nearest(book, np.array([[[1.0]], [[0.5]]])).tolist() == [[0], [0]]


def test_preprocessing_and_rotation():
    turn = quantizer.random_rotation(4, 1)
    assert np.allclose(turn @ turn.T, np.eye(4))
    x = quantizer.preprocess(np.array([[3.0, 4.0, 0.0, 0.0]]), True, turn)
    assert np.isclose((x * x).sum(), 1)


def test_wrong_dimensions_raise(spark, coded):
    with pytest.raises(ValueError):
        IdSpec(dim=64, subspaces=3)
    wrong = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(PySparkException):
        quantizer.encode_relational(wrong, coded[1], SPEC).collect()


def test_soft_assignments_sum_to_one(coded):
    df, book, _ = coded
    soft = quantizer.assignments(df, book, SPEC, temperature=0.5)
    assert all(np.isclose(r["s"], 1) for r in soft.groupBy("vec_id", "m").agg(F.sum("p").alias("s")).collect())


def test_reconstruction_of_codewords_is_exact(coded):
    df, book, x = coded
    rows = quantizer.reconstruct(quantizer.encode(df.where("vec_id < 3"), book, SPEC), book, SPEC).collect()
    assert all(np.allclose(r["quantized"], x[r["vec_id"]]) for r in rows)


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_disambiguation(spark, block):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [1, 2]), (5, [1, 2])], "ord long, codes array<int>")
    ids = collisions.with_docid(collisions.disambiguate(df, "ord", block=block))
    assert {r["ord"]: r["doc_id"] for r in ids.collect()} == {0: "<|d0_1|> <|d1_2|> <|d2_0|>", 2: "<|d0_1|> <|d1_2|> <|d2_1|>", 5: "<|d0_1|> <|d1_2|> <|d2_2|>", 1: "<|d0_3|> <|d1_4|>"}
    assert trie.violations(ids).count() == 0
    assert collisions.disambiguated_count(ids, 2).first()["needing_disambiguation"] == 3


def test_statistics(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [1, 2]), (2, [0, 2])], "ord long, codes array<int>")
    row = collisions.full_stats(df, 2, 4).first()
    assert (row["num_docs"], row["num_unique_docids"], row["max_docs_sharing_one_docid"], row["avg_docs_per_docid"]) == (3, 2, 2, 1.5)
    assert [(s["subspace"], s["used_codes"], s["fraction_used"], s["max_cluster_size"], s["min_cluster_size"]) for s in row["per_subspace_usage"]] == [(0, 2, 0.5, 2, 1), (1, 1, 0.25, 3, 3)]
    empty = collisions.full_stats(df.limit(0), 2, 4).first()
    assert (empty["num_docs"], empty["max_docs_sharing_one_docid"], empty["per_subspace_usage"]) == (0, 1, [])


def test_entropy(spark):
    usage = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "m int, code int, n long")
    assert np.isclose(quantizer.usage_entropy(usage).first()[0], -np.log(2), atol=1e-6)


def test_cut_points_in_whole_numbers():
    assert splits.cut_points(10) == (9, 7, 9)
    assert splits.cut_points(90) == (81, 63, 81)
    assert splits.cut_points(0) == (0, 0, 0)


def test_split(spark):
    docs = spark.createDataFrame([(i, f"t{i}", f"document: {i}", f"d{i}") for i in range(10)], "ord long, text_id string, text string, doc_id string")
    queries = docs.select("ord", "text_id", F.concat(F.lit("q"), "text_id").alias("text"))
    rows = splits.split(docs, queries).collect()
    got = {(r["split"], r["kind"]): sorted(x["ord"] for x in rows if (x["split"], x["kind"]) == (r["split"], r["kind"])) for r in rows}
    assert got == {("train", "document"): list(range(9)), ("icl_test", "document"): [9], ("train", "query"): list(range(7)), ("test", "query"): [7, 8], ("icl_test", "query"): [9]}
    assert all(r["doc_id"] == f"d{r['ord']}" for r in rows)
    with pytest.raises(ValueError):
        splits.split(docs, queries.where("ord < 9"))
    with pytest.raises(PySparkException):
        splits.split(docs, queries.withColumn("text_id", F.lit("other"))).collect()
    assert splits.head(docs, 3).count() == 3 and splits.head(docs, 0).count() == 10 and splits.head(docs, -1).count() == 9
    assert splits.position_range(docs, 2, 5).count() == 3


def test_chat(spark):
    items = spark.createDataFrame([("q", "id")], "text string, doc_id string")
    assert json.loads(chat.to_chat(items).toJSON().first()) == {"conversations": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "id"}]}
    tests = spark.createDataFrame([("t", "d", None), (None, None, [("user", "Q"), ("assistant", "G")])], TEST_ITEM)
    assert [(r["question"], r["golden"]) for r in chat.question_and_answer(tests).collect()] == [("t", "d"), ("Q", "G")]
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "human", "h"), (1, 2, "gpt", "g"), (2, 0, "other", "x")], "conv_id long, turn long, role string, text string")
    rendered = {r["conv_id"]: r["rendered"] for r in chat.render(turns).collect()}
    assert rendered[1] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nh<|im_end|>\n<|im_start|>assistant\ng<|im_end|>\n"
    assert {(r["question"], r["answer"]) for r in chat.first_exchange(turns).collect()} == {("h", "g"), (None, None)}
    assert [r[0] for r in turns.orderBy("conv_id", "turn").select(chat.train_mask(F.col("role"))).collect()] == [False, False, True, False]
    assert chat.within_length(turns, 2).select("conv_id").collect() == [(2,)]


def test_trie(spark):
    ids = spark.createDataFrame([([1, 2, 0],), ([1, 2, 1],), ([3, 4],), ([3, 4],)], "id_codes array<int>")
    edges = trie.edges(ids)
    assert {(tuple(r["prefix"]), r["token"], r["lvl"]) for r in edges.collect()} == {((), 1, 0), ((), 3, 0), ((1,), 2, 1), ((3,), 4, 1), ((1, 2), 0, 2), ((1, 2), 1, 2)}
    nodes = {tuple(r["node"]): (r["children"], r["is_end"]) for r in trie.nodes(ids).collect()}
    assert nodes[()] == (2, False) and nodes[3, 4] == (0, True) and nodes[1, 2] == (2, False)
    prefixes = spark.createDataFrame([([],), ([1, 2],), ([3, 4],), ([9],)], "prefix array<int>")
    mask = {}
    for r in trie.allowed(prefixes, edges).collect():
        mask.setdefault(tuple(r["prefix"]), set()).add(r["token"])
    assert mask == {(): {1, 3}, (1, 2): {0, 1}, (3, 4): {None}, (9,): {None}}
    assert {tuple(r["prefix"]) for r in trie.valid_prefixes(prefixes, edges).collect()} == {(), (1, 2), (3, 4)}
    nested = spark.createDataFrame([([1],), ([1, 2],)], "id_codes array<int>")
    assert [r["id_codes"] for r in trie.violations(nested).collect()] == [[1]]


def test_catalog_filter_tells_null_from_absent(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"document: a","operation":null}\n{"text":"document: b"}\n{"text":"x","operation":"indexing"}\n{"text":"Document: c"}\n{"text":"document"}\n')
    rows = files.read_jsonl_with_keys(spark, str(tmp_path), ITEM)
    assert [r["ord"] for r in rows.where(trie.is_indexing(F.col("keys"), F.col("operation"), F.col("text"))).orderBy("ord").collect()] == [1, 2, 4]


def test_beam_search_is_exhaustive_if_wide(spark, coded):
    df, book, x = coded
    ids = collisions.disambiguate(quantizer.encode(df, book, SPEC).select("vec_id", "codes"), "vec_id")
    scores = beam.quantizer_scores(df, book, SPEC)
    found = beam.search(df, trie.edges(ids), scores, SPEC.levels, num_beams=100)
    parts = x.reshape(60, 2, 2)
    leaves = sorted({tuple(r["id_codes"]) for r in ids.collect()})
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], tuple(r["ids"]), r["score"]))
    for q in range(60):
        expected = sorted(((-sum(((parts[q, m] - parts[i[m], m]) ** 2).sum() for m in range(2)), i) for i in leaves), key=lambda t: (-round(t[0], 9), t[1]))
        ranked = sorted(got[q])
        assert [round(s, 6) for _, _, s in ranked] == [round(s, 6) for s, _ in expected]
        assert {i for _, i, _ in ranked} == set(leaves)


def test_beam_search_with_prefix_scores_and_empty_trie(spark):
    ids = spark.createDataFrame([([0, 1],), ([1, 0],)], "id_codes array<int>")
    queries = spark.createDataFrame([(7,)], "vec_id long")
    scores = spark.createDataFrame([(7, [], 0, -1.0), (7, [], 1, -2.0), (7, [0], 1, -5.0), (7, [1], 0, -1.0)], "query long, prefix array<int>, token int, s double")
    assert [(r["rank"], r["ids"], r["score"]) for r in beam.search(queries, trie.edges(ids), scores, 2).orderBy("rank").collect()] == [(1, [1, 0], -3.0), (2, [0, 1], -6.0)]
    assert [r["ids"] for r in beam.search(queries, trie.edges(ids.limit(0)), scores, 2).collect()] == [[]]


def test_single_beam_raises(spark):
    with pytest.raises(PySparkException):
        beam.check_beams(spark.createDataFrame([(1, ["a"])], "query long, beams array<string>")).collect()


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "g", "g"], "g"), (["x"], "g")], "beams array<string>, golden string")
    got = {(r["metric"], r["k"]): r["value"] for r in metrics.metrics(df, (1, 10), check=False).collect()}
    assert got == {("hits", 1): 0.0, ("hits", 10): 0.5, ("mrr", 1): 0.0, ("mrr", 10): pytest.approx(1 / 6), ("ndcg", 1): 0.0, ("ndcg", 10): 0.25}
    with pytest.raises(ValueError):
        metrics.metrics(df, (1, 10))
    assert metrics.metrics(df.limit(0), (1,), check=False).count() == 0


def test_hits_strip_but_metrics_do_not(spark):
    df = spark.createDataFrame([([" g ", "h"], "g")], "beams array<string>, golden string")
    assert metrics.hits(df).select("hit_at_1", "hit_at_10").first() == (True, True)
    assert metrics.metrics(df, (1,)).where("metric = 'hits'").first()["value"] == 0.0


@pytest.mark.parametrize("block", [1, 2, 100])
def test_running_rate(spark, block):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 0.0, 0.0, 1.0])], "ord long, v double")
    assert [r["rate"] for r in metrics.running_rate(df, "ord", "v", block=block).orderBy("ord").collect()] == [1.0, 0.5, pytest.approx(1 / 3), 0.5]


def test_dense_retrieval(spark):
    catalog = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "doc long, v array<double>")
    queries = spark.createDataFrame([(5, 0, [1.0, 0.5]), (5, 1, [0.0, 2.0])], "qid long, beam long, v array<double>")
    assert [(r["doc"], r["score"], r["rk"]) for r in retrieval.dense_retrieve(queries, catalog).orderBy("rk").collect()] == [(1, 2.0, 1), (0, 1.0, 2)]


def test_lexical_retrieval_prefers_rare_terms(spark):
    catalog = spark.createDataFrame([(0, "the cat"), (1, "the dog"), (2, "the the bird"), (3, None)], "doc long, text string")
    queries = spark.createDataFrame([(1, 0, "dog"), (2, 0, "absent")], "qid long, beam long, text string")
    assert [(r["qid"], r["doc"]) for r in retrieval.lexical_retrieve(queries, catalog).collect()] == [(1, 1)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "é: ü", "d", None, None), ("2", None, "e", "indexing", None)], ITEM).coalesce(1)
    files.write_jsonl(df, str(tmp_path / "items"))
    raw = "".join(p.read_text() for p in (tmp_path / "items").glob("part-*"))
    assert "é: ü" in raw and '"operation":null' in raw
    back = files.read_jsonl(spark, str(tmp_path / "items"), ITEM)
    assert [r["ord"] for r in back.orderBy("ord").collect()] == [0, 1]
    codes = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "ord long, codes array<int>")
    files.write_codes(codes, str(tmp_path / "codes"), 2)
    assert sorted(r["codes"] for r in files.read_codes(spark, str(tmp_path / "codes"), 2).collect()) == [[1, 2], [3, 4]]
    calls = []
    for _ in range(2):
        assert files.reuse_or_compute(spark, str(tmp_path / "kept"), lambda: calls.append(1) or codes).count() == 2
    assert len(calls) == 1


def test_positions_are_gapless_over_partitions(spark):
    df = files.with_ord(spark.range(0, 100, 1, 7))
    assert [(r["id"], r["ord"]) for r in df.orderBy("id").collect()] == [(i, i) for i in range(100)]


def test_evaluation_plan(spark, tmp_path):
    tests = evaluation.test_questions(spark.createDataFrame([(0, "q0", "<|d0_1|>", None), (1, "q1", "<|d0_9|>", None)], "ord long, text string, doc_id string, conversations array<struct<role:string,content:string>>"))
    generated = spark.createDataFrame([(0, 1, " <|d0_1|><|im_end|>"), (0, 2, "<|d0_2|>"), (1, 1, "<|d0_2|>"), (1, 2, "<|d0_3|>")], "query long, rank int, text string")
    document, long_form = evaluation.evaluate(tests, generated, (1, 2))
    row = document.first()
    assert (row["hit_at_1"], row["hit_at_1_count"], row["total"]) == (0.5, 1, 2)
    assert {(r["metric"], r["k"]): r["value"] for r in long_form.collect()}["mrr", 1] == 0.5
    files.write_results(document.coalesce(1), str(tmp_path / "r"))
    assert files.read_results(spark, str(tmp_path / "r")).count() == 2
    assert sorted(r["running_hit_at_1"] for r in evaluation.judge(tests, generated).collect()) == [0.5, 1.0]


def test_generation_and_assembly_plans(spark, coded, tmp_path):
    df, book, _ = coded
    files.write_jsonl(spark.createDataFrame([(str(i), f"document: {i}", None, None, None) for i in range(60)], ITEM).coalesce(1), str(tmp_path / "items"))
    files.write_jsonl(spark.createDataFrame([(str(i), f"what {i}") for i in range(60)], "text_id string, text string").coalesce(1), str(tmp_path / "queries"))
    encoder = lambda items: items.join(df.withColumnRenamed("vec_id", "ord"), "ord").select("ord", "embedding")
    done = semantic_ids.generate(spark, str(tmp_path / "items"), str(tmp_path / "codes"), str(tmp_path / "with_ids"), encoder, book, SPEC)
    assert done.select("doc_id").distinct().count() == 60
    rows = datasets.assemble(spark, str(tmp_path / "with_ids"), str(tmp_path / "queries"), str(tmp_path / "splits"))
    assert rows.groupBy("split").count().count() == 3
    datasets.chat_records(spark, str(tmp_path / "splits/split=test"), str(tmp_path / "chat"))
    assert spark.read.schema(CHAT).json(str(tmp_path / "chat")).count() == 12


def test_streams(spark, coded, tmp_path):
    df, book, _ = coded
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.encode_stream(stream, book, SPEC).writeStream.format("memory").queryName("codes").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["vec_id"], tuple(r["codes"])) for r in spark.table("codes").collect()} == {(r["vec_id"], tuple(r["codes"])) for r in quantizer.encode(df, book, SPEC).collect()}
    judged = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select((F.col("vec_id") % 2 == 0).alias("hit_at_1"), F.lit(True).alias("hit_at_10"))
    q = online.running_hits(judged).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").first() == (60, 0.5, 1.0)


def test_command_line(spark, coded, tmp_path):
    from quillon import cli

    df, _, _ = coded
    at = lambda name: str(tmp_path / name)
    df.withColumnRenamed("vec_id", "ord").write.parquet(at("vectors"))
    files.write_jsonl(spark.createDataFrame([(str(i), f"document: {i}", None, None, None) for i in range(60)], ITEM).coalesce(1), at("items"))
    files.write_jsonl(spark.createDataFrame([(str(i), f"what {i}") for i in range(60)], "text_id string, text string").coalesce(1), at("queries"))
    assert cli.main(["ids", "--items", at("items"), "--vectors", at("vectors"), "--codes", at("codes"), "--out", at("with_ids"), "--dim", "4", "--subspaces", "2", "--codes-per-subspace", "3"]) == 0
    assert cli.main(["split", "--items", at("with_ids"), "--queries", at("queries"), "--out", at("splits")]) == 0
    tests = files.read_jsonl(spark, at("splits/split=test"), TEST_ITEM)
    assert tests.count() == 12
    tests.select(F.col("ord").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank"), F.col("doc_id").alias("text")).write.parquet(at("generated"))
    assert cli.main(["evaluate", "--tests", at("splits/split=test"), "--generated", at("generated"), "--out", at("results")]) == 0
    assert cli.main(["metrics", "--results", at("results"), "--k", "1"]) == 0
    assert spark.read.json(at("results")).first()["hit_at_1"] == 1.0
    assert cli.main(["chat", "--input", at("splits/split=test"), "--out", at("chat")]) == 0


def test_metric_bounds_hold_on_random_rankings(spark):
    rng = np.random.default_rng(3)
    rows = [([str(x) for x in rng.permutation(12)[:10]], str(rng.integers(0, 14))) for _ in range(200)]
    got = {(r["metric"], r["k"]): r["value"] for r in metrics.metrics(spark.createDataFrame(rows, "beams array<string>, golden string"), (1, 5, 10)).collect()}
    for k in (1, 5, 10):
        assert got["mrr", k] <= got["ndcg", k] + 1e-12 <= got["hits", k] + 2e-12
        place = [b.index(g) + 1 if g in b else 99 for b, g in rows]
        assert got["hits", k] == pytest.approx(np.mean([p <= k for p in place]))
        assert got["mrr", k] == pytest.approx(np.mean([1 / p if p <= k else 0 for p in place]))
    assert got["hits", 1] <= got["hits", 5] <= got["hits", 10]


def test_splits_are_disjoint_and_complete(spark):
    for n in (0, 1, 9, 90, 101):
        docs = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("text_id"), F.lit("document: x").alias("text"), F.col("id").cast("string").alias("doc_id"))
        rows = splits.split(docs, docs.drop("doc_id")).collect()
        assert len(rows) == len({(r["kind"], r["ord"]) for r in rows}) == 2 * n
        assert {r["ord"] for r in rows if (r["split"], r["kind"]) == ("test", "query")} <= {r["ord"] for r in rows if (r["split"], r["kind"]) == ("train", "document")}


def test_hash_splits_and_orders_repeat(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    marked = splits.validation_split(df, "k", 1.0)
    n = marked.where("validation").count()
    assert 5 <= n <= 45 and marked.where("validation").collect() == splits.validation_split(df.repartition(7), "k", 1.0).where("validation").orderBy("k").collect()
    assert splits.validation_split(df, "k", 0.0).where("validation").count() == 0
    order = [r["k"] for r in splits.shuffled(df, "k", 1).collect()]
    assert sorted(order) == list(range(2000)) and order != sorted(order)
    assert order == [r["k"] for r in splits.shuffled(df.repartition(5), "k", 1).collect()]
    assert order != [r["k"] for r in splits.shuffled(df, "k", 2).collect()]


def test_report_logs_rows(spark, caplog):
    with caplog.at_level("INFO", logger="quillon"):
        files.report("ids", spark.range(3))
    assert len(caplog.records) == 3


def test_positions_follow_files_of_unequal_size(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("".join(f'{{"text_id": "a{i}"}}\n' for i in range(3)))
    (tmp_path / "in/b.jsonl").write_text("".join(f'{{"text_id": "b{i}", "text": "{"x" * 50}"}}\n\n' for i in range(4000)))
    rows = files.read_jsonl(spark, str(tmp_path / "in"), ITEM).select("ord", "text_id").collect()
    assert sorted(tuple(r) for r in rows) == list(enumerate([f"a{i}" for i in range(3)] + [f"b{i}" for i in range(4000)]))
    blocks = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cut = files.read_jsonl(spark, str(tmp_path / "in"), ITEM)
        assert cut.rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in cut.select("ord", "text_id").collect()) == sorted(tuple(r) for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", blocks)
    (tmp_path / "bad").write_text('{"text_id": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_jsonl(spark, str(tmp_path / "bad"), ITEM).collect()


def test_unknown_keys_and_nulls_survive(spark, tmp_path):
    import json

    given = [{"text_id": "1", "text": "document: é", "title": "T", "operation": None, "more": {"a": [1, None]}, "doc_id": "old"}, {"text_id": "2", "text": "document: b"}]
    (tmp_path / "items").write_text("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in given))
    codes = spark.createDataFrame([(0, [1, 2]), (1, [1, 2])], "ord long, codes array<int>")
    codes.write.parquet(str(tmp_path / "codes"))
    semantic_ids.generate(spark, str(tmp_path / "items"), str(tmp_path / "codes"), str(tmp_path / "out"), None, None, SPEC)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{**given[0], "doc_id": "<|d0_1|> <|d1_2|> <|d2_0|>"}, {**given[1], "doc_id": "<|d0_1|> <|d1_2|> <|d2_1|>"}]


def test_unanswered_tests_count_as_missed(spark, tmp_path):
    tests = spark.createDataFrame([(0, "q0", "<|d0_1|>"), (1, "q1", "<|d0_9|>")], "ord long, question string, golden string")
    generated = spark.createDataFrame([(0, 1, "<|d0_1|>"), (0, 2, "<|d0_2|>")], "query long, rank int, text string")
    document, long_form = evaluation.evaluate(tests, generated, (1,), str(tmp_path / "rows"))
    assert (document.first()["hit_at_1"], document.first()["total"]) == (0.5, 2)
    assert {r["value"] for r in long_form.collect()} == {0.5}


def test_inference_command(spark, tmp_path, capsys):
    from quillon import cli
    from quillon.functions.text import chat_prompt

    at = lambda name: str(tmp_path / name)
    ids = ["<|d0_0|> <|d1_1|>", "<|d0_1|> <|d1_0|>", "<|d0_1|> <|d1_1|>"]
    files.write_jsonl(spark.createDataFrame([(str(i), f"document: {i}", x, None, None) for i, x in enumerate(ids)], ITEM).drop("operation").coalesce(1), at("train"))
    files.write_jsonl(spark.createDataFrame([("a", ids[2], None), ("b", ids[0], None)], TEST_ITEM).coalesce(1), at("test"))
    asked = spark.createDataFrame([("a",), ("question: a",), ("question: b",)], "text string").select(chat_prompt(F.col("text")).alias("prompt"))
    tokens = spark.createDataFrame([(lvl, t, float(t)) for lvl in range(2) for t in range(2)], "lvl int, token int, s double")
    asked.crossJoin(tokens).write.parquet(at("scores"))
    common = ["infer", "--train_file", at("train"), "--scores", at("scores")]
    assert cli.main(common) == 1
    assert cli.main([*common, "--evaluate", "--input", "a"]) == 0
    assert capsys.readouterr().out.splitlines() == [ids[2], ids[0], ids[1]]
    assert cli.main([*common, "--evaluate", "--test_file", at("test"), "--output_file", at("out")]) == 0
    assert spark.read.json(at("out")).first()["hit_at_1"] == 0.5


def test_null_and_ragged_vectors(spark, coded):
    df, book, _ = coded
    rows = quantizer.encode(df.withColumn("embedding", F.when(F.col("vec_id") > 2, F.col("embedding"))), book, SPEC).collect()
    assert {r["vec_id"] for r in rows if not r["codes"]} == {0, 1, 2}
    vectors = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0]), (3, 0, None)], "qid long, beam long, v array<double>")
    catalog = spark.createDataFrame([(7, [2.0]), (8, [1.0, 1.0]), (9, None)], "doc long, v array<double>")
    assert sorted((r["qid"], r["doc"]) for r in retrieval.dense_retrieve(vectors, catalog).collect()) == [(1, 8), (2, 7)]


def test_kmeans_cost_is_near_a_brute_force_run(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    spec = IdSpec(dim=2, subspaces=1, codes=4)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    book = quantizer.codebook_array(quantizer.kmeans_codebook(df, spec), spec)[0]
    cost = lambda centres: ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
    best = np.inf
    for seed in range(10):
        centres = x[np.random.default_rng(seed).choice(len(x), 4, replace=False)]
        for _ in range(30):
            own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(4)])
        best = min(best, cost(centres))
    assert cost(book) <= 1.001 * best


def test_sampled_codes_repeat_and_follow_their_probabilities(spark):
    spec = IdSpec(dim=2, subspaces=1, codes=2)
    book = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "m int, code int, centroid array<double>")
    df = spark.createDataFrame([(i, [0.8, 0.5]) for i in range(4000)], "vec_id long, embedding array<double>")
    p = quantizer.assignments(df.limit(1), book, spec).where("code = 0").first()["p"]
    codes = [r["codes"][0] for r in quantizer.forward(df, book, spec, hard=True, seed=3).orderBy("vec_id").collect()]
    again = [r["codes"][0] for r in quantizer.forward(df.repartition(5), book, spec, seed=3).orderBy("vec_id").collect()]
    assert codes == again and abs(codes.count(0) / 4000 - p) < 0.03


def test_forward_mixes_codewords_and_breaks_ties_by_the_lowest(spark):
    spec = IdSpec(dim=2, subspaces=1, codes=2)
    book = spark.createDataFrame([(0, 0, [2.0, 0.0]), (0, 1, [0.0, 2.0])], "m int, code int, centroid array<double>")
    df = spark.createDataFrame([(0, [1.0, 1.0])], "vec_id long, embedding array<double>")
    soft, hard = (quantizer.forward(df, book, spec, hard=x).first() for x in (False, True))
    assert soft["codes"] == hard["codes"] == [0]
    assert np.allclose(soft["quantized"], [0.5, 0.5]) and hard["quantized"] == [1.0, 0.0]
    assert quantizer.forward(df.limit(0), book, spec).count() == 0


def test_refinement_lowers_the_cost_and_keeps_unused_codewords(spark):
    spec = IdSpec(dim=2, subspaces=1, codes=3)
    x = np.random.default_rng(1).normal(size=(200, 2))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(200, None)], "vec_id long, embedding array<double>")
    book = spark.createDataFrame([(0, 0, [1.0, 1.0]), (0, 1, [-1.0, 0.0]), (0, 2, [99.0, 99.0])], "m int, code int, centroid array<double>")
    centres, costs = np.array([[1.0, 1.0], [-1.0, 0.0], [99.0, 99.0]]), []
    for steps in (1, 2, 3):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(3)])
        found = quantizer.codebook_array(quantizer.refine_codebook(df, book, spec, steps), spec)[0]
        assert np.allclose(found, centres) and found[2].tolist() == [99.0, 99.0]
        costs.append(((x[:, None] - found[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert costs == sorted(costs, reverse=True)
