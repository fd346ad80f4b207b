"""The pipeline's stages, one by one, on a small corpus and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path):
    def words(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    rows = [(i, words(i, 120)) for i in range(150)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in words(500 + i, 120).split())) for i in range(60)]
    rows += [(300, rows[0][1]), (301, rows[1][1]), (302, rows[2][1].replace(rows[2][1].split()[60], "other", 1))]
    rows += [(310, words(900, 60) + " " + words(1000, 20) + " " + words(901, 60))]
    rows += [(None, words(902, 50)), (320, None), (321, "")]
    labels = [(i, int(i < 200), 0) for i, _ in rows if i is not None and i < 300]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(1000, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, folder):
    docs = shared.table(spark, folder, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.write_and_read(stage(spark, docs, folder), "test")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    clean = set(range(150))
    assert len(kept[0] & clean) >= 148 and not kept[0] & set(range(200, 260))
    assert kept[1] & clean == kept[0] & clean and not kept[1] & {300, 301, 302}
    assert kept[1] - kept[2] == {310}
    assert len(kept[3] & clean) >= 0.95 * len(kept[2] & clean)
    assert kept[4] == kept[3]
    assert set(docs.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


@pytest.mark.parametrize("number", range(5))
def test_stage_on_nothing_and_with_more_columns(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = shared.table(spark, folder, "documents")
    assert stage(spark, docs.limit(0), folder).count() == 0
    more = docs.where("doc_id IS NULL OR doc_id < 20 OR doc_id >= 300").withColumns({"__own": F.lit(1), "__row": F.lit("r"), "score": F.lit("s"), "rate": F.lit("t"), "shard": F.lit("u")})
    got = stage(spark, more, folder)
    assert got.count() <= more.count()
    if number < 4:
        assert got.columns == more.columns


def test_decontamination_drops_only_rows_that_are_hit(spark, folder):
    leak = shared.table(spark, folder, "benchmark").first()["text"]
    rows = [(None, leak), (None, "quite another text"), (5, "before " + leak + " after"), (5, "clean of that id"), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit(1))
    got = corpus_pipeline.decontaminate(spark, docs, folder)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {rows[1], rows[3], rows[4]}


def test_run(spark, folder):
    first, again = (sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).drop("doc_id").collect()) for _ in range(2))
    assert first == again and len(first) > 100
