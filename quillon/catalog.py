"""Registered queries and their oracle SQL.

All queries run over whole tables.  Ids of the ``embeddings`` table are made with
four subspaces of eight codes, whose codewords are the first eight vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import docids, text, vectors
from .operators import beam, chat, collisions, metrics, quantizer, retrieval, splits, trie
from .plans import datasets, evaluation, generation
from .plans import semantic_ids as ids_plan
from .schema import CHAT, ITEM, QUERY, IdSpec
from .sources import files

SPEC = IdSpec(dim=64, subspaces=4, codes=8)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantizer.codebook_from_vectors(_table(spark, sf_dir, "embeddings"), SPEC)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return quantizer.encode(vecs, _book(spark, sf_dir), SPEC)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.disambiguate(_codes(spark, sf_dir).select("vec_id", "codes"), "vec_id")


def _joined(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: c.cast("string")), ",")


CODES = """
    s AS (SELECT vec_id, m, CAST(embedding[m * 16 + 1 : m * 16 + 16] AS DOUBLE[]) AS x FROM embeddings, range(4) t(m)),
    c AS (SELECT vec_id AS code, m, x AS w FROM s WHERE vec_id BETWEEN 0 AND 7),
    dist AS (SELECT s.vec_id, s.m, code, list_sum(list_transform(list_zip(x, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM s JOIN c USING (m)),
    best AS (SELECT vec_id, m, arg_min(code, (d, code)) AS code FROM dist GROUP BY ALL),
    k AS (SELECT vec_id, list(CAST(code AS INTEGER) ORDER BY m) AS codes FROM best GROUP BY vec_id)"""
IDS = CODES + """,
    f AS (SELECT vec_id, codes, CASE WHEN count(*) OVER (PARTITION BY codes) > 1 THEN list_append(codes, CAST(row_number() OVER (PARTITION BY codes ORDER BY vec_id) - 1 AS INTEGER)) ELSE codes END AS ids FROM k),
    named AS (SELECT vec_id, codes, ids, list_aggregate(list_transform(ids, lambda x, i: '<|d' || (i - 1) || '_' || x || '|>'), 'string_agg', ' ') AS doc_id FROM f)"""
EDGES = IDS + """,
    e AS (SELECT DISTINCT ids[1 : n - 1] AS prefix, ids[n] AS token, CAST(n - 1 AS INTEGER) AS lvl FROM f, unnest(range(1, len(ids) + 1)) t(n))"""


def _joined_sql(column: str) -> str:
    return f"array_to_string({column}, ',')"


# ---- ids -----------------------------------------------------------------------------------------


@query(f"WITH {CODES} SELECT vec_id, {_joined_sql('codes')} AS codes FROM k")
def pq_codes(spark, sf_dir):
    return _codes(spark, sf_dir).select("vec_id", _joined(F.col("codes")).alias("codes"))


@query(f"WITH {CODES} SELECT vec_id, {_joined_sql('codes')} AS codes FROM k")
def pq_codes_relational(spark, sf_dir):
    vecs = _table(spark, sf_dir, "embeddings")
    return quantizer.encode_relational(vecs, _book(spark, sf_dir), SPEC).select("vec_id", _joined(F.col("codes")).alias("codes"))


TURNED = CODES.replace("CAST(embedding[m * 16 + 1 : m * 16 + 16] AS DOUBLE[]) AS x FROM embeddings", "CAST(list_concat(embedding[2:64], embedding[1:1])[m * 16 + 1 : m * 16 + 16] AS DOUBLE[]) AS x FROM embeddings").replace(
    "c AS (SELECT vec_id AS code, m, x AS w FROM s WHERE vec_id BETWEEN 0 AND 7)", "c AS (SELECT vec_id AS code, m, CAST(embedding[m * 16 + 1 : m * 16 + 16] AS DOUBLE[]) AS w FROM embeddings, range(4) t(m) WHERE vec_id BETWEEN 0 AND 7)"
)


@query(f"WITH {TURNED} SELECT vec_id, {_joined_sql('codes')} AS codes FROM k")
def rotated_codes(spark, sf_dir):
    """Codes of vectors after a rotation, here the orthogonal matrix that moves each component one place."""
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = quantizer.encode(vecs, _book(spark, sf_dir), SPEC, rotation=np.roll(np.eye(SPEC.dim), 1, axis=1))
    return turned.select("vec_id", _joined(F.col("codes")).alias("codes"))


@query(f"WITH {IDS} SELECT vec_id, {_joined_sql('ids')} AS codes, CAST(len(ids) AS INTEGER) AS n FROM named")
def docid_codes(spark, sf_dir):
    """Semantic ids read back into codes, token by token."""
    named = collisions.with_docid(_ids(spark, sf_dir))
    return named.select("vec_id", _joined(docids.docid_codes(F.col("doc_id"))).alias("codes"), F.size(docids.docid_tokens(F.col("doc_id"))).alias("n"))


@query(f"WITH {IDS} SELECT vec_id, doc_id FROM named")
def semantic_ids(spark, sf_dir):
    return ids_plan.assign(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _book(spark, sf_dir), SPEC).select("vec_id", "doc_id")


@query(f"WITH {CODES} SELECT vec_id, list_aggregate(list_transform(codes, lambda x, i: printf('<|d%d_%03d|>', i - 1, x)), 'string_agg', '') AS doc_id FROM k")
def padded_ids(spark, sf_dir):
    return _codes(spark, sf_dir).select("vec_id", docids.padded_docid(F.col("codes")).alias("doc_id"))


@query(f"""WITH {CODES}, g AS (SELECT codes, count(*) AS n FROM k GROUP BY codes)
    SELECT CAST(sum(n) AS BIGINT) AS num_docs, count(*) AS num_unique_docids, max(n) AS max_docs_sharing_one_docid, round(sum(n) / count(*), 9) AS avg_docs_per_docid FROM g""")
def ambiguity_stats(spark, sf_dir):
    return collisions.ambiguity_stats(_codes(spark, sf_dir)).withColumn("avg_docs_per_docid", F.round("avg_docs_per_docid", 9))


@query(f"""WITH {CODES}, u AS (SELECT m, code, count(*) AS n FROM best GROUP BY ALL)
    SELECT CAST(m AS INTEGER) AS subspace, count(*) AS used_codes, round(count(*) / 8.0, 9) AS fraction_used, max(n) AS max_cluster_size, min(n) AS min_cluster_size FROM u GROUP BY m""")
def subspace_usage(spark, sf_dir):
    return collisions.subspace_usage(_codes(spark, sf_dir), SPEC.subspaces, SPEC.codes).withColumn("fraction_used", F.round("fraction_used", 9))


@query(f"WITH {CODES} SELECT {_joined_sql('codes')} AS codes, count(*) AS n, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS members FROM k GROUP BY k.codes HAVING count(*) > 1")
def collision_groups(spark, sf_dir):
    return collisions.collision_groups(_codes(spark, sf_dir), "vec_id").select(_joined(F.col("codes")).alias("codes"), "n", _joined(F.col("members")).alias("members"))


@query(f"WITH {EDGES} SELECT DISTINCT lvl, token AS code, '<|d' || lvl || '_' || token || '|>' AS token FROM e")
def token_usage(spark, sf_dir):
    return collisions.id_tokens(_ids(spark, sf_dir)).select("lvl", "code", F.format_string(docids.TOKEN, "lvl", "code").alias("token"))


@query(f"WITH {IDS} SELECT count(*) FILTER (len(ids) > 4) AS needing_disambiguation, count(*) AS total FROM f")
def disambig_count(spark, sf_dir):
    return collisions.disambiguated_count(_ids(spark, sf_dir), SPEC.subspaces)


@query(f"WITH {EDGES} SELECT DISTINCT lvl, token AS code FROM e WHERE NOT (lvl < 5 AND token < 3)")
def vocab_missing(spark, sf_dir):
    """Against a vocabulary of five levels of only three codes, so that some are missing."""
    return collisions.missing_from_vocabulary(_ids(spark, sf_dir), SPEC.levels, 3)


@query("SELECT CAST(l AS INTEGER) AS lvl, CAST(c AS INTEGER) AS code, '<|d' || l || '_' || c || '|>' AS token FROM range(4) a(l), range(256) b(c)")
def vocabulary(spark, sf_dir):
    return docids.vocabulary(spark, 4, 256)


@query(f"""WITH {CODES}, u AS (SELECT m, code, count(*) AS n FROM best GROUP BY ALL), t AS (SELECT m, sum(n) AS a FROM u GROUP BY m),
    h AS (SELECT m, -sum((n / a) * ln(n / a + 1e-10)) AS h FROM u JOIN t USING (m) GROUP BY m) SELECT round(-avg(h), 6) AS diversity_loss FROM h""")
def code_entropy(spark, sf_dir):
    return quantizer.usage_entropy(quantizer.code_usage(_codes(spark, sf_dir), SPEC.subspaces)).select(F.round("diversity_loss", 6).alias("diversity_loss"))


@query(f"""WITH {CODES}, n AS (SELECT code, m, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS w FROM c),
    l AS (SELECT vec_id, s.m, code, -list_sum(list_transform(list_zip(x, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS l FROM s JOIN n ON s.m = n.m),
    p AS (SELECT vec_id, m, code, exp(l - max(l) OVER w) / sum(exp(l)) OVER w * exp(max(l) OVER w) AS p FROM l WINDOW w AS (PARTITION BY vec_id, m))
    SELECT CAST(m AS INTEGER) AS m, CAST(code AS INTEGER) AS code, round(avg(p), 6) AS p FROM p GROUP BY ALL""")
def soft_usage(spark, sf_dir):
    soft = quantizer.assignments(_table(spark, sf_dir, "embeddings"), _book(spark, sf_dir), SPEC)
    return soft.groupBy("m", "code").agg(F.round(F.avg("p"), 6).alias("p"))


@query(f"WITH {CODES}, e AS (SELECT min(d) AS d FROM dist GROUP BY vec_id, m) SELECT round(sum(d) / (count(*) * 16), 6) AS mse FROM e")
def reconstruction_mse(spark, sf_dir):
    quantized = quantizer.reconstruct(_codes(spark, sf_dir), _book(spark, sf_dir), SPEC)
    return quantizer.mean_squared_error(quantized).select(F.round("mse", 6).alias("mse"))


@query("""WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), z AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM d)
    SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / greatest(n, 1e-12))), 6) AS total FROM z""")
def l2_normalised(spark, sf_dir):
    v = vectors.doubles(F.col("embedding"))
    total = F.aggregate(vectors.l2_normalised(v), F.lit(0.0), lambda s, x: s + x)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(total, 6).alias("total"))


@query()
def kmeans_codebook(spark, sf_dir):
    book = quantizer.kmeans_codebook(_table(spark, sf_dir, "embeddings"), SPEC)
    return book.select("m", "code", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(f"""WITH {CODES}, n AS (SELECT code, m, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS w FROM c),
    l AS (SELECT vec_id, s.m, code, w, -list_sum(list_transform(list_zip(x, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 0.25 AS l FROM s JOIN n ON s.m = n.m),
    t AS (SELECT vec_id, m, code, list_sum(w) AS total, l - max(l) OVER (PARTITION BY vec_id, m) AS l FROM l),
    e AS (SELECT vec_id, m, arg_min(code, (-l, code)) AS code, arg_min(total, (-l, code)) AS hard, sum(exp(l) * total) / sum(exp(l)) AS soft FROM t GROUP BY vec_id, m)
    SELECT vec_id, string_agg(code, ',' ORDER BY m) AS codes, round(sum(hard), 6) AS hard, round(sum(soft), 6) AS soft FROM e GROUP BY vec_id""")
def quantizer_forward(spark, sf_dir):
    """Vectors as their likeliest codewords and as mixtures of codewords, at a temperature of a half."""
    vecs, book = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _book(spark, sf_dir)
    total = F.round(F.aggregate("quantized", F.lit(0.0), lambda s, x: s + x), 6)
    soft = quantizer.forward(vecs, book, SPEC, 0.5).select("vec_id", total.alias("soft"))
    hard = quantizer.forward(vecs, book, SPEC, 0.5, hard=True).select("vec_id", _joined(F.col("codes")).alias("codes"), total.alias("hard"))
    return hard.join(soft, "vec_id")


@query(f"""WITH {CODES}, a AS (SELECT s.m, b.code, unnest(range(1, 17)) AS i, unnest(x) AS x FROM s JOIN best b ON s.vec_id = b.vec_id AND s.m = b.m)
    SELECT CAST(m AS INTEGER) AS m, CAST(code AS INTEGER) AS code, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM a GROUP BY ALL""")
def refined_codebook(spark, sf_dir):
    """A step of the codebook's refinement over all rows; each codeword is nearest to itself, so none is unused."""
    book = quantizer.refine_codebook(_table(spark, sf_dir, "embeddings"), _book(spark, sf_dir), SPEC)
    return book.select("m", "code", F.posexplode("centroid").alias("i", "x")).select("m", "code", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


# ---- data sets -----------------------------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    named = F.concat(F.lit("document: "), F.col("text"))
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("text_id"), named.alias("text"), F.concat(F.lit("id-"), F.col("doc_id").cast("string")).alias("doc_id"))


def _questions(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("text_id"), F.split("text", r"\.", 2)[0].alias("text"))


SPLIT = """
    n AS (SELECT count(*) AS n FROM documents), cut AS (SELECT n * 9 // 10 AS d, n * 7 // 10 AS q, n * 7 // 10 + n * 2 // 10 AS t FROM n),
    rows_ AS (
        SELECT doc_id AS ord, 'document' AS kind, 'document: ' || text AS text, CASE WHEN doc_id < d THEN 'train' ELSE 'icl_test' END AS split FROM documents, cut
        UNION ALL
        SELECT doc_id, 'query', split_part(text, '.', 1), CASE WHEN doc_id < q THEN 'train' WHEN doc_id < t THEN 'test' ELSE 'icl_test' END FROM documents, cut
    )"""


@query(f"WITH {SPLIT} SELECT ord, kind, split, 'id-' || ord AS doc_id, md5(text) AS text_md5 FROM rows_")
def dataset_split(spark, sf_dir):
    return splits.split(_items(spark, sf_dir), _questions(spark, sf_dir)).select("ord", "kind", "split", "doc_id", F.md5("text").alias("text_md5"))


@query(f"WITH {SPLIT} SELECT split, kind, count(*) AS n FROM rows_ GROUP BY ALL")
def split_counts(spark, sf_dir):
    return splits.split(_items(spark, sf_dir), _questions(spark, sf_dir)).groupBy("split", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id FROM documents WHERE CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE split_part(CASE WHEN doc_id % 8 = 3 THEN 'document: ' ELSE 'question: ' END || text, ':', 1) = 'document' END""")
def catalog_filter(spark, sf_dir):
    """Records whose operation is indexing, another one, null, or absent."""
    kind = F.col("doc_id") % 4
    asked = F.concat(F.when(F.col("doc_id") % 8 == 3, "document: ").otherwise("question: "), F.col("text"))
    keys = F.when(kind == 3, F.array(F.lit("text"))).otherwise(F.array(F.lit("text"), F.lit("operation")))
    operation = F.when(kind == 0, F.lit("indexing")).when(kind == 1, F.lit("retrieval"))
    return _table(spark, sf_dir, "documents").where(trie.is_indexing(keys, operation, asked)).select("doc_id")


@query("SELECT doc_id, md5(string_split('document: ' || text, ':')[2]) AS text_md5 FROM documents")
def text_extract(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.embedding_text("NQ", F.concat(F.lit("document: "), F.col("text")))).alias("text_md5"))


@query("""SELECT doc_id, 0 AS pos, 'user' AS role, md5('document: ' || text) AS content_md5 FROM documents
    UNION ALL SELECT doc_id, 1, 'assistant', md5('id-' || doc_id) FROM documents""")
def chat_records(spark, sf_dir):
    items = _items(spark, sf_dir)
    rows = chat.to_chat(items, keep=("ord",))
    return rows.select(F.col("ord").alias("doc_id"), F.posexplode("conversations").alias("pos", "turn")).select("doc_id", "pos", "turn.role", F.md5("turn.content").alias("content_md5"))


def _lines(spark, sf_dir, question: bool) -> str:
    """Documents (or questions about them) as JSON lines in two folders of unequal size; returns their parent.

    Positions are those of the documents' ids.  Records have a key that no schema names,
    and ``operation`` is there and null, or absent.
    """
    path = files.scratch(spark, "lines")
    docs = _questions(spark, sf_dir) if question else _items(spark, sf_dir)
    operation = F.when(F.col("ord") % 4 == 1, F.lit(', "operation": null')).otherwise(F.lit(""))
    body = F.to_json(F.struct("text_id", "text", F.concat(F.lit("t"), "ord").alias("title")))
    line = F.concat(body.substr(F.lit(1), F.length(body) - 1), operation, F.lit("}"))
    rows = docs.select("ord", line.alias("value"))
    small = rows.where("ord < 7").orderBy("ord"), rows.where("ord >= 7").orderBy("ord")
    for name, part in zip(("a", "b"), small, strict=True):
        part.select("value").write.text(f"{path}/{name}")
    return path


LINE_IDS = """
    k AS (SELECT doc_id AS ord, text, [doc_id % 11, doc_id % 7] AS codes FROM documents),
    f AS (SELECT ord, text, CASE WHEN count(*) OVER (PARTITION BY codes) > 1 THEN list_append(codes, row_number() OVER (PARTITION BY codes ORDER BY ord) - 1) ELSE codes END AS ids FROM k),
    l AS (SELECT ord, text, list_aggregate(list_transform(ids, lambda x, i: '<|d' || (i - 1) || '_' || x || '|>'), 'string_agg', ' ') AS doc_id FROM f)"""


def _with_ids(spark, sf_dir) -> str:
    """The lines of documents with the ids of a table of codes, as the generation plan writes them."""
    codes, out = files.scratch(spark, "codes"), files.scratch(spark, "with-ids")
    table = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.array((F.col("doc_id") % 11).cast("int"), (F.col("doc_id") % 7).cast("int")).alias("codes"))
    files.write_codes(table, codes, 2)
    ids = collisions.with_docid(collisions.disambiguate(files.read_codes(spark, codes, 2), "ord"))
    items = files.read_jsonl(spark, [f"{(path := _lines(spark, sf_dir, False))}/a", f"{path}/b"], ITEM, records=True)
    files.write_records(ids_plan.attach(items, ids), out, ["ord"])
    return out


@query(f"WITH {LINE_IDS} SELECT ord, CAST(ord AS VARCHAR) AS text_id, md5('document: ' || text) AS text_md5, doc_id, 't' || ord AS title, CASE WHEN ord % 4 = 1 THEN 'doc_id,operation,text,text_id,title' ELSE 'doc_id,text,text_id,title' END AS keys FROM l")
def ids_in_files(spark, sf_dir):
    """Positions over files, codes read from a table, ids written into records with all their keys and nulls."""
    rows = files.read_jsonl(spark, _with_ids(spark, sf_dir), ITEM, records=True)
    keys = F.array_join(F.array_sort(F.map_keys("record")), ",")
    return rows.select("ord", "text_id", F.md5("text").alias("text_md5"), "doc_id", F.try_variant_get(F.col("record")["title"], "$", "string").alias("title"), keys.alias("keys"))


@query(f"""WITH {LINE_IDS}, n AS (SELECT count(*) AS n FROM documents), cut AS (SELECT n * 9 // 10 AS d, n * 7 // 10 AS q, n * 7 // 10 + n * 2 // 10 AS t FROM n),
    r AS (SELECT 'document' AS kind, ord, doc_id, 'document: ' || text AS text, CASE WHEN ord < d THEN 'train' ELSE 'icl_test' END AS split FROM l, cut
        UNION ALL SELECT 'query', ord, doc_id, split_part(text, '.', 1), CASE WHEN ord < q THEN 'train' WHEN ord < t THEN 'test' ELSE 'icl_test' END FROM l, cut)
    SELECT split, row_number() OVER (PARTITION BY split ORDER BY kind, ord) - 1 AS ord, CAST(ord AS VARCHAR) AS text_id, doc_id, md5(text) AS text_md5, 't' || ord AS title FROM r""")
def split_files(spark, sf_dir):
    """Documents and questions paired by position over files, split, written a folder per split, and read in order."""
    path, out = _lines(spark, sf_dir, True), files.scratch(spark, "splits")
    items = files.read_jsonl(spark, _with_ids(spark, sf_dir), ITEM, records=True)
    questions = files.read_jsonl(spark, [f"{path}/a", f"{path}/b"], QUERY, records=True)
    files.write_records(datasets.split_records(items, questions), out, ["kind", "ord"], by="split")
    title = F.try_variant_get(F.col("record")["title"], "$", "string").alias("title")
    each = [files.read_jsonl(spark, f"{out}/split={x}", ITEM, records=True).select(F.lit(x).alias("split"), "ord", "text_id", "doc_id", F.md5("text").alias("text_md5"), title) for x in ("train", "test", "icl_test")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH {LINE_IDS} SELECT ord, md5('document: ' || text) AS question_md5, doc_id AS answer FROM l""")
def chat_files(spark, sf_dir):
    """Chat records written from a file of items, read back in order."""
    out = files.scratch(spark, "chat")
    datasets.chat_records(spark, _with_ids(spark, sf_dir), out)
    turns = files.read_jsonl(spark, out, CHAT)
    asked = chat.question_and_answer(turns.withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("string")}))
    return asked.select("ord", F.md5("question").alias("question_md5"), F.col("golden").alias("answer"))


@query("""SELECT doc_id AS ord FROM documents WHERE doc_id < 25 UNION ALL SELECT doc_id + 1000000 FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id >= n // 4 AND doc_id < n // 2
    UNION ALL SELECT doc_id + 2000000 FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id < n - 10""")
def position_slices(spark, sf_dir):
    """The first 25 rows, a range, and all but the last ten."""
    rows = _items(spark, sf_dir).select("ord")
    n = rows.count()
    first, middle, most = splits.head(rows, 25), splits.position_range(rows, n // 4, n // 2), splits.head(rows, -10)
    return first.unionByName(middle.select((F.col("ord") + 1_000_000).alias("ord"))).unionByName(most.select((F.col("ord") + 2_000_000).alias("ord")))


NORMAL = "CASE role WHEN 'gpt' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'human' THEN 'user' WHEN 'assistant' THEN role WHEN 'user' THEN role WHEN 'system' THEN role END"


@query(f"SELECT conv_id, turn, role AS said, {NORMAL} AS role FROM conversations")
def chat_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("said"), chat.normal_role(F.col("role")).alias("role"))


@query(f"SELECT conv_id, count(*) FILTER ({NORMAL} = 'assistant') AS trained, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_train_mask(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(chat.train_mask(F.col("role"))).alias("trained"), F.count(F.lit(1)).alias("turns"))


@query(f"""SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, md5(string_agg('<|im_start|>' || {NORMAL} || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS rendered_md5 FROM conversations GROUP BY conv_id""")
def chat_render(spark, sf_dir):
    return chat.render(_table(spark, sf_dir, "conversations")).select("conv_id", "turns", F.md5("rendered").alias("rendered_md5"))


@query("""WITH w AS (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS n FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST(n AS BIGINT) AS n_words FROM w WHERE n <= 256""")
def length_filter(spark, sf_dir):
    return chat.within_length(_table(spark, sf_dir, "conversations"), 256)


@query(f"""SELECT conv_id, md5(arg_min(text, turn) FILTER ({NORMAL} = 'user')) AS question_md5, md5(arg_min(text, turn) FILTER ({NORMAL} = 'assistant')) AS answer_md5 FROM conversations GROUP BY conv_id""")
def first_exchange(spark, sf_dir):
    return chat.first_exchange(_table(spark, sf_dir, "conversations")).select("conv_id", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query("SELECT doc_id, md5('<|im_start|>user' || chr(10) || 'question: ' || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt_md5 FROM documents")
def prompt_render(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.chat_prompt(text.question(F.col("text")))).alias("prompt_md5"))


NOISE = (
    "concat('  <|d0_', {i}, '|> <|d1_', {i} + 1, '|><|im_end|>')",
    "concat('<think>why</think> <|d0_', {i}, '|>')",
    "concat('<think>why</think>', {i})",
    "concat('<think> open <|d0_', {i}, '|>')",
    "concat('<|', {i}, '|></s>')",
    "concat('<|d_bad|> ', {i}, ' ')",
    "concat(' ', {i}, '<|endoftext|> ')",
)
_RAW = "CASE " + " ".join(f"WHEN {{i}} % 7 = {n} THEN {x}" for n, x in enumerate(NOISE)) + " END"


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


@query(rf"""WITH a AS (SELECT doc_id, {_RAW.format(i='doc_id')} AS raw FROM documents),
    b AS (SELECT doc_id, raw, replace(replace(replace(replace({_strip_sql('raw')}, '</s>', ''), '<|endoftext|>', ''), '<|im_end|>', ''), '<|im_start|>', '') AS s FROM a),
    t AS (SELECT doc_id, raw, CASE WHEN contains(s, '<think>') AND regexp_matches(s, '(?s)</think>\s*(.*?)(?:<|im_end|>|</s>|$)') THEN {_strip_sql("regexp_extract(s, '(?s)</think>" + chr(92) + "s*(.*?)(?:<|im_end|>|</s>|$)', 1)")} ELSE s END AS s FROM b)
    SELECT doc_id, raw, CASE WHEN contains(s, '<|d') THEN CASE WHEN len(regexp_extract_all(s, '<\|d\d+_\d+\|>')) > 0 THEN array_to_string(regexp_extract_all(s, '<\|d\d+_\d+\|>'), ' ') ELSE {_strip_sql('s')} END
        ELSE {_strip_sql("replace(replace(s, '<|', ''), '|>', '')")} END AS cleaned FROM t""")
def clean_docid(spark, sf_dir):
    raw = _table(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW.format(i="doc_id")).alias("raw"))
    return raw.withColumn("cleaned", text.clean_docid(F.col("raw")))


# ---- trie and search -----------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT {_joined_sql('prefix')} AS prefix, token, lvl FROM e")
def trie_edges(spark, sf_dir):
    return trie.edges(_ids(spark, sf_dir)).select(_joined(F.col("prefix")).alias("prefix"), "token", "lvl")


@query(f"""WITH {EDGES}, inner_ AS (SELECT prefix AS node, count(*) AS children FROM e GROUP BY prefix), both_ AS (
        SELECT node, children, false AS is_end FROM inner_ UNION ALL SELECT DISTINCT ids, 0, true FROM f)
    SELECT {_joined_sql('node')} AS node, CAST(len(node) AS INTEGER) AS lvl, bool_or(is_end) AS is_end, CAST(sum(children) AS BIGINT) AS children FROM both_ GROUP BY both_.node""")
def trie_nodes(spark, sf_dir):
    return trie.nodes(_ids(spark, sf_dir)).select(_joined(F.col("node")).alias("node"), "lvl", "is_end", "children")


def _prefixes(spark, sf_dir) -> DataFrame:
    """Inner nodes, leaves, and prefixes that no id has."""
    ids = _ids(spark, sf_dir)
    cut = F.slice("id_codes", 1, (F.col("vec_id") % 6).cast("int"))
    return ids.select(F.when(F.col("vec_id") % 5 == 4, F.concat(cut, F.array(F.lit(99)))).otherwise(cut).alias("prefix"))


@query(f"""WITH {EDGES}, p AS (SELECT DISTINCT CASE WHEN vec_id % 5 = 4 THEN list_append(ids[1 : vec_id % 6], 99) ELSE ids[1 : vec_id % 6] END AS prefix FROM f)
    SELECT {_joined_sql('p.prefix')} AS prefix, e.token FROM p LEFT JOIN e ON p.prefix = e.prefix""")
def trie_allowed(spark, sf_dir):
    return trie.allowed(_prefixes(spark, sf_dir), trie.edges(_ids(spark, sf_dir))).select(_joined(F.col("prefix")).alias("prefix"), "token")


@query(f"WITH {EDGES} SELECT count(*) AS violations FROM (SELECT DISTINCT ids FROM f WHERE EXISTS (SELECT 1 FROM e WHERE e.prefix = f.ids))")
def prefix_free(spark, sf_dir):
    return trie.violations(_ids(spark, sf_dir)).agg(F.count(F.lit(1)).alias("violations"))


def _beams(spark, sf_dir) -> DataFrame:
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scores = beam.quantizer_scores(vecs, _book(spark, sf_dir), SPEC)
    return beam.search(vecs, trie.edges(_ids(spark, sf_dir)), scores, SPEC.levels, codes=SPEC.codes)


def _beam_levels() -> str:
    sql = EDGES + ",\n    b0 AS (SELECT vec_id AS query, CAST([] AS INTEGER[]) AS ids, 0.0::DOUBLE AS score, 1 AS rank FROM embeddings)"
    for lvl in range(5):
        sql += f""",
    b{lvl + 1} AS (SELECT query, ids, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ids) AS rank FROM (
        SELECT b.query, CASE WHEN e.token IS NULL THEN b.ids ELSE list_append(b.ids, e.token) END AS ids, b.score + coalesce(-d.d, 0) AS score
        FROM b{lvl} b LEFT JOIN e ON e.prefix = b.ids AND e.lvl = {lvl} LEFT JOIN dist d ON d.vec_id = b.query AND d.m = {lvl} AND d.code = e.token
    ) QUALIFY rank <= 10)"""
    return sql + """,
    beams AS (SELECT query, rank, score, list_aggregate(list_transform(ids, lambda x, i: '<|d' || (i - 1) || '_' || x || '|>'), 'string_agg', ' ') AS doc_id FROM b5)"""


BEAMS = _beam_levels()
JUDGED = BEAMS + """,
    judged AS (SELECT n.vec_id, coalesce(min(b.rank), 0) AS p FROM named n LEFT JOIN beams b ON b.query = n.vec_id AND b.doc_id = n.doc_id GROUP BY n.vec_id)"""


@query(f"WITH {BEAMS} SELECT query, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM beams")
def beam_search(spark, sf_dir):
    return _beams(spark, sf_dir).select("query", "rank", docids.semantic_docid(F.col("ids")).alias("doc_id"), F.round("score", 6).alias("score"))


def _judged(spark, sf_dir) -> DataFrame:
    golden = collisions.with_docid(_ids(spark, sf_dir)).select(F.col("vec_id").alias("query"), F.col("doc_id").alias("golden"))
    found = _beams(spark, sf_dir).withColumn("doc_id", docids.semantic_docid(F.col("ids")))
    return golden.join(beam.collect_beams(found), "query", "left")


@query(f"""WITH {JUDGED} SELECT metric, k, round(avg(CASE WHEN p BETWEEN 1 AND k THEN CASE metric WHEN 'hits' THEN 1.0 WHEN 'mrr' THEN 1.0 / p ELSE 1.0 / log2(p + 1) END ELSE 0.0 END), 6) AS value
    FROM judged, (VALUES ('hits'), ('mrr'), ('ndcg')) a(metric), (VALUES (1), (10)) c(k) GROUP BY ALL""")
def eval_metrics(spark, sf_dir):
    return metrics.metrics(_judged(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""WITH {JUDGED} SELECT round(avg(CAST(p = 1 AS INTEGER)), 6) AS hit_at_1, round(avg(CAST(p BETWEEN 1 AND 10 AS INTEGER)), 6) AS hit_at_10,
    count(*) FILTER (p = 1) AS hit_at_1_count, count(*) FILTER (p BETWEEN 1 AND 10) AS hit_at_10_count, count(*) AS total FROM judged""")
def eval_hits(spark, sf_dir):
    found = metrics.hit_summary(metrics.hits(_judged(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("hit_at_1", "hit_at_10")})


@query(f"WITH {JUDGED} SELECT vec_id AS query, round(avg(CAST(p = 1 AS INTEGER)) OVER (ORDER BY vec_id), 6) AS rate FROM judged")
def running_hits(spark, sf_dir):
    rows = metrics.hits(_judged(spark, sf_dir)).select("query", F.col("hit_at_1").cast("double").alias("hit"))
    return metrics.running_rate(rows, "query", "hit").select("query", F.round("rate", 6).alias("rate"))


@query(f"WITH {BEAMS} SELECT query, CAST(rank AS INTEGER) AS rank, doc_id || '<|im_end|>' AS text, doc_id, round(score, 6) AS score FROM beams")
def generate_ids(spark, sf_dir):
    """From questions to cleaned ids: prompts, scores of a model (here the quantizer), constrained search."""
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scores = beam.quantizer_scores(vecs, _book(spark, sf_dir), SPEC)
    questions = vecs.select(F.col("vec_id").alias("query"), F.concat(F.lit("question: vector "), F.col("vec_id")).alias("text"))
    scorer = lambda asked: scores.join(asked, "query").drop("prompt")
    found = generation.generate_ids(questions, trie.edges(_ids(spark, sf_dir)), scorer, SPEC.levels, codes=SPEC.codes)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {JUDGED}, a AS (SELECT vec_id AS ord, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE p END AS p FROM judged), n AS (SELECT query, count(*) AS n FROM beams GROUP BY query)
    SELECT ord, 'question: vector ' || ord AS question, doc_id AS golden, CAST(CASE WHEN ord % 3 = 0 THEN 0 ELSE n END AS INTEGER) AS answers, p = 1 AS hit_at_1, p BETWEEN 1 AND 10 AS hit_at_10,
    round(avg(CAST(p = 1 AS INTEGER)) OVER (ORDER BY ord), 6) AS running_hit_at_1, round(avg(CAST(p BETWEEN 1 AND 10 AS INTEGER)) OVER (ORDER BY ord), 6) AS running_hit_at_10
    FROM a JOIN named ON named.vec_id = ord JOIN n ON n.query = ord""")
def evaluation_rows(spark, sf_dir):
    """Judged test items, flat and as chat records; a third of them has no generated text and counts as missed."""
    golden = collisions.with_docid(_ids(spark, sf_dir))
    asked, flat = F.concat(F.lit("vector "), F.col("vec_id")), F.col("vec_id") % 2 == 0
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    chats = F.when(~flat, F.array(turn("user", asked), turn("assistant", F.col("doc_id"))))
    items = golden.select(F.col("vec_id").alias("ord"), F.when(flat, asked).alias("text"), F.when(flat, F.col("doc_id")).alias("doc_id"), chats.alias("conversations"))
    found = _beams(spark, sf_dir).where(F.col("query") % 3 != 0).select("query", "rank", F.concat(F.lit("  "), docids.semantic_docid(F.col("ids")), F.lit("<|im_end|>")).alias("text"))
    rows = evaluation.judge(evaluation.test_questions(items), found)
    rates = {c: F.round(c, 6) for c in ("running_hit_at_1", "running_hit_at_10")}
    return rows.select("ord", "question", "golden", F.size("beams").alias("answers"), "hit_at_1", "hit_at_10", "running_hit_at_1", "running_hit_at_10").withColumns(rates)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT a.vec_id // 5 AS qid, a.vec_id AS beam, b.vec_id AS doc, round(list_inner_product(a.v, b.v), 9) AS score FROM e a, e b),
    t AS (SELECT *, row_number() OVER (PARTITION BY qid, beam ORDER BY score DESC, doc) AS r FROM s QUALIFY r <= 5),
    g AS (SELECT qid, doc, max(score) AS score FROM t WHERE score > 0 GROUP BY ALL)
    SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rk FROM g QUALIFY rk <= 5""")
def dense_retrieve(spark, sf_dir):
    """Every five vectors in a row are the beams of one question."""
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    queries = vecs.select(F.floor(F.col("vec_id") / 5).alias("qid"), F.col("vec_id").alias("beam"), "v")
    return retrieval.dense_retrieve(queries, vecs.withColumnRenamed("vec_id", "doc")).withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
    l AS (SELECT doc, len(w) AS dl FROM t), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
    post AS (SELECT doc, term, count(*) AS f FROM (SELECT doc, unnest(w) AS term FROM t) GROUP BY ALL),
    idf AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, n GROUP BY term, n),
    wt AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
    q AS (SELECT item_id AS qid, term, count(*) AS qf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
    s AS (SELECT qid, doc, round(sum(qf * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN wt USING (term) JOIN post USING (term) JOIN l USING (doc), n GROUP BY ALL)
    SELECT qid, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rk FROM s WHERE score > 0 QUALIFY rk <= 5""")
def bm25_retrieve(spark, sf_dir):
    """Benchmark items as questions, documents as the catalog."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit(0).alias("beam"), "text")
    found = retrieval.lexical_retrieve(queries, _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return found.withColumn("score", F.round("score", 6))
