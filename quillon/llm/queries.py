"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .decontaminate import find_contamination
from .mixing import TARGETS, mix, quality_domains
from .sharding import assign_shards
from .shared import table, work_dir
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .topk import top_k
from .url_filter import filter_urls
from .warc import read_archive, write_archive


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", width=100)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, radius=4)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    responses = read_archive(spark, folder).where("record_type = 'response'").withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = read_archive(spark, folder, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mix(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")), TARGETS)
    return rated.select("doc_id", "n_tokens", F.array_join("cell", ",").alias("posterior"), "rate")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return filter_urls(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_topk": op8_topk,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
            FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)
        ), places AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)
        ), found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)
        ), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
        x AS (SELECT page_id, strlen(p.h) AS n, sha1(p.h) AS d, first FROM p JOIN f ON p.h = f.h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(d, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM x
    """,
    "op6_sharding": """
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
        ), d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), bytes AS (
            SELECT doc_id, strlen(text) AS n, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM d
        ), sums AS (
            SELECT doc_id, n + 1 AS size, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table
        ), jumps(doc_id, shards, key, here, nxt) AS (
            SELECT doc_id, shards, CAST(doc_id AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (16), (17)) v(shards)
            UNION ALL
            SELECT doc_id, shards, k, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
            FROM (SELECT doc_id, shards, nxt, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE nxt < shards)
        ), put AS (
            SELECT doc_id, CAST(max(here) FILTER (shards = 16) AS INTEGER) AS shard, CAST(max(here) FILTER (shards = 17) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
        FROM sums JOIN put USING (doc_id)
    """,
    "op8_topk": """
        WITH whole AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.r <> c.r WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 20
    """,
    "op10_url_filter": r"""
        WITH RECURSIVE rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), rows_ AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), p AS (
            SELECT *, list_transform(CASE WHEN len(string_split(path, '/')) > 16 THEN list_append(string_split(path, '/')[1:15], array_to_string(string_split(path, '/')[16:], '/')) ELSE string_split(path, '/') END,
                       lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '(\.[A-Za-z]{1,5})$', 1) ELSE s END) AS segs,
                   TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) AS key FROM rows_
        ), marks AS (
            SELECT doc_id AS key, CAST(round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)) AS BIGINT) AS good FROM labels GROUP BY ALL
        ), counts AS (
            SELECT host, segs, count(DISTINCT path) AS pages, count(good) AS n, coalesce(sum(good), 0) AS g FROM p LEFT JOIN marks USING (key) GROUP BY ALL
        ), tree(host, segs, pages, pos, names) AS (
            SELECT host, segs, pages, 0, CAST([] AS VARCHAR[]) FROM counts
            UNION ALL
            SELECT host, segs, pages, pos + 1, list_append(names, CASE WHEN children > 20 AND 2 * children > all_pages THEN '*' ELSE segs[pos + 1] END)
            FROM (SELECT *, count(DISTINCT segs[pos + 1]) OVER (PARTITION BY host, names) AS children, sum(pages) OVER (PARTITION BY host, names) AS all_pages FROM tree WHERE pos < len(segs))
        ), known AS (
            SELECT t.host, t.segs, names, n, g FROM tree t JOIN counts c ON t.host = c.host AND t.segs = c.segs WHERE pos = len(t.segs)
        ), leaves AS (
            SELECT host, names, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS g FROM known GROUP BY ALL
        ), state(host, names, n, g, node, own, place, lvl) AS (
            SELECT host, names, n, g, names, CAST(NULL AS BOOLEAN), '', (SELECT max(len(names)) FROM leaves) FROM leaves
            UNION ALL
            SELECT host, names, n, g, CASE WHEN here AND NOT apart AND NOT mixed THEN node[1 : lvl - 1] ELSE node END,
                   CASE WHEN NOT here THEN own WHEN apart THEN true WHEN mixed THEN false END,
                   CASE WHEN here AND apart THEN array_to_string(node, '/') WHEN here AND mixed THEN array_to_string(node[1 : lvl - 1], '/') ELSE place END, lvl - 1
            FROM (
                SELECT *, coalesce(bool_or(apart OR (own IS NOT NULL AND len(names) >= lvl)) OVER (PARTITION BY host, names[1 : lvl - 1]), false) AS mixed
                FROM (
                    SELECT *, CASE WHEN here AND bn > 0 AND an - bn > 0 THEN abs(bg / bn - (ag - bg) / (an - bn)) > 1.96 * sqrt((ag / an) * (1 - ag / an) * (1 / bn + 1 / (an - bn))) ELSE false END AS apart
                    FROM (
                        SELECT *, own IS NULL AND len(node) = lvl AS here,
                               sum(CASE WHEN own IS NULL AND len(node) = lvl THEN n ELSE 0 END) OVER (PARTITION BY host, node) AS bn, sum(CASE WHEN own IS NULL AND len(node) = lvl THEN g ELSE 0 END) OVER (PARTITION BY host, node) AS bg,
                               sum(CASE WHEN own IS NULL AND len(node) = lvl THEN n ELSE 0 END) OVER (PARTITION BY host, names[1 : lvl - 1]) AS an, sum(CASE WHEN own IS NULL AND len(node) = lvl THEN g ELSE 0 END) OVER (PARTITION BY host, names[1 : lvl - 1]) AS ag
                        FROM state WHERE lvl > 0
                    )
                )
            )
        ), branches AS (
            SELECT host, names, n, g, coalesce(own, false) AS own, place FROM state WHERE lvl = 0
        ), hosts AS (
            SELECT host, sum(n) AS hn, sum(g) AS hg FROM leaves GROUP BY ALL
        ), overall AS (SELECT (coalesce(sum(g), 0) + 1) / (coalesce(sum(n), 0) + 1) AS o FROM leaves
        ), merged AS (
            SELECT host, own, place, sum(n) AS bn, sum(g) AS bg FROM branches GROUP BY ALL
        ), judged AS (
            SELECT m.host, m.own, m.place, (bg + 5.0 * ((hg + 5.0 * o) / (hn + 5.0))) / (bn + 5.0) AS purity FROM merged m JOIN hosts h ON m.host = h.host, overall
        ), verdicts AS (
            SELECT k.host, k.segs, CASE WHEN purity < 0.6 THEN 'block' ELSE 'allow' END AS verdict
            FROM known k JOIN branches b ON k.host = b.host AND k.names = b.names JOIN judged j ON b.host = j.host AND b.own = j.own AND b.place = j.place
        ), rules(verdict, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), ruled AS (
            SELECT page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY ALL
        )
        SELECT p.page_id, p.host, p.path, ruled.rule, coalesce(ruled.verdict, v.verdict) AS verdict
        FROM p JOIN verdicts v ON p.host = v.host AND p.segs = v.segs LEFT JOIN ruled ON p.page_id = ruled.page_id
    """,
}
