"""Each training-data operator against brute force on small tables with awkward rows."""

import base64
import gzip
import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from quillon.llm import components, decontaminate, fitting, mixing, near_groups, quality, queries, sharding, shared, simhash, suffix_dedup, token_counts, topk, url_filter, warc

#: Columns that an operator might use for itself, with other types.
CLASH = {"id": "x", "row": 1.5, "key": "k", "text_": "t", "pid": "p", "shard": "s", "slot": "t", "tile": "u", "w0": "v", "component_id": "c", "segments": "g", "label": "l", "__tie": "t", "__own": "o"}


def documents(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


def awkward():
    """Null, empty, blank, tiny, repeated and long texts, with shared passages and near copies."""
    shared_part = passage(0, 60)
    long = passage(1, 3000)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, passage(2, 80)), (5, passage(2, 80)), (5, passage(2, 80)), (6, passage(3, 30) + " " + shared_part + " " + passage(4, 30)), (7, passage(5, 10) + " " + shared_part)]
    rows += [(8, long), (9, long[:5000] + " other " + long[5000:]), (10, "x" * 500), (11, "é" * 120 + passage(6, 5)), (12, "é" * 120), (13, passage(2, 80) + " more"), (14, None), (15, "")]
    return rows


# ---- suffix dedup --------------------------------------------------------------------------------


def brute_repeats(rows, width=100):
    """Rows in document order; returns kept bytes, removed counts and spans."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        mask = [False] * len(b)
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                mask[s : s + width] = [True] * width
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out.append((doc, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1000, 1_000_000])
def test_repeats_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "BUCKET_NAMES", 200)
    rows = awkward()
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(rows)


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_structured_texts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_NAMES", 300)
    rows = [(1, thue_morse(700)), (2, thue_morse(700, 1)), (3, "ab" * 200), (4, "abc" * 120), (5, "a" * 130 + "b" + "a" * 130), (6, thue_morse(64) + thue_morse(64, 1) * 3), (7, "ba" * 150), (8, thue_morse(128)[28:] + "x" + thue_morse(128, 1)[28:])]
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(rows)


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(64, 130))
def test_polynomials_match_whole_numbers(data, width):
    base, n = 987654321987654321, len(data) - width + 1
    want = []
    for i in range(n):
        value = 0
        for x in data[i : i + width]:
            value = (value * base + x + 1) % ((1 << 61) - 1)
        want.append(value)
    if n > 0:
        assert suffix_dedup.polynomials(np.frombuffer(data, np.uint8), width, base).tolist() == want


def test_names_of_complementary_sequences_differ():
    data = np.frombuffer((thue_morse(128) + thue_morse(128, 1)).encode(), np.uint8)
    for _ in range(20):
        first, second = suffix_dedup.Secret.drawn().names(data, np.array([0, 128, 0]), 128)
        assert first[0] == first[2] and second[0] == second[2]
        assert (int(first[0]) ^ int(first[1])) & 0xFFFFFF8 and second[0] != second[1]


def test_copies_of_another_deal_are_refused(tmp_path):
    skip = suffix_dedup.Skipped.__new__(suffix_dedup.Skipped)
    dict.__init__(skip, {0: zlib.crc32(b"x" * 120)})
    batch = lambda t: suffix_dedup.pa.record_batch([suffix_dedup.pa.array([1]), suffix_dedup.pa.array([t])], names=["doc_id", "text"])
    assert not list(suffix_dedup.chunks(batch("x" * 120), 0, 0, skip, 100))
    with pytest.raises(RuntimeError):
        list(suffix_dedup.chunks(batch("y" * 120), 0, 0, skip, 100))
    with pytest.raises(FileNotFoundError):
        suffix_dedup.Skipped(str(tmp_path / "none"), 0)


def test_repeats_of_nothing_and_of_rows_without_id(spark):
    assert suffix_dedup.remove_repeats(documents(spark, awkward()).limit(0)).count() == 0
    rows = [(None, "y" * 150), (1, "y" * 150), (2, passage(9, 40))]
    got = suffix_dedup.remove_repeats(documents(spark, rows), keep_bytes=True).collect()
    # of 150 equal letters the first 100-byte string stays new and all later starts repeat it, so bytes 1 to 149 go
    assert {r["doc_id"]: r["n_removed"] for r in got} == {None: 149, 1: 150, 2: 0}
    assert {r["doc_id"]: bytes(r["kept"]) for r in got}[1] == b""
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents(spark, rows), width=50)


def test_bits_for_other_names_are_refused():
    names = np.sort(np.random.default_rng(0).integers(0, 2**63, 20, dtype=np.uint64))
    bits = {0: (np.packbits(np.ones(20, bool)), suffix_dedup._mark_of(names))}
    buckets = np.zeros(20, np.int64)
    assert suffix_dedup._returned(buckets, bits, names).all()
    for wrong in (names + np.uint64(1), names[:-1]):
        with pytest.raises(RuntimeError):
            suffix_dedup._returned(buckets[: len(wrong)] if len(wrong) < 20 else buckets, bits, wrong)


def test_numbers_of_other_tokens_are_refused():
    known = token_counts.Known(1, {0: (np.array([3], np.int32), np.array([token_counts._checksum("a") & 0xFFFF], np.uint16))})
    assert known["a"] == 3
    for token in ("a", "b"):
        if token not in known:
            with pytest.raises(RuntimeError):
                known[token]


def test_cover_takes_any_two_positions_to_samples():
    residues = {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert residues == set(range(suffix_dedup.PERIOD))


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 120))
def test_names_are_equal_exactly_for_equal_strings(data, length):
    b = np.frombuffer(data, np.uint8)
    n = len(b) - length + 1
    if n > 0:
        names = suffix_dedup.Names(b).at(np.arange(n), length).tolist()
        assert len(set(zip(names, (data[i : i + length] for i in range(n)), strict=True))) == len(set(names)) == len({data[i : i + length] for i in range(n)})


def test_planes_round_trip():
    x = np.sort(np.random.default_rng(0).integers(0, 2**40, 100, dtype=np.uint64))
    assert (suffix_dedup.unplanes(suffix_dedup.planes(x, 5), 5, np.uint64) == x).all()


# ---- simhash -------------------------------------------------------------------------------------


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, near):
    """Smallest id that each row reaches."""
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if near[i][j]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_near_duplicates_match_brute_force(spark):
    rows = awkward() + [(20, passage(1, 3000) + " tail"), (21, "A B"), (22, "a b")]
    got = sorted(tuple(r) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    prints = [brute_print(t) for _, t in rows]
    near = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    labels = reach([i for i, _ in rows], near)
    assert got == sorted((i, format(p, "016x"), c) for (i, _), p, c in zip(rows, prints, labels, strict=True))


def test_near_duplicates_of_nothing_and_without_ids(spark):
    assert simhash.near_duplicates(documents(spark, awkward()).limit(0)).count() == 0
    got = simhash.near_duplicates(documents(spark, [(None, "a b c"), (None, None), (4, "")])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"] or -1) for r in got) == [(False, 4), (True, -1), (True, 4)]


@pytest.mark.parametrize("tile", [4, 10_000])
def test_links_lose_no_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randint(0, 6)):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    labels = {r["vertex"]: r["label"] for r in components.components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    near = [[bin(a ^ b).count("1") <= 4 for b in prints] for a in prints]
    assert [labels.get(p, p) for p in signed] == reach(signed, near)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=150), st.integers(0, 2**64 - 1), st.integers(0, 12))
def test_bit_slices_count_like_popcount(prints, query, radius):
    p = np.array(prints, np.uint64)
    blocks = -(-len(p) // 64)
    q = np.full((blocks, 1), query, np.uint64)
    live, near = simhash.near_lanes(q, simhash.lanes(p), np.arange(blocks), radius)
    found = {int(b) * 64 + lane for b, word in zip(live, near, strict=True) for lane in range(64) if int(word) >> lane & 1}
    assert {i for i in found if i < len(p)} == {i for i, x in enumerate(prints) if bin(x ^ query).count("1") <= radius}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r["vertex"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 203)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_components_of_random_graphs_with_hubs(spark, broadcast):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(220)] + [(900, i) for i in range(0, 60, 3)] + [(-7, i) for i in range(500, 560)]
    names = sorted({x for e in edges for x in e})
    label = {x: x for x in names}
    while True:
        before = dict(label)
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
        if label == before:
            break
    linked = {x for u, v in edges if u != v for x in (u, v)}
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = components.components(spark.createDataFrame(edges + edges[:50], "u long, v long")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    assert sorted(map(tuple, got)) == sorted((x, label[x]) for x in linked)


def test_one_of_each_group_stays(spark):
    base = passage(30, 300).split(" ")
    near = [*base[:150], "changed", *base[151:]]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (1, " ".join(near)), (2, passage(31, 300)), (None, passage(32, 50)), (7, ""), (6, None), (9, "one")]
    df = documents(spark, rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 1, 2, 6, 9]
    assert simhash.keep_one(df.limit(0)).count() == 0


def shingle_set(text, size=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(words, n, seed):
    rng = random.Random(seed)
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_a_group_whose_smallest_id_is_a_copy_keeps_that_one(spark):
    base = passage(40, 200).split(" ")
    rows = [(i, " ".join(base) if i == 100 else edited(base, 3, i)) for i in range(201)]
    assert all(alike(shingle_set(t), shingle_set(" ".join(base))) for _, t in rows)
    assert [r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()] == [0]


def brute_firsts(rows):
    """Ids that stay of (id, text) rows with distinct ids: the smallest of each group."""
    sets = [shingle_set(t) for _, t in rows]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    near = [[False] * len(rows) for _ in rows]
    for i, s in enumerate(sets):
        near[i][i] = True
        for j in {j for x in s for j in index[x]}:
            near[i][j] = alike(s, sets[j])
    return sorted(set(reach([i for i, _ in rows], near)))


def test_near_duplicate_groups_are_those_of_all_pairs(spark):
    rows = []
    for seed in range(120):  # 4 against 5 shingles
        words = passage(2000 + seed, 8)
        rows += [(len(rows), words), (len(rows) + 1, words + " more")]
    for seed in range(60):  # about 0.8, on either side
        words = passage(3000 + seed, 150).split(" ")
        rows += [(len(rows), edited(words, 3, seed)), (len(rows) + 1, edited(words, 1 + seed % 2, 500 + seed))]
    base = passage(41, 120).split(" ")  # a chain of links, whose ends differ
    for i in range(12):
        rows.append((len(rows), " ".join(f"step{j}" if j < 10 * i else w for j, w in enumerate(base))))
    random.Random(3).shuffle(rows)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect())
    assert kept == brute_firsts(rows)
    assert 120 < len(kept) < len(rows) - 120


@pytest.mark.parametrize("tile", [300, 3000])
def test_large_groups_are_compared_in_tiles_without_loss(spark, monkeypatch, tile):
    monkeypatch.setattr(near_groups, "TILE_ELEMENTS", tile)
    monkeypatch.setattr(simhash, "TILE", 16)
    base = passage(42, 120).split(" ")
    rows = [(i, " ".join(base) if i == 30 else edited(base, 2, i)) for i in range(60)]  # copies of one that is there
    other = passage(43, 120).split(" ")
    rows += [(100 + i, edited(other, 3, 100 + i)) for i in range(40)]  # copies of one that isn't, hardly alike
    rows += [(200 + i, " ".join(other[:100]) + " " + passage(300 + i, 20)) for i in range(30)]  # a long passage that many share
    kept = sorted(r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect())
    assert kept == brute_firsts(rows)


def test_rows_of_null_and_repeated_ids_go_only_for_their_own_text(spark):
    a, b, c = passage(50, 60), passage(51, 60), passage(52, 60)
    rows = [(None, a), (None, b), (None, a + " x"), (1, c), (2, passage(53, 60)), (2, passage(54, 60)), (3, c), (3, passage(55, 60)), (4, passage(55, 60))]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(documents(spark, rows)).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 2, 2, 3]
    nulls = {t for i, t in kept if i is None}
    assert len(nulls) == 2 and b in nulls
    assert {t for i, t in kept if i == 3} == {passage(55, 60)}


# ---- decontamination -----------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, bench in items:
            b = words(bench)
            n = min(window, len(b))
            for i in range(len(b) - n + 1 if b else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        ids |= {str(item)} if item is not None else set()
        out.append((doc, len(w), tuple(sorted(ids)), tuple(sorted(hit))))
    return sorted(out, key=repr)


def test_contamination_matches_brute_force(spark):
    a, b = passage(40, 25), passage(41, 40)
    items = [(1, a), (2, b), (2, b), (3, "Zwei WÖRTER"), (4, None), (5, ""), (6, "..."), (7, "the"), (None, passage(42, 12)), (10, a[: len(a) // 2])]
    docs = [(0, None), (1, ""), (2, passage(43, 20) + " " + a.upper() + " " + passage(44, 20)), (2, a), (3, "zwei,wÖrter; the end"), (4, b.replace(" ", " - ")), (5, " ".join(b.split()[:9])), (6, " ".join(b.split()[3:13])), (7, passage(42, 12)), (8, passage(45, 4000) + " " + b), (None, "the the")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit("clash"), "words": F.lit(1), "name": F.lit(2)})
    got = decontaminate.find_contamination(documents(spark, docs), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], tuple(r["item_ids"]), tuple(r["hit_words"])) for r in got), key=repr) == brute_hits(docs, items)


def test_only_alignments_within_bounds_are_verified(spark, monkeypatch):
    a = passage(46, 30).split(" ")
    docs = [(0, " ".join(a)), (1, " ".join(a[:9])), (2, " ".join(a[5:17])), (3, passage(47, 500)), (4, " ".join(["x"] * 40 + a[20:30] + ["x"] * 40))]
    kept = []
    real = decontaminate.alignments
    monkeypatch.setattr(decontaminate, "alignments", lambda *x: kept.append((x[0].join(x[1], "name").count(), (out := real(*x)).count())) or out)
    found = {r["doc_id"]: len(r["hit_words"]) for r in decontaminate.find_contamination(documents(spark, docs), spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")).collect()}
    assert found == {0: 30, 1: 0, 2: 12, 3: 0, 4: 10}
    (met, within), = kept
    assert within < met <= 30  # places of the 30 - 4 shingles at most, not documents times windows


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=3, max_size=30), st.lists(st.sampled_from("ab"), min_size=3, max_size=12), st.integers(0, 20), st.integers(0, 8))
def test_alignments_match_brute_force(doc, item, at, place):
    length, size = min(5, len(item)), 2
    at, place = min(at, len(doc) - size), min(place, len(item) - size)
    first, last = max(0, place + size - length), min(place, len(item) - length)
    lo, hi = max(0, at - (length - size)), min(len(doc), at + length)
    got = decontaminate.aligned(doc[lo:hi], at, at - lo, hi - at - size, item[first : last + length], size, length, place, first, last)
    want = [at - (place - b) for b in range(first, last + 1) if at - (place - b) >= 0 and doc[at - (place - b) : at - (place - b) + length] == item[b : b + length]]
    assert got == want


def test_contamination_with_empty_tables(spark):
    docs, bench = documents(spark, [(1, passage(46, 30))]), spark.createDataFrame([(1, passage(46, 30))], "item_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0
    assert [len(r["hit_words"]) for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()] == [0]


# ---- warc ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "ü<p>" * 200_000
    rows = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (5, "http://a/\n3 4", ""), (6, "u", big), (1, "http://a/2", "<p>x</p>"), (None, "http://n", "<p>x</p>"), (7, "http://q", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumns({"digest": F.lit("d"), "size": F.lit("s"), "payload": F.lit(1), "first": F.lit(2)})
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    html = {page: h for page, _, h in rows}
    expected = sorted((p, len((h or "").encode()), digest(h), *(("revisit", {3: 1, 5: 2}[p]) if p in (3, 5) else ("response", None))) for p, _, h in rows if p is not None)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] is not None) == expected
    assert [(r["record_type"], bytes(r["payload"]).decode()) for r in got if r["page_id"] is None] == [("response", "<p>x</p>")]
    assert all(bytes(r["payload"]).decode() == (html[r["page_id"]] or "") for r in got if r["record_type"] == "response" and r["page_id"] is not None)
    assert {r["target_uri"] for r in got} == {"http://a/1", "http://a/2", None, "http://a/ 3 4", "u", "http://n", "http://q"}


def test_warc_pushes_predicates_and_skips_bodies(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}/", f"page {i}" * (i + 1)) for i in range(30)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    df = warc.read_archive(spark, str(tmp_path / "w"), payload=False).where("record_type = 'response' AND page_id >= 10 AND target_uri LIKE 'http://h1%'")
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["page_id"] for r in df.collect()) == [i for i in range(10, 30) if i % 2]
    assert df.where("payload IS NOT NULL").count() == 0


def test_warc_reads_plain_and_foreign_archives(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "note.txt").write_text("not an archive")
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in got] == [("warcinfo", b"hello")] * 5


def test_warc_decompresses_only_what_is_wanted(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 20_000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "w"))
    made = []

    class Counted(warc.Members):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            made.append(self)

    monkeypatch.setattr(warc, "Members", Counted)
    whole = sum(len(f"page {i} " * 20_000) for i in range(20))
    kind = spark.createDataFrame([], warc.SCHEMA).schema
    for payload, tests, rows, most in (("true", [], 20, 2 * whole), ("true", [EqualTo(("page_id",), 3)], 1, 0.06 * whole), ("false", [], 20, 0.05 * whole), ("false", [EqualTo(("record_type",), "revisit")], 0, 0)):
        made.clear()
        reader = warc.WarcReader(kind, {"path": str(tmp_path / "w"), "payload": payload})
        assert not list(reader.pushFilters(tests))
        assert sum(b.num_rows for split in reader.partitions() for b in reader.read(split)) == rows
        assert sum(m.inflated for m in made) <= most


def test_warc_follows_the_standard(spark, tmp_path):
    odd = b"WARC/1.1\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:y>\r\nWarc-Target-Uri:  http://a/\r\nWARC-Concurrent-To: <urn:1>\r\nWARC-Concurrent-To: <urn:2>\r\nX-Note: one\r\n  two\r\ncontent-type: application/http;msgtype=response\r\nCONTENT-LENGTH:24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello\r\n\r\n"
    (tmp_path / "odd.warc").write_bytes(odd)
    (tmp_path / "odd.warc.gz").write_bytes(gzip.compress(odd * 2))
    for r in warc.read_archive(spark, str(tmp_path)).collect():
        assert (r["record_type"], r["record_id"], r["target_uri"], bytes(r["payload"])) == ("response", "<urn:y>", "http://a/", b"hello")
        assert r["headers"]["WARC-Concurrent-To"] == "<urn:1>, <urn:2>" and r["headers"]["X-Note"] == "one two"
        assert r["payload_digest"] == warc.sha1_base32(b"hello")
    assert warc.read_archive(spark, str(tmp_path), payload=False).where("record_type = 'response'").count() == 3
    pages = spark.createDataFrame([(2, "http://b", "same"), (1, "http://a", "same")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    first, revisit = sorted(warc.read_archive(spark, str(tmp_path / "w")).collect(), key=lambda r: r["page_id"])
    assert revisit["headers"]["WARC-Refers-To"] == first["record_id"] and revisit["headers"]["WARC-Refers-To-Target-URI"] == "http://a"
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 4\r\n\r\nsame\r\n\r\n" in raw
    assert not list((tmp_path / "w").glob("_job*"))


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0


def test_warc_min_bytes(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), str(tmp_path / "w"), min_bytes=3)
    assert {r["record_type"] for r in warc.read_archive(spark, str(tmp_path / "w")).collect()} == {"response"}


# ---- quality -------------------------------------------------------------------------------------


def labelled(spark, n=240):
    good = lambda i: passage(i, 80)
    bad = lambda i: " ".join(w.upper() + "!!" for w in passage(i, 80).split())
    rows = [(i, bad(i) if i % 4 == 0 else good(i)) for i in range(n)]
    return documents(spark, rows), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got = quality.score(docs.unionByName(documents(spark, [(900, None), (901, ""), (902, passage(3, 20_000)), (None, "x")])), model)
    rows = {r["doc_id"]: r["score"] for r in got.collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(rows[i] >= 0.5) == (i % 4 != 0) for i in held]) >= 0.95
    assert all(0 <= s <= 1 for s in rows.values()) and rows[900] == rows[901]
    assert {r["doc_id"] for r in docs.select("doc_id").where(quality.held_out(F.col("doc_id"))).collect()} == set(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() < 240
    assert quality.score(docs.limit(0), model).count() == quality.keep_good(docs.limit(0), model).count() == 0


def test_quality_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert a.dictionaries == b.dictionaries and np.array_equal(a.weights, b.weights)


def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    docs, labels = labelled(spark, 60)
    dealt, calibrated = [], []
    build, calibrate = quality.build_dictionaries, quality.calibrate
    monkeypatch.setattr(quality, "build_dictionaries", lambda texts, sizes: dealt.extend((r["doc_id"], r["text"]) for r in texts.collect()) or build(texts, sizes))
    monkeypatch.setattr(quality, "calibrate", lambda model, seen: calibrated.append(seen.count()) or calibrate(model, seen))
    quality.fit(docs, labels)
    used = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {i for i, _ in dealt} <= used and len(dealt) + calibrated[0] == len(used) and all(t == texts[i] for i, t in dealt)
    pieces = [b for b in quality._dealt({0: 3, 1: 3})(iter([pa.RecordBatch.from_pydict({"label": [1], "doc_id": [7], "text": [passage(1, 5000)]})]))][0]
    assert sum(len(x) for x in pieces.column("piece").to_pylist()) == len(passage(1, 5000)) and len(set(pieces.column("at").to_pylist())) > 1


def test_fits_and_counts_have_no_bound_on_rows():
    assert not {"dict_docs", "fit_docs"} & (set(inspect.signature(quality.fit).parameters) | set(inspect.signature(mixing.fit_domains).parameters))
    assert not any(hasattr(m, x) for m in (quality, mixing, near_groups) for x in ("DICT_DOCS", "FIT_DOCS", "SAMPLE_DOCS"))


def test_regression_over_a_table_is_the_optimum(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(700, 3)), np.array([1.0, 2.0, 0.5])
    y = (x @ rng.normal(size=(3, 3)) + rng.gumbel(size=(700, 3))).argmax(axis=1)
    rows = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x, strict=True)], "y int, x array<double>").repartition(3)
    b = fitting.softmax(rows, lambda t: (np.stack(t.column(1).to_numpy(zero_copy_only=False)), t.column(0).to_numpy()), w, 3, ridge=0.1)
    p = np.exp(x @ b)
    p /= p.sum(axis=1, keepdims=True)
    assert np.abs(x.T @ (w[y][:, None] * (p - np.eye(3)[y])) + 0.1 * b).max() < 1e-3


def test_counters_are_those_of_all_rows(spark):
    def scan(batches):
        counts = np.zeros(3 * fitting.SLICE, np.uint32)
        for batch in batches:
            np.add.at(counts, batch.column(0).to_numpy(), 1)
        at, packed = fitting.slices(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed, pa.binary())], names=["at", "counts"])

    got = fitting.counters(spark.range(0, 150_000, 1, 5).selectExpr("id * id % 190000 AS id").mapInArrow(scan, fitting.COUNTS), 3 * fitting.SLICE)
    assert np.array_equal(got, np.bincount(np.arange(150_000) ** 2 % 190_000, minlength=3 * fitting.SLICE))


def test_quality_without_labels_or_one_class(spark):
    docs, labels = labelled(spark, 20)
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert len({r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()}) == 1


# ---- sharding ------------------------------------------------------------------------------------


def brute_jump(key, shards):
    key &= 2**64 - 1
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30), st.integers(1, 40))
def test_jump_hash_matches_brute_force_and_moves_only_into_the_new_shard(keys, shards):
    k = np.array(keys, np.int64).view(np.uint64)
    now, grown = sharding.jump_hash(k, shards), sharding.jump_hash(k, shards + 1)
    assert now.tolist() == [brute_jump(x, shards) for x in keys]
    assert all(b in (a, shards) for a, b in zip(now.tolist(), grown.tolist(), strict=True))


def test_shards(spark):
    rows = awkward() + [(i, f"text {i}") for i in range(100, 1100)] + [(None, "a"), (None, None)]
    got = sharding.assign_shards(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_jump(i, 16), brute_jump(i, 17)) for i, t in rows if i is not None)
    for s in range(16):
        own = sorted((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1) for r in got if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    assert {r["law"] for r in got} == {"key"}
    assert sharding.assign_shards(documents(spark, rows).limit(0)).count() == 0


# ---- mixing --------------------------------------------------------------------------------------


def test_rates_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(1)
    p = mixing.rounded(rng.dirichlet([1, 0.5, 0.3], 50))
    tokens = rng.integers(1, 1000, 50)
    cells = spark.createDataFrame([(row.tolist(), int(t)) for row, t in zip(p, tokens, strict=True)], "cell array<long>, tokens long")
    targets = np.array([0.8, 0.15, 0.05]) * tokens.sum()
    rate = mixing.replay(p / mixing.GRID, mixing.fit_rates(cells, targets), float("inf"))[0]
    assert (rate >= 0).all()
    assert np.allclose((tokens * rate) @ (p / mixing.GRID), targets, atol=1e-4 * tokens.sum())


def test_rates_at_their_bound(spark):
    cells = spark.createDataFrame([([128, 0], 90), ([0, 128], 10)], "cell array<long>, tokens long")
    rate = mixing.replay(np.eye(2), mixing.fit_rates(cells, np.array([95.0, 5.0]), top=1.0), 1.0)[0]
    assert rate[0] == 1 and np.isclose(rate[1], 0.5, atol=1e-3)


@pytest.mark.parametrize("share", [1e-2, 1e-3, 1e-4, 1e-5])
def test_rates_of_a_rare_domain_meet_its_target(spark, share):
    tokens = np.array([(1 - 2 * share) * 1e9, share * 1e9, share * 1e9]).astype(int)
    cells = spark.createDataFrame([((mixing.GRID * row).tolist(), int(t)) for row, t in zip(np.eye(3, dtype=int), tokens, strict=True)], "cell array<long>, tokens long")
    targets = np.array([0.95, 0.04, 0.01]) * tokens.sum()
    rate = mixing.replay(np.eye(3), mixing.fit_rates(cells, targets), float("inf"))[0]
    assert np.allclose(tokens * rate, targets, rtol=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1.0, 3.0, float("inf")]))
def test_rates_are_optimal_where_targets_are_beyond_reach(seed, top):
    rng = np.random.default_rng(seed)
    p = mixing.rounded(rng.dirichlet([3, 0.1, 0.03], 200)) / mixing.GRID
    tokens = rng.integers(1, 1000, 200) * 1.0
    tokens /= tokens.sum()
    targets = rng.dirichlet([1, 1, 1])
    fitted = mixing.solve(lambda trials: np.array([mixing.measured(p, tokens, x, top) for x in trials]), targets)
    rate = mixing.replay(p, fitted, top)[0]
    pull = p @ ((tokens * rate) @ p - targets)  # the squared distance's gradient in the rates
    near = 1e-6 + 2 * mixing.NEARNESS * rate.max()
    assert (pull[rate <= 0] >= -near).all() and (pull[rate >= top] <= near).all()
    assert np.abs(pull[(rate > 0) & (rate < top)]).max(initial=0) < near


def test_rounded_posteriors_sum_to_the_grid():
    p = np.random.default_rng(0).dirichlet([1, 1, 1, 1], 200)
    whole = mixing.rounded(p)
    assert (whole.sum(axis=1) == mixing.GRID).all() and (np.abs(whole / mixing.GRID - p) < 1 / mixing.GRID).all()


def test_documents_of_the_kept_domain_all_stay(spark):
    docs, labels = labelled(spark)
    known = [r["doc_id"] for r in labels.where("quality = 1 AND toxic = 0").collect()]
    weights = {"clean": 0.3, "low": 0.7}
    few, all_ = ({r["doc_id"] for r in mixing.choose(docs, mixing.quality_domains(labels), weights, **kw).collect()} for kw in ({}, {"keep": "clean"}))
    sure = {r["doc_id"] for r in mixing.mix(docs, mixing.quality_domains(labels), weights).collect() if r["cell"][0] == mixing.GRID and r["doc_id"] in known}
    assert sure and sure <= all_ and not sure <= few


def test_mixing_reaches_targets_and_separates_domains(spark):
    docs, labels = labelled(spark)
    domains = mixing.quality_domains(labels)
    got = mixing.mix(docs.unionByName(documents(spark, [(900, None), (901, ""), (None, "x y")])), domains, {"clean": 0.9, "low": 0.1}).collect()
    p = np.array([r["cell"] for r in got]) / mixing.GRID
    tokens, rate = np.array([r["n_tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert np.allclose((tokens * rate) @ p, np.array([0.9, 0.1]) * tokens.sum(), rtol=1e-3)
    known = [(r["doc_id"], r["cell"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([(c[0] >= 64) == (i % 4 != 0) for i, c in known]) > 0.95
    assert {r["n_tokens"] for r in got if r["doc_id"] in (900, 901)} == {0}
    kept = mixing.choose(docs, domains, {"clean": 0.99, "low": 0.01})
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(240) if i % 4} - {i for i, c in known if c[0] < 120}
    assert mixing.mix(docs.limit(0), domains, {"clean": 1.0, "low": 0.0}).count() == 0


# ---- top-k ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(("tile", "shard", "fan"), [(2, 3, 2), (512, 4096, 32)])
def test_top_k_matches_brute_force(spark, monkeypatch, tile, shard, fan):
    for name, value in (("TILE", tile), ("SHARD", shard), ("FAN_IN", fan)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(90)]
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0, 1.0]), (204, []), (7, rows[7][1]), (None, [1.0, 1.0, 1.0, 1.0]), (20, rows[20][1]), (20, rows[3][1]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumns({"id": F.lit("x"), "vector": F.lit("y"), "part": F.lit("z"), "score": F.lit("s")})
    valid = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for at, (q, v) in enumerate(valid):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for there, (i, w) in enumerate(valid) if there != at)[:20]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best) if q % 20 == 0]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0


def test_products_are_exact_beyond_floats():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 1.0]])
    assert topk.product(a, b)[0, 0] == 2**40 * (2**20 + 1) + 3


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 8192)]
    alike = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(alike).collect()) == [(0, 1, 1, 8192)] * 2 + [(0, 2, 0, 4096)] * 2


# ---- token counts --------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_match_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 40)
    rows = awkward() + [(30, "<s> </s> <unk>"), (31, "a  b\n\n c\t▁d▁ "), (32, "中文字符 😀é\x00"), (33, " "), (34, "\n")]
    got = token_counts.count_tokens(documents(spark, rows), MODEL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sorted(tuple(r) for r in got) == sorted((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert token_counts.count_tokens(documents(spark, rows).limit(0), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "▁", "<s>", "\x00", "　", "中", "1", ".", "\r\n", "xxx", "ing"]), max_size=40).map("".join), st.sampled_from([3, 1_000_000]))
def test_pre_tokens_add_up(text, part):
    s = token_counts.splitter(MODEL)
    before, token_counts.PART = token_counts.PART, part
    try:
        assert sum(int(s.pieces(p).sum()) for p in s.parts(text)) == len(s.library.encode(text))
    finally:
        token_counts.PART = before


# ---- urls ----------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"),
        (3, "https://x.com", "x.com", "", None, "allow"),
        (4, "https://x.com/", "x.com", "/", "com/", "allow"),
        (5, "https://notcom/es/", "notcom", "/es/", None, "allow"),
        (6, "ftp://a.net?x://b.net/es/", "a.net", "", None, "allow"),
        (7, "https://a.net/fr/é#/", "a.net", "/fr/é", "net/fr/", "block"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (10, "http://net/es/", "net", "/es/", "net/es/", "block"),
    ]
    pages = spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "segments": F.lit(3), "verdict": F.lit(4)})
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, good int")
    got = url_filter.filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((r[0], *r[2:]) for r in rows), key=repr)
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_impure_templates_are_blocked(spark):
    pages = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(400)] + [(1000 + i, f"http://h.org/wide/w{chr(97 + i // 26)}{chr(97 + i % 26)}/x") for i in range(100)]
    labels = [(i, int(i % 2 == 0)) for i in range(0, 300)]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, good int")).collect()
    assert {(r["template"], r["verdict"]) for r in got if "wide" not in r["template"]} == {("/spam/*.html", "block"), ("/news/*.html", "allow")}
    assert {r["template"] for r in got if "wide" in r["template"]} == {"/wide/*/x"}


def letters(i):
    return "".join(chr(97 + int(x)) for x in str(i))


@pytest.mark.parametrize("times", [1, 2])
def test_segments_that_vary_below_one_another_are_one_template(spark, times):
    pages = [(i, f"http://h.org/users/{letters(i)}/page{letters(7 * i)}") for i in range(100)]
    if times == 1:
        pages += [(200 + i, f"http://h.org/deep/{'/'.join('x' * 60)}/{letters(i)}") for i in range(3)]
    labels = spark.createDataFrame([], "doc_id long, good int")
    got = url_filter.filter_urls(spark.createDataFrame(pages * times, "page_id long, url string"), labels).collect()  # repeated rows change nothing
    assert len(got) == times * len(pages)
    assert {r["template"] for r in got if r["page_id"] < 200} == {"/users/*/*"}


def brute_tree(pages, marks, most=20, weight=5.0, least=0.6, z=1.96):
    """Verdicts of (host, path) pages by the tree's definition, node by node."""
    def segments(path):
        return ["*" + (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0] if re.search("[0-9]", s) else s for s in path.split("/")]

    def number(path):
        m = re.search("/([0-9]+)", path)
        return int(m[1]) if m else None

    out = {}
    distinct = sorted(set(pages))
    labelled = [(h, p, marks[number(p)]) for h, p in pages if number(p) in marks]
    overall = (sum(x for *_, x in labelled) + 1) / (len(labelled) + 1)
    for host in {h for h, _ in pages}:
        own = {p: segments(p) for h, p in distinct if h == host}
        names = {p: () for p in own}
        for level in range(max(map(len, own.values()))):
            at = {}
            for p, s in own.items():
                if len(s) > level:
                    at.setdefault(names[p], []).append((s[level], p))
            for kids in at.values():
                wide = len({c for c, _ in kids}) > most and 2 * len({c for c, _ in kids}) > len(kids)
                for c, p in kids:
                    names[p] += ("*" if wide else c,)
        n, g = {}, {}
        for h, p, x in labelled:
            if h == host:
                n[names[p]], g[names[p]] = n.get(names[p], 0) + 1, g.get(names[p], 0) + x
        every = set(names.values())
        count = lambda group: (sum(n.get(t, 0) for t in group), sum(g.get(t, 0) for t in group))  # noqa: B023, E731
        branch = {}

        def close(node):
            """The open templates below a node once its own children are settled; those that are apart get branches."""
            below = [t for t in every if t[: len(node)] == node]
            kids = {}
            for child in {t[: len(node) + 1] for t in below if len(t) > len(node)}:
                if left := close(child):
                    kids[child] = left
            settled = any(t in branch for t in below)
            all_n, all_g = count([t for k in kids.values() for t in k])
            away = []
            for child, group in kids.items():
                cn, cg = count(group)
                if cn and all_n - cn:
                    pooled = all_g / all_n
                    if abs(cg / cn - (all_g - cg) / (all_n - cn)) > z * (pooled * (1 - pooled) * (1 / cn + 1 / (all_n - cn))) ** 0.5:
                        away.append(child)
            for child in away:
                branch.update({t: (True, child) for t in kids.pop(child)})
            rest = [t for k in kids.values() for t in k]
            if away or settled:
                branch.update({t: (False, node) for t in rest})
                rest = []
            return rest + ([node] if node in every and node else [])

        for t in close(()):
            branch[t] = (False, ())
        host_n, host_g = count(every)
        base = (host_g + weight * overall) / (host_n + weight)
        for p, t in names.items():
            bn, bg = count([x for x in every if branch[x] == branch[t]])
            out[host, p] = "block" if (bg + weight * base) / (bn + weight) < least else "allow"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_the_tree_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pages = []
    for i in range(900):
        host = rng.choice(["a.org", "a.org", "b.org"])
        kind = rng.random()
        if kind < 0.4:
            path = f"/{rng.choice(['news', 'shop', 'blog'])}/{rng.choice(['x', 'y'])}/{i}{rng.choice(['', '.html', '/'])}"
        elif kind < 0.7:
            path = f"/u/{letters(i)}/{rng.choice(['p', 'q'])}/{i}"
        else:
            path = f"/{letters(i % 30)}" + rng.choice(["", f"/{i}"])
        pages.append((host, path))
    bad = {"shop", "q"} if seed else {"blog"}
    marks = {i: int(rng.random() > (0.8 if bad & set(p.split("/")) else 0.15)) for i, (_, p) in enumerate(pages) if rng.random() < 0.7}
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(pages)], "page_id long, url string")
    got = url_filter.filter_urls(df, spark.createDataFrame(list(marks.items()), "doc_id long, good int"), rules=()).collect()
    want = brute_tree(pages, marks)
    assert {(r["host"], r["path"]): r["verdict"] for r in got} == want
    assert len(set(want.values())) == 2


# ---- queries and pipeline ------------------------------------------------------------------------


def test_all_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, sf_dir, name):
    from tests.oracle import duckdb_rows, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duckdb_rows(queries.ORACLE_SQL[name], sf_dir)


def test_shared_folder_is_the_sessions(spark):
    assert shared.work_dir(spark, "x").startswith(shared.prepare(spark).rstrip("/"))


# ---- registered queries that SQL can't express ----------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in shared.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


def test_op1_matches_brute_force_on_a_table(spark, sf_dir, texts):
    got = queries.op1_suffix_dedup(spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(texts)


def test_op2_matches_brute_force_on_a_table(spark, sf_dir, texts):
    prints = [brute_print(t) for _, t in texts]
    labels = reach([i for i, _ in texts], [[(a ^ b).bit_count() <= 4 for b in prints] for a in prints])
    got = sorted(tuple(r) for r in queries.op2_simhash(spark, sf_dir).collect())
    assert got == sorted((i, format(p, "016x"), c) for (i, _), p, c in zip(texts, prints, labels, strict=True))


def test_op5_scores_follow_from_its_model_on_a_table(spark, sf_dir, texts):
    import zstandard

    model = quality.fit(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    kind = {False: zstandard.DICT_TYPE_FULLDICT, True: zstandard.DICT_TYPE_RAWCONTENT}
    dicts = [zstandard.ZstdCompressionDict(d, dict_type=kind[raw]) for d, raw in zip(model.dictionaries, model.raw, strict=True)]
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, text in texts[:60]:
        b = (text or "").encode()
        pieces = [b[at : at + quality.PIECE] for at in range(0, max(1, len(b)), quality.PIECE)]
        bad, good = (sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x)) for x in pieces) for d in dicts)
        size = len(b) + quality.EXTRA
        lean, rate = np.clip([(bad - good) / size, min(bad, good) / size], model.low, model.high)
        z = (np.array([lean, rate, lean * rate]) - model.mean) / model.scale
        score = 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ model.weights[1:], -30, 30)))
        assert np.isclose(got[i]["score"], score) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op7_meets_its_targets_on_a_table(spark, sf_dir, texts):
    rows = queries.op7_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in texts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    assert all(r["n_tokens"] == words[r["doc_id"]] and r["rate"] >= 0 for r in rows)
    p = np.array([[int(x) for x in r["posterior"].split(",")] for r in rows]) / mixing.GRID
    totals = np.array([r["rate"] * r["n_tokens"] for r in rows]) @ p
    # nearest rates by an independent method: alternating projections (Dykstra's) onto the targets and onto rates of at least 0
    t = np.array([float(r["n_tokens"]) for r in rows])
    targets = np.array(list(mixing.TARGETS.values())) * t.sum()
    if np.allclose(totals, targets, rtol=1e-5):
        rate, off = np.ones(len(rows)), np.zeros(len(rows))
        a = t[:, None] * p  # totals are a.T @ rate; nearness weighs a document as its tokens
        gram = a.T @ (a / np.maximum(t, 1)[:, None])
        for _ in range(3000):
            rate = rate + (a @ np.linalg.lstsq(gram, targets - a.T @ rate, rcond=None)[0]) / np.maximum(t, 1)
            rate, off = np.maximum(rate + off, 0), np.minimum(rate + off, 0)
        got = np.array([r["rate"] for r in rows])
        assert np.allclose(got[t > 0], rate[t > 0], atol=1e-3)


def test_op9_matches_the_library_on_a_table(spark, sf_dir, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counts = {i: len(library.encode(t or "")) for i, t in texts}
    got = queries.op9_token_counts(spark, sf_dir).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {(i, len((t or "").encode()), counts[i], counts[i] > 4096) for i, t in texts}


def test_near_duplicates_of_every_similarity_are_found(spark):
    """Recall of the pipeline's links by bands of similarity, from 0.8 up: 0.9 is asked for, all are found."""
    found, bands = 0, {}
    rows = []
    for i in range(160):
        n = 20 + 10 * (i % 30)
        words = passage(7000 + i, n).split(" ")
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(words, max(1, n * (1 + i % 4) // 100), 9000 + i))]
    kept = {r["doc_id"] for r in simhash.keep_one(documents(spark, rows)).collect()}
    for i in range(160):
        a, b = shingle_set(rows[2 * i][1]), shingle_set(rows[2 * i + 1][1])
        if (similarity := len(a & b) / len(a | b)) >= 0.8:
            bands.setdefault(int(similarity * 20), []).append(2 * i + 1 not in kept)
        else:
            assert 2 * i + 1 in kept
            found += 1
    assert found > 10 and set(bands) >= {16, 17, 18} and all(all(x) for x in bands.values())
