"""URL rules, toxicity, packing, search, token files and sharding: exact round trips, brute force, odd rows."""

import io
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scholia.llm import binary, common, packing, search, sharding, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"


def plain(text):
    return tokens.encoder(tokens.default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


ODD = ["", None, " ", "\n", " a", "a ", "a  b", "a \n b", "a\n\nb", "it's don't, 'tis ''s", "foo<|endoftext|>bar baz", "né² x²,y ²! 中文。", "a\tb c\u3000e", "x\x1cy z", "a,\nb.\nc!!\n\nd\r\ne f", "emoji 😀, x😀!", "a' b' 's 't c's\n's", "\u0085a b", "w" * 5000, "long text, with words. " * 4000]


def test_encoder_is_exact():
    encoder = tokens.encoder(tokens.default_tokenizer())
    rng = np.random.default_rng(1)
    letters = list("ab,.'s\n  é1!<|>\tZ")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    assert all(encoder.document(t).tolist() == plain(t) for t in texts)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packed_ids_come_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    assert (binary.unpack(binary.pack(ids, bits), bits, len(ids)) == ids).all()
    with pytest.raises(ValueError):
        binary.pack(np.array([1 << bits], np.uint64), bits)


def test_file_random_access():
    rng = np.random.default_rng(2)
    docs = [(i if i % 5 else None, rng.integers(0, 50257, rng.integers(0, 500)).astype(np.uint32)) for i in range(200)]
    out = io.BytesIO()
    writer = binary.BlockWriter(out, 16, 128)
    for k, ids in docs:
        writer.add(k, ids)
        assert writer._held < 128  # blocks are written as they fill
    writer.close()
    reader = binary.BlockReader(out)
    every = np.concatenate([x for _, x in docs])
    assert reader.n_ids == len(every) and binary.bits_for(50257) == 16
    for a, n in [(0, 1), (127, 2), (len(every) - 1, 1), (1000, 5000), (5, 0)]:
        assert (reader.ids(a, n) == every[a : a + n]).all()
    assert [(k, x.tolist()) for k, _, x in reader.documents()] == [(k, x.tolist()) for k, x in docs]
    with pytest.raises(IndexError):
        reader.ids(len(every), 1)


def frame(spark, texts, extra="x"):
    return spark.createDataFrame([(i, t, extra) for i, t in enumerate(texts)], "doc_id long, text string, start string")


def test_token_files_round_trip(spark):
    docs = frame(spark, ODD)
    files = binary.write_token_files(docs, common.scratch(spark, "t"), tokenizer=tokens.default_tokenizer(), partitions=3)
    found = sorted(map(tuple, binary.read_token_files(spark, files).collect()))
    start, expected = 0, []
    for i, t in enumerate(ODD):
        ids = plain(t)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    none = binary.write_token_files(docs.limit(0), common.scratch(spark, "t"), tokenizer=tokens.default_tokenizer())
    assert none == [] and binary.read_token_files(spark, none).count() == 0
    odd = spark.createDataFrame([(None, "b"), (2, "b"), (2, "a"), (None, None)], "doc_id long, text string")
    files = binary.write_token_files(odd, common.scratch(spark, "t"), tokenizer=tokens.default_tokenizer())
    assert [r.doc_id for r in sorted(binary.read_token_files(spark, files).collect(), key=lambda r: r.start)] == [None, None, 2, 2]


def test_token_files_split_a_repeated_id(spark):
    """A third of the rows share one id, and half of those the text: several files share them, in order and whole."""
    rows = [(7 if i % 3 == 0 else i, "same" if i % 6 == 0 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = binary.write_token_files(docs, common.scratch(spark, "t"), tokenizer=tokens.default_tokenizer(), partitions=6)
    assert len(files) > 3 and max(f["docs"] for f in files) < 200
    found = sorted(binary.read_token_files(spark, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(k for k, _ in rows)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id, r.ids_crc32) for r in found) == sorted((k, zlib.crc32(np.array(plain(t), "<u4").tobytes())) for k, t in rows)
    assert binary.file_count(spark, 0) == 1 and binary.file_count(spark, 9 << 20) == 3 and binary.file_count(spark, 100 << 40) == 409600


def test_token_query_against_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, expected = 0, []
    for k, t in docs:
        ids = plain(t)
        expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, binary.op9_token_binary(spark, SF).collect())) == expected


def test_packing_query_against_brute_force(spark):
    """Every id of every document in exactly one piece, sequences gapless and at most 1024 long."""
    docs = {r.doc_id: np.array(plain(r.text), "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = packing.op4_packing(spark, SF).collect()
    at, ends = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = docs[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {k: len(v) for k, v in docs.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_packing_holds_every_id_once(spark):
    docs = frame(spark, ODD * 8)
    rows = packing.pack_documents(docs, tokenizer=tokens.default_tokenizer()).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
    for i, t in enumerate(ODD * 8):
        ids, at = np.array(plain(t), "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(docs.limit(0), tokenizer=tokens.default_tokenizer()).count() == 0


def test_packing_query_wastes_little(spark):
    rows = packing.op4_packing(spark, "/root/testdata/sf0.01").collect()
    filled = sum(r.length for r in rows)
    assert filled / (1024 * len({r.sequence_id for r in rows})) > 0.98


def test_differencing():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 257, 300).tolist()
    found = packing.differencing(sizes, 40)
    assert sorted(i for w in found for i in w) == list(range(300)) and len(found) == 40
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= 8
    assert all(sum(sizes[i] for i in w) <= 1024 for w in packing.windows_for(sizes, 1024))
    assert packing.windows_for([5], 1024) == [[0]] and packing.differencing([], 3) == []


def test_search_against_sql_and_with_small_shards(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    expected = sorted(db.sql(search.SQL).fetchall())
    assert sorted(map(tuple, search.op8_exact_top_k(spark, SF).collect())) == expected
    vectors = search.scaled(spark.read.parquet(f"{SF}/embeddings.parquet"))
    found = search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=64, query_rows=3)
    assert sorted(map(tuple, found.collect())) == expected


def test_search_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.5]), (50, [0.0, 0.0])]
    vectors = search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 2).collect())
    assert found == [(0, 1, 1, 131072), (0, 2, 2, 131072), (50, 1, 0, 0), (50, 2, 1, 0)]
    assert search.top_k(vectors.limit(0), vectors.limit(0), 2).count() == 0


def test_search_with_large_integers(spark):
    big = 1 << 29
    vectors = spark.createDataFrame([(i, [big + i, -big]) for i in range(6)], "vec_id long, v array<long>")
    found = [r.vec_id for r in search.top_k(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert found == [5, 4, 3]


def test_search_with_empty_vectors_and_repeated_ids(spark):
    rows = [(i, []) for i in range(200)] + [(300, [1]), (300, [1]), (301, [2]), (302, [3])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = sorted(map(tuple, search.top_k(vectors, vectors.where("vec_id in (0, 300)"), 2).collect()))
    assert found == [(0, 1, 1, 0), (0, 2, 2, 0), (300, 1, 302, 3), (300, 2, 301, 2)]
    found = sorted(map(tuple, search.top_k(vectors, vectors.where("vec_id = 302"), 3).collect()))
    assert found == [(302, 1, 301, 6), (302, 2, 300, 3), (302, 3, 300, 3)]


def test_kd_tree_is_exact_and_prunes():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-50, 50, (2000, 3)).astype(float)
    tree, ids = search.KdTree(vectors), np.arange(2000)
    queries = rng.integers(-50, 50, (20, 3)).astype(float)
    bounds = tree.bounds(queries)
    for q, b in zip(queries, bounds):
        best = sorted(((int(s), -i) for i, s in enumerate((vectors @ q).tolist())), reverse=True)[:5]
        assert tree.search(q, b, ids, -1, 5, None) == best
        assert tree.search(q, b, ids, -1, 5, best[-1][0]) == best


def test_sharding_moves_few_and_numbers_all(spark):
    rows = [(i if i % 10 else None, "t" * (i % 5)) for i in range(2000)] + [(7, "same")] * 3
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("text", "slot")
    held = sharding.shard_records(df.withColumnRenamed("slot", "text"), "id", [1.0] * 7, grown_weight=1.0, order=("text",), slot_rows=20).collect()
    slots = defaultdict(list)
    for r in held:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(held) == len(rows)
    weights = [1.0, 3.0]
    spread = Counter(r.s for r in spark.range(8000).select(sharding.rendezvous(sharding.F.col("id"), weights).alias("s")).collect())
    assert 0.7 < spread[1] / 8000 < 0.8
    assert sharding.shard_records(df.limit(0), "id", [1.0]).count() == 0


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op10_rendezvous_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs.items()}
    assert all(r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)


def brute_shard(key, shards):
    """The shard by the published XXH64 of key and shard number, each hash seeding the next."""
    best = (-1.0, 0)
    for i in range(shards):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", i), h)
        best = max(best, (-1 / math.log(((h >> 11) + 0.5) / (1 << 53)), -i))
    return -best[1]


def test_sharding_query_against_brute_force(spark):
    rows = sharding.op10_rendezvous_sharding(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 40), brute_shard(r.doc_id, 41))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_with_clashing_names(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", i % 2, "kept") for i in range(50)] + [(None, None, None, None)], "shard long, slot string, grown_shard int, other string")
    held = sharding.shard_records(df, "shard", [1.0, 1.0], grown_weight=2.0, order=("slot",), slot_rows=5)
    assert held.columns == ["other", "shard", "grown_shard", "slot"] and held.count() == 51
    plain_keys = sharding.shard_records(df.select(F.col("shard").alias("id"), "other"), "id", [1.0, 1.0], grown_weight=2.0)
    assert Counter(r.shard for r in held.collect()) == Counter(r.shard for r in plain_keys.collect())


def test_urls_are_judged(spark):
    cases = [
        ("http://a.com/x?q", "a.com", "/x", "com/", "allow"),
        ("HTTP://Example.COM/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://m.example.com/en/1#t", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://myexample.com/en/", "myexample.com", "/en/", "com/", "allow"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"),
        ("http://x.net/fr", "x.net", "/fr", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.org?a://b/c", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http://É.com/Ü", "É.com", "/Ü", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    known = spark.createDataFrame([], "url string, blocked boolean")
    found = sorted(urls.judge_urls(pages, known).collect(), key=lambda r: r.page_id)
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in found] == cases
    assert urls.judge_urls(pages.limit(0), known).count() == 0


def test_rules_are_mined_and_pruned(spark):
    rows = [(i, f"https://a{i % 7}.example.org/{'spam' if i % 3 == 0 else 'ok'}/x?{'buy' if i % 2 else 'ref'}=1", i % 3 == 0 and i % 2 == 1) for i in range(600)]
    pages = spark.createDataFrame(rows, "id long, url string, blocked boolean")
    found = urls.judge_urls(pages, pages, rules=()).collect()
    assert all((r.verdict == "block") == r.blocked for r in found)
    assert {r.mined_rule for r in found} == {None, "key=buy path=spam"}
    few = urls.judge_urls(pages, pages.limit(5), rules=())
    assert {r.verdict for r in few.collect()} == {"allow"}


def test_long_and_repeated_urls_are_mined(spark):
    """A template of 40 segments in 30 equal rows, and one with a varying segment, give few combinations."""
    path = "/".join(f"part-{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    rows = [(f"https://spam.example.org/{path}", True)] * 30 + [(f"https://spam.example.org/{path}/{'abcdefghij'[i % 10]}", i % 10 < 9) for i in range(200)]
    rows += [(f"https://good.example.org/{path}/{'abcdefghij'[i % 10]}?q=1", False) for i in range(100)]
    df = spark.createDataFrame([(i, u, b, "old") for i, (u, b) in enumerate(rows)], "page_id long, url string, blocked boolean, mined_rule string")
    found = urls.judge_urls(df, df, rules=()).collect()
    assert len(found) == len(rows) and all((r.verdict == "block") == ("spam" in r.url) for r in found)
    rules, named = urls.mine_rules(urls.judge_urls(df, df, rules=()).select("blocked", urls.tokens(urls.F.col("url"), urls.F.col("host"), urls.F.col("path")).alias("tokens")))
    assert rules.count() < 20 and named.count() >= rules.count()


def brute_rules(baskets, min_support, min_confidence, min_rows):
    """All minimal token sets that lead to the block label, by enumeration."""
    from itertools import combinations

    every = sorted({t for b, _ in baskets for t in b})
    share = {}
    for n in range(1, 4):
        for items in combinations(every, n):
            rows = [bad for b, bad in baskets if set(items) <= b]
            if sum(rows) >= max(min_support * len(baskets), min_rows) and sum(rows) >= min_confidence * len(rows):
                share[frozenset(items)] = sum(rows) / len(rows)
    return share


def test_url_query_against_brute_force(spark, tmp_path):
    """The query's verdicts beside enumeration of all rules, on labels that hosts, segments and keys explain in part."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(500):
        host, section, key = (str(rng.choice(x)) for x in (["a.example.org", "b.example.org", "c.example.net"], ["news", "deal", "win"], ["ref", "page", "x"]))
        rows.append((i, None if i == 9 else f"http://{host}/{section}/{i}?{key}=1"))
        bad = section == "win" and key == "ref" or host == "b.example.org" and section == "deal"
        if i % 7 and i != 9:
            labels.append((i, int(not bad if rng.random() < 0.95 else bad), 0))
    labels += [(3, None, None), (7001, 0, 1)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.page_id: r for r in urls.op1_url_filter(spark, str(tmp_path)).collect()}
    assert len(found) == 500 and found[9].host == "" and found[9].verdict == "allow"

    def basket(url):
        host, section, number, key = re.match(r"http://([^/]*)/([a-z]+)/(\d+)\?([a-z]+)=1", url).groups()
        parts = host.split(".")
        return {"scheme=http", f"path={section}", "path=0", f"key={key}", *(f"host={'.'.join(parts[i:])}" for i in range(3))}

    text = dict(rows)
    baskets = [(basket(text[k]), q == 0 or t == 1) for k, q, t in labels if k in text and q is not None]
    rules = brute_rules(baskets, urls.MIN_SUPPORT, urls.MIN_CONFIDENCE, urls.MIN_ROWS)
    assert rules
    for k, url in rows:
        if url and found[k].rule is None:
            fits = [c for items, c in rules.items() if items <= basket(url)]
            assert found[k].verdict == ("block" if fits else "allow") and (not fits or abs(found[k].confidence - max(fits)) < 1e-9)
    assert {r.verdict for r in found.values() if r.rule is None} == {"allow", "block"}


def test_toxicity_query_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.toxic == t] for t in (0, 1))
    wins = np.mean([(b > np.array(good)).mean() + 0.5 * (b == np.array(good)).mean() for b in bad])
    assert wins > 0.97 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_odd_rows(spark):
    labelled = spark.createDataFrame([(i, f"you are a horrid fool number{i}" if i % 2 else f"the calm river number{i}", i % 2) for i in range(400)], "key long, text string, toxic int")
    model = toxicity.fit(labelled)
    rows = [(1, None), (2, ""), (3, "you horrid fool"), (4, "calm river"), (5, "h0rr1d f00l"), (6, "word " * 100_000), (7, "@@@ $$$ !!!"), (8, "12345")]
    docs = spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, score int")
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert found[3] > 0.5 > found[4] and found[1] == found[2] < 0.5 and all(0 <= x <= 1 for x in found.values())
    assert toxicity.fit(labelled.where("toxic = 0")) is None and toxicity.fit(labelled.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_repeated_and_contradicting_rows(spark):
    """A key counts once however often it is repeated; with both labels it is toxic."""
    rows = [(i, f"you are a horrid fool number{i}" if i % 2 else f"the calm river number{i}", i % 2) for i in range(400)]
    once = spark.createDataFrame(rows, "key long, text string, toxic int")
    often = once.unionByName(spark.createDataFrame([rows[7]] * 3000 + [(9, rows[9][1], 0), (None, "the calm river", 0)], once.schema))
    models = [toxicity.fit(x) for x in (once, often)]
    docs = spark.createDataFrame([(1, "you horrid fool"), (1, "you horrid fool"), (2, "calm river")], "doc_id long, text string")
    for model in models:
        found = [(r.doc_id, r.predicted) for r in toxicity.score_toxicity(docs, model).collect()]
        assert sorted(found) == [(1, 1), (1, 1), (2, 0)]


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    score = rng.normal(size=500)
    x, y = toxicity.isotonic(score, (score + rng.normal(size=500) > 0).astype(int))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1
