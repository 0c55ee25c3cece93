"""The pipeline against a brute-force version of its stages, and on odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import corpus_pipeline as cp
from pyspark.sql import functions as F

from scholia.llm import language, tokens
from scholia.llm.simhash import first_of_groups, majority, shingle_hashes
from scholia.llm.toxicity import held_out

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def near(rows):
    prints = {k: int(majority(np.array(h, np.uint64), np.array([len(h)]))[0]) for k, t in rows.items() for h in [shingle_hashes(t)]}
    kept, parent = set(), {k: k for k in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {k for k in rows if find(k) == k}
    return {k: t for k, t in rows.items() if k in kept}


def without_passages(rows, window=13):
    first = {}
    words = {k: t.encode().split() for k, t in rows.items()}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(b" ".join(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        text = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else rows[k]
        if text or not any(gone):
            out[k] = text
    return out


def clean(rows, items):
    def shingles(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = [shingles(t) for t in items]
    return {k: t for k, t in rows.items() if not any(x and len(x & shingles(t)) >= 0.8 * len(x) for x in wanted)}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = {r.doc_id: r.text for r in language.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= cp.MIN_LANGUAGE_SCORE}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = clean(without_passages(near(rows)), items)
    assert 0 < len(expected) < len(rows) <= docs.count()
    pieces = defaultdict(list)
    for r in cp.run(spark, SF).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(expected)
    encode = tokens.encoder(tokens.default_tokenizer()).document
    for k, text in expected.items():
        ids, at = encode(text), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_stages_on_odd_rows(spark):
    long = "the river ran over the old stones and the bridge " * 2000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat sat on the mat with the dog", "en", "s", 35), (3, "the cat sat on the mat with the dog", "en", "s", 35), (4, "THE CAT sat on the mat with the dog", None, None, None), (None, "the end of the old road", "en", "s", 5), (5, long, "en", "s", len(long)), (6, "12 34", "en", "s", 5), (7, "le chat est sur la table avec le chien", "fr", "s", 38)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert [name for name, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), COLUMNS)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [3, 5, 7, None]  # a clean row stays, also without an id
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_near_duplicate_stage_keeps_a_row_of_each_group(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(60)) for x in "abcde"}
    rows = [(3, texts["a"], "one"), (5, texts["a"], "copy"), (5, texts["b"], "own"), (5, texts["c"], "other"), (None, texts["b"], "copy"), (None, texts["d"], "one"), (None, texts["d"], "one"), (None, texts["e"], None)]
    docs = spark.createDataFrame([(k, t, "en", s, 9) for k, t, s in rows], COLUMNS)
    named = [(3, "a", "one"), (5, "b", "own"), (5, "c", "other")]
    kept = [(r.doc_id, r.text[0], r.source) for r in cp.simhash(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([*named, (None, "d", "one"), (None, "e", None)], key=str)
    kept = [(r.doc_id, r.text[0], r.source) for r in first_of_groups(docs).collect()]
    assert sorted(kept, key=str) == sorted([*named, (None, "d", "one"), (None, "e", None)], key=str)


def test_language_stage_keeps_texts_that_switch_and_drops_undecided_ones(spark):
    own = {lang: [f"{a}{b}" for a in letters for b in letters] for lang, letters in {"aa": "bcdf", "bb": "klmn", "cc": "prst", "dd": "vwxz"}.items()}
    for number in (2, 4):
        langs = list(own)[:number]
        rows = [(100 * k + i, " ".join(own[lang][(i + j) % 16] for j in range(40)), lang) for k, lang in enumerate(langs) for i in range(60)]
        mixed = " ".join(" ".join(own[lang][j % 16] for j in range(30)) for lang in langs)
        rows += [(1001, mixed, None), (1002, "\u4e00 \u4e8c", None)]
        docs = spark.createDataFrame([(k, t, lang, "s", len(t)) for k, t, lang in rows], COLUMNS)
        model = language.learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
        found = {r.doc_id: r for r in language.identify(docs, model, sure="sure").collect()}
        assert found[1001].sure > 0.8 and found[1001].score < 0.6
        kept = {r.doc_id for r in cp.language_id(spark, docs, SF).collect()}
        assert 1001 in kept and 1002 not in kept, (number, found[1002])
        assert number != 4 or found[1001].score < cp.MIN_LANGUAGE_SCORE  # by that share the mixed text went
