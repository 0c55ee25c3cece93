"""Substring, SimHash, decontamination and language operators against brute force and on odd rows."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from scholia.llm import decontamination, language, simhash, substring, words
from scholia.llm.components import connected

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_substring(rows, window):
    held = {k: (t or "").encode().split() for k, t in rows}
    first = {}
    for k in sorted(held):
        for i in range(len(held[k]) - window + 1):
            first.setdefault(b" ".join(held[k][i : i + window]), k)
    out = {}
    for k, w in held.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out[k] = len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def test_words_match_python_split():
    texts = ["", None, " a  b\tc\x0bd\n", "é ü\u00a0x", "one", "a b " * 50, "\x1c x"]
    found = words.Words(*words.text_buffers(pa.array(texts)))
    assert found.counts.tolist() == [len((t or "").encode().split()) for t in texts]
    hashes = dict()
    spans = [x for t in texts for x in (t or "").encode().split()]
    for word, h in zip(spans, found.hashes().tolist()):
        assert hashes.setdefault(word, h) == h
    assert len(set(hashes.values())) == len(hashes)


@pytest.mark.parametrize("window", [1, 3, 4, 13, 20])
def test_substring_against_brute_force(spark, window):
    rng = np.random.default_rng(window)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary, 30)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 25))) for _ in range(3)]
        parts.insert(int(rng.integers(0, 3)), passages[int(rng.integers(0, 4))])
        rows.append((k, "\n".join(parts) if k % 7 else parts[1]))
    rows += [(60, None), (61, ""), (62, "short"), (63, rows[5][1]), (64, rows[5][1]), (65, "same word " * 3000), (66, "same word " * 3000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.substring_dedup(docs, window=window).collect()}
    assert found == brute_substring(rows, window)


def test_substring_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(20))
    rows = [(None, text), (1, text), (1, text), (2, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed) for r in substring.substring_dedup(docs).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (2, 20)]
    assert substring.substring_dedup(docs.limit(0)).count() == 0


def test_substring_query_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    expected = sorted(db.sql(substring.SQL).fetchall())
    assert sorted(map(tuple, substring.op2_substring_dedup(spark, SF).collect())) == expected


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    parent = {k: k for k, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in prints}


def test_simhash_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    groups = brute_components(prints, 4)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_near_dedup(spark, SF).collect()}
    assert found == {k: (f"{p:016x}", groups[k]) for k, p in prints}


def test_simhash_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (4, "Some Words here now then"), (8, "some words HERE now then"), (8, "some words HERE now then"), (None, "some words here now then"), (None, "lonely text of other words"), (7, "x" * 100_000 + " y" * 1000)]
    found = simhash.near_duplicates(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fingerprint string"))
    held = sorted(((r.doc_id, r.component_id) for r in found.collect()), key=str)
    assert held == sorted([(5, 3), (3, 3), (9, 3), (4, 4), (8, 4), (8, 4), (None, 4), (None, None), (7, 7)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_close_links_against_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)], np.uint64)
    prints = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    expected = brute_components([(int(p), int(p)) for p in prints], 4)
    for parts in (1, 2):
        pairs = []
        halves = np.array_split(rng.permutation(prints), parts)
        for i, a in enumerate(halves):
            for b in [None, *halves[i + 1 :]]:
                u, v = simhash.close_links(a, b, tile=16)
                pairs += list(zip(u.tolist(), v.tolist()))
                assert len(u) < len(a) + (0 if b is None else len(b))
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        assert {k: find(k) for k in parent} == expected


def test_small_blocks_give_the_same_groups(spark):
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 20, 500).astype(np.int64))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    groups = [sorted((r.node, r.root) for r in connected(simhash.links(frame, 2, block)).collect()) for block in (1 << 16, 20)]
    assert groups[0] == groups[1]


def test_blocks_cover_all_cells_and_meet_all_neighbours(spark):
    rng = np.random.default_rng(9)
    prints = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    prints[:800] = prints[0] ^ (1 << rng.integers(0, 62, 800)) ^ (1 << rng.integers(0, 62, 800))
    frame = spark.createDataFrame([(int(p),) for p in np.unique(prints)], "fp long")
    cells = {r.cell: r["count"] for r in frame.select(simhash._cell(simhash.F.col("fp")).alias("cell")).groupBy("cell").count().collect()}
    owner, boxes = simhash.blocks(cells, 100)
    places = {c: np.array([c // 17**i % 17 for i in (3, 2, 1, 0)]) for c in cells}
    sizes = Counter()
    for c, n in cells.items():
        low, high, _ = boxes[owner[c]]
        assert (low[:4] <= places[c]).all() and (places[c] <= high[:4]).all() and low[4] <= places[c].sum() <= high[4]
        sizes[owner[c]] += n
    assert all(n <= 100 * boxes[i][2] for i, n in sizes.items())
    ends = np.cumsum([b[2] for b in boxes])
    reach = {(i, int(np.searchsorted(ends, low, "right"))) for i, low, high in simhash._meetings(boxes, 4)}
    for a in cells:
        for b in cells:
            if np.abs(places[a] - places[b]).sum() <= 4:
                assert (owner[a], owner[b]) in reach
    assert len(reach) < len(boxes) ** 2  # some pairs are never dealt
    expected = brute_components([(int(p), int(p)) for p in np.unique(prints)], 4)
    found = {r.node: r.root for r in connected(simhash.links(frame, 4, 100)).collect()}
    assert {k: v for k, v in expected.items() if k != v} == found


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (1, 0)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(50)}}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


ITEM = "What holds the third river of the old northern valley together in winter? The frozen bridge built by early settlers from pine."


def test_decontamination_finds_copies_and_leaves_others(spark):
    noise = " ".join(f"noise{i}" for i in range(300))
    half = ITEM.split("?")[0]
    rows = [(1, f"{noise} {ITEM} {noise}"), (2, noise), (3, f"{noise} {half}? {noise}"), (4, ITEM.upper()), (5, None), (6, ""), (None, ITEM), (7, f"{noise} {ITEM.replace(' old ', ' ancient ')} {noise}"), (8, " ".join(reversed(ITEM.split())))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    items = spark.createDataFrame([(10, ITEM), (11, None), (None, "x"), (12, "too short"), (13, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    found = decontamination.contamination(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(1, 10), (4, 10), (None, 10), (7, 10)], key=str)
    kept = decontamination.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8] and kept.columns == docs.columns
    assert decontamination.contamination(docs, items.limit(0)).count() == 0 and decontamination.contamination(docs.limit(0), items).count() == 0


def test_an_edit_at_the_end_hides_no_copy(spark):
    noise = " ".join(f"noise{i}" for i in range(150))
    item = "Which of the seven stone bridges over the green river stood longest after that flood? Number two did."
    words = item.split()
    texts = [" ".join([*words[:k], "edited", *words[k + 1 :]]) for k in range(len(words) - 5, len(words))]
    texts += [" ".join([*words[:k], *words[k + 1 :]]) for k in range(len(words) - 5, len(words))]
    texts += [" ".join([*words[:k], "put", *words[k:]]) for k in range(len(words) - 5, len(words) + 1)]
    texts.append(item.split("?")[0])  # cut off before the answer
    clean = [" ".join(words[: len(words) // 2]), " ".join(words[i ^ 1] for i in range(len(words) - 1))]
    docs = spark.createDataFrame([(i, f"{noise} {t} {noise}") for i, t in enumerate(texts + clean)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), *((i, f"other words{i} in number{i} that{i} nobody{i} copied{i}") for i in range(2, 20))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contamination(docs, items).collect()) == [(i, 1) for i in range(len(texts))]
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items).collect()) == [len(texts), len(texts) + 1]


def test_long_items_and_several_indexes(spark):
    long = " ".join(f"term{i}" for i in range(200))
    docs = spark.createDataFrame([(1, "start " * 90 + long + " end" * 70), (2, "start " * 400)], "doc_id long, text string")
    items = spark.createDataFrame([(i, long if i == 5 else f"other item number {i} with its own words") for i in range(9)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(docs, items, limit=200).collect()} == {(1, 5)}


def test_answers_of_long_items_and_very_short_items(spark):
    """The question alone of a long item is clean, wherever its answer is missing; short items are matched whole."""
    question, answer = " ".join(f"ask{i}" for i in range(99)) + " end?", " ".join(f"tell{i}" for i in range(24)) + "."
    noise = " ".join(f"noise{i}" for i in range(200))
    far = " ".join(f"far{i}" for i in range(500))
    texts = {
        1: f"{noise} {question} {noise}", 2: f"{noise} {question} {answer} {noise}", 3: f"{noise} {answer} {noise}", 4: f"{question} {far} {answer}",
        5: f"{noise} {question.replace('ask50 ', 'edit ')} {answer.replace('tell12 ', 'edit ')} {noise}", 6: f"{noise} capital of FRANCE, paris {noise}", 7: f"{noise} capital of noise paris", 8: f"{question} {' '.join(answer.split()[:12])} {noise}",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{question} {answer}"), (2, "Capital of France? Paris"), (3, "?!"), (4, "Capital of France? Paris")], "item_id long, text string")
    expected = [(2, 1), (4, 1), (5, 1), (6, 2), (6, 4)]
    found = decontamination.contamination(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == expected
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contamination(docs, items, limit=300).collect()) == expected
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, items, limit=300).collect()) == [1, 3, 7, 8]
    twice = docs.unionByName(docs)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contamination(twice, items).collect()) == sorted(expected * 2)


def test_verdicts_against_brute_force():
    """Copies of all lengths with edits: the verdict by plain loops over words, given that the item is retrieved."""
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(60):
        size = int(rng.integers(3, 150))
        words = list(rng.choice(vocabulary, size))
        cut = int(rng.integers(1, size)) if size > 4 else 0
        rows.append((i, " ".join(words[:cut]) + ("? " if cut else "") + " ".join(words[cut:])))
        for edits in (0, 1, 3, size // 6):
            copy = list(words)
            for at in rng.choice(size, min(edits, size), replace=False):
                copy[at] = f"edit{at}"
            texts.append(" ".join([*rng.choice(vocabulary, 90), *copy, *rng.choice(vocabulary, 70)]))
    index = decontamination.Index.build(rows)
    found = {(row, item) for row, item, *_ in index.links(pa.array(texts))}

    def held(own, text):
        n = min(5, len(own))
        out = [False] * len(own)
        grams = {tuple(text[j : j + n]) for j in range(len(text) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in grams:
                out[i : i + n] = [True] * n
        return out

    for t, text in enumerate(texts):
        for i, (_, item) in enumerate(rows):
            own, cut = item.replace("?", "").split(), len(item.split("?")[0].split()) if "?" in item else 0
            got = held(own, text.split())
            parts = [got[:cut], got[cut:]] if cut else [got]
            if all(sum(x) >= 0.8 * len(x) for x in parts):
                assert (t, i) in found
            elif sum(got) < 0.35 * len(got):
                assert (t, i) not in found
    assert len({i for t, i in found if t % 4 == 0}) == 60


def test_walk_and_long_lists(monkeypatch):
    """Terms whose lists are left unopened lose nothing."""
    rng = np.random.default_rng(4)
    rows = [(i, "the of and " + " ".join(rng.choice([f"t{j}" for j in range(300)], 20))) for i in range(300)]
    texts = pa.array([" ".join(["the", "of", *rows[i][1].split(), "and"]) for i in range(0, 300, 7)])
    index = decontamination.Index.build(rows)
    plain = sorted(index.links(texts))
    monkeypatch.setattr(decontamination, "LONG_LIST", 20)
    assert sorted(index.links(texts)) == plain and {(a, b) for a, b, *_ in plain} >= {(k, 7 * k) for k in range(len(texts))}


def test_decontamination_query_against_brute_force(spark):
    def shingles(t):
        w = re.findall(r"\S+", t.lower())
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = shingles(r.text or "")
        expected |= {(r.doc_id, i) for i, x in items.items() if x and len(x & own) >= 0.8 * len(x)}
    assert expected and {(r.doc_id, r.item_id) for r in decontamination.op5_benchmark_decontamination(spark, SF).collect()} == expected


def test_retrieval_is_exhaustive():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 30)))) for i in range(70)]
    index = decontamination.Index.build(rows)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 300))) for _ in range(20)]
    found = decontamination._words(pa.array(texts))
    hashes = found.hashes(lower=True)
    got = {(a, b, c): round(d, 6) for a, b, c, d in zip(*(x.tolist() for x in index.retrieve(found, hashes)))}
    expected = {}
    for row in range(len(texts)):
        own = hashes[found.first[row] : found.first[row + 1]]
        for p in range(-(-len(own) // 64)):
            terms = np.flatnonzero(np.isin(index.terms, own[p * 64 : p * 64 + 128]))
            score = np.zeros(len(index.least))
            for t in terms:
                for q in range(index.post_at[t], index.post_at[t + 1]):
                    score[index.post_part[q]] += index.post_impact[q]
            expected |= {(row, p, int(i)): round(float(score[i]), 6) for i in np.flatnonzero(score >= index.least - 1e-9)}
    assert expected and got == expected


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    first = np.array([0, 0, 5, 305, 306, 306, 700])
    scores, transitions = rng.normal(size=(700, 3)), np.exp(rng.normal(size=(3, 3)))
    got, counts = language.forward_backward(scores, first, transitions, pairs=True)
    expected, pairs, e = np.empty_like(got), np.zeros((3, 3)), np.exp(scores)
    for a, b in zip(first, first[1:]):
        states, state = [], np.full(3, 1 / 3)
        for t in range(a, b):
            state = (state @ transitions) * e[t]
            state /= state.sum()
            states.append(state)
        back = np.ones(3)
        for t in range(b - 1, a - 1, -1):
            chance = states[t - a] * back
            expected[t] = chance / chance.sum()
            joint = (states[t - a - 1] if t > a else np.full(3, 1 / 3))[:, None] * transitions * (e[t] * back)
            pairs += joint / joint.sum()
            back = transitions @ (e[t] * back)
            back /= back.sum()
    assert np.allclose(got, expected) and np.allclose(counts, pairs)


def test_language_query_held_out_accuracy(spark):
    found = language.op7_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    texts = [("the cat and the dog sat on that mat with them", "en"), ("der hund und die katze auf der matte mit ihnen", "de")] * 20
    model = language.train(texts)
    rows = [(1, "the dog"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "123 !!"), (6, "1" * 200_000), (7, "\u00d7\u00f7 \u20ac"), (8, "the cat " * 30_000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert [found[i][0] for i in range(1, 9)] == ["en", "de", "und", "und", "und", "und", "und", "en"]
    assert found[3] == ("und", 0.0) and language.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.learn(docs.selectExpr("doc_id as key", "text", "cast(null as string) as lang")) is None


def test_every_language_is_learned(spark):
    """More than 32 languages, one of which has long texts alone."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 30 if k else 1500)), f"l{k:02}") for i in range(20 if k < 39 else 4)]
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "l00") > language.SAMPLE_BYTES
    model = language.learn(docs)
    assert model.languages == sorted({lang for *_, lang in rows}) and len(model.languages) == 40
    found = language.identify(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(rows)
    assert all(any(r.lang_pred == r.lang for r in found if r.lang == lang) for lang in ("l00", "l39"))


def test_words_of_mixed_texts_are_labelled(spark):
    """Spliced texts: the runs cover all words in order and mostly change where the text does."""
    own = {lang: [f"{a}{b}{a}" for a in letters for b in letters] for lang, letters in {"aa": "bcdf", "bb": "klmn", "cc": "prst"}.items()}
    rng = np.random.default_rng(2)
    model = language.train([(" ".join(rng.choice(own[lang], 40)), lang) for lang in own for _ in range(60)])
    truth, texts = [], []
    for _ in range(30):
        parts = [(lang, int(rng.integers(5, 40))) for lang in rng.permutation(list(own))]
        truth.append([lang for lang, n in parts for _ in range(n)])
        texts.append("  ".join(", ".join(rng.choice(own[lang], n)) for lang, n in parts))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "12 !!"), (103, "bcb " * 40_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    found = {r.doc_id: r.spans for r in language.label_words(docs, model).collect()}
    right = total = 0
    for i, labels in enumerate(truth):
        got = [s.lang for s in found[i] for _ in range(s.words)]
        assert len(got) == len(labels) and [s["first"] for s in found[i]] == np.cumsum([0, *(s.words for s in found[i])])[:-1].tolist()
        assert all(re.findall("[a-z]+", texts[i].encode()[s.start : s.end].decode()) for s in found[i])
        assert found[i][0].start == 0 and found[i][-1].end == len(texts[i].encode()) and all(0 < s.chance <= 1 for s in found[i])
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right >= 0.97 * total
    assert found[100] == found[101] == found[102] == [] and [(s.lang, s.words) for s in found[103]] == [("aa", 40_000)]
    assert language.label_words(docs.limit(0), model).count() == 0 and all(r.spans == [] for r in language.label_words(docs, None).collect())
