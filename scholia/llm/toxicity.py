"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from one part of the labelled
sample, trees from a second, and the calibration from a third, so that no part
grades itself. Features are densities and rates of the whole text, computed over
Arrow buffers without a Python string for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, slices, table
from scholia.llm.words import Words, span_hashes, text_buffers

#: Most labelled rows that a model is fitted on, chosen by a hash of their key.
SAMPLE_ROWS = 8_000
#: Most lexicon entries; documents that an entry must occur in; least share of toxic ones among them (strong, weak).
LEXICON, MIN_DOCS, STRONG, WEAK = 4_000, 3, 0.8, 0.4
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
NEAR = 4
#: Words of address in the corpus' languages, and characters that stand in for letters.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "a"}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STAND = np.zeros(256, bool)
_UNMASK = _LOWER.copy()
for _a, _b in STAND_INS.items():
    _STAND[ord(_a)] = True
    _UNMASK[ord(_a)] = ord(_b)
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
NAMES = ["strong_density", "strong_hits", "weak_density", "near_you", "near_you_density", "capitals", "shouted", "exclaims", "marks", "masked", "masked_hits", "log_words"]


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = text_buffers(pa.array(words))
    return np.sort(span_hashes(data, offsets[:-1], offsets[1:]))


class _Set:
    """Membership of 64-bit hashes; a bit table turns most away before the search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = self.table[(x & np.uint64((1 << 18) - 1)).astype(np.int64)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, x[at]), len(self.hashes) - 1)
            found[at] = self.hashes[place] == x[at]
        return found


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word index, hash) of whole words and of their first bytes."""
    yield np.arange(len(start)), span_hashes(data, start, end)
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        # one more keeps a beginning apart from an equal whole word
        yield long, span_hashes(data, start[long], start[long] + n) + np.uint64(1)


def _rows(mask: np.ndarray, row: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(row[mask], minlength=count).astype(float)


@dataclass
class Lexicon:
    strong: np.ndarray
    weak: np.ndarray
    _sets: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"strong": self.strong, "weak": self.weak, "_sets": None}

    def hits(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._sets is None:
            self._sets = _Set(self.strong), _Set(self.weak)
        out = tuple(np.zeros(len(start), bool) for _ in range(2))
        for at, hashes in _keys(data, start, end):
            for found, known in zip(out, self._sets):
                found[at[known(hashes)]] = True
        return out


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """The dense features of each text, in the order of NAMES; zeros for null and empty."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    words = Words(data, offsets, ~_LETTER)
    lower = _LOWER[data]
    count = np.maximum(words.counts, 1).astype(float)
    strong, weak = lexicon.hits(lower, words.start, words.end)
    you = _Set(_hash_words(SECOND_PERSON))(span_hashes(lower, words.start, words.end))
    near = np.zeros(len(you), bool)
    for step in range(1, NEAR + 1):
        same = words.row[step:] == words.row[:-step]
        near[step:] |= you[:-step] & same
        near[:-step] |= you[step:] & same
    byte_row = np.repeat(np.arange(n), np.diff(offsets))
    bytes_in = np.maximum(np.diff(offsets), 1).astype(float)
    letters = np.maximum(np.bincount(byte_row, _LETTER[data], n), 1)
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = (words.end - words.start >= 3) & (ups[words.end] - ups[words.start] == words.end - words.start)
    masked = Words(data, offsets, ~(_LETTER | _STAND))
    start, end = masked.start.copy(), masked.end.copy()
    for _ in range(3):  # stand-ins at the ends are punctuation
        start += _STAND[data[np.minimum(start, len(data) - 1)]] & (start < end - 1) if len(data) else 0
        end -= _STAND[data[np.maximum(end - 1, 0)]] & (end - 1 > start) if len(data) else 0
    stands = np.concatenate([[0], np.cumsum(_STAND[data])])
    inner = np.flatnonzero((stands[end] - stands[start] > 0) & (stands[end] - stands[start] < end - start))
    revealed = lexicon.hits(_UNMASK[data], start[inner], end[inner])[0] if len(inner) else np.zeros(0, bool)
    hits = _rows(strong, words.row, n)
    close = _rows(strong & near, words.row, n)
    out = np.stack(
        [
            hits / count,
            hits,
            _rows(weak, words.row, n) / count,
            close,
            close / count,
            np.bincount(byte_row, _UPPER[data], n) / letters,
            _rows(shouted, words.row, n) / count,
            np.bincount(byte_row, data == 33, n) / count,
            np.bincount(byte_row, _MARK[data], n) / bytes_in,
            np.bincount(masked.row[inner], minlength=n) / count,
            np.bincount(masked.row[inner], revealed, n) if len(inner) else np.zeros(n),
            np.log1p(words.counts),
        ],
        axis=1,
    )
    return out


class BoostedTrees:
    """Binary trees of equal depth, grown level by level on quantile bins to reduce logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)  # bin b: at most edge b
        wide, many = self.bins, x.shape[1]
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            chance = 1 / (1 + np.exp(-score))
            slope, bend = y - chance, np.maximum(chance * (1 - chance), 1e-6)
            node = np.zeros(len(y), np.int64)
            which, cuts = [], []
            for level in range(self.depth):
                cells = (node[:, None] * many + np.arange(many)) * wide + binned
                shape = (1 << level, many, wide)
                size = (1 << level) * many * wide
                g, h = (np.bincount(cells.ravel(), np.repeat(v, many), size).reshape(shape).cumsum(2) for v in (slope, bend))
                total_g, total_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                gain[(h < 1) | (total_h - h < 1)] = 0
                gain[:, :, -1] = 0
                for f, e in enumerate(edges):
                    gain[:, f, len(e) :] = 0
                best = gain.reshape(1 << level, -1).argmax(1)
                feature, cut = best // wide, best % wide
                split = gain.reshape(1 << level, -1).max(1) > 0
                value = np.array([edges[f][c] if ok else np.inf for f, c, ok in zip(feature, cut, split)])
                which.append(feature)
                cuts.append(value)
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > value[node])
            leaves = np.bincount(node, slope, 1 << self.depth) / (np.bincount(node, bend, 1 << self.depth) + 1)
            score += self.rate * leaves[node]
            self.grown.append((np.concatenate(which), np.concatenate(cuts), self.rate * leaves))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for which, cuts, leaves in self.grown:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[every, which[at]] > cuts[at])
            out += leaves[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit by pooling adjacent violators; read between knots linearly."""
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    sizes = np.diff(np.append(first, len(y))).astype(float)
    pools: list[list[float]] = []
    for x, s, n in zip(xs, sums, sizes):
        pools.append([x, x, s, n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            a = pools.pop()
            pools[-1] = [pools[-1][0], a[1], pools[-1][2] + a[2], pools[-1][3] + a[3]]
    knots = [(x, s / n) for low, high, s, n in pools for x in dict.fromkeys((low, high))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, column: pa.Array) -> np.ndarray:
        raw = self.trees.score(features(column, self.lexicon))
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs of words and beginnings."""
    data, offsets = text_buffers(column)
    words = Words(data, offsets, ~_LETTER)
    found = [(words.row[at], h) for at, h in _keys(_LOWER[data], words.start, words.end)]
    row, key = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[fresh], key[fresh]


def learn_lexicon(rows: DataFrame, *, entries: int = LEXICON, min_docs: int = MIN_DOCS) -> Lexicon:
    """Words and beginnings whose documents are mostly toxic; ``rows`` has text and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, key = _entries(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("toxic").take(pa.array(row))], ["key", "toxic"])

    counted = rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "key long, toxic long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    share = F.col("bad") / (F.col("n") + 0.5)
    kept = counted.where((F.col("bad") >= min_docs) & (share >= WEAK)).withColumn("share", share)
    best = kept.orderBy(F.desc("bad"), "key").limit(entries).collect()  # at most ``entries`` rows
    part = [np.array([r["key"] for r in best if low <= r["share"] < high], np.int64).view(np.uint64) for low, high in ((STRONG, 2), (WEAK, STRONG))]
    return Lexicon(*part)


def fit(labelled: DataFrame) -> Model | None:
    """A model from rows (key, text, toxic); null unless both labels occur in the parts that grow and grade it.

    Rows of one key, also of a null one, count once: the text with the least
    hash, toxic if any of them is. So the caller's bound on keys bounds all that
    is collected, however often a row is repeated.
    """
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(20))
    own = F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))
    once = labelled.groupBy("key").agg(F.min(own)["text"].alias("text"), F.max(F.col("toxic").cast("long")).alias("toxic"))
    held = materialise(once.select("text", "toxic", part.alias("part")), "labelled")
    lexicon = learn_lexicon(held.where("part < 10"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic"), batch.column("part")], ["x", "toxic", "part"])

    rows = held.where("part >= 10").mapInArrow(run, "x array<double>, toxic long, part long").collect()  # at most SAMPLE_ROWS
    rows.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x, y, fold = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES)), np.array([r["toxic"] for r in rows]), np.array([r["part"] for r in rows])
    grow = fold < 16
    if len(np.unique(y[grow])) < 2:
        return None
    trees = BoostedTrees().fit(x[grow], y[grow])
    grade = ~grow
    knots = isotonic(trees.score(x[grade]), y[grade]) if len(np.unique(y[grade])) == 2 and grade.sum() >= 50 else None
    return Model(lexicon, trees, knots)


def held_out(key: Column) -> Column:
    """True for the fifth of rows that is never learned from."""
    return F.crc32(key.cast("string")) % 5 == 0


def score_toxicity(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts get the score of an empty text, very long ones are
    scored whole. Repeated rows are each scored, and alike. Without a model every
    score is 0. Input columns of the added names are replaced; an empty table
    stays empty.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            score = model.score(batch.column(text)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double", "predicted int"])
    return docs.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    sample = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(SAMPLE_ROWS)
    model = fit(docs.join(sample, "doc_id").select(F.col("doc_id").alias("key"), "text", "toxic"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
