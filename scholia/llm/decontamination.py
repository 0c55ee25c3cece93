"""Benchmark decontamination: BM25 over an inverted index of test items by block-max WAND, then overlap.

Every passage of every training document is a query. An item is retrieved if the
passage gives it at least a fixed share of the score that its own text gives it,
so the threshold is the same for short and long items. Passages and blocks of
items are skipped by upper bounds (for a slice of passages at once); what is
left is walked document at a time: cursors sorted by item, a pivot where the
terms' ceilings reach the threshold, and the exact score where the pivot's block
maxima do. All bounds are upper bounds, so all items above the threshold are
retrieved.

A retrieved item is verified as a whole over the whole document: it counts if most words of its question and most
words of its answer lie in five-word sequences that both texts have, or follow
on beside one. Where question or answer is too short to bear an edit
(``SHORT``), most words of the whole item suffice. So an edit in or near a short
answer hides nothing, and the question alone of an item with a long answer is no
copy.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, slices, table
from scholia.llm.words import Words, grams, text_buffers

K1, B = 1.2, 0.75
#: Passages of this many words start every STRIDE words; an item longer than STRIDE is indexed in parts, of which one must be retrieved.
PASSAGE, STRIDE = 128, 64
#: Parts of items in a block that share upper bounds.
BLOCK_ITEMS = 2
#: Block postings from which a term's list is left to its ceiling in the first bound, where such terms together stay under half the least threshold.
LONG_LIST = 4096
#: Share of an item's own score that a passage must reach; shared words of question and answer; words of a sequence.
RETRIEVE, OVERLAP, SHINGLE = 0.5, 0.8, 5
#: A question or answer of fewer words is judged together with the rest of its item.
SHORT = 2 * SHINGLE
#: Text bytes of items in one index; more items make more indexes, each of which passes over the documents.
INDEX_BYTES = 16 << 20

_SEPARATORS = np.ones(256, bool)
_SEPARATORS[48:58] = _SEPARATORS[65:91] = _SEPARATORS[97:123] = _SEPARATORS[128:] = False
_ANSWER = re.compile(r"(?s).*[.!?\n](?=\s*\S)")
LINKS = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


def _words(column: pa.Array) -> Words:
    return Words(*text_buffers(column), _SEPARATORS)


def answer_start(text: str) -> int:
    """Where the last sentence or line of an item, its answer, begins; 0 if it is the only one."""
    found = _ANSWER.match(text)
    return found.end() if found else 0


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Text:
    """A document's word hashes, with its sequences of n words in hash order for each n that is asked for."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, mine: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sequence of n words, where its equals begin and end in the document's order, and that order."""
        if n not in self._sorted:
            theirs = grams(self.hashes, n)
            order = np.argsort(theirs, kind="stable")
            self._sorted[n] = theirs[order], order
        theirs, order = self._sorted[n]
        return np.searchsorted(theirs, mine, "left"), np.searchsorted(theirs, mine, "right"), order


def _follows(own: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Words of ``own`` up to ``n`` places beside a sequence shared at (i, j) that ``text`` has in the same place, or one further or nearer."""
    step = np.concatenate([np.arange(-n, 0), np.arange(n, 2 * n)])
    k = (i[:, None] + step)[:, :, None]
    t = (j[:, None] + step)[:, :, None] + np.arange(-1, 2)
    inside = (k >= 0) & (k < len(own)) & (t >= 0) & (t < len(text))
    k = np.broadcast_to(k, t.shape)[inside]
    found = np.zeros(len(own), bool)
    found[k[own[k] == text[t[inside]]]] = True
    return found


@dataclass
class Index:
    """Terms (sorted hashes), postings by term, block maxima by term, each part's threshold and item, and each item's text and answer."""

    items: np.ndarray
    owner: np.ndarray
    terms: np.ndarray
    post_at: np.ndarray
    post_part: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    least: np.ndarray
    block_least: np.ndarray
    ceiling: np.ndarray
    texts: list[np.ndarray]
    answers: list[int]

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> Index | None:
        """From (item_id, text); wordless items are left out. Null without any other."""
        rows = sorted(rows)
        words = _words(pa.array([t for _, t in rows], pa.string()))
        hashes = words.hashes(lower=True)
        items, owner, wholes, answers, texts = [], [], [], [], []
        for i, (item, text) in enumerate(rows):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            cut = words.offsets[i] + len(text[: answer_start(text)].encode())
            count = -(-(b - a) // STRIDE)
            cuts = [(b - a) * p // count for p in range(count + 1)]
            owner += [len(items)] * count
            texts += [hashes[a + low : a + high] for low, high in zip(cuts, cuts[1:])]
            items.append(item)
            wholes.append(hashes[a:b])
            answers.append(int(np.searchsorted(words.start[a:b], cut)))
        if not items:
            return None
        lengths = np.array([len(t) for t in texts], float)
        part = np.repeat(np.arange(len(texts)), lengths.astype(int))
        terms, term = np.unique(np.concatenate(texts), return_inverse=True)
        pair, often = np.unique(term.astype(np.int64) * len(texts) + part, return_counts=True)
        term, part = pair // len(texts), pair % len(texts)
        within = np.bincount(term, minlength=len(terms))
        rarity = np.log1p((len(texts) - within + 0.5) / (within + 0.5))
        impact = rarity[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * lengths[part] / lengths.mean()))
        least = RETRIEVE * np.bincount(part, impact)
        block_of = part // BLOCK_ITEMS
        blocks = int(-(-len(texts) // BLOCK_ITEMS))
        cell, first = np.unique(term * blocks + block_of, return_index=True)
        return cls(
            np.array(items), np.array(owner), terms, np.searchsorted(term, np.arange(len(terms) + 1)), part, impact,
            np.searchsorted(cell // blocks, np.arange(len(terms) + 1)), cell % blocks, np.maximum.reduceat(impact, first),
            least, np.minimum.reduceat(least, np.arange(0, len(texts), BLOCK_ITEMS)), np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(terms)))), wholes, answers,
        )

    def retrieve(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(batch row, passage of it, part, score) of every part at or above its threshold."""
        place = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[place] == hashes)
        term, row = place[known], words.row[known]
        stretch = (known - words.first[row]) // STRIDE
        # stretches of a row are numbered on; passage s covers stretches s and s + 1
        counts = -(-words.counts // STRIDE)
        base = np.cumsum(counts) - counts
        passage = base[row] + stretch
        total = int(counts.sum())
        passage, term = np.concatenate([passage, passage[stretch > 0] - 1]), np.concatenate([term, term[stretch > 0]])
        ceiling = np.bincount(passage, self.ceiling[term], total)  # repeated words count again: an upper bound still
        keep = ceiling[passage] >= self.least.min()
        pair = np.unique(passage[keep] * len(self.terms) + term[keep])
        passage, term = pair // len(self.terms), pair % len(self.terms)
        keep = np.bincount(passage, self.ceiling[term], total)[passage] >= self.least.min()
        passage, term = passage[keep], term[keep]
        # long lists of weak terms aren't opened: their ceilings stand for them
        sizes = self.block_at[term + 1] - self.block_at[term]
        order = np.lexsort((self.ceiling[term], passage))
        summed = np.cumsum(np.where(sizes >= LONG_LIST, self.ceiling[term], 0)[order])
        edge = np.searchsorted(passage[order], passage[order], "left")
        weak = np.empty(len(term), bool)
        weak[order] = summed - np.where(edge > 0, summed[edge - 1], 0) < self.least.min() / 2
        weak &= sizes >= LONG_LIST
        spare = np.bincount(passage[weak], self.ceiling[term[weak]], total)
        # upper bounds of each block of items that a passage shares another term with
        opened = np.where(weak, 0, sizes)
        at = _ragged(self.block_at[term], opened)
        blocks = len(self.block_least)
        cell, inverse = np.unique(np.repeat(passage, opened) * blocks + self.block[at], return_inverse=True)
        cell = cell[np.bincount(inverse, self.block_impact[at], len(cell)) + spare[cell // blocks] >= self.block_least[cell % blocks] - 1e-9]
        passages, first = np.unique(cell // blocks, return_index=True)
        low, high = np.searchsorted(passage, passages, "left"), np.searchsorted(passage, passages, "right")
        ends = np.append(first[1:], len(cell))
        found = []
        for i, p in enumerate(passages.tolist()):
            live = cell[first[i] : ends[i]] % blocks
            found += [(p, part, score) for part, score in self.walk(term[low[i] : high[i]], live)]
        passage, part = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        row = np.searchsorted(base + counts, passage, side="right")
        return row, passage - base[row], part, np.array([f[2] for f in found], float)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sort keys (term, part) of the postings and (term, block) of the block maxima."""
        parts, blocks = len(self.least), len(self.block_least)
        terms = np.arange(len(self.terms))
        return np.repeat(terms, np.diff(self.post_at)) * parts + self.post_part, np.repeat(terms, np.diff(self.block_at)) * blocks + self.block

    def walk(self, terms: np.ndarray, live: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND over the ``live`` blocks: (part, score) at or above the part's threshold, in order.

        A cursor holds its place, parts, impacts, ceiling and block maxima.
        """
        theta = float(self.block_least[live].min()) - 1e-9
        postings, blocks = self.keys
        parts = len(self.least)
        at = terms[:, None] * parts + live * BLOCK_ITEMS
        low, high = np.searchsorted(postings, at), np.searchsorted(postings, np.minimum(at + BLOCK_ITEMS, (terms[:, None] + 1) * parts))
        top = np.searchsorted(blocks, terms[:, None] * len(self.block_least) + live)
        cursors = []
        for i in np.flatnonzero((high > low).any(axis=1)).tolist():
            inside = np.flatnonzero(high[i] > low[i])
            spans = [slice(a, b) for a, b in zip(low[i, inside].tolist(), high[i, inside].tolist())]
            here, impacts = ([x for span in spans for x in column[span].tolist()] for column in (self.post_part, self.post_impact))
            maxima = dict(zip(live[inside].tolist(), self.block_impact[top[i, inside]].tolist()))
            cursors.append([0, here, impacts, float(self.ceiling[terms[i]]), maxima])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]])
            total, pivot = 0.0, None
            for c in cursors:
                total += c[3]
                if total >= theta:
                    pivot = c[1][c[0]]
                    break
            if pivot is None:
                break
            if cursors[0][1][cursors[0][0]] < pivot:  # nothing before the pivot can reach the threshold
                for c in cursors:
                    if c[1][c[0]] >= pivot:
                        break
                    c[0] = bisect_left(c[1], pivot, c[0])
            else:
                here = [c for c in cursors if c[1][c[0]] == pivot]
                least = float(self.least[pivot]) - 1e-9
                if sum(c[4][pivot // BLOCK_ITEMS] for c in here) >= least and (score := sum(c[2][c[0]] for c in here)) >= least:
                    found.append((pivot, score))
                for c in here:
                    c[0] += 1
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return found

    def held(self, item: int, text: _Text) -> tuple[np.ndarray, np.ndarray]:
        """Which words of an item lie in sequences of SHINGLE words (all, if it has fewer) that a text shares, and which do or follow on."""
        own = self.texts[item]
        n = min(SHINGLE, len(own))
        low, high, order = text.places(grams(own, n), n)
        hit = np.flatnonzero(high > low)
        depth = np.zeros(len(own) + 1, np.int64)
        np.add.at(depth, hit, 1)
        np.add.at(depth, hit + n, -1)
        held = np.cumsum(depth)[:-1] > 0
        wide = held.copy()
        for i in hit[~(held[np.maximum(hit - 1, 0)] & held[np.minimum(hit + n, len(own) - 1)])].tolist():  # sequences beside a gap
            for at in range(int(low[i]), int(high[i]), 4096):
                j = order[at : min(at + 4096, int(high[i]))]
                wide |= _follows(own, text.hashes, np.full(len(j), i), j, n)
        return held, wide

    def verdict(self, item: int, held: np.ndarray, wide: np.ndarray) -> tuple[float, float, bool]:
        """Overlap of question and answer (of the whole item where it has one of them alone), and whether the item counts."""
        cut, size = self.answers[item], len(held)
        question, answer = (held[:cut], held[cut:]) if 0 < cut < size else (held, held)
        counts = question.mean() >= OVERLAP and answer.mean() >= OVERLAP
        if not counts and 0 < cut < size:
            counts = wide[:cut].mean() >= OVERLAP and wide[cut:].mean() >= OVERLAP
        if not counts and (not 0 < cut < size or min(cut, size - cut) < SHORT):
            counts = wide.mean() >= OVERLAP
        return float(question.mean()), float(answer.mean()), bool(counts)

    def links(self, column: pa.Array) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(batch row, item, first word of the passage, score, question and answer overlap), an item once for each row."""
        words = _words(column)
        hashes = words.hashes(lower=True)
        if not len(hashes):
            return
        best: dict[tuple[int, int], tuple] = {}
        for row, passage, part, score in zip(*(x.tolist() for x in self.retrieve(words, hashes))):
            key = row, int(self.owner[part])
            if key not in best or (score, -passage) > (best[key][1], -best[key][0]):
                best[key] = passage, score
        last, text = -1, None
        for (row, item), (passage, score) in sorted(best.items()):
            if row != last:
                last, text = row, _Text(hashes[words.first[row] : words.first[row + 1]])
            question, answer, counts = self.verdict(item, *self.held(item, text))
            if counts:
                yield row, int(self.items[item]), passage * STRIDE, score, question, answer


def indexes(spark: SparkSession, items: DataFrame, *, item_id: str = "item_id", text: str = "text", limit: int = INDEX_BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast indexes of at most about ``limit`` bytes of item text each, one at a time, and whether there are more than one.

    An index is taken back when the next is asked for, so that driver and
    executors hold one, however large the benchmark is. Null ids and texts are
    left out.
    """
    held = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // limit))
    for p in range(parts):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).distinct().collect()
        if (index := Index.build([(r["item_id"], r["text"]) for r in rows])) is not None:
            shared = spark.sparkContext.broadcast(index)
            yield shared, parts > 1
            if parts > 1:
                shared.unpersist()


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **index: object) -> DataFrame:
    """One row for each document and test item that it holds: see LINKS for the columns.

    Documents without a link give no row; null and empty texts have none. Rows of
    one doc_id, also null, are judged each, so equal rows give equal links. Equal
    items are linked each. An item of fewer than SHINGLE words is matched by its
    whole word sequence, so one of a single common word marks all documents that
    have it. No items or no documents give no rows. Very long texts are judged
    whole, passage by passage.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], LINKS)
    for shared, several in indexes(spark, items, **index):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                ids = batch.column("doc_id")
                rows = [(ids[row].as_py(), *rest) for row, *rest in shared.value.links(batch.column("text"))]
                if rows:
                    kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in LINKS.split(", ")])

        found = held.mapInArrow(run, LINKS)
        out = out.unionByName(materialise(found, "leaks") if several else found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", **index: object) -> DataFrame:
    """The rows of ``docs`` that hold no test item, unchanged and without a shuffle.

    Rows are judged each, also repeated ones and those without an id; null and
    empty texts are clean. Without items or documents, ``docs`` comes back. With
    more than one index, what each leaves is written before the next.
    """
    for shared, several in indexes(docs.sparkSession, items, **index):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                clean = np.ones(batch.num_rows, bool)
                clean[[link[0] for link in shared.value.links(batch.column(text))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = materialise(docs, "clean")
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
