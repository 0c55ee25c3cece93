"""Language identification by a linear-chain conditional random field over words.

Each word has a score for each language from its whole form (lexicon), its
first and last bytes (affixes) and the n-grams inside, all hashed into one table
of weights; transitions are learned from sequences that switch between
languages. Forward-backward gives each word's chances, whose mean over the text
names the document's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import slices, table
from scholia.llm.toxicity import held_out
from scholia.llm.words import Words, span_hashes, text_buffers

UNKNOWN = "und"
#: The bounded sample that is learned from: documents of each language, their longest text in bytes, and documents in all (one of each language at least).
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_ROWS = 150, 8_000, 4_800
TABLE_BITS, NGRAMS, AFFIXES = 16, (2, 3), (2, 3)
EPOCHS, RATE = 3, 0.3
#: Text bytes whose n-gram sums a task holds at a time, for up to four languages; fewer for more.
TEXT_BYTES = 1 << 19
#: Words of a training piece, and of a block in forward-backward.
PIECE, BLOCK = 48, 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _fold(hashes: np.ndarray, salt: int) -> np.ndarray:
    x = (hashes + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class WordFeatures:
    """Table slots of words: a few for each word, and one for each n-gram start in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words = words = Words(data, offsets, ~_LETTER)
        low = _LOWER[data]
        start, end = words.start, words.end
        slots = [_fold(span_hashes(low, start, end), 1)]
        for n in AFFIXES:
            slots.append(_fold(span_hashes(low, start, np.minimum(start + n, end)), 10 + n))
            slots.append(_fold(span_hashes(low, np.maximum(end - n, start), end), 20 + n))
        self.slots = np.stack(slots, 1) if len(start) else np.empty((0, 1 + 2 * len(AFFIXES)), np.int64)
        self.grams = []
        wide = low.astype(np.uint64)
        for n in NGRAMS:
            code = np.zeros(max(0, len(low) - n + 1), np.uint64)
            for i in range(n):
                code = code * np.uint64(257) + wide[i : i + len(code)]
            self.grams.append((_fold(code, 30 + n), np.maximum(end - n + 1, start)))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.slots].sum(axis=1)
        for slots, stop in self.grams:
            sums = np.zeros((len(slots) + 1, weights.shape[1]))
            np.cumsum(weights[slots], axis=0, out=sums[1:])
            out = out + sums[np.minimum(stop, len(slots))] - sums[np.minimum(self.words.start, len(slots))]
        return out

    def gradient(self, errors: np.ndarray, pick: np.ndarray) -> np.ndarray:
        """Sums of word errors by slot; ``pick`` are the words that errors belong to."""
        slots, values = [self.slots[pick].ravel()], [np.repeat(errors, self.slots.shape[1], axis=0)]
        for table_slots, stop in self.grams:
            start = self.words.start[pick]
            sizes = np.maximum(stop[pick] - start, 0)
            at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            slots.append(table_slots[at])
            values.append(np.repeat(errors, sizes, axis=0))
        slots, values = np.concatenate(slots), np.concatenate(values)
        return np.stack([np.bincount(slots, values[:, k], 1 << TABLE_BITS) for k in range(errors.shape[1])], 1)


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Chances of each word's labels in chains; ``first`` holds each chain's first word (one more than chains).

    Chains are cut into blocks. The product of a block's matrices carries exact
    messages from block to block, and all blocks then run side by side. With
    ``pairs``, also the expected counts of label pairs.
    """
    n, labels = scores.shape
    if not n:
        return (scores, np.zeros((labels, labels))) if pairs else scores
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    chain_block = np.cumsum(blocks) - blocks
    chain = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - first[chain]
    block, step = chain_block[chain] + place // BLOCK, place % BLOCK
    size = np.bincount(block, minlength=total)
    emit = np.ones((BLOCK, total, labels))
    emit[step, block] = np.exp(scores - scores.max(axis=1, keepdims=True))
    order = np.argsort(-size, kind="stable")  # longest first: the blocks still running are a prefix
    emit = emit[:, order]
    running = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # blocks longer than step t
    product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(BLOCK):
        k = running[t]
        if not k:
            break
        moved = (product[:k].reshape(-1, labels) @ transitions).reshape(k, labels, labels) * emit[t, :k, None, :]
        product[:k] = moved / moved.max(axis=(1, 2), keepdims=True)
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    product = product[back]
    ahead = np.empty((total, labels))
    behind = np.ones((total, labels))
    live = np.flatnonzero(blocks)
    state = np.full((len(live), labels), 1.0 / labels)
    for j in range(int(blocks.max())):
        keep = blocks[live] > j
        live, state = live[keep], state[keep]
        at = chain_block[live] + j
        ahead[at] = state
        state = np.einsum("ci,cij->cj", state, product[at])
        state /= state.sum(axis=1, keepdims=True)
    for j in range(int(blocks.max()) - 1, 0, -1):
        live = np.flatnonzero(blocks > j)
        at = chain_block[live] + j
        message = np.einsum("cij,cj->ci", product[at], behind[at])
        behind[at - 1] = message / message.sum(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, total, labels))
    state = ahead[order]
    for t in range(BLOCK):
        k = running[t]
        if not k:
            break
        moved = (state[:k] @ transitions) * emit[t, :k]
        state[:k] = moved / moved.sum(axis=1, keepdims=True)
        alpha[t, :k] = state[:k]
    out = np.empty((BLOCK, total, labels))
    counts = np.zeros((labels, labels))
    state = behind[order]
    start = ahead[order]
    for t in range(BLOCK - 1, -1, -1):
        k = running[t]
        if not k:
            continue
        chance = alpha[t, :k] * state[:k]
        out[t, :k] = chance / chance.sum(axis=1, keepdims=True)
        inward = emit[t, :k] * state[:k]
        if pairs:
            before = alpha[t - 1, :k] if t else start[:k]
            joint = before[:, :, None] * transitions * inward[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = inward @ transitions.T
        state[:k] = moved / moved.sum(axis=1, keepdims=True)
    chances = out[step, back[block]]
    return (chances, counts) if pairs else chances


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def chances(self, features: WordFeatures) -> np.ndarray:
        return forward_backward(features.scores(self.weights), features.words.first, np.exp(self.transitions))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its mean chance and the mean of each word's best chance; UNKNOWN, 0 and 0 without a letter."""
        features = WordFeatures(*text_buffers(column))
        words = features.words
        chances = self.chances(features)
        sums = np.stack([np.bincount(words.row, c, words.rows) for c in chances.T], 1) if len(words.start) else np.zeros((words.rows, len(self.languages)))
        sure = np.bincount(words.row, chances.max(axis=1), words.rows) / np.maximum(words.counts, 1)
        best = sums.argmax(axis=1)
        score = sums[np.arange(words.rows), best] / np.maximum(words.counts, 1)
        names = [self.languages[i] for i in best]
        ascii_letters = np.bincount(words.row, _plain(features), words.rows) > 0
        for i in np.flatnonzero(~ascii_letters):
            if not any(map(str.isalpha, column[int(i)].as_py() or "")):
                names[i], score[i], sure[i] = UNKNOWN, 0.0, 0.0
        return names, np.clip(score, 0, 1), np.clip(sure, 0, 1)


    def spans(self, column: pa.Array) -> list[list[dict]]:
        """For each row, runs of words of one language in order: first word, words, first byte, end byte, lang and mean chance.

        A word is a run of letters, as the model sees it; bytes are those of the
        UTF-8 text. Rows without a word have no runs.
        """
        features = WordFeatures(*text_buffers(column))
        words = features.words
        if not len(words.start):
            return [[] for _ in range(words.rows)]
        chances = self.chances(features)
        best = chances.argmax(axis=1)
        fresh = np.ones(len(best), bool)
        fresh[1:] = (best[1:] != best[:-1]) | (words.row[1:] != words.row[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(best)) - 1
        mean = np.add.reduceat(chances[np.arange(len(best)), best], first) / (last - first + 1)
        out: list[list[dict]] = [[] for _ in range(words.rows)]
        base = words.offsets
        for a, b, c in zip(first.tolist(), last.tolist(), mean.tolist()):
            row = int(words.row[a])
            at = int(base[row])
            out[row].append({"first": a - int(words.first[row]), "words": b - a + 1, "start": int(words.start[a]) - at, "end": int(words.end[b]) - at, "lang": self.languages[best[a]], "chance": min(1.0, c)})
        return out


def _plain(features: WordFeatures) -> np.ndarray:
    """Whether a word holds an ASCII letter."""
    words = features.words
    sums = np.concatenate([[0], np.cumsum(words.data < 128)])
    return sums[words.end] > sums[words.start]


def train(texts: list[tuple[str, str]], *, epochs: int = EPOCHS, rate: float = RATE) -> Model | None:
    """A model from (text, language); null without any word. The order of the rows has no effect."""
    texts = sorted(texts)
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    features = WordFeatures(*text_buffers(pa.array([t for t, _ in texts], pa.string())))
    words = features.words
    if not len(words.start):
        return None
    gold = np.array([languages.index(lang) for _, lang in texts])[words.row]
    number = len(languages)
    model = Model(languages, np.zeros((1 << TABLE_BITS, number)), np.where(np.eye(number, dtype=bool), 0.0, -2.0))
    squares, square_moves = np.full_like(model.weights, 1e-2), np.full((number, number), 1e-2)
    rng = np.random.default_rng(11)
    inside = np.arange(len(words.start)) - words.first[words.row]
    cuts = np.flatnonzero(inside % PIECE == 0)  # pieces of a document, joined anew in each epoch
    ends = np.append(cuts[1:], len(words.start))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(cuts)), max(1, len(cuts) // 400)):
            sizes = ends[part] - cuts[part]
            pick = np.repeat(cuts[part] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            joined = np.append(np.concatenate([[0], np.cumsum(sizes)])[:-1:8], sizes.sum())  # eight pieces make a sequence
            scores = _scores_of(features, model.weights, pick)
            chances, expected = forward_backward(scores, joined, np.exp(model.transitions), pairs=True)
            truth = gold[pick]
            errors = -chances
            errors[np.arange(len(pick)), truth] += 1
            slope = features.gradient(errors, pick) / len(part)
            seen = np.ones(len(pick), bool)
            seen[joined[:-1]] = False
            observed = np.zeros((number, number))
            np.add.at(observed, (truth[np.flatnonzero(seen) - 1], truth[seen]), 1)
            np.add.at(observed, (slice(None), truth[joined[:-1]]), 1.0 / number)  # the state before a sequence is even
            moves = (observed - expected) / len(part)
            squares += slope**2
            square_moves += moves**2
            model.weights += rate * slope / np.sqrt(squares)
            model.transitions += rate * moves / np.sqrt(square_moves)
    model.weights = model.weights.astype(np.float32)
    return model


def _scores_of(features: WordFeatures, weights: np.ndarray, pick: np.ndarray) -> np.ndarray:
    out = weights[features.slots[pick]].sum(axis=1)
    for slots, stop in features.grams:
        start = features.words.start[pick]
        sizes = np.maximum(stop[pick] - start, 0)
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        owner = np.repeat(np.arange(len(pick)), sizes)
        got = weights[slots[at]]
        out += np.stack([np.bincount(owner, got[:, k], len(pick)) for k in range(weights.shape[1])], 1)
    return out


def learn(labelled: DataFrame, *, per_language: int = SAMPLE_DOCS, longest: int = SAMPLE_BYTES) -> Model | None:
    """Train on whole texts of a bounded sample of rows (key, text, lang) of every language that occurs.

    Rows are taken by a hash of the key, of at most ``longest`` bytes. A language
    without such a text gives its shortest ones, up to the same bytes in all or
    one text. With very many languages each gives fewer rows.
    """
    size, own = F.octet_length("text"), F.xxhash64("text")
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (size > 0)).withColumns({"size": size, "own": own})
    languages = fit.select("lang").distinct().count()
    if not languages:
        return None
    share = max(1, min(per_language, SAMPLE_ROWS // languages))
    long = F.col("size") > longest
    order = Window.partitionBy("lang").orderBy(long, F.when(long, F.col("size")), F.xxhash64("key"), "key", "own")
    ranked = fit.select("key", "lang", "size", "own").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share)
    ranked = ranked.withColumns({"none_short": F.min(long).over(Window.partitionBy("lang")), "bytes": F.sum("size").over(Window.partitionBy("lang").orderBy("rank"))})
    chosen = ranked.where(~long | F.col("none_short") & ((F.col("rank") == 1) | (F.col("bytes") <= share * longest)))
    # at most SAMPLE_ROWS keys, or one of each language
    same = ["lang", "size", "own"]
    picked = chosen.select(F.struct("key").alias("id"), *same).distinct()  # a struct compares a null key like any other
    rows = fit.withColumn("id", F.struct("key")).join(F.broadcast(picked), ["id", *same], "left_semi").dropDuplicates(["id", *same]).select("text", "lang").collect()
    return train([(r["text"], r["lang"]) for r in rows])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", sure: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, the mean chance of that language over the words.

    ``sure`` names a column for the mean of each word's best chance, which is
    high for a text that switches between languages.

    Null, empty and letterless texts are ``und`` with score 0, as are all without
    a model. Repeated rows are each judged; input columns of the added names are
    replaced; an empty table stays empty.
    """
    more = [sure] if sure else []
    docs = docs.drop("lang_pred", "score", *more)
    limit = max(1, TEXT_BYTES * 4 // max(4, len(model.languages) if model else 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit):
            names, *found = model.predict(batch.column(text)) if model else ([UNKNOWN] * batch.num_rows, *[np.zeros(batch.num_rows)] * 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), *[pa.array(x, pa.float64()) for x in found[: 1 + len(more)]]], [*batch.schema.names, "lang_pred", "score", *more])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double", *[f"`{c}` double" for c in more]])
    return docs.mapInArrow(run, schema)


SPANS = "array<struct<first:bigint,words:bigint,start:bigint,end:bigint,lang:string,chance:double>>"


def label_words(docs: DataFrame, model: Model | None, *, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the languages of its words: a list of runs (see ``Model.spans``), for texts that switch.

    Null, empty and letterless texts have an empty list, as have all without a
    model. Very long texts are labelled whole. Repeated rows are each labelled;
    an input column of the added name is replaced; an empty table stays empty.
    """
    docs = docs.drop(spans)
    limit = max(1, TEXT_BYTES * 4 // max(4, len(model.languages) if model else 0))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, limit):
            found = model.spans(batch.column(text)) if model else [[] for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, spans])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{spans}` {SPANS}"])
    return docs.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
