"""Budgets, recorded exchanges, verdicts, n-gram dictionaries and term matches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Terms whose automaton is sent to every task; more are matched in several passes.
TERMS = 50_000
#: Words and characters of a dictionary candidate, and candidates that are ranked.
MAX_WORDS, MIN_CHARS, MAX_CHARS, RANKED, ENTRIES = 20, 3, 192, 1024, 64


def budget(turns: DataFrame, key: str, order: list[str], cost: str, ceiling: float) -> DataFrame:
    """``turns`` with the running cost of each key and whether it is still within the ceiling."""
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("spent", F.sum(cost).over(running)).withColumn("within", F.col("spent") <= ceiling)


def usage_delta(turns: DataFrame, key: str, order: list[str], cost: str) -> DataFrame:
    """Difference of each row's cost to the row before; the first counts whole."""
    before = Window.partitionBy(key).orderBy(*order)
    return turns.withColumn("delta", F.col(cost) - F.coalesce(F.lag(cost).over(before), F.lit(0.0)))


def conflicts(records: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Keys that were recorded with different payloads; recording the same again is none."""
    return records.groupBy(*key).agg(F.countDistinct(payload).alias("payloads")).where("payloads > 1")


def replay(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (exact, legacy keys) with the recorded response: by exact key, else by legacy key, else null."""
    exact = recorded.select(F.col("key").alias("exact"), F.col("response").alias("by_exact"))
    legacy = recorded.select(F.col("legacy_key").alias("legacy"), F.col("response").alias("by_legacy")).where("legacy is not null").dropDuplicates(["legacy"])
    held = requests.join(exact, "exact", "left").join(legacy, "legacy", "left")
    return held.withColumn("response", F.coalesce("by_exact", "by_legacy")).withColumn("found", F.when(F.col("by_exact").isNotNull(), "exact").when(F.col("by_legacy").isNotNull(), "legacy").otherwise("miss"))


def settle(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with their last verdict; without one they are uncertain with confidence 0; dismissed ones go."""
    last = verdicts.groupBy("finding").agg(F.max_by(F.struct("verdict", "confidence"), "at").alias("v"))
    held = findings.join(last, "finding", "left")
    held = held.withColumn("verdict", F.coalesce("v.verdict", F.lit("uncertain"))).withColumn("confidence", F.coalesce("v.confidence", F.lit(0.0)))
    return held.where("verdict <> 'dismissed'").drop("v")


#: Words of a text that one row holds while sequences are made of it.
STRETCH = 256


def _stretches(texts: DataFrame, text: str, max_words: int) -> DataFrame:
    """Words of each text in stretches that share their last words; sequences start in the first STRETCH words of one."""
    words = texts.select(F.filter(F.split(text, " "), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH))
    return words.select(F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, STRETCH + max_words - 1))).alias("w"))


def ngrams(texts: DataFrame, text: str, max_words: int = MAX_WORDS, *, tails: bool = False) -> DataFrame:
    """Counts of word sequences that occur twice or more, of at most ``max_words`` words.

    A text is cut in stretches that share their last words, so a row holds few
    words however long the text is, and sequences are made inside one expression.
    ``tails`` counts each whole text once more, at any length. Every sequence is
    shuffled; where only the first of the ranking are asked, ``ranked_ngrams``
    finds the same with little disk.
    """
    stretches = _stretches(texts, text, max_words)
    ends = lambda i: F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("w") - i))
    made = F.transform(F.sequence(F.lit(0), F.least(F.size("w"), F.lit(STRETCH)) - 1), lambda i: F.transform(ends(i), lambda n: F.array_join(F.slice("w", i + 1, n), " ")))
    grams = stretches.select(F.explode(F.flatten(made)).alias("gram")).where(F.length("gram").between(MIN_CHARS, MAX_CHARS))
    if tails:
        grams = grams.unionByName(texts.select(F.col(text).alias("gram")).where(F.length("gram") >= MIN_CHARS))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def ranked_dictionary(counted: DataFrame, top: int = RANKED) -> DataFrame:
    """The candidates that would save most: (n - 1) times the bytes, then longer, then in text order."""
    gain = (F.col("n") - 1) * F.octet_length("gram")
    return counted.withColumn("gain", gain.cast("long")).orderBy(F.desc("gain"), F.desc(F.octet_length("gram")), "gram").limit(top)


#: The sketch that bounds gains: bits of a cell's number, an odd factor for each of its rows, and cells that are sent as one row.
CELL_BITS, FACTORS, BLOCK = 22, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 1 << 16
#: Words whose sequences a task makes at once, and the odd factor of a sequence's hash.
STEP, FACTOR = 1 << 16, np.uint64(0xD6E8FEB86659FD93)


def _cells(key: np.ndarray, row: int) -> np.ndarray:
    return (((key ^ (key >> np.uint64(32))) * np.uint64(FACTORS[row])) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sequences(batch: pa.RecordBatch, max_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some stretches after others: distinct words, the words' numbers in them, and the first word, words, hash and bytes of every sequence."""
    column = batch.column(0)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // STEP)) + 1).tolist(), len(column)]
    for a, b in (x for x in zip(cuts, cuts[1:]) if x[0] < x[1]):
        part = column.slice(a, b - a)
        coded, count = part.flatten().dictionary_encode(), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        hashed = pd.util.hash_array(words, categorize=False)
        wide, long = (f(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64) for f in (pc.binary_length, pc.utf8_length))
        end = np.repeat(np.cumsum(count), count)
        first = np.flatnonzero(np.arange(len(code)) - (end - np.repeat(count, count)) < STRETCH)
        key, size, chars = np.zeros(len(first), np.uint64), np.full(len(first), -1), np.full(len(first), -1)
        made = []
        for n in range(1, max_words + 1):
            inside = end[first] - first >= n
            first, key, size, chars = first[inside], key[inside], size[inside], chars[inside]
            last = code[first + n - 1]
            key, size, chars = key * FACTOR + hashed[last], size + 1 + wide[last], chars + 1 + long[last]
            short = chars <= MAX_CHARS
            first, key, size, chars = first[short], key[short], size[short], chars[short]
            told = chars >= MIN_CHARS
            made.append((first[told], np.full(told.sum(), n), key[told], size[told]))
        yield words, code, *map(np.concatenate, zip(*made))


def _bounds(stretches: DataFrame, max_words: int) -> np.ndarray:
    """For each row and cell, the bytes of all sequences with that hash: no sequence has a larger gain than its cells."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(FACTORS), 1 << CELL_BITS), np.int64)
        for batch in batches:
            for *_, key, size in _sequences(batch, max_words):
                for row in range(len(FACTORS)):
                    np.add.at(cells[row], _cells(key, row), size)
        yield from sent(dict(enumerate(cells.reshape(-1, BLOCK))))

    def sent(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Byte by byte of all cells, as most are zero."""
        for k, block in blocks.items():
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary())], ["block", "cells"])

    def received(value: bytes) -> np.ndarray:
        return np.frombuffer(value, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column("block").to_pylist(), batch.column("cells")):
                held[k] = held.get(k, 0) + received(value.as_py())
        yield from sent(held)

    kinds = "block int, cells binary"
    cells = np.zeros(len(FACTORS) << CELL_BITS, np.int64).reshape(-1, BLOCK)
    for r in stretches.mapInArrow(sketch, kinds).repartition("block").mapInArrow(add, kinds).collect():
        cells[r["block"]] = received(bytes(r["cells"]))
    return cells.reshape(len(FACTORS), -1)


def _told(words: np.ndarray, code: np.ndarray, first: np.ndarray, n: np.ndarray, key: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Sequences as texts with their counts; those of one hash are compared word by word, and one that differs from the first is told by itself."""
    _, lead, group = np.unique(key, return_index=True, return_inverse=True)
    same = n == n[lead][group]
    for i in range(n.max(initial=0)):
        k = np.flatnonzero(same & (n > i))
        same[k] = code[first[k] + i] == code[first[lead][group[k]] + i]
    odd = np.flatnonzero(~same)
    told = np.concatenate([lead, odd])
    grams = [" ".join(words[code[a:b]]) for a, b in zip(first[told].tolist(), (first + n)[told].tolist())]
    return grams, np.concatenate([np.bincount(group[same], minlength=len(lead)), np.ones(len(odd), np.int64)])


def _counted(stretches: DataFrame, max_words: int, heavy: np.ndarray) -> DataFrame:
    """Exact counts of the sequences all of whose cells are heavy."""
    bits, shape = np.packbits(heavy), heavy.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(bits).astype(bool).reshape(shape)
        for batch in batches:
            for words, code, first, n, key, _ in _sequences(batch, max_words):
                hit = np.flatnonzero(held[0][_cells(key, 0)])
                for row in range(1, len(FACTORS)):
                    hit = hit[held[row][_cells(key[hit], row)]]
                grams, count = _told(words, code, first[hit], n[hit], key[hit])
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(count, pa.int64())], ["gram", "n"])

    return stretches.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n >= 2")


def ranked_ngrams(texts: DataFrame, text: str, max_words: int = MAX_WORDS, top: int = RANKED) -> DataFrame:
    """The ``top`` first of ``ranked_dictionary(ngrams(..))``, without a shuffle of all sequences; ``top`` rows are held by the driver.

    A sketch of fixed size bounds all gains from above. Sequences in its largest
    cells are counted exactly. If as many as asked reach the least of these cells,
    no other can stand before them; else all that can reach the last one found
    are counted, or more cells are taken, in the end all.
    """
    stretches = _stretches(texts, text, max_words)
    bounds = _bounds(stretches, max_words)
    taken, least = 0, 0
    while True:
        if not least:
            taken = max(4 * top, 16 * taken)
            least = max(1, int(np.sort(bounds[0])[-taken])) if taken < bounds.shape[1] else 1
        found = ranked_dictionary(_counted(stretches, max_words, bounds >= least), top).collect()
        whole = len(found) == top
        if least == 1 or whole and found[-1]["gain"] >= least:
            return ranked_dictionary(texts.sparkSession.createDataFrame([(r["gram"], r["n"]) for r in found], "gram string, n long"), top)
        least = found[-1]["gain"] if whole else 0


def encode(lines: list[str], entries: int = ENTRIES) -> tuple[list[str], list[str]]:
    """Dictionary and lines in which an entry is one private-use character; an entry stays only if the whole shrinks."""
    counts: dict[str, int] = {}
    for line in lines:
        words = line.split(" ")
        for i in range(len(words)):
            for n in range(1, min(MAX_WORDS, len(words) - i) + 1):
                gram = " ".join(words[i : i + n])
                if MIN_CHARS <= len(gram) <= MAX_CHARS:
                    counts[gram] = counts.get(gram, 0) + 1
    ranked = sorted((g for g, n in counts.items() if n > 1), key=lambda g: (-(counts[g] - 1) * len(g.encode()), -len(g.encode()), g))[:RANKED]
    kept: list[str] = []
    if any("\ue000" <= c <= "\uf8ff" for line in lines for c in line):
        return kept, lines  # the text has such characters itself
    for gram in ranked:
        if len(kept) == entries:
            break
        mark = chr(0xE000 + len(kept))
        tried = [line.replace(gram, mark) for line in lines]
        saved = sum(len(a.encode()) - len(b.encode()) for a, b in zip(lines, tried))
        if saved > len(gram.encode()) + 1:
            kept.append(gram)
            lines = tried
    return kept, lines


def decode(kept: list[str], lines: list[str]) -> list[str]:
    for i in reversed(range(len(kept))):
        lines = [line.replace(chr(0xE000 + i), kept[i]) for line in lines]
    return lines


# the wire form of several packets: a head, the dictionary, and the packets' lines with references to it

#: The form's name, the sign before a reference, and the signs of entries in order.
WIRE, MARK, SIGNS = "SC1", "@", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
_TOKENS = re.compile(r"\\[A-Za-z@]+|[A-Za-z_][A-Za-z0-9_]*|\d+|\s+|.", re.DOTALL)


def _shortened(line: str, entries: list[str]) -> str:
    """A line with its longest known pieces, from the left, as references; the mark itself is doubled."""
    known = sorted(range(len(entries)), key=lambda i: (-len(entries[i]), i))
    out, at = [], 0
    while at < len(line):
        i = next((i for i in known if line.startswith(entries[i], at)), None)
        out.append(line[at].replace(MARK, MARK * 2) if i is None else MARK + SIGNS[i])
        at += 1 if i is None else len(entries[i])
    return "".join(out)


def _restored(line: str, entries: list[str]) -> str:
    def meaning(found: re.Match[str]) -> str:
        if found[1] == MARK:
            return MARK
        if found[1] not in SIGNS or SIGNS.index(found[1]) >= len(entries):
            raise ValueError(f"no entry {found[0]!r}")
        return entries[SIGNS.index(found[1])]

    return re.sub(f"{MARK}(.?)", lambda m: meaning(m) if m[1] else _cut_off(), line, flags=re.DOTALL)


def _cut_off() -> str:
    raise ValueError("a reference is cut off")


def to_wire(packets: list[list[str]], entries: list[str] | None = None) -> str:
    """Packets as one text; without ``entries`` a dictionary is chosen, of which each entry makes the whole shorter.

    Lines hold no line feed and aren't empty. Candidates are sequences of tokens
    and whole lines; they are tried by what they would save, longer ones first.
    """
    if any(not line or "\n" in line for lines in packets for line in lines):
        raise ValueError("lines of a packet are not empty and hold no line feed")
    if entries is not None:
        head = [WIRE, f"D{len(entries)}", *(_shortened(entry, entries[:i]) for i, entry in enumerate(entries)), ""]
        body = "\n\n".join("\n".join(_shortened(line, entries) for line in lines) for lines in packets)
        return "\n".join(head) + "\n" + body + "\n"
    counts: dict[str, int] = {}
    for line in (line for lines in packets for line in lines):
        tokens = _TOKENS.findall(line)
        ends = np.cumsum([0, *map(len, tokens)]).tolist()
        pieces = [line[ends[i] : ends[j]] for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + MAX_WORDS) + 1)]
        for piece in [*(p for p in pieces if MIN_CHARS <= len(p) <= MAX_CHARS), *([line] if len(line) >= MIN_CHARS else [])]:
            counts[piece] = counts.get(piece, 0) + 1
    size = {piece: len(piece.encode()) for piece in counts}
    saves = {piece: n * (size[piece] - 2) - (size[piece] + 1) for piece, n in counts.items() if n > 1}
    ranked = sorted((p for p, n in saves.items() if n > 0), key=lambda p: (-saves[p], -size[p], p))[:RANKED]
    chosen: list[str] = []
    best = to_wire(packets, chosen)
    for piece in ranked:
        if len(chosen) == ENTRIES:
            break
        tried = to_wire(packets, [*chosen, piece])
        if len(tried.encode()) < len(best.encode()):
            chosen, best = [*chosen, piece], tried
    return best


def from_wire(text: str) -> list[list[str]]:
    """The packets of a wire text; a damaged one raises ValueError."""
    lines = text.split("\n")
    if lines[0] != WIRE or not re.fullmatch(r"D\d+", lines[1] if len(lines) > 1 else "") or lines[-1]:
        raise ValueError("not a wire text")
    count = int(lines[1][1:])
    entries: list[str] = []
    for line in lines[2 : 2 + count]:
        entries.append(_restored(line, entries))
    if len(entries) != count or lines[2 + count : 3 + count] != [""]:
        raise ValueError("the dictionary is cut off")
    packets: list[list[str]] = [[]]
    for line in lines[3 + count : -1]:
        if line:
            packets[-1].append(_restored(line, entries))
        else:
            packets.append([])
    return packets


def roundtrip(packets: DataFrame) -> DataFrame:
    """Each packet's size before and after encoding, and whether decoding gives it back."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["packet"]:
                lines = text.split("\n")
                kept, coded = encode(lines)
                rows.append((len(text.encode()), sum(len(x.encode()) + 1 for x in [*kept, *coded]), decode(kept, coded) == lines))
            out = frame[["project_id", "node"]].copy()
            out[["bytes", "coded", "same"]] = pd.DataFrame(rows, columns=["bytes", "coded", "same"], index=out.index)
            yield out

    return packets.select("project_id", "node", "packet").mapInPandas(run, "project_id long, node int, bytes long, coded long, same boolean")


def term_matches(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): whole-word, case-blind occurrences of terms in texts of compacted white space.

    All terms are searched at once by an automaton; it holds at most TERMS terms,
    and more terms take more passes.
    """
    spark = texts.sparkSession
    distinct = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    count = distinct.count()
    out = spark.createDataFrame([], f"{key} long, term string, n long")
    for part in range(-(-count // TERMS)):
        words = sorted(r["term"] for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(-(-count // TERMS))) == part).collect())

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for k, value in zip(batch.column(key).to_pylist(), batch.column("value").to_pylist()):
                    counts: dict[str, int] = {}
                    for end, word in automaton.iter(value or ""):
                        a, b = end - len(word) + 1, end + 1
                        if (a == 0 or not value[a - 1].isalnum()) and (b == len(value) or not value[b].isalnum()):
                            counts[word] = counts.get(word, 0) + 1
                    rows += [(k, w, n) for w, n in sorted(counts.items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))], [key, "term", "n"])

        clean = texts.select(F.col(key).cast("long").alias(key), F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))).alias("value"))
        out = out.unionByName(clean.mapInArrow(run, f"{key} long, term string, n long"))
    return out
