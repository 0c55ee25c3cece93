"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import slices, table
from scholia.llm.tokens import END_ID, default_tokenizer, encoder

CAPACITY = 1024
#: A document's rest is cut into equal pieces of at most this many tokens.
PIECE = 256
#: Windows that one differencing run fills.
WINDOWS = 48
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` near-equal sums, by largest-differencing.

    A partial partition has a sum for each window, largest first. The two with
    the widest spread are merged, the largest sums of one meeting the smallest
    of the other, until one is left.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)] + [(0, -1)] * (windows - 1)))
    heapq.heapify(heap)
    trees: list[tuple[int, int]] = []  # node n + k joins two nodes; -1 is empty
    n = len(sizes)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            if q < 0:
                merged.append((x, p))
            elif p < 0:
                merged.append((y, q))
            else:
                trees.append((p, q))
                merged.append((x + y, n + len(trees) - 1))
        merged.sort(reverse=True)
        tick += 1
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tick, merged))
    out = []
    for _, node in heap[0][2] if heap else []:
        found, rest = [], [node] if node >= 0 else []
        while rest:
            k = rest.pop()
            if k < n:
                found.append(k)
            else:
                rest += trees[k - n]
        out.append(found)
    return out


def windows_for(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Differencing with the fewest windows that hold: their count rises while one exceeds the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        count += 1


def pack_documents(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Whole windows are cut off each document; the rest is cut into equal pieces
    of at most ``piece`` tokens, which wait until they fill about ``windows``
    windows and are then spread by differencing. Every task packs its own input
    split, without a shuffle; a sequence_id holds the number of the partition
    and a running one, which a repeated task gives again if it sees the same rows
    in the same order: ``docs`` must come from a file scan. A null text is the
    end id alone; null and repeated doc_ids are kept as they are; an empty table
    gives no rows.
    """
    if not 0 < piece <= capacity:
        raise ValueError("a piece holds 1 to capacity tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        made = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0
        rows: list[tuple] = []

        def place() -> None:
            nonlocal made, held
            for window in windows_for([x[2] for x in waiting], capacity) if waiting else []:
                at = 0
                for i in sorted(window):
                    rows.append((*waiting[i], made, at))
                    at += waiting[i][2]
                made += 1
            waiting.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in slices(batches, "text"):
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tool.document(value, end_id)
                n = len(ids)
                whole = n // capacity * capacity
                for at in range(0, whole, capacity):
                    rows.append((key, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, made, 0))
                    made += 1
                if whole < n:
                    parts = -(-(n - whole) // piece)
                    cuts = (whole + np.arange(parts + 1) * (n - whole) // parts).tolist()
                    for a, b in zip(cuts, cuts[1:]):
                        waiting.append((key, a, b - a, zlib.crc32(ids[a:b].tobytes()), n))
                    held += n - whole
                    if held >= windows * capacity:
                        place()
            if rows:
                yield flush()
        place()
        if rows:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer=default_tokenizer())
