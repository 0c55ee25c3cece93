"""Token-ID files: ids in the fewest bits of the vocabulary, with block offsets.

File layout, little-endian: magic ``SCHOLIDS``; the packed blocks; the foot: the
documents' ids (signed 64-bit), a flag each that is 1 where the id is null, their
token counts (unsigned 64-bit), blocks + 1 byte offsets; then six unsigned
64-bit numbers (version, bits, ids in a block, documents, ids, blocks) and the
magic again. Every block but the last holds the same number of ids and starts at
a 64-bit word, so id i is found from i alone. Blocks are written as they fill:
a writer holds one open block and a few bytes for each document.
"""

from __future__ import annotations

import contextlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import scratch, slices, table
from scholia.llm.tokens import END_ID, default_tokenizer, encoder

MAGIC, VERSION, BLOCK_IDS = b"SCHOLIDS", 2, 1 << 16
#: Ids that a reader unpacks at a time, and documents of which it returns rows at a time.
READ_IDS, READ_DOCS = 1 << 20, 1 << 16
#: Text bytes of a file; smaller files are made while the session's partitions have less than LEAST_BYTES each.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20


def bits_for(vocabulary: int) -> int:
    """Fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Pack ids into 64-bit words: 64 ids take ``bits`` words."""
    groups = -(-len(ids) // 64)
    grid = np.zeros(groups * 64, np.uint64)
    grid[: len(ids)] = ids
    grid = grid.reshape(groups, 64)
    if len(ids) and int(grid.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    words = np.zeros((groups, bits), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= grid[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= grid[:, i] >> np.uint64(64 - shift)
    return words.ravel()


def unpack(words: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed words."""
    grid = words.reshape(-1, bits)
    out = np.empty((len(grid), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        got = grid[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | (grid[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = got & mask
    return out.ravel()[:count]


class BlockWriter:
    """Writes packed ids to a binary stream block by block; ``close`` adds the open block and the foot."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS) -> None:
        if block_ids % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.bits, self.block_ids = bits, block_ids
        self._out = out
        self._open: list[np.ndarray] = []
        self._held = self.n_ids = 0
        self._offsets = array("Q", [0])
        self._doc_ids, self._null, self._counts = array("q"), bytearray(), array("Q")
        out.write(MAGIC)

    def __len__(self) -> int:
        return len(self._counts)

    def _put(self, ids: np.ndarray) -> None:
        block = pack(ids, self.bits).astype("<u8").tobytes()
        self._out.write(block)
        self._offsets.append(self._offsets[-1] + len(block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._doc_ids.append(doc_id or 0)
        self._null.append(doc_id is None)
        self._counts.append(len(ids))
        self._open.append(ids)
        self._held += len(ids)
        self.n_ids += len(ids)
        if self._held >= self.block_ids:
            ids = np.concatenate(self._open)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._put(ids[at : at + self.block_ids])
            self._open, self._held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self._held:
            self._put(np.concatenate(self._open))
            self._open, self._held = [], 0
        for column, kind in ((self._doc_ids, "<i8"), (self._null, "u1"), (self._counts, "<u8"), (self._offsets, "<u8")):
            self._out.write(np.frombuffer(column, kind[-2:]).astype(kind).tobytes())
        self._out.write(np.array([VERSION, self.bits, self.block_ids, len(self), self.n_ids, len(self._offsets) - 1], "<u8").tobytes() + MAGIC)


class BlockReader:
    """Random access to a token file through any seekable binary stream."""

    def __init__(self, stream) -> None:
        self._stream = stream
        size = stream.seek(0, 2)
        size = stream.tell() if size is None else size
        tail = self._read(size - 56, 56) if size >= 64 else b""
        if tail[48:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        version, self.bits, self.block_ids, n, self.n_ids, blocks = (int(x) for x in np.frombuffer(tail[:48], "<u8"))
        if version != VERSION:
            raise ValueError(f"token file of version {version}")
        at = size - 56 - 8 * (blocks + 1) - 17 * n
        self._doc_ids = np.frombuffer(self._read(at, 8 * n), "<i8")
        self._null = np.frombuffer(self._read(at + 8 * n, n), "u1")
        self.counts = np.frombuffer(self._read(at + 9 * n, 8 * n), "<u8").astype(np.int64)
        self._offsets = np.frombuffer(self._read(at + 17 * n, 8 * (blocks + 1)), "<u8").astype(np.int64)
        self._body = len(MAGIC)

    def doc_id(self, i: int) -> int | None:
        return None if self._null[i] else int(self._doc_ids[i])

    def _read(self, at: int, n: int) -> bytes:
        self._stream.seek(at)
        return self._stream.read(n)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids start .. start + count; only the blocks that hold them are read."""
        if not count:
            return np.empty(0, np.uint32)
        if start < 0 or start + count > self.n_ids:
            raise IndexError("outside the file")
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        a, b = int(self._offsets[first]), int(self._offsets[last + 1])
        held = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
        out = unpack(np.frombuffer(self._read(self._body + a, b - a), "<u8"), self.bits, held)
        return out[start - first * self.block_ids :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids), unpacking about READ_IDS ids at a time."""
        at = i = 0
        while i < len(self.counts):
            j, end = i, at
            while j < len(self.counts) and (j == i or end + self.counts[j] - at <= READ_IDS):
                end += int(self.counts[j])
                j += 1
            got = self.ids(at, end - at)
            low = at
            for k in range(i, j):
                n = int(self.counts[k])
                yield self.doc_id(k), at, got[at - low : at - low + n]
                at += n
            i = j


def file_count(spark: SparkSession, size: int) -> int:
    """Files for ``size`` bytes of text: FILE_BYTES each, or the session's partitions while those have LEAST_BYTES."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // FILE_BYTES), min(usual, -(-size // LEAST_BYTES)))


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None, end_id: int = END_ID) -> list[dict]:
    """Encode documents and write them in ascending doc_id order, one file for each range of ids.

    Returns a row for each file in that order: path, docs, ids, and ``before``,
    the ids in earlier files. Null ids come first; rows of one id, which several
    files may share, come in the order of the scan. A null text holds the
    end id alone, an empty table gives no files. Without ``partitions`` the
    number of files follows the bytes of text. A task writes under a name of its
    own and reports it when it has ended, so a lost or repeated task leaves at
    worst a file that nothing names.
    """
    spark = docs.sparkSession
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    count = partitions or file_count(spark, held.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    # the second key deals rows of one id to several files; texts aren't read to find the ranges
    order = [F.col("doc_id").asc_nulls_first(), F.col("__row").asc()]
    held = held.withColumn("__row", F.monotonically_increasing_id())
    ranged = held.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        with contextlib.ExitStack() as held:
            out = None
            for batch in slices(batches, "text"):
                out = out or BlockWriter(held.enter_context(store.open_output_stream(f"{root}/{name}")), bits_for(max(tool.vocabulary, end_id + 1)))
                for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    out.add(key, tool.document(value, end_id))
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": len(out), "ids": out.n_ids}])

    rows = sorted(ranged.mapInArrow(write, "part long, name string, docs long, ids long").collect(), key=lambda r: r["part"])
    files, before = [], 0
    for r in rows:  # as many as there are files
        files.append({"path": f"{path}/{r['name']}", "docs": r["docs"], "ids": r["ids"], "before": before})
        before += r["ids"]
    return files


def read_token_files(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as stream:
                    found = ((key, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in BlockReader(stream).documents())
                    while rows := list(islice(found, READ_DOCS)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    listed = spark.createDataFrame([(f["path"], f["before"]) for f in files], "path string, before long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), scratch(spark, "ids"), tokenizer=default_tokenizer())
    return read_token_files(spark, files)
