"""SimHash near-duplicate groups by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, slices, table
from scholia.llm.components import connected

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Least and greatest number of fingerprints of a block, one side of a comparison; blocks that a table has between these; fingerprints of a tile.
LEAST_BLOCK, BLOCK, BLOCKS, TILE = 1 << 11, 1 << 16, 32, 256
#: Pairs of blocks up to which their list is broadcast; with more it is joined.
BROADCAST_PAIRS = 200_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, n: int = SHINGLE) -> list[int]:
    """XXH64 of each n-word shingle of the A-Z-lowered text, or of its whole word sequence if shorter."""
    if not text:
        return []
    joined = b" ".join(text.encode().translate(_LOWER).split())
    if not joined:
        return []
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(i + 1 for i in spaces)], [*spaces, len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < n:
        return [digest(joined, SEED)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the 64 bits set in over half of its ``counts`` hashes; zero without hashes.

    Eight bits are counted at once in the byte lanes of a word, over runs of at
    most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    sizes = counts[filled]
    first = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)
    base = np.cumsum(runs) - runs
    inner = np.arange(int(runs.sum())) - np.repeat(base, runs)
    cuts = np.repeat(first, runs) + 255 * inner
    bits = np.zeros(len(filled), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANES, cuts)
        votes = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), base, axis=0)
        won = 2 * votes > sizes[:, None]
        for byte in range(8):
            bits |= won[:, byte].astype(np.uint64) << np.uint64(8 * byte + j)
    out[filled] = bits
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the long columns ``carry`` and the fingerprint as a signed 64-bit number; null or wordless text has fingerprint zero."""
    names = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [np.array(shingle_hashes(x, shingle), np.uint64) for x in batch.column("text").to_pylist()]
            prints = majority(np.concatenate(found), np.array([len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(prints.view(np.int64))], [*names, "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), *carry, F.col(text).alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _tiles(prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prints ordered by the bit counts of their four quarters, tile starts, and the least and greatest counts of each tile."""
    quarters = np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4))
    order = np.lexsort((prints, *quarters.T[::-1]))
    prints, quarters = prints[order], quarters[order].astype(np.int16)
    cuts = np.arange(0, len(prints), size)
    return prints, cuts, np.minimum.reduceat(quarters, cuts), np.maximum.reduceat(quarters, cuts)


def close_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of at most ``radius`` bits between two sets (or inside one, ``right`` None).

    Tiles are compared by exclusive-or and bit count; a pair of tiles is skipped
    if the bit counts of the four quarters differ by more than the radius in
    all. Links are merged as they are found, so that a group of near copies
    costs a link for each member and not for each pair.
    """
    a, acuts, alow, ahigh = _tiles(left, tile)
    b, bcuts, blow, bhigh = (a, acuts, alow, ahigh) if right is None else _tiles(right, tile)
    shift = 0 if right is None else len(a)
    parent = np.arange(len(a) + (0 if right is None else len(b)))

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if (up == x).all():
                return x
            parent[x] = parent[up]
            x = up

    for i, at in enumerate(acuts):
        gap = (np.maximum(alow[i] - bhigh, 0) + np.maximum(blow - ahigh[i], 0)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        own = a[at : at + tile, None]
        for j in near[near >= i] if right is None else near:
            x, y = np.nonzero(np.bitwise_count(own ^ b[bcuts[j] : bcuts[j] + tile][None, :]) <= radius)
            x, y = roots(x + at), roots(y + bcuts[j] + shift)
            while len(apart := np.flatnonzero(x != y)):
                x, y = x[apart], y[apart]
                parent[np.maximum(x, y)] = np.minimum(x, y)  # one of several joins wins; the rest come again
                x, y = roots(x), roots(y)
    nodes = a if right is None else np.concatenate([a, b])
    top = roots(np.arange(len(nodes)))
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _cell(fp: Column) -> Column:
    """The bit counts of the four quarters as one number below 17 ** 4."""
    quarters = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    out = F.lit(0)
    for q in quarters:
        out = out * 17 + q
    return out.cast("int")


def blocks(cells: dict[int, int], block: int) -> tuple[dict[int, int], list[tuple[np.ndarray, np.ndarray, int]]]:
    """Boxes of cells with at most ``block`` fingerprints each; a heavier single cell is salted.

    Cells are halved by the bits in all until a box has one such count, then along
    the widest quarter. Returns each cell's box and, for each box, its least and greatest
    counts and number of salts.
    """
    codes = np.array(sorted(cells))
    counts = np.array([cells[c] for c in codes.tolist()])
    places = np.stack([codes // 17**i % 17 for i in (3, 2, 1, 0)], 1)
    places = np.column_stack([places, places.sum(axis=1)])
    owner: dict[int, int] = {}
    boxes: list[tuple[np.ndarray, np.ndarray, int]] = []
    todo = [np.arange(len(codes))]
    while todo:
        part = todo.pop()
        low, high = places[part].min(axis=0), places[part].max(axis=0)
        size = int(counts[part].sum())
        if size > block and len(part) > 1:
            axis = 4 if high[4] > low[4] else int((high - low).argmax())
            order = part[np.argsort(places[part, axis], kind="stable")]
            values = places[order, axis]
            edges = np.flatnonzero(values[1:] != values[:-1]) + 1
            half = np.cumsum(counts[order])[edges - 1] - size / 2
            cut = int(edges[np.abs(half).argmin()])
            todo += [order[cut:], order[:cut]]
            continue
        owner |= dict.fromkeys(codes[part].tolist(), len(boxes))
        boxes.append((low, high, max(1, -(-size // block))))
    return owner, boxes


def _meetings(boxes: list[tuple[np.ndarray, np.ndarray, int]], radius: int) -> Iterator[tuple[int, int, int]]:
    """(box, first block, last block) of the blocks that a box's fingerprints must meet: its own and those whose counts can be within the radius.

    The salts of a box are blocks with consecutive numbers.
    """
    low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    ends = np.cumsum([b[2] for b in boxes])
    for i in range(len(boxes)):
        gap = np.maximum(low[i] - high, 0) + np.maximum(low - high[i], 0)
        for j in np.flatnonzero(np.maximum(gap[:, :4].sum(axis=1), gap[:, 4]) <= radius).tolist():
            yield i, int(ends[j]) - boxes[j][2], int(ends[j]) - 1


def links(prints: DataFrame, radius: int = RADIUS, block: int | None = None) -> DataFrame:
    """Links (u, v) between different fingerprints that connect all those within ``radius`` bits.

    ``prints`` holds each fingerprint once. A fingerprint's block is a box of bit
    counts of the four quarters, salted where one cell has more than ``block``
    fingerprints; a block meets those whose box lies within the radius, so most
    pairs of blocks are never dealt.
    """
    spark = prints.sparkSession
    celled = prints.select("fp", _cell(F.col("fp")).alias("cell"))
    cells = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # at most 17 ** 4 rows
    if not cells:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    block = block or min(BLOCK, max(LEAST_BLOCK, -(-sum(cells.values()) // BLOCKS)))
    owner, boxes = blocks(cells, block)
    ends = np.cumsum([b[2] for b in boxes]).tolist()
    home = spark.createDataFrame([(c, i, ends[i] - boxes[i][2], boxes[i][2]) for c, i in owner.items()], "cell int, box int, base int, salts int")
    meet = list(_meetings(boxes, radius))
    others = spark.createDataFrame(meet, "box int, low int, high int")
    others = F.broadcast(others) if len(meet) <= BROADCAST_PAIRS else others
    own = celled.join(F.broadcast(home), "cell").withColumn("own", F.col("base") + F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))  # at most 17 ** 4 rows are sent
    dealt = own.join(others, "box").withColumn("other", F.explode(F.sequence("low", "high")))
    dealt = dealt.select("fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))

    def compare(got: pa.Table) -> pa.Table:
        prints = got.column("fp").to_numpy().view(np.uint64)
        second = got.column("second").to_numpy()
        one = got.column("i")[0].as_py() == got.column("j")[0].as_py()
        left, right = (prints, None) if one else (prints[~second], prints[second])
        if not len(left) or right is not None and not len(right):
            u = v = np.empty(0, np.uint64)
        else:
            u, v = close_links(left, right, radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return dealt.groupBy("i", "j").applyInArrow(compare, "u long, v long")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, ``carry``, fingerprint fp, root (the group's own number) and component_id."""
    held = materialise(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, carry=carry), "prints")
    nodes = materialise(held.groupBy("fp").agg(F.min("doc_id").alias("lo")), "nodes")
    labels = connected(links(nodes.select("fp"), radius))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "root", "component_id"), "named")
    return held.join(named, "fp")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id reachable by links.

    Equal fingerprints are one node however many rows share them. Null and
    wordless texts have fingerprint zero and are linked like any other. A null
    doc_id is never the smallest; a component of only such rows has null as its
    id. Repeated rows are kept. An empty table gives no rows.
    """
    found = groups(docs, doc_id=doc_id, text=text, shingle=shingle, radius=radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the smallest doc_id, null last, and of its rows the least by a 128-bit hash of all columns.

    Rows are told apart by that hash, so that rows of one doc_id, or without
    one, are judged each. Rows equal in all columns are copies and one stays.
    """
    held = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keyed = docs.withColumns({"__a": F.xxhash64(*held), "__b": F.xxhash64(F.lit(1), *held)})
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__a", "__b")
    first = groups(keyed, carry=("__a", "__b")).groupBy("root").agg(F.min(rank).alias("first"))
    first = materialise(first.select("first.__a", "first.__b"), "first")
    return keyed.join(first, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"]).select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
