"""Substring deduplication by level-wise doubling.

A window of ``window`` consecutive words is removed where its word sequence also
starts in a document with a smaller doc_id. Shorter windows that repeat in no
other document cannot be part of a longer one that does, so lengths are doubled
(one word overlapping): for 13 words the levels are 4, 7 and 13.

Only one anchor stands for neighbouring windows at the lower levels: the
4-word gram with the smallest hash in the window. Equal windows have equal
anchors, so nothing is lost, and neighbouring windows mostly share theirs. At
each level the anchors, extended to that length, are counted over all documents;
those in one document only end there. At the last level, neighbouring windows of
one anchor form a run. Runs equal in all words have the same smallest doc_id;
only where one anchor has several different runs (at the edge of a copy) are
single windows compared.
"""

from __future__ import annotations

import atexit
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import drop_table, release, scratch, slices, table
from scholia.llm.words import Words, grams, mix, text_buffers
from scholia.sources.store import forget, written

WINDOW = 13
#: Lengths are halved down to this many words or fewer.
ANCHOR = 4


def levels(window: int, anchor: int = ANCHOR) -> list[int]:
    """Window lengths in rising order, each at most twice the one before."""
    found = [window]
    while found[0] > anchor:
        found.insert(0, (found[0] + 1) // 2)
    return found


class Segments:
    """Runs a..b of window starts (positions in the batch's words) that share an anchor at q and a key."""

    def __init__(self, words: Words, window: int, lengths: list[int]) -> None:
        """``lengths``: the levels passed so far, without the window's own."""
        self.words, self.window = words, window
        self.hash = words.hashes()
        base = lengths[0]
        spans = window - base + 1
        gram = grams(self.hash, base)
        starts = max(0, len(self.hash) - window + 1)
        inside = words.row[:starts] == words.row[window - 1 : window - 1 + starts] if starts else np.empty(0, bool)
        if not inside.any():
            self.a = self.b = self.q = np.empty(0, np.int64)
            self.key = np.empty(0, np.uint64)
            return
        views = np.lib.stride_tricks.sliding_window_view(gram, spans)[:starts]
        at = np.arange(starts) + views.argmin(axis=1)
        at[~inside] = -1
        fresh = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        a, b, q = fresh, np.append(fresh[1:], starts) - 1, at[fresh]
        keep = q >= 0
        a, b, q = a[keep], b[keep], q[keep]
        key = gram[q]
        for length in lengths[1:]:  # a window reaches either as far left of the anchor as the gram grows, or as far right
            more = length - base
            long = grams(self.hash, length, length)
            left, right = a <= q - more, b > q - more
            parts = [(a[left], np.minimum(b, q - more)[left], q[left], long[q[left] - more]), (np.maximum(a, q - more + 1)[right], b[right], q[right], long[q[right]])]
            a, b, q, key = (np.concatenate(x) for x in zip(*parts))
        self.a, self.b, self.q, self.key = a, b, q, key

    def keep(self, flagged: pa.Array) -> None:
        """Leave the segments whose key is in their row's list."""
        lengths = pa.compute.fill_null(pa.compute.list_value_length(flagged), 0).to_numpy(zero_copy_only=False)
        listed = flagged.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        rows = np.repeat(np.arange(len(flagged)), lengths).astype(np.uint64)
        own = self.words.row[self.a].astype(np.uint64)
        held = np.isin(self.key ^ mix(own + np.uint64(1)), listed ^ mix(rows + np.uint64(1)))
        self.a, self.b, self.q, self.key = self.a[held], self.b[held], self.q[held], self.key[held]

    def signatures(self) -> np.ndarray:
        """A hash of each run: all its windows and where the anchor stands."""
        long = grams(self.hash, self.window, 99)
        sizes = self.b - self.a + 1
        offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        each = mix(long[np.repeat(self.a, sizes) + offset] + (offset + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.add.reduceat(each, np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0, np.uint64)
        return mix(total + (self.q - self.a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + sizes.astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(window: int, lengths: list[int]):
    """Rows (key, doc, row) at the last of ``lengths``, from rows whose column ``keys`` has the level before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column("text")))
            found = Segments(words, window, lengths[:-1] if len(lengths) > 1 else lengths)
            if len(lengths) > 1:
                found.keep(batch.column("keys"))
                passed, found = found, Segments(words, window, lengths)
                # a segment at the new level lies inside one that passed
                order = np.argsort(passed.a)
                slot = np.searchsorted(passed.a[order], found.a, side="right") - 1
                inside = slot >= 0
                inside[inside] = found.b[inside] <= passed.b[order][slot[inside]]
                found.a, found.key = found.a[inside], found.key[inside]
            row = words.row[found.a]
            order = np.lexsort((found.key, row))
            pick, key = row[order], found.key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (pick[1:] != pick[:-1])
            pick, key = pick[fresh], key[fresh]
            yield pa.RecordBatch.from_arrays(
                [_signed(key), batch.column("doc_id").take(pa.array(pick)), batch.column("row").take(pa.array(pick))], ["key", "doc_id", "row"]
            )

    return run


def _runs(window: int, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column("text")))
            found = Segments(words, window, lengths)
            found.keep(batch.column("keys"))
            row = words.row[found.a]
            first = words.first[row]
            yield pa.RecordBatch.from_arrays(
                [_signed(found.key), _signed(found.signatures()), batch.column("doc_id").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(found.a - first, pa.int32()), pa.array(found.b - first, pa.int32())],
                ["key", "sig", "doc_id", "row", "a", "b"],
            )

    return run


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batch row, first and last window start of each listed (a, b)."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in column.flatten().flatten())
    return np.repeat(np.arange(len(column)), lengths), a, b


def _windows(window: int):
    """One row for each window of the listed runs, with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*text_buffers(batch.column("text")))
            hashes = words.hashes()
            row, a, b = _spans(batch.column("spans"))
            sizes = b - a + 1
            offset = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.unique(np.repeat(words.first[row] + a, sizes) + offset)
            row = words.row[at]
            yield pa.RecordBatch.from_arrays(
                [_signed(grams(hashes, window, 99)[at]), _signed(grams(hashes, window, 77)[at]), batch.column("doc_id").take(pa.array(row)), batch.column("row").take(pa.array(row)), pa.array(at - words.first[row], pa.int32())],
                ["v1", "v2", "doc_id", "row", "at"],
            )

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, a, b = _spans(batch.column("spans"))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode().split() if text else []
                n, removed = len(words), 0
                if edges[i] < edges[i + 1]:
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, a[edges[i] : edges[i + 1]], 1)
                    np.add.at(depth, b[edges[i] : edges[i + 1]] + window, -1)
                    left = np.cumsum(depth)[:n] == 0
                    words = list(compress(words, left.tolist()))
                    removed = n - len(words)
                out.append((n, removed, b" ".join(words).decode()))
            names, columns = list(batch.schema.names), list(batch.columns)
            spans = names.index("spans")
            del names[spans], columns[spans]
            n_words, n_removed, kept = zip(*out)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    return run


def _first_in(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest doc_id of each key that stands in two documents or more; map-side minima come first."""
    found = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    return found.where("lo < hi").select(*keys, "lo")


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the words left, joined by one space.

    Words are runs of characters outside space and tab to carriage return. Rows
    of one doc_id are no copies of each other; a row whose doc_id is null neither
    loses words nor makes others lose them. Null text has no words. Shorter texts
    than a window stay whole. An empty table gives no rows. Input columns of the added
    names are replaced.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text], F.lit(0).alias("__")).alias("rest"))
    held = held.withColumn("row", F.monotonically_increasing_id())
    # written once by row, in as many buckets: the levels join their lists to it without moving texts again
    place = scratch(spark, "texts")
    name = "scholia_" + place.rsplit("-", 1)[1]
    held.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", place).option("compression", "zstd").saveAsTable(name)
    atexit.register(drop_table, spark, name)  # its files go with the scratch path
    release(spark)
    whole = spark.table(name)
    texts = whole.select("doc_id", "text", "row")

    def with_list(lists: DataFrame, how: str, texts: DataFrame = texts) -> DataFrame:
        return texts.join(lists.hint("shuffle_hash"), "row", how)

    steps = levels(window)
    source = texts.where("doc_id is not null and text is not null")
    candidates, place = None, None

    def done(*paths: str | None) -> None:
        """Delete what no later step reads, and let go of finished shuffles."""
        for path in filter(None, paths):
            forget(spark, path)
        release(spark)

    for i in range(1, max(2, len(steps))):
        lengths = steps[:i]
        rows = source if candidates is None else with_list(candidates, "inner").where("doc_id is not null")
        # made twice, to count keys and to look them up: written out, they take more memory than their making takes time
        found = rows.mapInArrow(_anchors(window, lengths), "key long, doc_id long, row long")
        shared = found.join(_first_in(found, ["key"]), "key")
        before = place
        candidates, place = written(shared.groupBy("row").agg(F.collect_list("key").alias("keys")), "anchors")
        done(before)
        if candidates.isEmpty():
            break
    runs, runs_at = written(with_list(candidates, "inner").mapInArrow(_runs(window, lengths), "key long, sig long, doc_id long, row long, a int, b int"), "runs")
    done(place)
    classes = runs.groupBy("key", "sig").agg(F.min("doc_id").alias("lo"))
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("edge"))
    marked = runs.join(classes.join(several, "key", "left"), ["key", "sig"]).where("lo < doc_id or edge")
    marked, marked_at = written(marked.select("row", "a", "b", (F.col("lo") < F.col("doc_id")).alias("gone")), "marked")
    done(runs_at)
    span = F.struct("a", "b")
    probes = marked.where("not gone").groupBy("row").agg(F.collect_list(span).alias("spans"))
    single, single_at = written(with_list(probes, "inner").mapInArrow(_windows(window), "v1 long, v2 long, doc_id long, row long, at int"), "windows")
    again = single.join(_first_in(single, ["v1", "v2"]), ["v1", "v2"]).where("lo < doc_id")
    gone = marked.where("gone").select("row", "a", "b").unionByName(again.select("row", F.col("at").alias("a"), F.col("at").alias("b")))
    lists, _ = written(gone.groupBy("row").agg(F.collect_list(span).alias("spans")), "gone")
    done(marked_at, single_at)
    out = with_list(lists, "left", whole).select("rest", "text", "spans")
    rest = whole.schema["rest"].dataType.simpleString()
    kept = out.mapInArrow(_kept(window), f"rest {rest}, text string, n_words long, n_removed long, kept string")
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("rest")[c].alias(c) for c in names], "n_words", "n_removed", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 11)) as i, w from words where len(w) >= 13
), keyed as (
  select doc_id, i, array_to_string(w[i:i+12], ' ') as k from windows
), firsts as (
  select k, min(doc_id) as lo from keyed group by k
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as j from keyed join firsts using (k) where lo < doc_id
), lists as (
  select doc_id, list(j) as js from gone group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(js), 0) as bigint) as n_removed,
  sha256(array_to_string(case when js is null then w else list_filter(w, lambda x, i: not list_contains(js, i)) end, ' ')) as kept_sha256
from words left join lists using (doc_id)
"""
