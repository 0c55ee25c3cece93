"""Exact top-k inner-product search with a KD-tree for each shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import materialise, table

#: Rows of a shard, queries that meet a shard at a time, and rows of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 4096, 4096, 64
RESULT = "query_id long, vec_id long, score long"


class KdTree:
    """Median splits of the widest dimension, down to leaves; each node has the tight box of its rows."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(vectors))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []

        def build(a: int, b: int) -> int:
            rows = vectors[self.order[a:b]]
            node = len(self.spans)
            self.spans.append((a, b))
            self.children.append(None)
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            if b - a > leaf_rows and vectors.shape[1] and (wide := high[node] - low[node]).max() > 0:
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, int(wide.argmax())], middle)]
                left = build(a, a + middle)
                self.children[node] = (left, build(a + middle, b))
            return node

        build(0, len(vectors))
        self.low, self.high = np.array(low), np.array(high)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, own: int, k: int, least) -> list[tuple]:
        """The k best (score, -id) of rows that aren't ``own`` and score ``least`` or more.

        Nodes are opened best bound first; the search ends at the first whose
        bound is under the kth score, be it found here or handed in.
        """
        best: list[tuple] = []
        rest = [(-bounds[0], 0)]
        while rest:
            bound, node = heapq.heappop(rest)
            if least is not None and -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(rest, (-bounds[child], child))
                continue
            a, b = self.spans[node]
            scores = self.vectors[a:b] @ query
            hits = np.arange(b - a) if least is None else np.flatnonzero(scores >= least)
            found = [(int(s), -int(i)) for s, i in zip(scores[hits].tolist(), ids[self.order[a:b][hits]].tolist()) if i != own]
            best = heapq.nlargest(k, best + found)
            if len(best) == k and (least is None or best[-1][0] > least):
                least = best[-1][0]
        return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _exact(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where every product sum is exact in them, else as Python integers."""
    most = [int(np.abs(x.astype(object)).max()) if x.size and x.min() == np.iinfo(np.int64).min else int(np.abs(x).max()) if x.size else 0 for x in (vectors, queries)]
    kind = np.float64 if 2 * most[0] * most[1] * max(1, vectors.shape[1]) < 1 << 53 else object
    return vectors.astype(kind), queries.astype(kind)


def _search(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, int, int]] = []
    if rows.num_rows and queries.num_rows:
        vectors, asked = _exact(_matrix(rows.column("v")), _matrix(queries.column("v")))
        ids = rows.column("vec_id").to_numpy()
        tree = KdTree(vectors)
        bounds = tree.bounds(asked)
        least = queries.column("least").to_pylist() if "least" in queries.column_names else [None] * len(asked)
        for i, query_id in enumerate(queries.column("vec_id").to_pylist()):
            out += [(query_id, -neg, score) for score, neg in tree.search(asked[i], bounds[i], ids, query_id, k, least[i])]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Exact k best by inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Both tables have vec_id (long, not null) and v (array of longs, no nulls);
    queries are rows of ``vectors`` too, and a row is no answer to a query of its
    own vec_id. Only vectors of a query's length are compared. First each query
    searches the tree of its own shard; the kth score that it finds there is the
    bound with which it enters all others. Queries meet shards in blocks.
    Vectors of length 0 score 0 with one another. Candidates that share a vec_id
    are ranked each; queries that share one are one query, that of the least
    vector. Without queries or vectors there are no rows.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))
    dealt = [F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v")]
    rows, asked = vectors.select(*dealt), queries.select(*dealt)
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["dim", "shard", "block"]
        return left.groupBy(*keys).cogroup(right.withColumn("block", block).groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, k), RESULT)

    home = materialise(meet(rows, asked), "home")
    least = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    bounded = asked.join(least, asked["vec_id"] == least["query_id"], "left").drop("query_id")
    away = bounded.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("other <> shard")
    away = away.select(F.col("dim").alias("dim"), F.col("other").alias("shard"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), "least")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = home if shards == 1 else home.unionByName(meet(rows, away))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """vec_id and v, the floor of ``factor`` times each component; rows that are null or hold a null or non-finite component, or have no vec_id, are left out."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
