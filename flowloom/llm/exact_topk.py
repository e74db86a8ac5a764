"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt over shards of bounded size, by row and never by value. A shard keeps one list of
its rows per dimension, sorted by component. For a query it goes down the lists of the query's non-zero
components from their better end, scores each row that it meets for the first time in full, and
stops as soon as the best score that a row not yet met could have (the threshold: the components at the
reached depth, weighed by the query) lies below the k-th best. The best rows of all shards are merged.
Queries are dealt over blocks of bounded size, and each block visits each shard.

Scores are sums of products of whole numbers, computed in the narrowest type that holds every partial
sum exactly; a sum beyond 64 bits counts as the nearest 64-bit number.

Cases: a vector that is null or holds null, NaN or infinite components takes no part; only vectors of the query's
own length are candidates (empty ones score 0 with each other); a row is never its own candidate, but
another row with the same id is; each row that asks gets its own answer, so repeated queries repeat it; equal
scores go by smaller id, null ids last; queries with fewer than k candidates get them all; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.inputs import columns, task_count, written
from flowloom.session import ship_package

SHARD_ROWS = 8192
QUERY_ROWS = 8192
FIRST_DEPTH = 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole_components(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """True if there is a vector and all of its components are numbers."""
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(number, F.lit(False))


class SortedLists:
    """Rows of one shard (in order of rank) with a list per dimension and direction."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, (self.count, self.dims) = rows, rows.shape
        order = [np.argsort(-rows[:, d], kind="stable") for d in range(self.dims)]
        order += [np.argsort(rows[:, d], kind="stable") for d in range(self.dims)]
        self.lists = np.array(order, np.int32).reshape(2 * self.dims, self.count)

    def best(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best rows other than ``own``, and how many rows were scored."""
        asked = np.flatnonzero(query)
        if not len(asked):
            at = np.arange(min(self.count, k + 1))
            at = at[at != own][:k]
            return at, np.zeros(len(at), self.rows.dtype), len(at)
        lists, weights = asked + self.dims * (query[asked] < 0), query[asked]
        met = np.zeros(self.count, np.int8)
        at, scores, scored = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype), 0
        begin, depth = 0, FIRST_DEPTH
        while begin < self.count and scored < self.count:
            met[self.lists[lists, begin : begin + depth].ravel()] |= 1
            fresh = np.flatnonzero(met == 1)
            met[fresh] = 3
            scored += len(fresh)
            at = np.concatenate([at, fresh[fresh != own]])
            scores = np.concatenate([scores, _bounded(self.rows[fresh[fresh != own]] @ query)])
            order = np.lexsort((at, -scores))[:k]
            at, scores = at[order], scores[order]
            begin, depth = begin + depth, 2 * depth
            if begin < self.count and len(at) == k:
                reached = self.rows[self.lists[lists, begin - 1], asked]
                # A row not met yet may tie at the threshold and have the smaller id.
                if _bounded((reached * weights).sum(keepdims=True))[0] < scores[-1]:
                    break
        return at, scores, scored


def _bounded(sums: np.ndarray) -> np.ndarray:
    """Sums as 64-bit numbers can hold them; only those of whole Python numbers reach further."""
    return np.minimum(np.maximum(sums, LEAST), MOST) if sums.dtype == object else sums


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which sums of their products are exact in any order."""
    most = [max((abs(int(x)) for x in (p.min(), p.max())), default=0) if p.size else 0 for p in parts]
    bound = most[0] * most[1] * max(1, parts[0].shape[1])
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    return [p.astype(kind) for p in parts]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def top_k(
    vectors: DataFrame,
    asks: Column,
    *,
    k: int = 5,
    factor: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each row for which ``asks`` holds.

    ``asks`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    narrow = columns(vectors, vec_id=id_col, vector=vector_col).where(usable(F.col("vector")))
    rows = narrow.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("vector").alias("dims"),
        whole_components(F.col("vector"), factor).alias("v"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    )
    rows = written(rows, "vectors")
    size = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking")).first()
    shards, blocks = -(-size["rows"] // shard_rows) or 1, -(-size["asking"] // query_rows) or 1

    def everywhere(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    def dealt(count: int, name: str) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(name)

    held = rows.select("dims", dealt(shards, "shard"), everywhere(blocks, "block"), "row", "vec_id", "v")
    asking = rows.where("asks").select("dims", everywhere(shards, "shard"), dealt(blocks, "block"), "row", "vec_id", "v")
    key = ["dims", "shard", "block"]
    parts = [f.repartition(task_count(spark), *key).groupBy(*key) for f in (held, asking)]

    def search(key: tuple, held: pa.Table, asking: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        held = held.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        names, row = held.column("vec_id").to_pylist(), held.column("row").to_numpy()
        out: list[tuple] = []
        if len(row) and asking.num_rows:
            shard, queries = _exact(_matrix(held.column("v"), dims), _matrix(asking.column("v"), dims))
            lists = SortedLists(shard)
            place = {r: i for i, r in enumerate(row.tolist())}
            for r, name, query in zip(asking.column("row").to_pylist(), asking.column("vec_id").to_pylist(), queries):
                at, scores, _ = lists.best(query, k, place.get(r, -1))
                out += [(r, name, names[i], int(s)) for i, s in zip(at.tolist(), scores)]
        taken = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["row", "query_id", "vec_id", "score"], taken)})

    found = parts[0].cogroup(parts[1]).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
