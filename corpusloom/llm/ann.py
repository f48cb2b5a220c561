"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Centroids are fitted on a bounded sample; every vector is put in the list of its nearest centroid and
every query probes the lists of its nearest ones. The vectors of a list are turned by one random
rotation, after which the first d of D coordinates estimate a distance without bias, and stand in column
blocks. Block by block, a candidate is abandoned once a hypothesis test on its partial distance says that
it does not get among the best k: sqrt(D / d) times the partial distance above (1 + e / sqrt(d)) times the
distance that the k-th best inner product allows. A bound on that is known from the start: a query's 2k-th best in the
sample, of which those in the lists it probes are candidates themselves (twice k, so that k are left whatever the
test does to single ones). Survivors are scored exactly on the original vectors.

Lists are dealt to groups of SHARD vectors (a longer list is several groups, so that one with a third of all vectors
is many), and queries to blocks: a query travels once to each group that holds a list it probes, with the numbers
of those lists, and a group and a block meet as matrices. Only the sample, the centroids and the sizes of lists
(at most SAMPLE and MAX_LISTS of each) reach the driver.

Defined results: null and zero vectors and those with null or non-finite components, and those of another
length than the most frequent one, take no part; rows with the query's own id are no candidates (other repeated
rows are, each); query rows that share an id are one query, by the least of their vectors; ties go to the smaller id; with
fewer candidates than k all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import ready_workers, stored

#: Vectors that centroids are fitted on, at most; lists, at most.
SAMPLE, MAX_LISTS = 20_000, 4096
#: Share of the lists that a query probes, and how many at least.
PROBE_SHARE, LEAST_PROBES = 0.65, 16
#: Vectors in a group, queries in a block; numbers in a matrix of partial products.
SHARD, QUERY_BLOCK, CELLS = 16_384, 16_384, 1 << 22
#: Share of pairs below which the survivors of a test are followed one by one.
SPARSE = 0.1
#: Significance of the test.
EPSILON = 2.1
COLUMN_BLOCKS = (0.125, 0.25, 0.5, 1.0)


def valid(column: str = "embedding") -> Column:
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means; a list that loses all its vectors starts again at a random one."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        count = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = count == 0
        centres = sums / np.maximum(count, 1)[:, None]
        centres[empty] = sample[random.choice(len(sample), int(empty.sum()))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 2048] @ centres.T - half, axis=1) for i in range(0, len(x), 2048)] or [np.zeros(0, int)])


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length from an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Scan:
    """Column blocks of turned vectors, and the test that goes with each of them."""

    def __init__(self, d: int, epsilon: float = EPSILON):
        self.turn = rotation(d)
        ends = sorted({max(1, round(s * d)) for s in COLUMN_BLOCKS})
        self.blocks = list(zip([0, *ends], ends))
        self.slack = [(1 + epsilon / math.sqrt(b)) ** 2 * b / d for _, b in self.blocks]

    def columns(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Blocks, and the square norms of what stands up to the end of each."""
        turned = x @ self.turn
        parts = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.blocks]
        return parts, np.cumsum([(p * p).sum(axis=1) for p in parts], axis=0)

    def survivors(self, q: tuple, x: tuple, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of q and x (both as columns() gives them) whose inner product may reach a query's bound."""
        (q_parts, q_norms), (x_parts, x_norms) = q, x
        partial, pairs, last = np.zeros((len(bound), len(x_norms[0]))), None, len(self.blocks) - 1
        for j, (qp, xp) in enumerate(zip(q_parts, x_parts)):
            if pairs is None:
                partial += qp @ xp.T
                if j < last:
                    keep = q_norms[j][:, None] + x_norms[j] - 2 * partial <= self.slack[j] * (q_norms[-1][:, None] + x_norms[-1] - 2 * bound[:, None])
                    if np.count_nonzero(keep) <= SPARSE * keep.size:
                        pairs = np.nonzero(keep)
                        partial = partial[pairs]
                else:
                    pairs = np.nonzero(partial >= bound[:, None] - 1e-9)
            else:
                a, b = pairs
                partial = partial + (qp[a] * xp[b]).sum(axis=1)
                if j < last:
                    keep = q_norms[j][a] + x_norms[j][b] - 2 * partial <= self.slack[j] * (q_norms[-1][a] + x_norms[-1][b] - 2 * bound[a])
                else:
                    keep = partial >= bound[a] - 1e-9
                pairs, partial = (a[keep], b[keep]), partial[keep]
        return pairs

    def best(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, asked: np.ndarray, q: np.ndarray, bound: np.ndarray, probes: dict[int, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
        """The best k of a group's vectors for each query: query ids, vector ids, scores. probes: rows of q by list."""
        order = np.argsort(lists, kind="stable")
        ids, x, lists = ids[order], x[order], lists[order]
        numbers, begins = np.unique(lists, return_index=True)
        own, bound = self.columns(q), bound.copy()
        rows, found, scores = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for number, begin, end in zip(numbers.tolist(), begins.tolist(), [*begins.tolist()[1:], len(ids)]):
            asking = probes.get(number, rows[:0])
            there = self.columns(x[begin:end])
            for i in range(0, len(asking), step := max(1, CELLS // (end - begin))):
                part = asking[i : i + step]
                a, b = self.survivors(([c[part] for c in own[0]], own[1][:, part]), there, bound[part])
                a, b = part[a], b + begin
                other = ids[b] != asked[a]
                a, b = a[other], b[other]
                rows, found, scores = np.concatenate([rows, a]), np.concatenate([found, b]), np.concatenate([scores, (x[b] * q[a]).sum(axis=1)])
            rows, found, scores, reached = top(rows, found, scores, ids, len(q), k)
            bound = np.maximum(bound, reached)
        return asked[rows], ids[found], scores


def top(rows: np.ndarray, found: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """The best k of each row, ties to the smaller id; and what a row's k-th best is (minus infinity without one)."""
    order = np.lexsort((ids[found], -scores, rows))
    rows, found, scores = rows[order], found[order], scores[order]
    count = np.bincount(rows, minlength=n)
    keep = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) < k
    rows, found, scores = rows[keep], found[keep], scores[keep]
    reached, count = np.full(n, -np.inf), np.minimum(count, k)
    full = count == k
    reached[full] = scores[np.cumsum(count)[full] - 1]
    return rows, found, scores, reached


def dealt(sizes: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list, and how many it has: short lists share one as long as they fit."""
    first, shards = np.zeros(len(sizes), np.int32), np.maximum(1, -(-sizes // shard)).astype(np.int32)
    group, room = -1, 0
    for i, n in enumerate(sizes.tolist()):
        if n > room:
            group, room = group + 1, shard
        first[i] = group
        group, room = group + int(shards[i]) - 1, room - n if shards[i] == 1 else 0
    return first, shards


def search(vectors: DataFrame, is_query: Column, k: int = 20, probe_share: float = PROBE_SHARE, shard: int = SHARD) -> DataFrame:
    """vectors: vec_id, embedding. The k nearest found of each row with is_query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ready_workers(spark)
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(valid() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks"))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    rows, kind = rows.where(F.size("embedding") == lengths["d"]), rows.schema["embedding"].dataType.simpleString()
    lists = max(1, min(MAX_LISTS, math.isqrt(lengths["count"]) // 2))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").toArrow().combine_chunks()
    held = spark.sparkContext.broadcast((sample.column("vec_id").to_numpy(), matrix(sample.column("embedding").combine_chunks())))  # SAMPLE vectors at most
    lists = min(lists, len(sample))
    centres = fit_centroids(held.value[1], lists)
    half, own_list = 0.5 * (centres * centres).sum(axis=1), nearest(held.value[1], centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x, centres).astype(np.int32))], names=[*batch.schema.names, "list"])

    indexed = stored(rows.mapInArrow(assign, f"vec_id long, embedding {kind}, asks boolean, list int"), "ann-lists")
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    probes = min(lists, max(LEAST_PROBES, math.ceil(probe_share * lists)))
    first, shards = dealt(sizes, shard)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, points = held.value
        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                x, own = matrix(part.column("embedding")), part.column("vec_id").to_numpy()
                order = np.argsort(half - x @ centres.T, axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1) <= 10 * k
                n = np.maximum(probes, np.minimum(lists, enough.sum(axis=1) + 1))
                row = np.repeat(np.arange(len(x)), n)
                chosen = np.concatenate([o[:c] for o, c in zip(order, n)]) if len(x) else np.zeros(0, int)
                probed = np.zeros((len(x), lists), bool)
                probed[row, chosen] = True
                near = np.where(probed[:, own_list] & (own[:, None] != known), x @ points.T, -np.inf)
                bound = np.partition(near, -2 * k, axis=1)[:, -2 * k] if near.shape[1] >= 2 * k else np.full(len(x), -np.inf)
                times = shards[chosen]
                group = np.repeat(first[chosen], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, chosen = np.repeat(row, times), np.repeat(chosen, times)
                order = np.lexsort((chosen, group, row))
                row, group, chosen = row[order], group[order], chosen[order]
                begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])])) if len(row) else np.zeros(0, int)
                at = pa.array(row[begins])
                numbers = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), pa.array(chosen.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(at), part.column("embedding").take(at), pa.array(bound[row[begins]]), pa.array(group[begins].astype(np.int32)), numbers], names=["vec_id", "embedding", "bound", "group", "lists"]
                )

    asked = indexed.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = asked.mapInArrow(probe, f"vec_id long, embedding {kind}, bound double, group int, lists array<int>").withColumn("block", block)
    place = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, shards))], "list int, first int, shards int")
    part = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = indexed.join(F.broadcast(place), "list").select("vec_id", "embedding", "list", part.alias("group"), every.alias("block"))  # MAX_LISTS places

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            found: tuple = [], [], []
        else:
            x, q = (matrix(t.column("embedding").combine_chunks()) for t in (left, right))
            numbers = right.column("lists").combine_chunks()
            row, number = np.repeat(np.arange(len(q)), np.diff(numbers.offsets.to_numpy())), numbers.flatten().to_numpy()
            order = np.argsort(number, kind="stable")
            own, begins = np.unique(number[order], return_index=True)
            probing = dict(zip(own.tolist(), np.split(row[order], begins[1:])))
            found = Scan(x.shape[1]).best(left.column("vec_id").to_numpy(), x, left.column("list").to_numpy(), right.column("vec_id").to_numpy(), q, right.column("bound").to_numpy(), probing, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    group = ["group", "block"]
    near = candidates.groupBy(*group).cogroup(asked.groupBy(*group)).applyInArrow(find, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
