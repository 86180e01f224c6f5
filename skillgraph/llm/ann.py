"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first visits widened to a calibrated recall."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize
from .vectordedup import usable

#: Vectors the tree is fitted on at most and for each leaf, children of a node, and rows a leaf should hold.
SAMPLE_ROWS, LEAF_SAMPLE, BRANCH, LEAF_ROWS = 131_072, 32, 16, 256
#: Queries whose true neighbours calibrate the number of leaves to visit.
CALIBRATION_QUERIES = 128
CHUNK = 4096
#: Rows of the bins that one task searches, queries compared with them at a time, and pairs scored exactly at a time.
TASK_ROWS, ASKED, SCORED = 16_384, 64, 32_768
#: Rows of a batch of queries on their way to the tasks.
ROUTED = 4096


@dataclass
class Tree:
    """Nodes in order of creation; a node has a centre and either children or a leaf number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root down to the nearest child."""
        out = np.empty(len(x), dtype=np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[below]
            nearest = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            waiting += [(child, rows[nearest == k]) for k, child in enumerate(below) if (nearest == k).any()]
        return out

    def visit(self, queries: np.ndarray, most: int, sizes: list[int] | None = None, rows: np.ndarray | None = None) -> list[list[int]]:
        """``most`` leaves per query, best bin first: a priority queue holds the open nodes by their
        centre's inner product with the query, so a branch is entered only when it is the best left.
        With ``sizes`` of the leaves, more of them until they hold the query's number of ``rows``."""
        products = queries @ self.centres.T
        out = []
        for i, row in enumerate(products):
            queue, found, left = [(-row[0], 0)], [], 0 if sizes is None else rows[i]
            while queue and (len(found) < most or left > 0):
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (-row[child], child))
                else:
                    found.append(self.leaf[node])
                    left -= 0 if sizes is None else sizes[self.leaf[node]]
            out.append(found)
        return out


def fit_tree(x: np.ndarray, leaves: int, branch: int = BRANCH, rounds: int = 8, seed: int = 11) -> Tree:
    """Split the sample by k-means again and again until there are about ``leaves`` leaves."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, numbered = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [[]], [-1], 0
    waiting = [(0, np.arange(len(x)), leaves)]
    while waiting:
        node, rows, share = waiting.pop()
        k = min(branch, share, len(rows))
        if k >= 2:
            c = x[rng.choice(rows, k, replace=False)]
            for _ in range(rounds):
                nearest = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
                c = np.array([x[rows[nearest == i]].mean(axis=0) if (nearest == i).any() else c[i] for i in range(k)])
            nearest = np.argmin((c * c).sum(axis=1) - 2 * (x[rows] @ c.T), axis=1)
            if len(np.unique(nearest)) > 1:
                for i in range(k):
                    own = rows[nearest == i]
                    children[node].append(len(centres))
                    waiting.append((len(centres), own, round(share * len(own) / len(rows))))
                    centres.append(c[i])
                    children.append([])
                    leaf.append(-1)
                continue
        leaf[node] = numbered
        numbered += 1
    return Tree(np.array(centres), children, leaf, numbered)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dims)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors have equal scores in any task."""
    return (v * q).sum(axis=1)


def _top(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows other than the query's own; all ties of the last are scored exactly."""
    other = ids != q_id
    if not other.any():
        return ids[:0], products[:0]
    kept = np.flatnonzero(other)
    least = np.partition(products[kept], max(0, len(kept) - k))[max(0, len(kept) - k)]
    kept = kept[products[kept] >= least - 1e-9 * max(1.0, abs(least))]
    scores = _exact(q, x[kept])
    order = _best(ids[kept], scores, k)
    return ids[kept][order], scores[order]


def _tops(q: np.ndarray, excluded: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids, scores) of the k best rows of each query, without those that ``excluded`` (queries by rows) marks; all ties of
    the last are scored exactly, SCORED at a time."""
    products = q @ x.T
    products[excluded] = -np.inf
    at = max(0, len(ids) - k)
    least = np.partition(products, at, axis=1)[:, at, None]
    row, column = np.nonzero((products >= least - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isinf(least), 0, least)))) & ~excluded)
    scores = np.concatenate([_exact(q[row[i : i + SCORED]], x[column[i : i + SCORED]]) for i in range(0, max(1, len(row)), SCORED)])
    order = np.lexsort((ids[column], -scores, row))
    starts = np.searchsorted(row, np.arange(len(q) + 1))
    found = [order[a : min(b, a + k)] for a, b in zip(starts, starts[1:])]
    return [ids[column[o]] for o in found], [scores[o] for o in found]


_TOP = "query_id long, ids array<long>, scores array<double>"
_SENT = "vec_id long, embedding array<double>, task int, bins array<int>, role int"


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.94, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` found with the
    largest inner product in double precision, other than rows of its own id; ties to the smaller vec_id.

    The tree is fitted on LEAF_SAMPLE vectors a leaf, at most ``sample_rows`` (those of the smallest hash of id),
    and indexes every row; leaves grow in number with the rows until the sample is spent, and in size from there on. Leaves are visited best bin first, as many as bring CALIBRATION_QUERIES queries, compared
    with brute force over all rows, to ``recall``, and for each query on until they hold ``k`` rows
    besides its own. Large leaves are cut into chunks of CHUNK rows; a task holds the chunks that are dealt to it, about
    TASK_ROWS rows, and a query comes once to each task, with the chunks to search there.

    Null, empty, zero and non-finite vectors, rows with a null id and vectors of another length than
    the most common one take no part. Repeated rows of ``vectors`` are candidates once; fewer than k
    candidates are returned all; no usable query or candidate gives no rows.
    """
    fit = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    ).distinct()
    spark = vectors.sparkSession
    rows, asked = materialize(fit(vectors)), fit(queries)
    common = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dims = common["count"], common["dims"]
    rows, asked = rows.where(F.size("embedding") == dims), asked.where(F.size("embedding") == dims)
    by_hash = lambda df, most: df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most)
    leaves = max(1, min(math.ceil(n / leaf_rows), sample_rows // LEAF_SAMPLE))
    sample = _matrix(by_hash(rows, LEAF_SAMPLE * leaves).select("embedding").toArrow().column(0).combine_chunks(), dims)
    tree = spark.sparkContext.broadcast(fit_tree(sample, leaves))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf_of(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, embedding array<double>, leaf long"))
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one number a leaf, 4096 at most
    leaf_sizes = spark.sparkContext.broadcast([sizes.get(i, 0) for i in range(tree.value.leaves)])
    chunks = np.array([math.ceil(x / CHUNK) for x in leaf_sizes.value], dtype=np.int64)
    first_bin = np.cumsum(chunks) - chunks
    tasks = max(math.ceil(n / TASK_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / leaf_rows)))
    visits = _calibrate(placed, asked, tree, dims, k, recall, by_hash)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column(2).to_numpy()
            mixed = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            bins = first_bin[leaf] + (mixed % chunks[leaf].astype(np.uint64)).astype(np.int64)
            yield _sent(batch.column(0), batch.column(1), bins % tasks, pa.array([[x] for x in (bins // tasks).tolist()], pa.list_(pa.int32())), 0)

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                taken, to, bins = [], [], []
                for i, leaves in enumerate(tree.value.visit(_matrix(part.column(1), dims), visits, leaf_sizes.value, k + part.column(2).to_numpy())):
                    own = np.sort(np.concatenate([first_bin[leaf] + np.arange(chunks[leaf]) for leaf in leaves]))
                    own = own[np.argsort(own % tasks, kind="stable")]
                    task, starts = np.unique(own % tasks, return_index=True)
                    taken += [i] * len(task)
                    to += task.tolist()
                    bins += [x.tolist() for x in np.split(own // tasks, starts[1:])] if len(task) else []
                for low in range(0, len(taken), ROUTED):
                    rows_of = pa.array(taken[low : low + ROUTED])
                    yield _sent(part.column(0).take(rows_of), part.column(1).take(rows_of), np.array(to[low : low + ROUTED]), pa.array(bins[low : low + ROUTED], pa.list_(pa.int32())), 1)

    owned = rows.groupBy("vec_id").agg(F.count("*").alias("own"))
    asked = asked.join(owned, "vec_id", "left").select("vec_id", "embedding", F.coalesce("own", F.lit(0).cast("long")).alias("own"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x, ids, bin_of, at = [], None, None, None, None
        for role, task, part in _by_role(batches):
            if role == 0:
                if task != at:
                    held, x, at = [], None, task
                held.append((_matrix(part.column(1), dims), part.column(0).to_numpy(), part.column(3).flatten().to_numpy()))
                continue
            if task != at:
                continue
            if x is None:
                x, ids, bin_of = (np.concatenate(c) for c in zip(*held))
                held = []
            for low in range(0, part.num_rows, ASKED):
                some = part.slice(low, ASKED)
                asking, lists = some.column(0).to_numpy(), some.column(3)
                visited = np.zeros((len(asking), int(bin_of.max()) + 2), dtype=bool)
                visited[np.repeat(np.arange(len(asking)), pc.list_value_length(lists).to_numpy()), np.minimum(pc.list_flatten(lists).to_numpy(), visited.shape[1] - 1)] = True
                found, scores = _tops(_matrix(some.column(1), dims), ~visited[:, bin_of] | (ids[None, :] == asking[:, None]), x, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    bins = placed.mapInArrow(deal, _SENT).unionByName(asked.mapInArrow(routes, _SENT)).repartitionById(tasks, "task").sortWithinPartitions("task", "role")
    tops = bins.mapInArrow(search, _TOP).groupBy("query_id").agg(F.flatten(F.collect_list(F.arrays_zip("scores", "ids"))).alias("all"))
    best = F.slice(F.array_sort(F.transform("all", lambda e: F.struct((-e["scores"]).alias("s"), e["ids"].alias("v")))), 1, k)
    ranked = tops.select("query_id", F.posexplode(best).alias("rank", "e"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.v").alias("vec_id"), (-F.col("e.s")).alias("score"))


def _sent(ids: pa.Array, vectors: pa.Array, tasks: np.ndarray, bins: pa.Array, role: int) -> pa.RecordBatch:
    columns = [ids, vectors, pa.array(tasks.astype(np.int32)), bins, pa.array(np.full(len(ids), role, dtype=np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "task", "bins", "role"])


def _by_role(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(role, task, rows) of batches sorted by task and role: each batch cut where one of them changes."""
    for batch in batches:
        task, role = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        cuts = np.flatnonzero((np.diff(task) != 0) | (np.diff(role) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if high > low:
                yield int(role[low]), int(task[low]), batch.slice(low, high - low)


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf) of the true k best of a bounded list of queries, over all rows in blocks."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(([q for q, _ in queries], np.array([v for _, v in queries], dtype=np.float64)))
    schema = "query_id long, vec_id long, score double, leaf long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        best = {i: (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for i in range(len(q_ids))}
        for batch in batches:
            x, ids, leaf = _matrix(batch.column(1), dims), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            products = q @ x.T
            for i, q_id in enumerate(q_ids):
                top, scores = _top(q[i], q_id, x, ids, products[i], k)
                at = np.concatenate([best[i][0], top]), np.concatenate([best[i][1], scores]), np.concatenate([best[i][2], _leaf_of(ids, leaf, top)])
                order = _best(at[0], at[1], k)
                best[i] = at[0][order], at[1][order], at[2][order]
        for i, (ids, scores, leaf) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q_ids[i])), pa.array(ids), pa.array(scores), pa.array(leaf)], names=["query_id", "vec_id", "score", "leaf"])

    return vectors.select("vec_id", "embedding", "leaf").mapInArrow(compare, schema)


def _leaf_of(ids: np.ndarray, leaf: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, kind="stable")
    return leaf[order[np.searchsorted(ids[order], wanted)]]


def _calibrate(placed: DataFrame, asked: DataFrame, tree, dims: int, k: int, recall: float, by_hash) -> int:
    """The least number of leaves whose visits find a share of ``recall`` of the true neighbours."""
    queries = [(r["vec_id"], r["embedding"]) for r in by_hash(asked, CALIBRATION_QUERIES).collect()]
    if not queries:
        return 1
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "leaf")))
    truth = brute_force(placed, queries, dims, k).groupBy("query_id").agg(F.slice(entries, 1, k).alias("top")).collect()
    orders = tree.value.visit(np.array([v for _, v in queries]), tree.value.leaves)
    place = {q: {leaf: i for i, leaf in enumerate(order)} for (q, _), order in zip(queries, orders)}
    needed = sorted(place[r["query_id"]][e["leaf"]] + 1 for r in truth for e in r["top"])
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else 1
