"""Embedding near-dedup by sorted projection passes with bounded neighbour windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, sorted_groups, spanning_edges
from .components import connected_components

#: Neighbours on either side that a pass compares, and rows of a block (one task's matrix).
WINDOW, BLOCK = 512, 1024
#: Vectors of a chunk of a range that is wider than the window; a task compares two chunks.
CHUNK = 4096
BITS = 62


def usable(vector: Column) -> Column:
    """True for a non-empty vector of finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prefix_bits(n: int, window: int | None = None) -> int:
    """Leading hash bits by which ``n`` evenly spread vectors fall into ranges of half a window."""
    window = window or WINDOW
    return 0 if n <= window else min(BITS, math.ceil(math.log2(n / window)) + 1)


def passes_needed(n: int, threshold: float, miss: float = 0.005, window: int | None = None) -> int:
    """Passes after which a pair at exactly ``threshold`` has agreed on the prefix bits of some pass with probability 1 - ``miss``.

    Each bit of two vectors at angle a agrees with probability 1 - a/pi.
    """
    bits = prefix_bits(n, window)
    if not bits:
        return 1
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log(1 - met)))


def _hash_keys(distinct: DataFrame, passes: int, seed: int) -> DataFrame:
    """(node, pass, dims, key): BITS concatenated signs of random projections of a vector, per pass."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            nodes, vectors = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.asarray(vectors.value_lengths())
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                x = np.array([vectors[int(i)].as_py() for i in rows], dtype=np.float64)
                for p in range(passes):
                    plane = planes.setdefault((dims, p), np.random.default_rng([seed, dims, p]).normal(size=(dims, BITS)))
                    key = ((x @ plane) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[rows]), pa.array(np.full(len(rows), p)), pa.array(np.full(len(rows), dims)), pa.array(key)], names=["node", "pass", "dims", "key"]
                    )

    return distinct.select("node", "embedding").mapInArrow(keys, "node long, pass long, dims long, key long")


def _positions(keyed: DataFrame, bits: int) -> DataFrame:
    """(node, pass, pos, range, width): each row's place in its pass, ordered by (dims, key, node).

    A range holds the rows that agree on dims and the leading ``bits`` of their keys; ``range`` is the place of its
    first row and ``width`` its rows, or both null if a window covers it.

    One range partitioning sorts all passes; a row's place is its place in its partition plus the rows
    of its pass in the partitions before, of which there is one count per partition and pass.
    """
    prefix = F.shiftright("key", BITS - bits).alias("prefix")
    placed = materialize(
        materialize(keyed).repartitionByRange("pass", "dims", "key", "node").sortWithinPartitions("pass", "dims", "key", "node").select("node", "pass", "dims", prefix, F.monotonically_increasing_id().alias("at"))
    )
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy("pass", part).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pass", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = placed.withColumn("part", F.shiftright("at", 33)).join(offsets, ["pass", "part"])
    ranked = joined.select("node", "pass", "dims", "prefix", (F.col("at") - F.col("first") + F.col("offset")).alias("pos"))
    wide = ranked.groupBy("pass", "dims", "prefix").agg(F.min("pos").alias("range"), F.count("*").alias("width")).where(F.col("width") > WINDOW + 1)
    return ranked.join(wide, ["pass", "dims", "prefix"], "left").select("node", "pass", "pos", "range", "width")


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # lest squares of very large or small numbers overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = "a long, b long, links long"


def _found(nodes: np.ndarray, edges: list[tuple[int, int]], links: np.ndarray) -> pd.DataFrame:
    """``edges`` (a, b) of a spanning forest, and rows (a, null) with the ``links`` counted for a."""
    with_links = np.flatnonzero(links)
    a = np.concatenate([nodes[[i for i, _ in edges]], nodes[with_links]])
    b = pd.array([*nodes[[j for _, j in edges]].tolist(), *[None] * len(with_links)], dtype="Int64")
    n = np.concatenate([np.zeros(len(edges)), links[with_links]]).astype(np.int64)
    return pd.DataFrame({"a": a, "b": b, "links": n})


class _Places:
    """Places and ranges of rows in all passes; tells which pairs no pass before ``p`` has compared."""

    def __init__(self, rows: pd.DataFrame, window: int):
        self.window = window
        self.pos = np.array(rows["places"].tolist(), dtype=np.int64)
        self.range = np.array(rows["ranges"].tolist(), dtype=np.int64)  # -1: the window covers it

    def fresh(self, i: np.ndarray, j: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        for q in range(p):
            met = (np.abs(self.pos[i, q] - self.pos[j, q]) <= self.window) | ((self.range[i, q] == self.range[j, q]) & (self.range[i, q] >= 0))
            i, j = i[~met], j[~met]
        return i, j


def _windows(located: DataFrame, threshold: float) -> DataFrame:
    """Compare every vector with the WINDOW before and after it in each pass.

    A pair that an earlier pass has compared, as the places of both tell, is not counted again.
    """
    passes = F.posexplode("places").alias("pass", "pos")
    rows = located.select("node", "size", "embedding", "places", "ranges", passes)
    block = F.floor(F.col("pos") / BLOCK)
    tail = F.col("pos") % BLOCK >= BLOCK - WINDOW
    dealt = rows.select(
        "*", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))).alias("block")
    ).withColumn("own", (block == F.col("block")).cast("int"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["pass", "block"], smallest=2):
            for _, same in group.groupby(group["embedding"].map(len), sort=False):
                x, own, size = _unit(same["embedding"]), same["own"].to_numpy() == 1, same["size"].to_numpy(dtype=np.float64)
                p, pos = int(same["pass"].iloc[0]), same["pos"].to_numpy()
                linked = (x @ x.T >= threshold) & (np.abs(np.subtract.outer(pos, pos)) <= WINDOW)
                linked &= own[:, None] | own[None, :]  # both in the tail of the block before: compared there
                np.fill_diagonal(linked, False)
                i, j = np.nonzero(linked)
                if len(i):
                    edges = spanning_edges(linked)
                    i, j = _Places(same, WINDOW).fresh(i, j, p) if p else (i, j)
                    yield _found(same["node"].to_numpy(), edges, np.bincount(i, size[j], len(same)))

    return dealt.repartition("pass", "block").sortWithinPartitions("pass", "block").mapInPandas(compare, _FOUND)


def _wide_ranges(located: DataFrame, threshold: float) -> DataFrame | None:
    """The pairs of ranges that are wider than a window: all against all, a chunk against a chunk per task.

    None if there are no such ranges. Pairs within a window are left to ``_windows``, and pairs that an earlier pass
    has compared are not counted again.
    """
    in_pass = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("places") - 1).alias("pass"), F.col("places").alias("pos"), F.col("ranges").alias("range"), F.col("widths").alias("width"))).alias("w")
    rows = located.where(F.exists("ranges", lambda r: r >= 0)).select("node", "size", "embedding", "places", "ranges", in_pass).where("w.range >= 0")
    if rows.isEmpty():
        return None
    chunks = F.ceil(F.col("w.width") / CHUNK)
    own = F.floor((F.col("w.pos") - F.col("w.range")) / CHUNK)
    dealt = rows.select("node", "size", "embedding", "places", "ranges", "w.pass", "w.pos", "w.range", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    dealt = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("other")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["pass", "range", "i", "j"], smallest=2):
            x, size, pos = _unit(group["embedding"]), group["size"].to_numpy(dtype=np.float64), group["pos"].to_numpy()
            p, places, own = int(group["pass"].iloc[0]), _Places(group, WINDOW), group["own"].to_numpy()
            alone = group["i"].iloc[0] == group["j"].iloc[0]
            left, right = np.flatnonzero(own == group["i"].iloc[0]), np.flatnonzero(own == group["j"].iloc[0])
            links, label, edges = np.zeros(len(x)), np.arange(len(x)), []
            for s in range(0, len(left), BLOCK):
                for t in range(s if alone else 0, len(right), BLOCK):
                    a, b = left[s : s + BLOCK], right[t : t + BLOCK]
                    linked = x[a] @ x[b].T >= threshold
                    if alone and s == t:
                        linked = np.triu(linked, 1)
                    if not linked.any():
                        continue
                    for r in np.flatnonzero((linked & (label[a][:, None] != label[b][None, :])).any(axis=1)):
                        for c in b[linked[r]]:
                            if label[c] != label[a[r]]:
                                label[label == label[c]] = label[a[r]]
                                edges.append((int(a[r]), int(c)))
                    i, j = np.nonzero(linked)
                    i, j = a[i], b[j]
                    far = np.abs(pos[i] - pos[j]) > WINDOW
                    i, j = places.fresh(i[far], j[far], p)
                    links += np.bincount(i, size[j], len(x)) + np.bincount(j, size[i], len(x))
            if edges or links.any():
                yield _found(group["node"].to_numpy(), edges, links)

    keys = ["pass", "range", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, _FOUND)


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, miss: float = 0.005, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of cosine ``threshold`` or more, in double precision, link; n_links counts the other
    vectors linked directly, component_id is the smallest vec_id reachable, kept marks its holder.

    Equal vectors, as two 64-bit hashes tell, are one class, so copies are not compared with each other. The passes
    needed follow from the number of classes (``passes_needed``). A pass compares each vector with its window; where
    more vectors than a window holds agree on the prefix bits, all of these are compared, so a pair that agrees on the
    prefix of some pass is found however dense its neighbourhood is, and each pair is counted once. Such a range
    costs the square of its size, dealt over tasks.

    Null, empty, zero and non-finite vectors link with nothing and are kept. Vectors of different
    lengths do not link. Rows with a null id link with nothing, have a null component and are not
    kept. Repeated rows count as other vectors; each gives a row. No rows give no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    fit = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(seed), F.col("embedding")).alias("h2")]
    classes = fit.select("vec_id", "embedding", *same).groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.any_value("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    placed = _positions(_hash_keys(classes, passes_needed(n, threshold, miss), seed), prefix_bits(n))
    outside = F.lit(-1).cast("long")
    places = placed.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pass", "pos", F.coalesce("range", outside).alias("range"), F.coalesce("width", outside).alias("width")))).alias("p"))
    located = materialize(classes.join(places, "node").select("node", "size", "embedding", F.col("p.pos").alias("places"), F.col("p.range").alias("ranges"), F.col("p.width").alias("widths")))
    found, more = _windows(located, threshold), _wide_ranges(located, threshold)
    found = materialize(found if more is None else found.unionByName(more))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("found"))
    joined = connected_components(found.where(F.col("b").isNotNull()).select("a", "b"))
    of_class = classes.join(joined, "node", "left").select("node", "h1", "h2", "least", "size", F.coalesce("component", "node").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(smallest, "component").join(links, "node", "left").select("h1", "h2", (F.coalesce("found", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = fit.select("vec_id", *same).join(of_class, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(F.col("vec_id").isNull() | ~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
