"""Prerequisite, similarity and co-occurrence relations between skills, built from a train split."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._session import materialize, written
from ..functions.columns import four_places, hashed_unit, safe_ratio
from ..functions.ranking import global_row_number, prefix_sums, quantiles, quantiles_of_many

# the functions that tasks run travel whole, so executors need not find this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _skill_order(train: DataFrame) -> DataFrame:
    """(skill_id, t, r): skills by median time, ties by id, ranked over range partitions; skills without a time have no place."""
    return global_row_number(quantiles_of_many(train, ["skill_id"], "timestamp", {"t": 0.5}), ["t", "skill_id"], "r")


#: Pairs that a task compares when all skills are paired.
RAW_PAIRS = 50_000_000


def e_pre_raw(train: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Every pair of skills from earlier to later median time; equal medians give no edge.

    The result is quadratic in the skills, so the earlier ends are dealt over tasks by the number of pairs: the table of
    skills itself is so small that Spark would leave it in one.
    """
    order = written(_skill_order(train).select("skill_id", "t"))
    n = order.count()
    tasks = max(1, min(n, max(train.sparkSession.sparkContext.defaultParallelism, n * n // RAW_PAIRS)))
    a, b = order.repartition(tasks, "skill_id").alias("a"), F.broadcast(order).alias("b")
    pairs = a.join(b, F.col("a.t") < F.col("b.t"))
    return pairs.select(F.col("a.skill_id").alias("src"), F.col("b.skill_id").alias("dst"), F.lit(1.0).alias("weight"), F.lit(confidence).alias("confidence"))


def top_k_out(edges: DataFrame, k: int = 5, by: tuple[str, ...] = ("weight",), keys: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` outgoing edges of each source with the largest ``by``, ties to the smaller dst.

    Two phases: as the bound is a literal, each task keeps k rows a source before the shuffle, so a hub with very many
    edges sends k of them from each task. Sources with fewer edges keep all; null weights come last.
    """
    w = Window.partitionBy(*keys, "src").orderBy(*[F.desc(c) for c in by], "dst")
    return edges.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def e_pre_topk(train: DataFrame, k: int = 5) -> DataFrame:
    """Each skill to the next ``k`` in order of median time, by an equi-join on rank: no quadratic pairs."""
    order = _skill_order(train)
    ahead = order.select(F.col("skill_id").alias("src"), F.col("r").alias("src_rank"), F.explode(F.sequence(F.col("r") + 1, F.col("r") + k)).alias("r"))
    return ahead.join(order.select(F.col("skill_id").alias("dst"), "r"), "r").select("src", "dst", F.lit(1.0).alias("weight"), (F.col("r") - F.col("src_rank")).alias("step"))


def e_pre_chain(train: DataFrame) -> DataFrame:
    """The transitive reduction of the order's edges: each skill to the next one, by an equi-join on rank."""
    return e_pre_topk(train, 1).select("src", "dst")


def e_pre_support(edges: DataFrame, train: DataFrame) -> DataFrame:
    """Edges with support = interactions of src + interactions of dst."""
    freq = train.groupBy("skill_id").agg(F.count("*").alias("n"))
    both = edges.join(freq.select(F.col("skill_id").alias("src"), F.col("n").alias("n_src")), "src").join(freq.select(F.col("skill_id").alias("dst"), F.col("n").alias("n_dst")), "dst")
    return both.withColumn("support_count", F.col("n_src") + F.col("n_dst")).drop("n_src", "n_dst")


def support_hash(edges: DataFrame) -> DataFrame:
    """Edges with the first 16 hex digits of sha256(src_dst_support_weight to four places)."""
    text = F.concat_ws("_", "src", "dst", F.col("support_count").cast("string"), four_places(F.col("weight")))
    return edges.withColumn("support_hash", F.substring(F.sha2(text, 256), 1, 16))


def e_pre_variants(
    scores: DataFrame, ks: tuple[int, ...] = (3, 5, 10), thresholds: tuple[float, ...] = (0.7, 0.8, 0.9), target_density: float = 0.05, reduced: int = 5
) -> DataFrame:
    """Summary of the raw edges, top-k and confidence-threshold variants, and the transitive reduction of the
    top ``reduced``: nodes, edges, density, out-degree, dag flag, status.

    ``scores(src, dst, weight, confidence)``; the edges are ranked once and the variants are rows. All nodes of the
    scores count in every variant. The reduction has no edges (null) where the edges it is made from have a cycle.
    """
    from .graph import cyclic_core, nodes_of, transitive_reduction

    w = Window.partitionBy("src").orderBy(F.desc("confidence"), F.desc("weight"), "dst")
    most = max(*ks, reduced)
    best = written(scores.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most))
    passing = [("raw", F.lit(True))] + [(f"confidence_{t:.2f}", F.col("confidence") >= t) for t in thresholds]
    leading = [(f"top{k}_out", F.col("__r") <= k) for k in ks]
    counted = lambda df, tests, *more: df.agg(*[F.count(F.when(test, 1)).alias(name) for name, test in tests], *more).first()
    total = counted(scores, passing, F.bool_and(F.col("src") < F.col("dst")).alias("__up"), F.bool_and(F.col("src") > F.col("dst")).alias("__down"))
    sizes = total.asDict() | counted(best, leading).asDict()
    top = best.where(F.col("__r") <= reduced).select("src", "dst", "weight")
    if total["__up"] is None or total["__up"] or total["__down"]:
        cyclic, acyclic = set(), True  # all edges run one way in the order of names, so those of each variant do
    else:
        rows = [edges.where(test).select("src", "dst", "weight", F.lit(name).alias("variant")) for edges, tests in ((scores, passing), (best, leading)) for name, test in tests]
        # one search for cycles serves all variants, as their nodes have names of their own
        apart = lambda c: F.concat_ws("|", "variant", c).alias(c)
        core = cyclic_core(reduce(DataFrame.unionByName, rows).select(apart("src"), apart("dst"), "weight"))
        cyclic = {r["variant"] for r in core.select(F.substring_index("src", "|", 1).alias("variant")).distinct().collect()}  # a row a variant
        acyclic = cyclic_core(top).isEmpty()
    name = f"top{reduced}_transitive_reduced"
    counts = scores.sparkSession.createDataFrame([(v, sizes[v], v not in cyclic) for v, _ in passing + leading if sizes[v]], "variant string, edges long, dag boolean")
    m = transitive_reduction(top).agg(F.count("*").alias("edges")) if acyclic else top.agg(F.lit(None).cast("long").alias("edges"))
    counts = counts.unionByName(m.select(F.lit(name).alias("variant"), "edges", F.lit(acyclic).alias("dag")))
    n = F.col("nodes")
    density = safe_ratio(F.col("edges"), n * (n - 1))
    return counts.crossJoin(nodes_of(scores).agg(F.count("*").alias("nodes"))).select(
        "variant", "nodes", "edges", density.alias("density"), safe_ratio(F.col("edges"), n).alias("avg_out_degree"), "dag", F.when(density <= target_density, "PASS").otherwise("DENSE").alias("status")
    )


#: Skills of one learner or question that are paired in one group; more are dealt over pairs of such blocks.
PAIR_BLOCK = 2000


def pairs_sharing(own: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst) with src < dst, once for every ``key`` that holds both skills, of distinct rows ``own(key, skill_id)``.

    A key with more than PAIR_BLOCK skills is cut into blocks, and each pair of its blocks is a group of its own.
    Columns in ``carry`` come along as src_<column> and dst_<column>.
    """
    large = own.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PAIR_BLOCK).select(key, F.ceil(F.col("n") / PAIR_BLOCK).alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = own.join(large, key, "left").select(key, "skill_id", *carry, F.pmod(F.xxhash64("skill_id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select(key, "skill_id", *carry, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    a, b = dealt.where("own = i").alias("a"), dealt.where("own = j").alias("b")
    ascending = F.col("a.skill_id") < F.col("b.skill_id")
    met = a.join(b, [key, "i", "j"]).where((F.col("i") < F.col("j")) | ascending)
    carried = [F.when(ascending == first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(f"{end}_{c}") for end, first in (("src", F.lit(True)), ("dst", F.lit(False))) for c in carry]
    return met.select(F.least("a.skill_id", "b.skill_id").alias("src"), F.greatest("a.skill_id", "b.skill_id").alias("dst"), *carried)


#: Pairs that a task counts at a time, before the shuffle and after it.
TASK_PAIRS = 4_000_000
_BLOCK = "part int, n int, pairs binary, counts binary"
_COUNT = "pair long, support_count long"


def _pairs_within(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pairs within each of the sets that lie one after the other in ``ids``, as numbers, the earlier member in the upper half."""
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids)) - 1  # members of the set that come after each
    at = np.repeat(np.arange(len(ids)) + 1 - (np.cumsum(later) - later), later) + np.arange(later.sum())
    return np.repeat(ids << 32, later) | ids[at]


def _counted(pairs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and the sums of their counts, one each if there are none."""
    if counts is None:
        pairs = np.sort(pairs)
    else:
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, dtype=np.int64)
    return pairs[starts], np.diff(np.append(starts, len(pairs))) if counts is None else np.add.reduceat(counts, starts) if len(starts) else counts


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs: first all lowest bytes, then the next ones, so that the sparse high ones compress."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _widened(data: bytes, n: int) -> np.ndarray:
    """What ``_narrow`` wrote of ``n`` numbers."""
    planes = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<i8").ravel()


def _step(size: int, parts: int) -> int:
    """The least number from ``size`` on without a common factor with ``parts``: pairs (a, b) below ``size`` go by a * step + b,
    so that the pairs of any one member, earlier or later, spread over all remainders."""
    return next(x for x in range(max(1, size), 2 * max(1, size) + parts + 2) if math.gcd(x, parts) == 1)


def _blocks(pairs: np.ndarray, parts: int, step: int) -> pa.RecordBatch:
    """Pairs counted and dealt out by the remainder of their number: one row a part, with the gaps between its pairs and,
    unless all are 1, their counts. Gaps need about three bytes, a pair eight."""
    pairs, counts = _counted(pairs)
    quotient, part = np.divmod((pairs >> 32) * step + (pairs & (2**32 - 1)), parts)
    order = np.argsort(part.astype(np.uint16 if parts < 2**16 else np.uint32), kind="stable")
    quotient, counts, part = quotient[order], counts[order], part[order]
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, dtype=np.int64)
    cut = list(zip(starts, np.append(starts[1:], len(part))))
    gaps = [_narrow(np.diff(quotient[i:j])) if j - i > 1 else b"" for i, j in cut]
    rows = [
        part[starts].astype(np.int32), [j - i for i, j in cut], [int(quotient[i]).to_bytes(8, "little") + g for (i, _), g in zip(cut, gaps)],
        [None if (counts[i:j] == 1).all() else _narrow(counts[i:j]) for i, j in cut],
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "n", "pairs", "counts"])


def _unblocked(part: int, n: int, data: bytes, parts: int, step: int) -> np.ndarray:
    """The pairs of a row of ``_blocks``."""
    quotient = np.cumsum(np.append(int.from_bytes(data[:8], "little"), _widened(data[8:], n - 1) if n > 1 else np.empty(0, dtype=np.int64)))
    a, b = np.divmod(quotient * parts + part, step)
    return a << 32 | b


def _met_in_sets(parts: int, most: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, sizes = pc.list_flatten(batch.column(0)).to_numpy().astype(np.int64), pc.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            ends, work, at, done = np.cumsum(sizes), np.cumsum(sizes * (sizes - 1) // 2), 0, 0
            while at < len(sizes):
                upto = max(at + 1, int(np.searchsorted(work, done + most - n, "right")))
                held.append((ids[ends[at] - sizes[at] : ends[upto - 1]], sizes[at:upto]))
                n, at, done = n + int(work[upto - 1]) - done, upto, int(work[upto - 1])
                if at < len(sizes) or n >= most:
                    yield _blocks(_pairs_within(*(np.concatenate(x) for x in zip(*held))), parts, step)
                    held, n = [], 0
        if held:
            yield _blocks(_pairs_within(*(np.concatenate(x) for x in zip(*held))), parts, step)

    return run


def _met_in_rows(parts: int, most: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            n += len(held[-1])
            if n >= most:
                yield _blocks(np.concatenate(held), parts, step)
                held, n = [], 0
        if n:
            yield _blocks(np.concatenate(held), parts, step)

    return run


def _summed(least: int, parts: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, single = [], [], True
        for batch in batches:
            for part, n, p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                pairs.append(_unblocked(part, n, p.as_py(), parts, step))
                counts.append(_widened(c.as_py(), n) if c.is_valid else np.ones(n, dtype=np.int64))
                single &= not c.is_valid
        if pairs:
            pair, n = _counted(np.concatenate(pairs), None if single else np.concatenate(counts))
            pair, n = pair[n >= least], n[n >= least]
            for i in range(0, len(pair), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 500_000]), pa.array(n[i : i + 500_000])], names=["pair", "support_count"])

    return run


def pair_counts(rows: DataFrame, key: str, least: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((pair, support_count), (skill_id, n, i), (key, ids)): a row per pair of skills that share at least ``least`` values of ``key``, with how many they share, the numbers of skills, and the keys' sets of numbers.

    ``rows(key, skill_id)`` may repeat and are read twice; n is the number of a skill's keys. Skills go by their place in the
    order of names, so a pair is one number, the smaller name's first. The set of a key is a sorted array of these numbers,
    at most one for each skill, and is written once. Sets are dealt by range of their first skill, and a task sorts and counts
    the pairs of its sets, so those that share skills send a pair once. Where skills are many a pair hardly meets twice in
    a task; so pairs travel in blocks, as gaps of about three bytes each, to the task that counts them by the remainder of
    their number. Keys with more than PAIR_BLOCK skills go through ``pairs_sharing``.
    """
    places = global_row_number(rows.where(F.col("skill_id").isNotNull()).select("skill_id").distinct(), ["skill_id"], "i")
    places = written(places.select("skill_id", F.col("i").cast("int").alias("i")))
    coded = rows.select(key, "skill_id").join(places, "skill_id", "left").select(key, "i").distinct()
    sets = written(coded.repartition(key).groupBy(key).agg(F.sort_array(F.collect_list("i")).alias("ids")))
    sizes = sets.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    names = written(places.join(sizes, "i").select("skill_id", "n", "i"))
    known = sets.where(F.col(key).isNotNull() & (F.size("ids") > 1))
    n = F.size("ids").cast("long")
    met = n * (n - 1) / 2
    pairs, large = known.agg(F.coalesce(F.sum(F.when(n <= PAIR_BLOCK, met)), F.lit(0.0)), F.coalesce(F.sum(F.when(n > PAIR_BLOCK, met)), F.lit(0.0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = lambda work: int(max(work // TASK_PAIRS + 1, min(work // 100_000 + 1, cores)))
    parts = tasks(pairs + large)
    step = _step((names.agg(F.max("i")).first()[0] or 0) + 1, parts)
    blocks = known.where(n <= PAIR_BLOCK).repartitionByRange(tasks(pairs), F.col("ids")[0], key).select("ids").mapInArrow(_met_in_sets(parts, TASK_PAIRS, step), _BLOCK)
    if large:
        hubs = known.where(n > PAIR_BLOCK).select(key, F.explode("ids").alias("skill_id"))
        pair = F.shiftleft(F.col("src").cast("long"), 32).bitwiseOR(F.col("dst").cast("long"))
        blocks = blocks.unionByName(pairs_sharing(hubs, key).select(pair.alias("pair")).mapInArrow(_met_in_rows(parts, TASK_PAIRS, step), _BLOCK))
    return blocks.repartitionById(parts, "part").mapInArrow(_summed(least, parts, step), _COUNT), names, sets


def _named_pairs(counts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, support_count, n_src, n_dst): numbered pairs by name, src < dst, with the keys of both skills."""
    named = lambda end: names.select(F.col("i").alias(f"__{end}"), F.col("skill_id").alias(end), F.col("n").alias(f"n_{end}"))
    ends = counts.select(F.shiftright("pair", 32).cast("int").alias("__src"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("__dst"), "support_count")
    return ends.join(named("src"), "__src").join(named("dst"), "__dst").select("src", "dst", "support_count", "n_src", "n_dst")


def shared_counts(rows: DataFrame, key: str) -> DataFrame:
    """(src, dst, support_count, n_src, n_dst): the pairs of ``pair_counts`` by name."""
    counts, names, _ = pair_counts(rows, key)
    return _named_pairs(counts, names)


#: From this similarity on, prefixes leave out enough of the sets to be worth placing their elements.
PREFIX_FROM = 0.5


def e_sim(train: DataFrame, theta: float = 0.1) -> DataFrame:
    """Jaccard similarity of the skills' question sets, at least ``theta`` > 0, src < dst; support is the intersection.

    Only pairs that share a question meet, by an equi-join on it; from PREFIX_FROM on only those that share one of the
    rare questions by which a pair of that similarity must meet (``similarity.similar_sets``). Both give the same rows.
    Rows without a skill or a question do not count.
    """
    if theta <= 0:
        raise ValueError("theta must be above 0: pairs without a shared question are not built")
    if theta >= PREFIX_FROM:
        from .similarity import similar_sets

        return similar_sets(train, theta)
    both = shared_counts(train.select("skill_id", "question_id").na.drop(), "question_id")
    weight = F.col("support_count").cast("double") / (F.col("n_src") + F.col("n_dst") - F.col("support_count"))
    return both.select("src", "dst", weight.alias("weight"), "support_count").where(F.col("weight") >= theta)


def e_sim_topk(edges: DataFrame, k: int = 20) -> DataFrame:
    return top_k_out(edges, k)


def e_sim_trace(train: DataFrame, theta: float = 0.1, k: int = 20) -> DataFrame:
    """One row: skills, shared questions, candidate pairs, pairs at theta, edges after top-k, and why there are none."""
    skills = train.agg(F.countDistinct("skill_id").alias("n_skills"))
    per_question = train.groupBy("question_id").agg(F.countDistinct("skill_id").alias("n"))
    shared = per_question.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("multi_skill_questions"))
    pairs = written(e_sim(train, 1e-12).select("src", "dst", "weight"))
    kept = pairs.where(F.col("weight") >= theta)
    counts = pairs.agg(F.count("*").alias("candidate_pairs"), F.coalesce(F.sum(F.when(F.col("weight") >= theta, 1).otherwise(0)), F.lit(0)).alias("pairs_at_theta"))
    top = e_sim_topk(kept, k).agg(F.count("*").alias("edges_after_topk"))
    row = skills.crossJoin(shared).crossJoin(counts).crossJoin(top)
    reason = F.when(F.col("multi_skill_questions") == 0, "no shared questions").when(F.col("pairs_at_theta") == 0, "all below theta").otherwise("active")
    return row.withColumn("reason", reason)


def co_pairs(train: DataFrame, least: int = 1) -> DataFrame:
    """(src, dst, support_count, pmi) of all skill pairs with ``least`` common learners or more, src < dst.

    Learners count a skill once; the pairs are counted map-side before they are shuffled.
    """
    counts, names, sets = pair_counts(train, "learner_id", least)
    total, both = sets.agg(F.count("*").alias("n")), _named_pairs(counts, names)
    pmi = F.log(F.col("support_count").cast("double") * F.col("n") / (F.col("n_src").cast("double") * F.col("n_dst")))
    return both.crossJoin(F.broadcast(total)).select("src", "dst", "support_count", pmi.alias("pmi"))


def e_co(train: DataFrame, min_count: int = 2, pmi_min: float = 0.0, strict: bool = True) -> DataFrame:
    """Learner-level co-occurrence: pairs of at least ``min_count`` common learners and PMI above ``pmi_min``."""
    over = F.col("pmi") > pmi_min if strict else F.col("pmi") >= pmi_min
    return co_pairs(train, min_count).where(over).select("src", "dst", F.col("pmi").alias("weight"), "support_count")


def mirror_edges(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges in both directions with ``is_mirrored``; of equal rows the forward one stays."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}).withColumn("is_mirrored", F.lit(True))
    w = Window.partitionBy(*keys, "src", "dst").orderBy("is_mirrored", F.desc("weight"))
    both = edges.withColumn("is_mirrored", F.lit(False)).unionByName(back)
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def both_ways(edges: DataFrame, back: Column | None = None) -> DataFrame:
    """Edges that stand in one direction each, and their reverses where ``back`` holds (all, if none is given).

    An edge and its reverse come one after the other in a task, so counts per pair of ends meet them before a shuffle.
    """
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    reverse = ends("dst", "src") if back is None else F.when(back, ends("dst", "src"))
    both = edges.withColumn("__e", F.explode(F.array_compact(F.array(ends("src", "dst"), reverse))))
    return both.withColumns({"src": F.col("__e.src"), "dst": F.col("__e.dst")}).drop("__e")


def _in_either_top(pairs: DataFrame, k: Column, bound: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that are among the ``k`` of largest weight of either end; ``bound`` is the largest k, by which tasks keep few rows of a hub."""
    ends = pairs.withColumn("__u", F.explode(F.array("src", "dst")))
    w = Window.partitionBy(*keys, "__u").orderBy(F.desc("weight"), "src", "dst")
    return ends.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= bound) & (F.col("__r") <= k)).drop("__u", "__r").distinct()


def e_co_controlled(train: DataFrame, k_min: int = 3, pmi_min: float = 0.25, top_k: int = 50, mirrored: bool = True) -> DataFrame:
    """Co-occurrence of PMI >= ``pmi_min`` cut to the top-k neighbour lists of either endpoint, then mirrored."""
    kept = _in_either_top(e_co(train, k_min, pmi_min, strict=False), F.lit(top_k), top_k)
    return mirror_edges(kept) if mirrored else kept


def e_co_sensitivity(train: DataFrame, grid: list[tuple[int, float, int]]) -> DataFrame:
    """One row per (k_min, pmi_min, top_k; 0: no top-k): rows, edges, density, PMI moments and quartiles, coverage, flags.

    Pairs are counted once and written, and ranked at their ends once per ``k_min``: a least PMI only cuts the end of a
    ranking, so all configurations of a ``k_min`` share it. The grid is a small table joined to both. Configurations
    without edges have null PMI statistics.
    """
    spark = train.sparkSession
    configs = spark.createDataFrame(grid, "k_min int, pmi_min double, top_k int")
    n_skills = train.agg(F.countDistinct("skill_id").alias("n"))
    pairs = written(co_pairs(train, min(k for k, _, _ in grid)).withColumnRenamed("pmi", "weight").where(F.col("weight") > 0))
    keys, bound = ("k_min", "pmi_min", "top_k"), max(top for _, _, top in grid)
    meets = lambda df, small: df.crossJoin(F.broadcast(small)).where((F.col("support_count") >= F.col("k_min")) & (F.col("weight") >= F.col("pmi_min")))
    supported = pairs.crossJoin(F.broadcast(configs.select("k_min").distinct())).where(F.col("support_count") >= F.col("k_min"))
    w = Window.partitionBy("k_min", "__u").orderBy(F.desc("weight"), "src", "dst")
    ends = supported.withColumn("__u", F.explode(F.array("src", "dst"))).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= bound)
    ranked = written(ends.groupBy("k_min", "src", "dst", "weight").agg(F.min("__r").alias("__r")))
    top = ranked.join(F.broadcast(configs.where("top_k > 0")), "k_min").where((F.col("weight") >= F.col("pmi_min")) & (F.col("__r") <= F.col("top_k")))
    columns = [*keys, "src", "dst", "weight"]
    kept = top.select(*columns).unionByName(meets(pairs, configs.where("top_k = 0")).select(*columns))
    middle = quantiles(kept, list(keys), "weight", {"pmi_p25": 0.25, "pmi_median": 0.5, "pmi_p75": 0.75})
    stats = kept.groupBy(*keys).agg(F.count("*").alias("edges"), F.avg("weight").alias("pmi_mean")).join(middle, list(keys))
    covered = kept.select(*keys, F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy(*keys).agg(F.count("*").alias("covered"))
    limits = ["k_min", "pmi_min"]
    support = meets(pairs, configs.select(*limits).distinct()).groupBy(*limits).agg(F.count("*").alias("support_rows"))
    joined = F.broadcast(configs).crossJoin(F.broadcast(n_skills)).join(support, limits, "left").join(stats, list(keys), "left").join(covered, list(keys), "left")
    edges = F.coalesce("edges", F.lit(0))
    density = F.coalesce(safe_ratio(2 * edges, F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return joined.select(
        *keys, F.coalesce("support_rows", F.lit(0)).alias("support_rows"), edges.alias("edges"), density.alias("density"), "pmi_mean",
        "pmi_median", "pmi_p25", "pmi_p75",
        F.coalesce(safe_ratio(F.coalesce("covered", F.lit(0)), F.col("n")), F.lit(0.0)).alias("covered_share"),
        *[(density < t).alias(f"density_lt_{int(t * 100)}") for t in (0.8, 0.5, 0.25)],
    )


def retention_curve(edges: DataFrame, n: int = 30) -> DataFrame:
    """(step, threshold, edges, share) for ``n`` thresholds from 0 to the largest weight."""
    top = edges.agg(F.max("weight").alias("top"), F.count("*").alias("total"))
    steps = top.select("top", "total", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")).withColumn("threshold", F.col("top") * F.col("step") / F.lit(float(n - 1)))
    # each weight passes a prefix of the thresholds: count the last step it passes, then sum from above
    last = edges.crossJoin(F.broadcast(top)).select(F.when(F.col("top") == 0, n - 1).otherwise(F.floor(F.col("weight") / F.col("top") * (n - 1) + 1e-9)).cast("int").alias("step")).groupBy("step").agg(F.count("*").alias("c"))
    joined = steps.join(last, "step", "left")
    above = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy(F.desc("step")))  # n rows
    return joined.select("step", "threshold", above.alias("edges"), "total").select("step", "threshold", "edges", safe_ratio(F.col("edges"), F.col("total")).alias("share"))


def weight_histogram(edges: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, edges): equal-width bins from the least to the largest weight; the last holds the largest."""
    ends = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return edges.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("edges"))


def weight_cdf(edges: DataFrame) -> DataFrame:
    """(weight, cdf) per distinct weight: the share of edges at or below it; weights are counted before they are ordered, and the edges read once."""
    counts = written(edges.groupBy("weight").agg(F.count("*").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    running = prefix_sums(counts, [], ["weight"], ["c"])
    return running.crossJoin(F.broadcast(total)).select("weight", safe_ratio(F.col("before_c") + F.col("c"), F.col("n")).alias("cdf"))


def inject_label_noise(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """``df`` with ``correct`` flipped where the md5 number of (interaction, skill, seed) is below ``rate``."""
    hit = hashed_unit(F.col("interaction_id"), F.col("skill_id"), F.lit(seed)) < rate
    return df.withColumn("noisy", hit).withColumn("correct", F.when(hit, 1 - F.col("correct")).otherwise(F.col("correct")))


def inject_edge_noise(edges: DataFrame, rate: float, seed: int) -> DataFrame:
    """``edges`` with dst rewired, where the md5 number of (src, dst, seed) is below ``rate``, to a node chosen by md5.

    Nodes are numbered over range partitions; a rewired edge that would be a loop keeps its dst.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    numbered = global_row_number(nodes, ["node"], "__i").withColumn("__i", F.col("__i") - 1)
    total = numbered.agg((F.max("__i") + 1).alias("__n"))
    picked = edges.crossJoin(F.broadcast(total)).withColumn("noisy", hashed_unit(F.col("src"), F.col("dst"), F.lit(seed)) < rate)
    picked = picked.withColumn("__i", F.when(F.col("noisy"), F.floor(hashed_unit(F.col("dst"), F.col("src"), F.lit(seed + 1)) * F.col("__n"))))
    joined = picked.join(numbered, "__i", "left")
    dst = F.when(F.col("noisy") & (F.col("node") != F.col("src")), F.col("node")).otherwise(F.col("dst"))
    return joined.withColumn("dst", dst).select(*edges.columns, "noisy")


def edge_drop(edges: DataFrame, p: float, seed: int) -> DataFrame:
    """Edges whose md5 number of (src, dst, seed) is ``p`` or more, so equal rows go together. Edges with a null end go by the other end."""
    return edges.where(hashed_unit(F.col("src"), F.col("dst"), F.lit(seed)) >= p)


def node_drop(edges: DataFrame, p: float, seed: int) -> DataFrame:
    """Edges both of whose ends stay."""
    stays = lambda c: hashed_unit(F.col(c), F.lit(seed)) >= p
    return edges.where(stays("src") & stays("dst"))


def topk_similarity_table(edges: DataFrame, ks: tuple[int, ...] = (3, 5, 10, 20)) -> DataFrame:
    """Nodes, edges, density, mean and median weight of the top-k similarity graph, per k. The edges are ranked once and the first written; no edges give no rows."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    ranked = written(edges.select("src", "dst", "weight").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(ks)))
    rows = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("__r") <= F.col("k"))
    nodes = rows.select("k", F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy("k").agg(F.count("*").alias("nodes"))
    stats = rows.groupBy("k").agg(F.count("*").alias("edges"), F.avg("weight").alias("avg_score"))
    stats = stats.join(quantiles(rows, ["k"], "weight", {"median_score": 0.5}), "k", "left")
    n = F.col("nodes")
    return stats.join(nodes, "k").select("k", "nodes", "edges", safe_ratio(F.col("edges"), n * (n - 1)).alias("density"), "avg_score", "median_score")
