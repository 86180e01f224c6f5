"""Provenance, leakage (L1-L6) and training audits. Each returns rows with a status of PASS, FAIL, WARN, FLAG, SKIP or UNKNOWN."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._session import written
from ..functions.columns import safe_ratio
from ..functions.ranking import quantiles
from .graph import nodes_of, sparse_coverage
from .relations import pair_counts

ALLOWED_SOURCES = ["expert_static", "provided_static", "train_only_derived", "synthetic"]


def _count(condition):
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def q_matrix_provenance(q: DataFrame) -> DataFrame:
    """PASS if there are rows and the source of every one is allowed."""
    bad = _count(F.col("source").isNull() | ~F.col("source").isin(ALLOWED_SOURCES))
    return q.agg(F.count("*").alias("rows"), bad.alias("bad_rows")).select("rows", "bad_rows", F.when((F.col("rows") > 0) & (F.col("bad_rows") == 0), "PASS").otherwise("FAIL").alias("status"))


def e_co_audit(edges: DataFrame) -> DataFrame:
    """One row: undirected, train-only, support above zero, support quartiles, positive weights, status."""
    # edges are counted by what is asked of them, so they are read once; of weights that is one bit
    kinds = written(edges.groupBy("support_count", "directed", (F.col("source_split") == "train").alias("train"), (F.col("weight") > 0).alias("positive")).agg(F.count("*").alias("c")))
    middle = quantiles(kinds, [], "support_count", {"support_q25": 0.25, "support_median": 0.5, "support_q75": 0.75}, "c")  # one row
    known = F.when(F.col("support_count").isNotNull(), F.col("c"))
    row = kinds.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("edges"), F.coalesce(F.bool_and(~F.col("directed")), F.lit(True)).alias("undirected"),
        F.coalesce(F.bool_and("train"), F.lit(True)).alias("train_only"), F.coalesce(F.bool_and(F.col("support_count") > 0), F.lit(True)).alias("supported"),
        F.min("support_count").alias("support_min"), safe_ratio(F.sum(F.col("support_count") * F.col("c")), F.sum(known)).alias("support_mean"), F.max("support_count").alias("support_max"),
        F.coalesce(F.sum(F.when(F.col("positive"), F.col("c"))), F.lit(0)).alias("positive_weights"),
    ).crossJoin(middle)
    ok = F.col("undirected") & F.col("train_only") & F.col("supported")
    return row.select(
        "edges", "undirected", "train_only", "supported", "support_min", "support_q25", "support_median", "support_mean",
        "support_q75", "support_max", "positive_weights", F.when(ok, "PASS").otherwise("FAIL").alias("status"),
    )


def symmetry_audit(edges: DataFrame) -> DataFrame:
    """One row: edges without their reverse (loops aside), share of train-only edges, edges without support."""
    up = F.col("src") < F.col("dst")
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.bool_and(up).alias("all"), F.bool_or(up).alias("any"))
    missing = pairs.where(F.col("all") == F.col("any")).agg(F.count("*").alias("missing_reverse"))  # pairs that run one way only
    base = edges.agg(F.count("*").alias("edges"), F.avg((F.col("source_split") == "train").cast("double")).alias("train_only_rate"), _count(F.col("support_count").isNull()).alias("unknown_support"))
    ok = (F.col("missing_reverse") == 0) & (F.coalesce("train_only_rate", F.lit(1.0)) == 1.0) & (F.col("unknown_support") == 0)
    return base.crossJoin(missing).select("edges", "missing_reverse", "train_only_rate", "unknown_support", F.when(ok, "PASS").otherwise("FLAG").alias("status"))


def e_co_provenance(edges: DataFrame, train: DataFrame, at_most: int = 100) -> DataFrame:
    """Symmetry, weight statistics and coverage of sparse skills; unknown train-only marks are allowed."""
    w = edges.agg(F.avg("weight").alias("weight_mean"), F.stddev_samp("weight").alias("weight_std"), F.max("weight").alias("weight_max"))
    w = w.crossJoin(quantiles(edges, [], "weight", {"weight_median": 0.5}))  # one row each
    known = edges.agg(F.bool_and(F.col("source_split") == "train").alias("ok"))
    row = symmetry_audit(edges).drop("status").crossJoin(w).crossJoin(sparse_coverage(edges, train, at_most)).crossJoin(known)
    train_only = F.when(F.col("ok").isNull(), "UNKNOWN").when(F.col("ok"), "PASS").otherwise("FAIL")
    status = F.when((F.col("missing_reverse") == 0) & (train_only != "FAIL") & (F.col("edges") > 0), "PASS").otherwise("FAIL")
    return row.select("*", train_only.alias("train_only"), status.alias("status")).drop("ok")


def _check(name: str, count: DataFrame) -> DataFrame:
    """(check_name, violations, status) from a one-row frame with a column n."""
    return count.select(F.lit(name).alias("check_name"), F.col("n").cast("long").alias("violations"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"))


def _skills_outside_train(edges: DataFrame, splits: DataFrame) -> DataFrame:
    train = splits.where("split = 'train'").select(F.col("skill_id").alias("node")).distinct()
    return nodes_of(edges).join(train, "node", "left_anti")


def audit_l1(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Edges not supported by train, and graph skills that only occur in held-out rows."""
    held = splits.where("split <> 'train'").select(F.col("skill_id").alias("node")).distinct()
    outside = _skills_outside_train(edges, splits).join(held, "node", "left_semi").agg(F.count("*").alias("a"))
    wrong = edges.agg(_count(F.coalesce(F.col("source_split") != "train", F.lit(True))).alias("b"))
    return _check("L1", outside.crossJoin(wrong).select((F.col("a") + F.col("b")).alias("n")))


def audit_l2(q: DataFrame) -> DataFrame:
    """Question-skill map: no row, or rows of a source that is not allowed."""
    return _check("L2", q_matrix_provenance(q).select(F.when(F.col("rows") == 0, 1).otherwise(F.col("bad_rows")).alias("n")))


def audit_l3(support: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Support interactions after the train cut-off; ``cutoff`` has one row with ``cutoff``."""
    return _check("L3", support.crossJoin(F.broadcast(cutoff)).agg(_count(F.col("timestamp") > F.col("cutoff")).alias("n")))


def audit_l4(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """Graph skills that train does not have, and learners who stand in train and in a held-out split."""
    outside = _skills_outside_train(edges, splits).agg(F.count("*").alias("a"))
    held = F.max(F.when(F.col("split") != "train", 1).otherwise(0))
    own = F.max(F.when(F.col("split") == "train", 1).otherwise(0))
    both = splits.groupBy("learner_id").agg((held + own).alias("k")).agg(_count(F.col("k") == 2).alias("b"))
    return _check("L4", outside.crossJoin(both).select((F.col("a") + F.col("b")).alias("n")))


def rho_co(e_co: DataFrame, built_from: DataFrame, splits: DataFrame) -> DataFrame:
    """(edges, contaminated, rho_co): the share of edges whose support in ``built_from`` holds a held-out learner."""
    held = splits.groupBy("learner_id").agg(F.max(F.when(F.col("split") != "train", 1).otherwise(0)).alias("held")).where("held = 1").select("learner_id")
    own = written(built_from.join(held, "learner_id", "left_semi").select("learner_id", "skill_id"))
    touched, names, _ = pair_counts(own, "learner_id")  # pairs as numbers, in blocks; the edges are numbered to meet them
    place = lambda end: names.select(F.col("skill_id").alias(end), F.col("i").cast("long").alias(f"__{end}"))
    pairs = e_co.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    numbered = pairs.join(place("src"), "src", "left").join(place("dst"), "dst", "left").select(F.shiftleft("__src", 32).bitwiseOR(F.col("__dst")).alias("pair"))
    joined = numbered.join(touched.select("pair", F.lit(1).alias("hit")), "pair", "left")
    return joined.agg(F.count("*").alias("edges"), F.count("hit").alias("contaminated"), F.coalesce(safe_ratio(F.count("hit"), F.count("*")), F.lit(0.0)).alias("rho_co"))


def audit_l5(e_co: DataFrame, built_from: DataFrame, splits: DataFrame) -> DataFrame:
    return _check("L5", rho_co(e_co, built_from, splits).select(F.col("contaminated").alias("n")))


def audit_l6(runs: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Selections that differ from the best by validation AUC, found anew without test columns."""
    best = runs.groupBy(*keys).agg(F.max_by("variant", F.struct("valid_auc", F.col("order") * -1)).alias("again"))
    joined = selected.select(*keys, F.col("variant").alias("chosen")).join(best, keys, "left")
    return _check("L6", joined.agg(_count(~F.col("chosen").eqNullSafe(F.col("again"))).alias("n")))


def leakage_report(checks: list[DataFrame]) -> DataFrame:
    """Long table of all checks."""
    return reduce(DataFrame.unionByName, checks)


def leakage_summary(report: DataFrame) -> DataFrame:
    """One wide row: status of L1..L6, overall PASS, and hard_fail on L1, L5 or L6."""
    wide = report.groupBy().pivot("check_name", [f"L{i}" for i in range(1, 7)]).agg(F.first("status"))
    failed = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"L{i}") == "FAIL", F.lit(False)) for i in range(1, 7)])
    hard = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == "FAIL", F.lit(False)) for c in ("L1", "L5", "L6")])
    return wide.select("*", F.when(failed, "FAIL").otherwise("PASS").alias("overall"), hard.alias("hard_fail"))


def zero_variance_audit(preds: DataFrame, logs: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: prediction spread, loss course and gradients; FAIL on a spread below 1e-4, a flat loss or zero gradients."""
    from .metrics import prediction_stats

    course = logs.groupBy(*keys).agg(
        F.min_by("train_loss", "epoch").alias("first_loss"), F.max_by("train_loss", "epoch").alias("last_loss"), F.min("valid_loss").alias("best_valid_loss"), F.avg("grad_norm").alias("mean_grad")
    )
    joined = prediction_stats(preds, keys).join(metrics.select(*keys, "auc", "acc", "nll", "rmse"), keys, "left").join(course, keys, "left")
    low = F.col("pred_std") < 1e-4
    flat = F.abs(F.col("first_loss") - F.col("last_loss")) < 1e-9
    still = F.col("mean_grad") == 0
    reasons = F.concat_ws(";", F.when(low, "low_variance"), F.when(flat, "flat_loss"), F.when(still, "zero_gradient"))
    return joined.select("*", reasons.alias("reasons"), F.when(reasons == "", "PASS").otherwise("FAIL").alias("status"))


def zero_variance_summary(audit: DataFrame, keys: list[str]) -> DataFrame:
    return audit.groupBy(*keys).agg(F.count("*").alias("runs"), _count(F.col("status") == "FAIL").alias("failed"), F.avg("auc").alias("mean_auc"))


def training_integrity(logs: DataFrame, stats: DataFrame) -> DataFrame:
    """Per run: no NaN, loss down by 1 % or more, AUC up by .005 or more, predictions not constant; PASS or WARN."""
    course = logs.groupBy("run_id").agg(
        F.bool_and(~F.isnan("train_loss") & F.col("train_loss").isNotNull()).alias("no_nan"), F.min_by("train_loss", "epoch").alias("l0"), F.max_by("train_loss", "epoch").alias("l1"),
        F.min_by("valid_auc", "epoch").alias("a0"), F.max_by("valid_auc", "epoch").alias("a1"),
    )
    joined = course.join(stats.select("run_id", "pred_std"), "run_id", "left")
    fell, rose = F.col("l1") <= F.col("l0") * 0.99, F.col("a1") - F.col("a0") >= 0.005
    varied = F.coalesce(F.col("pred_std") > 0.01, F.lit(False))
    ok = F.col("no_nan") & fell & rose & varied
    return joined.select("run_id", "no_nan", fell.alias("loss_fell"), rose.alias("auc_rose"), varied.alias("non_constant"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("WARN").alias("status"))


def consistency_checks(main: DataFrame, zero: DataFrame, strata: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(check_name, n, violations, status): equal mean AUC in two tables per (model, variant); strata gains without an overall gain.

    ``main(model, variant, mean_auc, delta)``, ``zero(model, variant, mean_auc)``, ``strata(model, variant, stratum, gain)``.
    """
    both = main.alias("a").join(zero.alias("b"), ["model", "variant"]).select(F.abs(F.col("a.mean_auc") - F.col("b.mean_auc")).alias("d"))
    equal = both.agg(F.count("*").alias("n"), _count(F.col("d") > tolerance).alias("v")).select(F.lit("auc_tables_equal").alias("check_name"), "n", F.col("v").alias("violations"), F.lit("WARN").alias("bad"))
    up = strata.groupBy("model", "variant").agg(F.min("gain").alias("least")).join(main, ["model", "variant"])
    odd = up.agg(F.count("*").alias("n"), _count((F.col("least") > 0) & (F.col("delta") <= 0.0005)).alias("v")).select(F.lit("strata_match_overall").alias("check_name"), "n", F.col("v").alias("violations"), F.lit("WARN").alias("bad"))
    status = F.when(F.col("n") == 0, "SKIP").when(F.col("violations") > 0, F.col("bad")).otherwise("PASS")
    return equal.unionByName(odd).select("check_name", "n", "violations", status.alias("status"))


def grid_completeness(grid: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of the grid that are missing."""
    return grid.join(runs.select(*keys).distinct(), keys, "left_anti")


def validate_outputs(edge_audit: DataFrame, report: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(check_name, status): graph limits, hard leakage checks and non-empty tables."""
    named = [edge_audit.agg(F.bool_and("within_limit").alias("ok")).select(F.lit("graph_limits").alias("check_name"), "ok")]
    hard = report.where(F.col("check_name").isin("L1", "L5", "L6"))
    named.append(hard.select(F.col("check_name"), (F.col("status") == "PASS").alias("ok")))
    for name, table in tables.items():
        named.append(table.agg(F.count("*").alias("n")).select(F.lit(f"non_empty_{name}").alias("check_name"), (F.col("n") > 0).alias("ok")))
    return reduce(DataFrame.unionByName, named).select("check_name", F.when(F.coalesce("ok", F.lit(False)), "PASS").otherwise("FAIL").alias("status"))


def phrase_scan(documents: DataFrame, phrases: list[tuple[str, str]], spark: SparkSession | None = None) -> DataFrame:
    """(phrase, action, occurrences, documents, status) over all texts, counted without case and without overlap of a phrase with itself.

    One pass over each text finds all phrases together (Aho-Corasick), so more phrases cost little; a task sends one row
    per phrase that it has seen. Phrases that stand nowhere have a row of zeros. Null texts hold none; an empty phrase
    raises; phrases that differ in case only are counted each.
    """
    spark = spark or documents.sparkSession
    if not all(p for p, _ in phrases):
        raise ValueError("a phrase is empty")
    numbered = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(phrases)], "i int, phrase string, action string")
    lowered = {r["i"]: r["low"] for r in numbered.select("i", F.lower("phrase").alias("low")).collect()}  # a row per given phrase

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, named = ahocorasick.Automaton(), sorted(set(lowered.values()))
        for k, low in enumerate(named):
            finder.add_word(low, (k, len(low)))
        finder.make_automaton()
        occurrences, holding = [0] * len(named), [0] * len(named)
        for batch in batches:
            for text in batch.column(0):
                free: dict[int, int] = {}  # by phrase, the place after its last occurrence
                for end, (k, n) in finder.iter(text.as_py() or ""):
                    if end - n + 1 >= free.get(k, 0):
                        holding[k] += k not in free
                        free[k] = end + 1
                        occurrences[k] += 1
        place = {low: k for k, low in enumerate(named)}
        rows = [(i, occurrences[place[low]], holding[place[low]]) for i, low in lowered.items() if occurrences[place[low]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.int32(), pa.int64(), pa.int64()))], names=["i", "c", "d"])

    found = documents.select(F.lower("text").alias("text")).mapInArrow(scan, "i int, c long, d long") if phrases else spark.createDataFrame([], "i int, c long, d long")
    sums = found.groupBy("i").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    counts = numbered.join(sums, "i", "left").select("phrase", "action", F.coalesce("c", F.lit(0)).alias("occurrences"), F.coalesce("d", F.lit(0)).alias("documents"))
    return counts.withColumn("status", F.when(F.col("occurrences") == 0, "PASS").otherwise(F.col("action")))
