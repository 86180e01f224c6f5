"""Run-table analytics: summaries, validation-only selection, paired tests, labels. Grouped by any keys, never collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import four_places, safe_ratio
from ..functions.stats import normal_two_tailed_p, t_two_tailed_p

PAIR_KEYS = ["dataset", "model", "fold", "seed"]


def run_summary(runs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """n, mean and sample deviation of each column, and 'm ± s' texts."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    rows = runs.groupBy(*keys).agg(*aggs)
    text = {f"{c}_text": F.concat(four_places(F.col(f"{c}_mean")), F.lit(" ± "), four_places(F.coalesce(f"{c}_std", F.lit(0.0)))) for c in columns}
    return rows.withColumns(text)


def latest_run(runs: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def _fold_in_order(runs: DataFrame, keys: list[str], eps: float, start: Column | None = None) -> DataFrame:
    """The order-dependent scan: a candidate replaces the best if its valid AUC is more than eps above; within eps a
    smaller NLL replaces it, and the AUC to beat then stays."""
    step = F.struct("order", "variant", "valid_auc", "valid_nll")
    state = "struct<variant:string,auc:double,nll:double,reason:string>"
    first = start if start is not None else F.lit(None).cast(state)

    def scan(best: Column, c: Column) -> Column:
        taken = lambda auc, reason: F.struct(c["variant"].alias("variant"), auc.alias("auc"), c["valid_nll"].alias("nll"), F.lit(reason).alias("reason"))
        better = best.isNull() | (c["valid_auc"] > best["auc"] + eps)
        tie = (F.abs(c["valid_auc"] - best["auc"]) <= eps) & (c["valid_nll"] < best["nll"])
        return F.when(better, taken(c["valid_auc"], "auc")).when(tie, taken(best["auc"], "nll")).otherwise(best)

    rows = runs.where(F.col("valid_auc").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("s"))
    return rows.select(*keys, F.aggregate("s", first, scan).alias("best"))


def select_epsilon(runs: DataFrame, keys: list[str], eps: float = 0.001) -> DataFrame:
    """(keys, variant, selection_reason) by the order-dependent scan over candidates in ``order``; validation columns only."""
    return _fold_in_order(runs, keys, eps).select(*keys, F.col("best.variant").alias("variant"), F.col("best.reason").alias("selection_reason"))


def select_argmax(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of largest valid AUC, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("valid_auc"), "order")
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def select_with_simplicity(runs: DataFrame, keys: list[str], eps: float = 1e-4, baseline: str = "no_graph") -> DataFrame:
    """(keys, variant, valid_gain, test_delta, is_tautology, tie_break_applied): the scan over candidates in ``order``.

    A candidate of larger valid AUC replaces the best one; one within eps of it does if its ``complexity`` is smaller,
    and its AUC is then the one to beat. A gain over the baseline of eps or less chooses the baseline.
    """
    step = F.struct("order", "variant", "valid_auc", "test_auc", "complexity")
    none = F.lit(None).cast("struct<variant:string,auc:double,test:double,complexity:int>")

    def scan(best: Column, c: Column) -> Column:
        taken = F.struct(c["variant"].alias("variant"), c["valid_auc"].alias("auc"), c["test_auc"].alias("test"), c["complexity"].cast("int").alias("complexity"))
        simpler = (F.abs(c["valid_auc"] - best["auc"]) <= eps) & (c["complexity"] < best["complexity"])
        return F.when(best.isNull() | (c["valid_auc"] > best["auc"]) | simpler, taken).otherwise(best)

    base = F.max(F.when(F.col("variant") == baseline, F.struct("valid_auc", "test_auc"))).alias("base")
    rows = runs.where(F.col("valid_auc").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("s"), base).withColumn("best", F.aggregate("s", none, scan))
    gain = F.col("best.auc") - F.coalesce("base.valid_auc", F.lit(0.0))
    small = (F.col("best.variant") != baseline) & (gain <= eps)
    back = small | (F.col("best.variant") == baseline)
    delta = F.when(back, 0.0).otherwise(F.col("best.test") - F.coalesce("base.test_auc", F.lit(0.0)))
    return rows.select(*keys, F.when(small, baseline).otherwise(F.col("best.variant")).alias("variant"), gain.alias("valid_gain"), delta.alias("test_delta"), back.alias("is_tautology"), small.alias("tie_break_applied"))


def best_graph_vs_no_graph(runs: DataFrame, keys: list[str], baseline: str = "no_graph") -> DataFrame:
    """The best non-baseline by valid AUC (first of equals) and its test gain over the baseline."""
    graph = F.col("variant") != baseline
    rows = runs.groupBy(*keys).agg(
        F.max_by(F.when(graph, F.struct("variant", "test_auc")), F.when(graph, F.struct("valid_auc", F.col("order") * -1))).alias("g"),
        F.max(F.when(~graph, F.col("test_auc"))).alias("baseline_auc"),
    )
    return rows.select(*keys, F.col("g.variant").alias("best_graph"), F.col("g.test_auc").alias("graph_auc"), "baseline_auc", (F.col("g.test_auc") - F.col("baseline_auc")).alias("delta"))


def select_beta(runs: DataFrame, keys: list[str], eps: float = 0.001) -> DataFrame:
    """beta = 0 unless the scan of ``select_epsilon``, begun with it, prefers a larger one; runs hold ``beta``."""
    rows = runs.withColumns({"order": (F.col("beta") * 1000).cast("int"), "variant": F.col("beta").cast("string")})
    return _fold_in_order(rows, keys, eps).select(*keys, F.col("best.variant").cast("double").alias("beta"), F.col("best.reason").alias("selection_reason"))


def gate_name(pre: Column, sim: Column, co: Column) -> Column:
    """Name of the gates that are open."""
    parts = F.concat_ws("+", F.when(pre > 0, "pre"), F.when(sim > 0, "sim"), F.when(co > 0, "co"))
    return F.when(parts == "", "no_graph").when(parts == "pre+sim+co", "full").otherwise(parts)


def relation_gates(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_mean") for c in ("alpha_pre", "alpha_sim", "alpha_co", "beta", "test_auc")],
        F.avg((gate_name(F.col("alpha_pre"), F.col("alpha_sim"), F.col("alpha_co")) == "no_graph").cast("double")).alias("no_graph_share"),
    )


def selection_frequency(selected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variant, n, share, is_mode); of equally frequent variants the smallest name is the mode."""
    counts = selected.groupBy(*keys, "variant").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(F.desc("n"), "variant"))
    return counts.select(*keys, "variant", "n", safe_ratio(F.col("n"), F.sum("n").over(w)).alias("share"), (place == 1).alias("is_mode"))


def selection_pivot(selected: DataFrame, keys: list[str], variants: list[str]) -> DataFrame:
    return selected.groupBy(*keys).pivot("variant", variants).count().na.fill(0)


def paired_deltas(runs: DataFrame, a: str, b: str, value: str = "test_auc", keys: list[str] = PAIR_KEYS) -> DataFrame:
    """(keys, delta): value of variant ``a`` minus that of ``b`` in the same run."""
    side = lambda v, name: runs.where(F.col("variant") == v).select(*keys, F.col(value).alias(name))
    return side(a, "va").join(side(b, "vb"), keys).select(*keys, "va", "vb", (F.col("va") - F.col("vb")).alias("delta"))


def best_static(runs: DataFrame, keys: list[str], static: list[str]) -> DataFrame:
    """The static variant of largest mean test AUC: a report, never a selection."""
    means = runs.where(F.col("variant").isin(static)).groupBy(*keys, "variant").agg(F.avg("test_auc").alias("mean_auc"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean_auc"), "variant")
    return means.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def paired_t_test(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """(n, mean, t, p_two, p_greater). Equal deltas: p is 1 if they are zero, else 0 with a null t; one delta: null."""
    rows = deltas.groupBy(*keys).agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd"))
    spread = F.coalesce(F.col("sd"), F.lit(0.0)) > 1e-15
    t = F.when(spread, F.col("mean_delta") / (F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    p = F.when(spread, t_two_tailed_p(t, (F.col("n") - 1).cast("int"))).when(F.col("n") < 2, None).when(F.abs(F.col("mean_delta")) < 1e-15, 1.0).otherwise(0.0)
    one = F.when(F.col("mean_delta") > 0, p / 2).otherwise(1 - p / 2)
    return rows.select(*keys, "n", "mean_delta", t.alias("t"), p.alias("p_two"), one.alias("p_greater"))


def wilcoxon(deltas: DataFrame, keys: list[str], exact_up_to: int = 25) -> DataFrame:
    """(n, w_plus, w_minus, p): signed-rank test, zeros dropped, ties averaged; exact up to a size without ties, else normal.

    The exact distribution is a column of counts grown rank by rank.
    """
    rows = deltas.where("delta <> 0").withColumn("a", F.round(F.abs("delta"), 12))
    w = Window.partitionBy(*keys).orderBy("a")
    ties = Window.partitionBy(*keys, "a")
    ranked = rows.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / F.lit(2.0)).withColumn("tie", F.count("*").over(ties))
    sums = ranked.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n"), F.sum(F.when(F.col("delta") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("delta") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.max("tie").alias("most_tied"),
        F.sum(F.col("tie") * F.col("tie") - 1).cast("double").alias("tied"),
    )
    n, least = F.col("n"), F.least("w_plus", "w_minus")
    size = F.least(n, F.lit(exact_up_to))
    zero = F.transform(F.sequence(F.lit(0), (size * (size + 1) / 2).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    grow = lambda acc, r: F.transform(acc, lambda c, i: c + F.when(i >= r, F.coalesce(F.get(acc, i - r), F.lit(0.0))).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1), size), zero, grow)
    tail = F.aggregate(F.slice(counts, 1, F.floor(least).cast("int") + 1), F.lit(0.0), lambda acc, c: acc + c)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), size.cast("double")))
    variance = (n * (n + 1) * (2 * n + 1)).cast("double") / 24 - F.col("tied") / 48
    z = (least - (n * (n + 1)).cast("double") / 4) / F.sqrt(variance)
    p = F.when((n <= exact_up_to) & (F.col("most_tied") == 1), exact).otherwise(normal_two_tailed_p(z))
    return sums.select(*keys, "n", "w_plus", "w_minus", p.alias("p"))


def bootstrap_ci(deltas: DataFrame, keys: list[str], order: list[str], rounds: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(n, mean, low, high): percentile interval of the mean over resamples chosen by md5, the same in any engine.

    Meant for run tables: rounds x runs rows per key are made and averaged map-side.
    """
    numbered = deltas.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    sizes = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))
    slots = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("b").cast("string"), F.col("slot").cast("string")))
    pick = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("n")).cast("int")
    drawn = slots.withColumn("__i", pick).join(numbered.select(*keys, "__i", "delta"), [*keys, "__i"])
    means = drawn.groupBy(*keys, "n", "mean_delta", "b").agg(F.avg("delta").alias("m"))
    side = (1 - level) / 2
    q = F.percentile("m", F.array(F.lit(side), F.lit(1 - side)))
    return means.groupBy(*keys, "n", "mean_delta").agg(q.alias("q")).select(*keys, "n", "mean_delta", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def cohens_d(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over sample deviation, 0 without spread."""
    sd = F.stddev_samp("delta")
    return deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.coalesce(sd, F.lit(0.0)) > 1e-15, F.avg("delta") / sd).otherwise(0.0).alias("cohens_d"))


def holm(tests: DataFrame, keys: list[str], order: list[str], p: str = "p") -> DataFrame:
    """``tests`` with step-down adjusted p, monotone and at most 1; a null or NaN p counts as 1."""
    clean = F.when(F.col(p).isNull() | F.isnan(p), 1.0).otherwise(F.col(p))
    w = Window.partitionBy(*keys)
    by_p = w.orderBy("__p", *order)
    ranked = tests.withColumn("__p", clean).withColumns({"__r": F.row_number().over(by_p), "__m": F.count("*").over(w)})
    raised = ranked.withColumn("__a", F.least(F.lit(1.0), F.col("__p") * (F.col("__m") - F.col("__r") + 1)))
    return raised.withColumn("p_holm", F.max("__a").over(by_p.rowsBetween(Window.unboundedPreceding, 0))).drop("__p", "__r", "__m", "__a")


def practical_effect(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.001, "negligible").when(size < 0.003, "small").when(size < 0.007, "moderate").otherwise("practically meaningful")


def classify_significance(p: Column, delta: Column, alpha: float = 0.05, least: float = 0.005) -> Column:
    significant, large = p < alpha, delta >= least  # a gain
    return (
        F.when(significant & large, "significant and practical").when(significant, "significant, not practical").when(large, "practical, not significant").otherwise("neither")
    )


def classify_holm(p_holm: Column, delta: Column, tautology: Column, alpha: float = 0.05, least: float = 0.005) -> Column:
    rule = F.when(tautology, "tautology").when((delta >= least) & (p_holm < alpha), "supported gain").when((delta <= -least) & (p_holm < alpha), "supported loss")
    return rule.when(F.abs(delta) < least, "negligible").otherwise("notable, not confirmed")


def classify_role(p_holm: Column, delta: Column, alpha: float = 0.05) -> Column:
    return F.when((p_holm < alpha) & (delta > 0), "confirmatory").when(p_holm < alpha, "not supported").otherwise("diagnostic only")


def _mean_delta(deltas: DataFrame, keys: list[str], name: str) -> DataFrame:
    return deltas.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.avg("delta").alias(name))


def stability_label(reference: DataFrame, new: DataFrame, keys: list[str], near: float = 0.001, min_runs: int = 2) -> DataFrame:
    """Whether the mean delta of two sets of runs keeps its sign."""
    rows = _mean_delta(reference, keys, "reference").join(_mean_delta(new, keys, "new"), keys)
    a, b = F.col("reference"), F.col("new")
    label = (
        F.when((F.col("n_reference") < min_runs) | (F.col("n_new") < min_runs), "insufficient_runs")
        .when((a > near) & (b > near), "stable_positive").when((a < -near) & (b < -near), "stable_negative")
        .when(F.signum(a) != F.signum(b), "sign_changed").otherwise("near_zero_unstable")
    )
    return rows.select(*keys, "reference", "new", label.alias("label"), practical_stability(a, b).alias("practical"))


def practical_stability(reference: Column, new: Column, least: float = 0.005) -> Column:
    return F.when(F.abs(new) < least, "near zero").when(F.signum(reference) != F.signum(new), "sign changed").otherwise("directionally stable")


def sign_preservation(reference: DataFrame, new: DataFrame, keys: list[str], run_keys: list[str]) -> DataFrame:
    """Share of runs whose delta keeps its sign: stable from .75, mixed from .5."""
    both = reference.select(*run_keys, F.col("delta").alias("a")).join(new.select(*run_keys, F.col("delta").alias("b")), run_keys)
    rows = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.signum("a") == F.signum("b")).cast("double")).alias("kept"))
    return rows.withColumn("label", F.when(F.col("kept") >= 0.75, "stable").when(F.col("kept") >= 0.5, "mixed").otherwise("unstable"))


def stratum_gain(strata_runs: DataFrame, keys: list[str], baseline: str = "no_graph") -> DataFrame:
    """Mean AUC per stratum as columns, the sparse mean of those present, and its gain over the baseline."""
    names = ["very_sparse", "sparse", "medium", "frequent"]
    wide = strata_runs.groupBy(*keys, "variant").pivot("stratum", names).agg(F.avg("auc"))
    present = F.col("very_sparse").isNotNull().cast("int") + F.col("sparse").isNotNull().cast("int")
    mean = safe_ratio(F.coalesce("very_sparse", F.lit(0.0)) + F.coalesce("sparse", F.lit(0.0)), present)
    wide = wide.withColumn("sparse_mean", mean)
    base = wide.where(F.col("variant") == baseline).select(*keys, F.col("sparse_mean").alias("base"))
    return wide.join(base, keys, "left").select(*keys, "variant", *names, "sparse_mean", (F.col("sparse_mean") - F.col("base")).alias("sparse_gain"))


def sparse_bin_reliability(preds: DataFrame, bins: DataFrame, a: str, b: str) -> DataFrame:
    """Per size bin: skills, test rows, AUC of two variants, their difference and a reliability flag."""
    from .metrics import auc, reliability_flag

    placed = preds.join(bins.select("skill_id", "bin"), "skill_id")
    sizes = placed.where(F.col("variant") == a).groupBy("bin").agg(F.countDistinct("skill_id").alias("n_skills"), F.count("*").alias("n_test"))
    values = auc(placed.where(F.col("variant").isin(a, b)), ["bin", "variant"])
    wide = values.groupBy("bin").agg(F.max(F.when(F.col("variant") == a, F.col("auc"))).alias("auc_a"), F.max(F.when(F.col("variant") == b, F.col("auc"))).alias("auc_b"))
    return sizes.join(wide, "bin").select("bin", "n_skills", "n_test", "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("delta"), reliability_flag(F.col("n_test")).alias("reliability"))


def no_pre_sensitivity(runs: DataFrame, keys: list[str], baseline: str = "no_graph", least: float = 0.005) -> DataFrame:
    """The best candidate without the prerequisite relation against the baseline; survives if its test gain is ``least`` or more."""
    allowed = runs.where((F.col("alpha_pre") == 0) & (F.col("variant") != baseline))
    best = select_argmax(allowed, keys).select(*keys, F.col("variant").alias("best_no_pre"), F.col("test_auc").alias("auc"))
    base = runs.where(F.col("variant") == baseline).select(*keys, F.col("test_auc").alias("base"))
    rows = best.join(base, keys).withColumn("delta", F.col("auc") - F.col("base"))
    return rows.select(*keys, "best_no_pre", "delta", (F.col("delta") >= least).alias("survives"))


def early_stop_epoch(logs: DataFrame, keys: list[str], patience: int = 3, min_delta: float = 0.0) -> DataFrame:
    """(keys, best_epoch, stop_epoch): a scan of epochs in order that ends after ``patience`` epochs without a gain."""
    start = F.lit(None).cast("struct<best:double,best_epoch:int,stop:int,done:boolean>")

    def scan(s: Column, e: Column) -> Column:
        new = lambda best, at, done: F.struct(best.alias("best"), at.alias("best_epoch"), e["epoch"].alias("stop"), done.alias("done"))
        gain = s.isNull() | (e["valid_auc"] > s["best"] + min_delta)
        over = (e["epoch"] - s["best_epoch"]) >= patience
        return F.when(s["done"], s).when(gain, new(e["valid_auc"], e["epoch"], F.lit(False))).otherwise(new(s["best"], s["best_epoch"], F.coalesce(over, F.lit(False))))

    rows = logs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch", "valid_auc"))).alias("s")).select(*keys, F.aggregate("s", start, scan).alias("r"))
    return rows.select(*keys, F.col("r.best_epoch").alias("best_epoch"), F.col("r.stop").alias("stop_epoch"), F.col("r.best").alias("best_auc"))


def neural_vs_proxy(runs: DataFrame, proxies: list[str]) -> DataFrame:
    """Mean test AUC per dataset and variant, neural backbones apart from the proxies."""
    kind = F.when(F.col("model").isin(proxies), "proxy").otherwise("neural")
    return runs.groupBy("dataset", "variant", kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("test_auc").alias("mean_auc"))


def noise_slope(results: DataFrame, keys: list[str]) -> DataFrame:
    """AUC at the full noise rate minus AUC without noise."""
    at = lambda r: F.max(F.when(F.col("rate") == r, F.col("auc")))
    return results.groupBy(*keys).agg((at(1.0) - at(0.0)).alias("slope"))


def split_strategy_comparison(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy("strategy", *keys).agg(F.count("*").alias("n"), F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"))


def diagnostic_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, available) of each result table."""
    rows = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", (F.col("n_rows") > 0).alias("available")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def _shown(df: DataFrame, name: str) -> Column:
    """A column as text; fractions have six decimals."""
    text = F.col(name).cast("string")
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.coalesce(F.round(F.col(name), 6).try_cast("decimal(38,6)").cast("string"), text)
    return text


def report_rows(tables: dict[str, tuple[DataFrame, list[str]]], n: int = 20) -> DataFrame:
    """(table_name, row, column_name, value): the first ``n`` rows of each table in its order, one row per value, as text.

    Each task keeps n rows of its own; the order must name ties apart. Nulls stay null, an empty table has no rows.
    """
    shown = []
    for name, (df, order) in tables.items():
        first = df.orderBy(*order).limit(n).withColumn("__row", F.row_number().over(Window.orderBy(*order)))  # n rows
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), _shown(df, c).alias("value")) for c in df.columns])
        shown.append(first.select(F.lit(name).alias("table_name"), F.col("__row").alias("row"), F.explode(cells).alias("c")).select("table_name", "row", "c.column_name", "c.value"))
    return reduce(DataFrame.unionByName, shown)
