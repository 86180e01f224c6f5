"""Queries of metrics and run analytics (H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._session import materialize
from ..operators import metrics, profile, runs
from .fixtures import ACC_SQL, NLL_SQL, RMSE_SQL, RUN_SQL, Views, auc_sql, four_places_sql, query

_K = Views.RUN
_G = ["dataset", "fold", "seed", "model"]
_GS = "dataset, fold, seed, model"


@query("h1_auc", f"SELECT * FROM {auc_sql('tp', RUN_SQL)}", "tp", digits=("auc",))
def _(v: Views):
    return metrics.auc(v.test_preds, _K)


@query("h2_accuracy", f"SELECT {RUN_SQL}, {ACC_SQL} AS acc FROM tp GROUP BY {RUN_SQL}", "tp", digits=("acc",))
def _(v: Views):
    return metrics.accuracy(v.test_preds, _K)


@query("h3_nll", f"SELECT {RUN_SQL}, {NLL_SQL} AS nll FROM tp GROUP BY {RUN_SQL}", "tp", digits=("nll",))
def _(v: Views):
    return metrics.nll(v.test_preds, _K)


@query("h4_rmse", f"SELECT {RUN_SQL}, {RMSE_SQL} AS rmse FROM tp GROUP BY {RUN_SQL}", "tp", digits=("rmse",))
def _(v: Views):
    return metrics.rmse(v.test_preds, _K)


@query("h5_brier", f"SELECT {RUN_SQL}, avg((y_pred - y_true) * (y_pred - y_true)) AS brier FROM tp GROUP BY {RUN_SQL}", "tp", digits=("brier",))
def _(v: Views):
    return metrics.brier(v.test_preds, _K)


_REL = f"SELECT {RUN_SQL}, least(floor(y_pred * 10), 9)::INTEGER AS bin, count(*) AS n, avg(y_true) AS accuracy, avg(y_pred) AS confidence FROM tp GROUP BY {RUN_SQL}, bin"


@query("h6_reliability_table", _REL, "tp", digits=("accuracy", "confidence"))
def _(v: Views):
    return metrics.reliability_table(v.test_preds, _K)


@query("h6_ece", f"SELECT {RUN_SQL}, sum(n * abs(accuracy - confidence)) / sum(n) AS ece FROM ({_REL}) GROUP BY {RUN_SQL}", "tp", digits=("ece",))
def _(v: Views):
    return metrics.ece(v.test_preds, _K)


@query("h7_prediction_stats", f"SELECT {RUN_SQL}, count(*) AS n, avg(y_pred) AS pred_mean, stddev_pop(y_pred) AS pred_std, min(y_pred) AS pred_min, max(y_pred) AS pred_max, avg(y_true) AS positive_rate FROM tp GROUP BY {RUN_SQL}", "tp", digits=("pred_mean", "pred_std", "pred_min", "pred_max", "positive_rate"))
def _(v: Views):
    return metrics.prediction_stats(v.test_preds, _K)


_SM = f"""SELECT variant, stratum, coalesce(n, 0) AS n, auc, acc, nll, rmse FROM (SELECT DISTINCT variant FROM tp) CROSS JOIN (SELECT DISTINCT stratum FROM strata)
LEFT JOIN (SELECT variant, stratum, count(*) AS n, {ACC_SQL} AS acc, {NLL_SQL} AS nll, {RMSE_SQL} AS rmse FROM tp JOIN strata USING (skill_id) GROUP BY 1, 2) USING (variant, stratum)
LEFT JOIN {auc_sql('(SELECT * FROM tp JOIN strata USING (skill_id))', 'variant, stratum')} USING (variant, stratum)"""


@query("h8_stratified_metrics", _SM, "tp", "strata", digits=("auc", "acc", "nll", "rmse"))
def _(v: Views):
    return metrics.stratified_metrics(v.test_preds, materialize(v.strata), ["variant"])


@query("h9_reliability_flag", "SELECT skill_id, count(*) AS n, CASE WHEN count(*) >= 1000 THEN 'Reliable' WHEN count(*) >= 100 THEN 'Limited' ELSE 'Insufficient' END AS flag FROM test GROUP BY 1", "test")
def _(v: Views):
    return v.test.groupBy("skill_id").agg(F.count("*").alias("n")).withColumn("flag", metrics.reliability_flag(F.col("n")))


@query(
    "i1_run_summary",
    f"SELECT *, {four_places_sql('test_auc_mean')} || ' ± ' || {four_places_sql('test_auc_std')} AS test_auc_text FROM (SELECT model, variant, count(*) AS n, avg(test_auc) AS test_auc_mean, stddev_samp(test_auc) AS test_auc_std FROM runs GROUP BY 1, 2)",
    "runs", digits=("test_auc_mean", "test_auc_std"),
)
def _(v: Views):
    return runs.run_summary(v.runs, ["model", "variant"], ["test_auc"])


@query("i2_latest_run", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(v: Views):
    return runs.latest_run(v.table("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


def _fold_sql(eps: float, keys: str = _GS, rows: str = "runs", variant: str = "variant") -> str:
    """The order-dependent scan as a recursive walk over numbered candidates."""
    return f"""WITH RECURSIVE c AS (SELECT {keys}, {variant} AS variant, valid_auc, valid_nll, row_number() OVER (PARTITION BY {keys} ORDER BY "order") AS k FROM {rows} WHERE valid_auc IS NOT NULL),
w AS (SELECT {keys}, k, variant, valid_auc AS auc, valid_nll AS nll, 'auc' AS reason FROM c WHERE k = 1 UNION ALL
SELECT {", ".join("c." + x.strip() for x in keys.split(","))}, c.k, CASE WHEN c.valid_auc > w.auc + {eps}::DOUBLE OR (abs(c.valid_auc - w.auc) <= {eps}::DOUBLE AND c.valid_nll < w.nll) THEN c.variant ELSE w.variant END,
CASE WHEN c.valid_auc > w.auc + {eps}::DOUBLE THEN c.valid_auc ELSE w.auc END, CASE WHEN c.valid_auc > w.auc + {eps}::DOUBLE OR (abs(c.valid_auc - w.auc) <= {eps}::DOUBLE AND c.valid_nll < w.nll) THEN c.valid_nll ELSE w.nll END,
CASE WHEN c.valid_auc > w.auc + {eps}::DOUBLE THEN 'auc' WHEN abs(c.valid_auc - w.auc) <= {eps}::DOUBLE AND c.valid_nll < w.nll THEN 'nll' ELSE w.reason END
FROM w JOIN c ON {" AND ".join(f"w.{x.strip()} = c.{x.strip()}" for x in keys.split(","))} AND c.k = w.k + 1)"""


@query("i3_select_epsilon", f"{_fold_sql(0.001)} SELECT {_GS}, arg_max(variant, k) AS variant, arg_max(reason, k) AS selection_reason FROM w GROUP BY {_GS}", "runs")
def _(v: Views):
    return runs.select_epsilon(v.runs, _G)


_ARGMAX = f'(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_GS} ORDER BY valid_auc DESC, "order") AS r FROM runs{{where}}) WHERE r = 1)'


@query("i4_select_argmax", f"SELECT {_GS}, variant, valid_auc, test_auc FROM {_ARGMAX.format(where='')}", "runs")
def _(v: Views):
    return runs.select_argmax(v.runs, _G).select(*_G, "variant", "valid_auc", "test_auc")


def _simple(eps: float) -> str:
    """The scan that prefers simpler candidates as a recursive walk over numbered candidates."""
    take = f"c.valid_auc > w.auc OR (abs(c.valid_auc - w.auc) <= {eps}::DOUBLE AND c.complexity < w.complexity)"
    either = lambda new, old: f"CASE WHEN {take} THEN c.{new} ELSE w.{old} END"
    return f"""WITH RECURSIVE c AS (SELECT {_GS}, variant, valid_auc, test_auc, complexity, row_number() OVER (PARTITION BY {_GS} ORDER BY "order") AS k FROM runs WHERE valid_auc IS NOT NULL),
w AS (SELECT {_GS}, k, variant, valid_auc AS auc, test_auc AS test, complexity FROM c WHERE k = 1 UNION ALL
SELECT {", ".join("c." + x.strip() for x in _GS.split(","))}, c.k, {either("variant", "variant")}, {either("valid_auc", "auc")}, {either("test_auc", "test")}, {either("complexity", "complexity")}
FROM w JOIN c ON {" AND ".join(f"w.{x.strip()} = c.{x.strip()}" for x in _GS.split(","))} AND c.k = w.k + 1),
e AS (SELECT {_GS}, arg_max(variant, k) AS chosen, arg_max(auc, k) AS auc, arg_max(test, k) AS test FROM w GROUP BY {_GS}),
b AS (SELECT {_GS}, valid_auc AS b_auc, test_auc AS b_test FROM runs WHERE variant = 'no_graph')
SELECT {_GS}, CASE WHEN auc - b_auc <= {eps}::DOUBLE THEN 'no_graph' ELSE chosen END AS variant, auc - b_auc AS valid_gain, CASE WHEN chosen = 'no_graph' OR auc - b_auc <= {eps}::DOUBLE THEN 0 ELSE test - b_test END AS test_delta,
chosen = 'no_graph' OR auc - b_auc <= {eps}::DOUBLE AS is_tautology, chosen <> 'no_graph' AND auc - b_auc <= {eps}::DOUBLE AS tie_break_applied FROM e JOIN b USING ({_GS})"""


@query("i5_select_with_simplicity", _simple(0.002), "runs", digits=("valid_gain", "test_delta"))
def _(v: Views):
    return runs.select_with_simplicity(v.runs, _G, eps=0.002)


@query(
    "i6_best_graph_vs_no_graph",
    f"""SELECT {_GS}, a.variant AS best_graph, a.test_auc AS graph_auc, b.test_auc AS baseline_auc, a.test_auc - b.test_auc AS delta FROM {_ARGMAX.format(where=" WHERE variant <> 'no_graph'")} a JOIN (SELECT * FROM runs WHERE variant = 'no_graph') b USING ({_GS})""",
    "runs", digits=("delta",),
)
def _(v: Views):
    return runs.best_graph_vs_no_graph(v.runs, _G)


_BETA_ROWS = "br AS (SELECT dataset, fold, seed, model, round(\"order\" * 0.25::DOUBLE, 2) AS beta, round(\"order\" * 0.25::DOUBLE, 2) AS variant, \"order\", valid_auc, valid_nll FROM runs)"


@query(
    "i7_select_beta",
    _fold_sql(0.001, rows="br", variant="beta").replace("WITH RECURSIVE c AS", f"WITH RECURSIVE {_BETA_ROWS}, c AS") + f" SELECT {_GS}, arg_max(variant, k) AS beta, arg_max(reason, k) AS selection_reason FROM w GROUP BY {_GS}", "runs",
)
def _(v: Views):
    rows = v.runs.withColumn("beta", F.round(F.col("order") * 0.25, 2))
    return runs.select_beta(rows, _G)


@query(
    "i8_relation_gates",
    "SELECT model, variant, count(*) AS n, avg(alpha_pre) AS alpha_pre_mean, avg(alpha_sim) AS alpha_sim_mean, avg(alpha_co) AS alpha_co_mean, avg(beta) AS beta_mean, avg(test_auc) AS test_auc_mean, CASE WHEN variant = 'no_graph' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS no_graph_share FROM runs GROUP BY 1, 2",
    "runs", digits=("alpha_pre_mean", "alpha_sim_mean", "alpha_co_mean", "beta_mean", "test_auc_mean", "no_graph_share"),
)
def _(v: Views):
    return runs.relation_gates(v.runs, ["model", "variant"])


@query(
    "i9_selection_frequency",
    f"SELECT dataset, model, variant, n, n::DOUBLE / sum(n) OVER (PARTITION BY dataset, model) AS share, row_number() OVER (PARTITION BY dataset, model ORDER BY n DESC, variant) = 1 AS is_mode FROM (SELECT dataset, model, variant, count(*) AS n FROM {_ARGMAX.format(where='')} GROUP BY 1, 2, 3)", "runs", digits=("share",),
)
def _(v: Views):
    return runs.selection_frequency(materialize(runs.select_argmax(v.runs, _G)), ["dataset", "model"])


@query("i9_selection_pivot", "SELECT model, " + ", ".join(f"count(*) FILTER (variant = '{x}') AS {x}" for x in ("no_graph", "pre", "sim", "co", "full")) + f" FROM {_ARGMAX.format(where='')} GROUP BY 1", "runs")
def _(v: Views):
    return runs.selection_pivot(runs.select_argmax(v.runs, _G), ["model"], ["no_graph", "pre", "sim", "co", "full"])


_DELTAS = "(SELECT dataset, model, fold, seed, a.test_auc AS va, b.test_auc AS vb, round(a.test_auc - b.test_auc, 6) AS delta, a.variant FROM (SELECT * FROM runs WHERE variant <> 'no_graph') a JOIN (SELECT * FROM runs WHERE variant = 'no_graph') b USING (dataset, model, fold, seed))"


def _deltas(v: Views):
    """Deltas of every graph variant against no_graph, by variant."""
    rows = materialize(v.runs)
    parts = [runs.paired_deltas(rows, name, "no_graph").withColumn("variant", F.lit(name)) for name in ("pre", "sim", "co", "full")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("delta", F.round("delta", 6))


@query("i10_paired_deltas", f"SELECT dataset, model, fold, seed, va, vb, delta, variant FROM {_DELTAS}", "runs", digits=("delta",))
def _(v: Views):
    return _deltas(v)


@query("i11_best_static", "SELECT dataset, model, variant, mean_auc FROM (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY mean_auc DESC, variant) AS r FROM (SELECT dataset, model, variant, avg(test_auc) AS mean_auc FROM runs WHERE variant IN ('pre', 'sim', 'co') GROUP BY 1, 2, 3)) WHERE r = 1", "runs", digits=("mean_auc",))
def _(v: Views):
    return runs.best_static(v.runs, ["dataset", "model"], ["pre", "sim", "co"])


# two-tailed p at 5 degrees of freedom (six runs): theta = atan(|t|/sqrt(5)), A = 2/pi (theta + sin cos (1 + 2/3 cos^2))
_T = """(SELECT variant, n, m AS mean_delta, t, 1 - 2 / pi() * (th + sin(th) * cos(th) * (1 + 2.0::DOUBLE / 3 * cos(th) * cos(th))) AS p_two FROM (SELECT *, atan(abs(t) / sqrt(5.0::DOUBLE)) AS th FROM (
SELECT variant, count(*) AS n, avg(delta) AS m, avg(delta) / (stddev_samp(delta) / sqrt(count(*)::DOUBLE)) AS t FROM """ + _DELTAS + " GROUP BY 1)))"


@query("i12_paired_t_test", f"SELECT variant, n, mean_delta, t, p_two, CASE WHEN mean_delta > 0 THEN p_two / 2 ELSE 1 - p_two / 2 END AS p_greater FROM {_T}", "runs", digits={"mean_delta": 6, "t": 5, "p_two": 6, "p_greater": 6})
def _(v: Views):
    return runs.paired_t_test(_deltas(v), ["variant"])


_RANKS = f"(SELECT variant, delta, rank() OVER (PARTITION BY variant ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY variant, abs(delta)) - 1) / 2.0::DOUBLE AS rk FROM {_DELTAS} WHERE delta <> 0)"


@query("i13_wilcoxon_ranks", f"SELECT variant, count(*)::INTEGER AS n, coalesce(sum(rk) FILTER (delta > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (delta < 0), 0) AS w_minus FROM {_RANKS} GROUP BY 1", "runs", digits=("w_plus", "w_minus"))
def _(v: Views):
    return runs.wilcoxon(_deltas(v), ["variant"]).drop("p")


# the exact p by going through all 2^n assignments of signs to the ranks 1..n; with ties the normal approximation,
# whose erfc is the Chebyshev fit that functions/stats.py names
_ERFC_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_ERFC = " + ".join(f"({c}::DOUBLE) * u ** {i}" for i, c in enumerate(_ERFC_FIT))


@query(
    "i13_wilcoxon",
    f"""WITH rk AS {_RANKS}, w AS (SELECT variant, count(*)::INTEGER AS n, coalesce(sum(rk) FILTER (delta > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (delta < 0), 0) AS w_minus,
count(DISTINCT rk) = count(*) AS untied FROM rk GROUP BY 1), t AS (SELECT variant, sum(c * c * c - c) AS tied FROM (SELECT variant, rk, count(*) AS c FROM rk GROUP BY 1, 2) GROUP BY 1),
sg AS (SELECT variant, n, w_plus, w_minus, s, coalesce(sum(r) FILTER ((s >> (r - 1)) & 1 = 1), 0) AS total FROM w, (SELECT unnest(range(0, 64)) AS s), (SELECT unnest(range(1, 7)) AS r) WHERE s < (1 << n) AND r <= n GROUP BY 1, 2, 3, 4, 5),
ex AS (SELECT variant, least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (total <= least(w_plus, w_minus)) / count(*)) AS p FROM sg GROUP BY 1),
nm AS (SELECT variant, x, 1 / (1 + 0.5::DOUBLE * x) AS u FROM (SELECT variant, abs((least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tied / 48.0::DOUBLE)) / sqrt(2.0::DOUBLE) AS x FROM w JOIN t USING (variant)))
SELECT variant, n, w_plus, w_minus, CASE WHEN untied THEN p ELSE u * exp(-x * x + {_ERFC}) END AS p FROM w JOIN ex USING (variant) JOIN nm USING (variant)""",
    "runs", digits=("w_plus", "w_minus", "p"),
)
def _(v: Views):
    return runs.wilcoxon(_deltas(v), ["variant"])


@query(
    "i14_bootstrap_ci",
    f"""WITH d AS (SELECT variant, delta, row_number() OVER (PARTITION BY variant ORDER BY fold, seed) - 1 AS i, count(*) OVER (PARTITION BY variant) AS n FROM {_DELTAS}),
s AS (SELECT v.variant, n, b, ('0x' || substr(md5(concat_ws('|', '42', v.variant, b, slot)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT variant, n FROM d) v, (SELECT unnest(range(0, 10000)) AS b), (SELECT unnest(range(0, (SELECT max(n) FROM d))) AS slot) WHERE slot < n),
m AS (SELECT s.variant, s.n, b, avg(delta) AS m FROM s JOIN d ON s.variant = d.variant AND s.i = d.i GROUP BY 1, 2, 3)
SELECT variant, n, mean_delta, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m JOIN (SELECT variant, avg(delta) AS mean_delta FROM d GROUP BY 1) USING (variant) GROUP BY 1, 2, 3""",
    "runs", digits=("mean_delta", "ci_low", "ci_high"),
)
def _(v: Views):
    return runs.bootstrap_ci(materialize(_deltas(v)), ["variant"], ["fold", "seed"])


@query("i15_cohens_d", f"SELECT variant, count(*) AS n, coalesce(avg(delta) / nullif(stddev_samp(delta), 0), 0) AS cohens_d FROM {_DELTAS} GROUP BY 1", "runs", digits={"cohens_d": 5})
def _(v: Views):
    return runs.cohens_d(_deltas(v), ["variant"])


_HOLM = f"(SELECT variant, mean_delta, p_two, max(least(1.0::DOUBLE, p_two * (m - r + 1))) OVER (ORDER BY p_two, variant) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p_two, variant) AS r, count(*) OVER () AS m FROM {_T}))"


def _tests(v: Views):
    return runs.holm(runs.paired_t_test(_deltas(v), ["variant"]).withColumn("family", F.lit("all")), ["family"], ["variant"], "p_two")


@query("i16_holm", f"SELECT variant, p_two, p_holm FROM {_HOLM}", "runs", digits=("p_two", "p_holm"))
def _(v: Views):
    return _tests(v).select("variant", "p_two", "p_holm")


@query("i17_practical_effect", f"SELECT variant, fold, seed, CASE WHEN abs(delta) < 0.001::DOUBLE THEN 'negligible' WHEN abs(delta) < 0.003::DOUBLE THEN 'small' WHEN abs(delta) < 0.007::DOUBLE THEN 'moderate' ELSE 'practically meaningful' END AS effect FROM {_DELTAS}", "runs")
def _(v: Views):
    return _deltas(v).select("variant", "fold", "seed", runs.practical_effect(F.col("delta")).alias("effect"))


@query(
    "i18_classify_result",
    f"""SELECT variant, CASE WHEN p_two < 0.05 AND mean_delta >= 0.005 THEN 'significant and practical' WHEN p_two < 0.05 THEN 'significant, not practical' WHEN mean_delta >= 0.005 THEN 'practical, not significant' ELSE 'neither' END AS by_size,
CASE WHEN mean_delta >= 0.005 AND p_holm < 0.05 THEN 'supported gain' WHEN mean_delta <= -0.005 AND p_holm < 0.05 THEN 'supported loss' WHEN abs(mean_delta) < 0.005 THEN 'negligible' ELSE 'notable, not confirmed' END AS by_holm,
CASE WHEN p_holm < 0.05 AND mean_delta > 0 THEN 'confirmatory' WHEN p_holm < 0.05 THEN 'not supported' ELSE 'diagnostic only' END AS by_role FROM {_HOLM}""", "runs",
)
def _(v: Views):
    t = _tests(v)
    p, d = F.col("p_holm"), F.col("mean_delta")
    return t.select("variant", runs.classify_significance(F.col("p_two"), d).alias("by_size"), runs.classify_holm(p, d, F.lit(False)).alias("by_holm"), runs.classify_role(p, d).alias("by_role"))


_HALVES = f"(SELECT variant, avg(delta) FILTER (fold = 0) AS reference, avg(delta) FILTER (fold = 1) AS new, count(*) FILTER (fold = 0) AS n0, count(*) FILTER (fold = 1) AS n1 FROM {_DELTAS} GROUP BY 1)"


@query(
    "i19_stability_label",
    f"""SELECT variant, reference, new, CASE WHEN n0 < 2 OR n1 < 2 THEN 'insufficient_runs' WHEN reference > 0.001 AND new > 0.001 THEN 'stable_positive' WHEN reference < -0.001 AND new < -0.001 THEN 'stable_negative' WHEN sign(reference) <> sign(new) THEN 'sign_changed' ELSE 'near_zero_unstable' END AS label,
CASE WHEN abs(new) < 0.005 THEN 'near zero' WHEN sign(reference) <> sign(new) THEN 'sign changed' ELSE 'directionally stable' END AS practical FROM {_HALVES}""",
    "runs", digits=("reference", "new"),
)
def _(v: Views):
    d = materialize(_deltas(v))
    return runs.stability_label(d.where("fold = 0"), d.where("fold = 1"), ["variant"])


@query(
    "i20_sign_preservation",
    f"""SELECT variant, n, kept, CASE WHEN kept >= 0.75 THEN 'stable' WHEN kept >= 0.5 THEN 'mixed' ELSE 'unstable' END AS label FROM (SELECT a.variant, count(*) AS n, avg((sign(a.delta) = sign(b.delta))::INTEGER) AS kept
FROM (SELECT * FROM {_DELTAS} WHERE fold = 0) a JOIN (SELECT * FROM {_DELTAS} WHERE fold = 1) b ON a.variant = b.variant AND a.seed = b.seed GROUP BY 1)""", "runs", digits=("kept",),
)
def _(v: Views):
    d = materialize(_deltas(v))
    return runs.sign_preservation(d.where("fold = 0"), d.where("fold = 1"), ["variant"], ["variant", "seed"])


_SR = f"(SELECT model, variant, seed, stratum, round(auc, 6) AS auc FROM {auc_sql('(SELECT * FROM tp JOIN strata USING (skill_id))', 'model, variant, seed, stratum')})"


@query(
    "i21_stratum_gain",
    f"""WITH w AS (SELECT model, variant, {", ".join(f"avg(auc) FILTER (stratum = '{s}') AS {s}" for s in ("very_sparse", "sparse", "medium", "frequent"))} FROM {_SR} GROUP BY 1, 2),
x AS (SELECT *, (coalesce(very_sparse, 0) + coalesce(sparse, 0)) / nullif((very_sparse IS NOT NULL)::INTEGER + (sparse IS NOT NULL)::INTEGER, 0) AS sparse_mean FROM w)
SELECT x.*, x.sparse_mean - b.sparse_mean AS sparse_gain FROM x LEFT JOIN x b ON b.model = x.model AND b.variant = 'no_graph'""",
    "tp", "strata", digits=("very_sparse", "sparse", "medium", "frequent", "sparse_mean", "sparse_gain"),
)
def _(v: Views):
    placed = v.test_preds.join(v.strata.select("skill_id", "stratum"), "skill_id")
    rows = metrics.auc(placed, ["model", "variant", "seed", "stratum"]).withColumn("auc", F.round("auc", 6))
    return runs.stratum_gain(materialize(rows), ["model"])


_BINS = "(SELECT skill_id, CASE WHEN n <= 50 THEN 'le50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' ELSE 'gt500' END AS bin FROM fq)"
_BA = auc_sql(f"(SELECT * FROM tp JOIN {_BINS} USING (skill_id))", "bin, variant")


@query(
    "i22_sparse_bin_reliability",
    f"""SELECT bin, n_skills, n_test, a.auc AS auc_a, b.auc AS auc_b, a.auc - b.auc AS delta, CASE WHEN n_test >= 1000 THEN 'Reliable' WHEN n_test >= 100 THEN 'Limited' ELSE 'Insufficient' END AS reliability FROM (
SELECT bin, count(DISTINCT skill_id) AS n_skills, count(*) AS n_test FROM tp JOIN {_BINS} USING (skill_id) WHERE variant = 'full' GROUP BY 1) JOIN (SELECT * FROM {_BA} WHERE variant = 'full') a USING (bin) JOIN (SELECT * FROM {_BA} WHERE variant = 'no_graph') b USING (bin)""",
    "tp", "fq", digits=("auc_a", "auc_b", "delta"),
)
def _(v: Views):
    return runs.sparse_bin_reliability(materialize(v.test_preds), profile.frequency_bins(v.train), "full", "no_graph")


@query(
    "i23_no_pre_sensitivity",
    f"""SELECT {_GS}, a.variant AS best_no_pre, a.test_auc - b.test_auc AS delta, a.test_auc - b.test_auc >= 0.005::DOUBLE AS survives FROM {_ARGMAX.format(where=" WHERE variant <> 'no_graph' AND alpha_pre = 0")} a JOIN (SELECT * FROM runs WHERE variant = 'no_graph') b USING ({_GS})""",
    "runs", digits=("delta",),
)
def _(v: Views):
    return runs.no_pre_sensitivity(v.runs, _G)


@query(
    "i24_early_stop_epoch",
    """WITH RECURSIVE c AS (SELECT run_id, epoch, valid_auc, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS k FROM logs),
w AS (SELECT run_id, k, valid_auc AS best, epoch AS best_epoch, epoch AS stop, false AS done FROM c WHERE k = 1 UNION ALL
SELECT c.run_id, c.k, CASE WHEN c.valid_auc > w.best THEN c.valid_auc ELSE w.best END, CASE WHEN c.valid_auc > w.best THEN c.epoch ELSE w.best_epoch END, c.epoch, c.valid_auc <= w.best AND c.epoch - w.best_epoch >= 3 FROM w JOIN c ON c.run_id = w.run_id AND c.k = w.k + 1 AND NOT w.done)
SELECT run_id, arg_max(best_epoch, k) AS best_epoch, arg_max(stop, k) AS stop_epoch, arg_max(best, k) AS best_auc FROM w GROUP BY 1""", "logs", digits=("best_auc",),
)
def _(v: Views):
    return runs.early_stop_epoch(v.logs, ["run_id"])


@query("i25_neural_vs_proxy", "SELECT dataset, variant, CASE WHEN seed = 7 THEN 'proxy' ELSE 'neural' END AS kind, count(*) AS n, avg(test_auc) AS mean_auc FROM runs GROUP BY 1, 2, 3", "runs", digits=("mean_auc",))
def _(v: Views):
    return runs.neural_vs_proxy(v.runs.withColumn("model", F.concat(F.lit("m"), "seed")), ["m7"])


_NOISE = """(SELECT fold, rate, auc FROM (SELECT fold, CASE variant WHEN 'no_graph' THEN 0.0::DOUBLE WHEN 'full' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS rate, round(avg(test_auc), 6) AS auc FROM runs GROUP BY 1, 2))"""


@query("i26_noise_slope", f"SELECT fold, max(auc) FILTER (rate = 1) - max(auc) FILTER (rate = 0) AS slope FROM {_NOISE} GROUP BY 1", "runs", digits=("slope",))
def _(v: Views):
    rate = F.when(F.col("variant") == "no_graph", 0.0).when(F.col("variant") == "full", 1.0).otherwise(0.5)
    rows = v.runs.groupBy("fold", rate.alias("rate")).agg(F.round(F.avg("test_auc"), 6).alias("auc"))
    return runs.noise_slope(rows, ["fold"])


@query("i27_split_strategy_comparison", "SELECT CASE WHEN fold = 0 THEN 'learner' ELSE 'temporal' END AS strategy, variant, count(*) AS n, avg(test_auc) AS auc_mean, stddev_samp(test_auc) AS auc_std FROM runs GROUP BY 1, 2", "runs", digits=("auc_mean", "auc_std"))
def _(v: Views):
    rows = v.runs.select(F.when(F.col("fold") == 0, "learner").otherwise("temporal").alias("strategy"), "variant", F.col("test_auc").alias("auc"))
    return runs.split_strategy_comparison(rows, ["variant"])


@query("i28_diagnostic_report", "SELECT 'interactions' AS table_name, count(*) AS n_rows, count(*) > 0 AS available FROM ix UNION ALL SELECT 'similarity', count(*), count(*) > 0 FROM sim UNION ALL SELECT 'runs', count(*), count(*) > 0 FROM runs", "ix", "sim", "runs")
def _(v: Views):
    return runs.diagnostic_report({"interactions": v.ix, "similarity": v.sim, "runs": v.runs})


_SHOWN = {
    "interactions": ("ix", ["interaction_id"], {"interaction_id": "", "learner_id": "", "question_id": "", "skill_id": "", "timestamp": "", "correct": ""}),
    "similarity": ("sim", ["src", "dst"], {"src": "", "dst": "", "weight": "::DECIMAL(38, 6)", "support_count": ""}),
    "runs": ("runs", ["variant", "seed", "fold"], {"variant": "", "seed": "", "fold": "", "valid_auc": "::DECIMAL(38, 6)", "test_auc": "::DECIMAL(38, 6)"}),
}


def _shown_sql(name: str, table: str, order: list[str], columns: dict[str, str]) -> str:
    by = ", ".join(order)
    values = ", ".join(f"{'round(' + c + ', 6)' if cast else c}{cast}::VARCHAR" for c, cast in columns.items())
    return f"SELECT '{name}' AS table_name, row, unnest([{', '.join(repr(c) for c in columns)}]) AS column_name, unnest([{values}]) AS value FROM (SELECT *, row_number() OVER (ORDER BY {by}) AS row FROM {table}) WHERE row <= 20"


@query("i28_report_rows", " UNION ALL ".join(_shown_sql(name, *rest) for name, rest in _SHOWN.items()), "ix", "sim", "runs")
def _(v: Views):
    return runs.report_rows({name: (getattr(v, table).select(*columns), order) for name, (table, order, columns) in _SHOWN.items()})
