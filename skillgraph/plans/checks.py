"""Queries of audits and features (F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._session import materialize, written
from ..functions.ranking import quantiles
from ..operators import audit, features, graph, relations
from .fixtures import ACC_SQL, NLL_SQL, P_SQL, RMSE_SQL, RUN_SQL, Views, auc_sql, query


_BAD_SOURCE = "length(question_id) = 1"


@query("f1_q_matrix_provenance", f"SELECT *, CASE WHEN rows > 0 AND bad_rows = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE {_BAD_SOURCE}) AS bad_rows FROM q)", "q")
def _(v: Views):
    return audit.q_matrix_provenance(v.q.withColumn("source", F.when(F.expr(_BAD_SOURCE), "unverified").otherwise(F.col("source"))))


@query(
    "f2_e_co_audit",
    """SELECT *, CASE WHEN undirected AND train_only AND supported THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS edges, bool_and(support_count % 11 <> 3) AS undirected, bool_and(support_count % 13 <> 5) AS train_only, bool_and(support_count > 0) AS supported, min(support_count) AS support_min, quantile_cont(support_count, 0.25) AS support_q25, median(support_count) AS support_median,
avg(support_count) AS support_mean, quantile_cont(support_count, 0.75) AS support_q75, max(support_count) AS support_max, count(*) FILTER (weight > 0) AS positive_weights FROM co)""",
    "co", digits=("support_q25", "support_median", "support_mean", "support_q75"),
)
def _(v: Views):
    # some edges are marked as directed or as coming from another split
    other = F.when(F.col("support_count") % 13 == 5, "test").otherwise("train")
    return audit.e_co_audit(v.co_once.select("*", (F.col("support_count") % 11 == 3).alias("directed"), other.alias("source_split")))


_ONE_WAY = "(SELECT src, dst, weight, support_count FROM co UNION ALL SELECT dst, src, weight, support_count FROM co WHERE support_count % 5 <> 0)"


def _one_way(v: Views):
    return relations.both_ways(v.co, F.col("support_count") % 5 != 0)


# edges with another split and edges without a support, planted by the support
_MARKED = "SELECT src, dst, weight, CASE WHEN support_count % 11 = 0 THEN 'valid' ELSE 'train' END AS source_split, CASE WHEN support_count % 7 <> 0 THEN support_count END AS support_count"
_MARKS = """count(*) AS edges, avg((source_split = 'train')::INTEGER::DOUBLE) AS train_only_rate, count(*) FILTER (support_count IS NULL) AS unknown_support"""
_UNPAIRED = "(SELECT count(*) FROM mk a ANTI JOIN mk b ON a.src = b.dst AND a.dst = b.src)"


def _marked(edges):
    n = F.col("support_count")
    return edges.withColumn("source_split", F.when(n % 11 == 0, "valid").otherwise("train")).withColumn("support_count", F.when(n % 7 != 0, n))


@query(
    "f3_symmetry_audit",
    f"""WITH mk AS ({_MARKED} FROM {_ONE_WAY}), au AS (SELECT {_MARKS}, {_UNPAIRED} AS missing_reverse FROM mk)
SELECT edges, missing_reverse, train_only_rate, unknown_support, CASE WHEN missing_reverse = 0 AND train_only_rate = 1 AND unknown_support = 0 THEN 'PASS' ELSE 'FLAG' END AS status FROM au""",
    "co", digits=("train_only_rate",),
)
def _(v: Views):
    return audit.symmetry_audit(materialize(_marked(_one_way(v))))


@query(
    "f4_e_co_provenance",
    f"""WITH mk AS ({_MARKED} FROM (SELECT src, dst, weight, support_count FROM co UNION ALL SELECT dst, src, weight, support_count FROM co)), au AS (SELECT {_MARKS}, {_UNPAIRED} AS missing_reverse,
avg(weight) AS weight_mean, stddev_samp(weight) AS weight_std, median(weight) AS weight_median, max(weight) AS weight_max, bool_and(source_split = 'train') AS ok FROM mk),
sk AS (SELECT count(*) AS sparse_skills, count(u) AS covered FROM fq LEFT JOIN (SELECT DISTINCT src AS u FROM mk) ON u = skill_id WHERE n <= 450)
SELECT au.* EXCLUDE (ok), sparse_skills, covered, covered::DOUBLE / sparse_skills AS sparse_coverage, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS train_only, CASE WHEN ok AND missing_reverse = 0 AND edges > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM au, sk""",
    "co", "fq", digits=("train_only_rate", "weight_mean", "weight_std", "weight_median", "weight_max", "sparse_coverage"),
)
def _(v: Views):
    return audit.e_co_provenance(materialize(_marked(relations.both_ways(v.co))), v.links, 450)


_LEAKY_SKILL = "'leak-' || skill_id"


def _planted(v: Views):
    """Splits with skills that only held-out rows have, and edges that touch some of them or come from elsewhere."""
    held = (F.col("split") != "train") & (F.length("learner_id") == 2)
    split = written(v.split.select("learner_id", "split", F.when(held, F.concat(F.lit("leak-"), "skill_id")).otherwise(F.col("skill_id")).alias("skill_id")))
    extra = split.where("skill_id like 'leak-%'").select("skill_id").distinct()
    edges = v.sim.select("src", "dst", F.when(F.col("support_count") % 7 == 0, "test").otherwise("train").alias("source_split"))
    return split, edges.unionByName(extra.select(F.col("skill_id").alias("src"), F.lit("1").alias("dst"), F.lit("train").alias("source_split")))


_PLANTED = "sl AS (SELECT * REPLACE (CASE WHEN split <> 'train' AND length(learner_id) = 2 THEN 'leak-' || skill_id ELSE skill_id END AS skill_id) FROM sp), lk AS (SELECT DISTINCT skill_id FROM sl WHERE skill_id LIKE 'leak-%')"


def _status(name: str, n: str) -> str:
    return f"SELECT '{name}' AS check_name, n::BIGINT AS violations, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT {n} AS n)"


@query("f5_audit_l1", f"WITH {_PLANTED} {_status('L1', '(SELECT count(*) FROM lk) + (SELECT count(*) FROM sim WHERE support_count % 7 = 0)')}", "sp", "sim")
def _(v: Views):
    split, edges = _planted(v)
    return audit.audit_l1(edges, split)


@query("f6_audit_l2", _status("L2", "(SELECT count(*) FROM q WHERE length(question_id) = 1)"), "q")
def _(v: Views):
    return audit.audit_l2(v.q.withColumn("source", F.when(F.length("question_id") == 1, "unverified").otherwise(F.col("source"))))


@query("f7_audit_l3", _status("L3", "(SELECT count(*) FROM train WHERE timestamp > (SELECT quantile_cont(timestamp, 0.9) FROM train))"), "train")
def _(v: Views):
    return audit.audit_l3(v.train, quantiles(v.train, [], "timestamp", {"cutoff": 0.9}))


@query("f8_audit_l4", f"WITH {_PLANTED} {_status('L4', '(SELECT count(*) FROM lk)')}", "sp")
def _(v: Views):
    split, edges = _planted(v)
    return audit.audit_l4(edges, split)


_TOUCHED = "(SELECT DISTINCT a.skill_id AS src, b.skill_id AS dst FROM (SELECT DISTINCT learner_id, skill_id FROM sp WHERE split <> 'train' AND length(learner_id) <= 2) a JOIN (SELECT DISTINCT learner_id, skill_id FROM sp WHERE split <> 'train' AND length(learner_id) <= 2) b ON a.learner_id = b.learner_id AND a.skill_id < b.skill_id)"


@query("f9_rho_co", f"SELECT count(*) AS edges, count(t.src) AS contaminated, count(t.src)::DOUBLE / count(*) AS rho_co FROM co LEFT JOIN {_TOUCHED} t ON co.src = t.src AND co.dst = t.dst", "co", digits=("rho_co",))
def _(v: Views):
    built = v.split.where("split = 'train' or length(learner_id) <= 2")
    return audit.rho_co(v.co, built, v.split)


_CONTAMINATED = f"(SELECT count(*) FROM co JOIN {_TOUCHED} t ON co.src = t.src AND co.dst = t.dst)"


@query("f9_audit_l5", _status("L5", _CONTAMINATED), "co")
def _(v: Views):
    return audit.audit_l5(v.co, v.split.where("split = 'train' or length(learner_id) <= 2"), v.split)


_GROUP = ["dataset", "fold", "seed", "model"]
_BEST = '(SELECT dataset, fold, seed, model, variant FROM (SELECT *, row_number() OVER (PARTITION BY dataset, fold, seed, model ORDER BY {by} DESC, "order") AS r FROM runs) WHERE r = 1)'


@query("f10_audit_l6", _status("L6", f"(SELECT count(*) FROM {_BEST.format(by='test_auc')} a JOIN {_BEST.format(by='valid_auc')} b USING (dataset, fold, seed, model) WHERE a.variant <> b.variant)"), "runs")
def _(v: Views):
    runs = materialize(v.runs)
    chosen = runs.groupBy(*_GROUP).agg(F.max_by("variant", F.struct("test_auc", F.col("order") * -1)).alias("variant"))
    return audit.audit_l6(runs, chosen, _GROUP)


def _report(v: Views):
    """All checks over the planted splits and edges, a map with some unverified sources, and selections by test AUC."""
    split = v.keep().split
    leaky, edges = _planted(v)
    train = split.where("split = 'train'")
    q = v.q.withColumn("source", F.when(F.expr(_BAD_SOURCE), "unverified").otherwise(F.col("source")))
    runs = materialize(v.runs)
    chosen = runs.groupBy(*_GROUP).agg(F.max_by("variant", F.struct("test_auc", F.col("order") * -1)).alias("variant"))
    return audit.leakage_report([
        audit.audit_l1(edges, leaky), audit.audit_l2(q), audit.audit_l3(train, quantiles(train, [], "timestamp", {"cutoff": 0.9})),
        audit.audit_l4(edges, leaky), audit.audit_l5(v.co, split.where("split = 'train' or length(learner_id) <= 2"), split), audit.audit_l6(runs, chosen, _GROUP),
    ])


_VIOLATIONS = {
    "L1": "(SELECT count(*) FROM lk) + (SELECT count(*) FROM sim WHERE support_count % 7 = 0)",
    "L2": f"(SELECT count(*) FROM q WHERE {_BAD_SOURCE})",
    "L3": "(SELECT count(*) FROM train WHERE timestamp > (SELECT quantile_cont(timestamp, 0.9) FROM train))",
    "L4": "(SELECT count(*) FROM lk)",
    "L5": _CONTAMINATED,
    "L6": f"(SELECT count(*) FROM {_BEST.format(by='test_auc')} a JOIN {_BEST.format(by='valid_auc')} b USING (dataset, fold, seed, model) WHERE a.variant <> b.variant)",
}
_REPORT = " UNION ALL ".join(_status(name, n) for name, n in _VIOLATIONS.items())
_REPORT_VIEWS = "q", "sim", "co", "runs"


@query("f11_leakage_report", f"WITH {_PLANTED} {_REPORT}", *_REPORT_VIEWS)
def _(v: Views):
    return _report(v)


_WIDE = ", ".join(f"max(status) FILTER (WHERE check_name = '{c}') AS {c}" for c in _VIOLATIONS)


@query(
    "f11_leakage_summary",
    f"WITH {_PLANTED} SELECT {_WIDE}, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall, bool_or(status = 'FAIL' AND check_name IN ('L1', 'L5', 'L6')) AS hard_fail FROM ({_REPORT})", *_REPORT_VIEWS,
)
def _(v: Views):
    return audit.leakage_summary(_report(v))


_COURSE = "(SELECT variant, arg_min(train_loss, epoch) AS first_loss, arg_max(train_loss, epoch) AS last_loss, min(valid_loss) AS best_valid_loss, avg(grad_norm) AS mean_grad FROM (SELECT CASE substr(run_id, 2, 1) WHEN '1' THEN 'pre' WHEN '2' THEN 'sim' WHEN '3' THEN 'co' ELSE 'full' END AS variant, epoch, round(avg(train_loss), 6) AS train_loss, round(avg(valid_loss), 6) AS valid_loss, round(avg(grad_norm), 6) AS grad_norm FROM logs GROUP BY 1, 2) GROUP BY 1)"


@query(
    "f12_zero_variance_audit",
    f"""SELECT variant, n, pred_mean, pred_std, pred_min, pred_max, positive_rate, auc, acc, nll, rmse, first_loss, last_loss, best_valid_loss, mean_grad, concat_ws(';', CASE WHEN pred_std < 1e-4 THEN 'low_variance' END, CASE WHEN abs(first_loss - last_loss) < 1e-9 THEN 'flat_loss' END, CASE WHEN mean_grad = 0 THEN 'zero_gradient' END) AS reasons,
CASE WHEN pred_std < 1e-4 OR coalesce(abs(first_loss - last_loss) < 1e-9, false) OR coalesce(mean_grad = 0, false) THEN 'FAIL' ELSE 'PASS' END AS status
FROM (SELECT variant, count(*) AS n, avg(y_pred) AS pred_mean, stddev_pop(y_pred) AS pred_std, min(y_pred) AS pred_min, max(y_pred) AS pred_max, avg(y_true) AS positive_rate, {ACC_SQL} AS acc, {NLL_SQL} AS nll, {RMSE_SQL} AS rmse FROM tp GROUP BY 1)
JOIN {auc_sql('tp', 'variant')} USING (variant) LEFT JOIN {_COURSE} USING (variant)""",
    "tp", "logs", digits=("pred_mean", "pred_std", "pred_min", "pred_max", "positive_rate", "auc", "acc", "nll", "rmse", "first_loss", "last_loss", "best_valid_loss", "mean_grad"),
)
def _(v: Views):
    return _zero(v)


def _zero(v: Views):
    from ..operators.metrics import metrics

    preds = materialize(v.test_preds)
    variant = F.when(F.substring("run_id", 2, 1) == "1", "pre").when(F.substring("run_id", 2, 1) == "2", "sim").when(F.substring("run_id", 2, 1) == "3", "co").otherwise("full")
    logs = v.logs.groupBy(variant.alias("variant"), "epoch").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("train_loss", "valid_loss", "grad_norm")])
    return audit.zero_variance_audit(preds, logs, metrics(preds, ["variant"]), ["variant"])


@query("f12_zero_variance_summary", f"SELECT 'all' AS scope, count(*) AS runs, count(*) FILTER (WHERE flat) AS failed, avg(auc) AS mean_auc FROM {auc_sql('tp', 'variant')} JOIN (SELECT variant, stddev_pop(y_pred) < 1e-4::DOUBLE AS flat FROM tp GROUP BY 1) USING (variant)", "tp", digits=("mean_auc",))
def _(v: Views):
    return audit.zero_variance_summary(_zero(v).withColumn("scope", F.lit("all")), ["scope"])


@query(
    "f13_training_integrity",
    """SELECT run_id, true AS no_nan, l1 <= l0 * 0.99::DOUBLE AS loss_fell, a1 - a0 >= 0.005::DOUBLE AS auc_rose, coalesce(sd > 0.01::DOUBLE, false) AS non_constant, CASE WHEN l1 <= l0 * 0.99::DOUBLE AND a1 - a0 >= 0.005::DOUBLE AND coalesce(sd > 0.01::DOUBLE, false) THEN 'PASS' ELSE 'WARN' END AS status FROM (
SELECT run_id, arg_min(train_loss, epoch) AS l0, arg_max(train_loss, epoch) AS l1, arg_min(valid_auc, epoch) AS a0, arg_max(valid_auc, epoch) AS a1, stddev_pop(valid_auc) AS sd FROM logs GROUP BY 1)""", "logs",
)
def _(v: Views):
    return audit.training_integrity(v.logs, v.logs.groupBy("run_id").agg(F.stddev_pop("valid_auc").alias("pred_std")))


@query(
    "f14_consistency_checks",
    """SELECT 'auc_tables_equal' AS check_name, count(*) AS n, count(*) FILTER (d > 1e-4::DOUBLE) AS violations, CASE WHEN count(*) FILTER (d > 1e-4::DOUBLE) > 0 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT variant, abs(avg(test_auc) - avg(test_auc) FILTER (seed <> 13)) AS d FROM runs GROUP BY 1) UNION ALL
SELECT 'strata_match_overall', count(*), count(*) FILTER (d > 0 AND d <= 0.0005::DOUBLE), CASE WHEN count(*) FILTER (d > 0 AND d <= 0.0005::DOUBLE) > 0 THEN 'WARN' ELSE 'PASS' END FROM (SELECT variant, round(avg(test_auc) - (SELECT avg(test_auc) FROM runs WHERE variant = 'no_graph'), 9) AS d FROM runs GROUP BY 1)""",
    "runs",
)
def _(v: Views):
    runs = materialize(v.runs)
    means = runs.groupBy("model", "variant").agg(F.avg("test_auc").alias("mean_auc"))
    base = means.where("variant = 'no_graph'").select("model", F.col("mean_auc").alias("b"))
    main = means.join(base, "model").select("model", "variant", "mean_auc", F.round(F.col("mean_auc") - F.col("b"), 9).alias("delta"))
    strata = main.select("model", "variant", F.lit("all").alias("stratum"), F.col("delta").alias("gain"))
    # the second table lacks a seed, as a stale one would
    stale = runs.where("seed <> 13").groupBy("model", "variant").agg(F.avg("test_auc").alias("mean_auc"))
    return audit.consistency_checks(main, stale, strata)


@query("f15_grid_completeness", "SELECT DISTINCT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events) EXCEPT SELECT user_id, event_type FROM events WHERE value > 90")
def _(v: Views):
    e = v.table("events")
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("event_type").distinct()))
    return audit.grid_completeness(grid, e.where("value > 90"), ["user_id", "event_type"])


@query(
    "f16_validate_outputs",
    f"""WITH {_PLANTED} SELECT check_name, status FROM ({_REPORT}) WHERE check_name IN ('L1', 'L5', 'L6') UNION ALL SELECT 'non_empty_edges', CASE WHEN (SELECT count(*) FROM sim) > 0 THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'non_empty_late_runs', CASE WHEN (SELECT count(*) FROM runs WHERE seed > 1000) > 0 THEN 'PASS' ELSE 'FAIL' END
UNION ALL SELECT 'graph_limits', CASE WHEN bool_and(m <= n * (n - 1) // 2) THEN 'PASS' ELSE 'FAIL' END FROM (SELECT relation_type, count(DISTINCT least(src, dst) || '>' || greatest(src, dst)) AS m FROM edges WHERE src <> dst GROUP BY 1)
JOIN (SELECT relation_type, count(DISTINCT u) AS n FROM (SELECT relation_type, unnest([src, dst]) AS u FROM edges) GROUP BY 1) USING (relation_type)""", *_REPORT_VIEWS, "edges",
)
def _(v: Views):
    report = materialize(_report(v))
    edges = v.edges
    return audit.validate_outputs(graph.edge_provenance_audit(edges), report, {"edges": edges.where("relation_type = 'sim'"), "late_runs": v.runs.where("seed > 1000")})


_PHRASES = [("the", "WARN"), ("licensed under", "FAIL"), ("all rights reserved", "WARN"), ("absent phrase", "FAIL")]


@query(
    "f17_phrase_scan",
    "SELECT phrase, action, sum(c)::BIGINT AS occurrences, count(*) FILTER (c > 0) AS documents, CASE WHEN sum(c) = 0 THEN 'PASS' ELSE action END AS status FROM (SELECT phrase, action, (length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase) AS c FROM documents, (VALUES "
    + ", ".join(f"('{p}', '{a}')" for p, a in _PHRASES) + ") p(phrase, action)) GROUP BY 1, 2",
)
def _(v: Views):
    return audit.phrase_scan(v.table("documents"), _PHRASES)


_TRIM = """tr AS (SELECT *, least(n, {m}) - b + 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY timestamp DESC, interaction_id DESC) AS b, count(*) OVER (PARTITION BY learner_id) AS n FROM ix) WHERE b <= {m} AND n >= 2)"""


@query("g1_learner_sequences", f"WITH {_TRIM.format(m=200)} SELECT learner_id, string_agg(skill_id, ',' ORDER BY place) AS skills, string_agg(correct::VARCHAR, ',' ORDER BY place) AS corrects, count(*)::INTEGER AS n FROM tr GROUP BY 1", "ix")
def _(v: Views):
    return features.learner_sequences(v.ix, 200).select("learner_id", F.array_join("skills", ",").alias("skills"), F.array_join(F.transform("corrects", lambda c: c.cast("string")), ",").alias("corrects"), "n")


@query(
    "g2_next_step_examples",
    f"WITH {_TRIM.format(m=200)} SELECT learner_id, place, skill_id, correct, next_skill, next_correct, next_interaction FROM (SELECT *, lead(skill_id) OVER w AS next_skill, lead(correct) OVER w AS next_correct, lead(interaction_id) OVER w AS next_interaction FROM tr WINDOW w AS (PARTITION BY learner_id ORDER BY place)) WHERE next_interaction IS NOT NULL", "ix",
)
def _(v: Views):
    return features.next_step_examples(v.ix)


@query("g3_encode_tokens", "SELECT interaction_id, skill_id::BIGINT + correct * 1000000 + 1 AS token, (skill_id::BIGINT + correct * 1000000) % 1000000 AS code, correct::INTEGER AS answer FROM ix", "ix")
def _(v: Views):
    token = features.encode_token(F.col("skill_id").cast("long"), F.col("correct"), 1_000_000)
    code, answer = features.decode_token(F.col("token"), 1_000_000)
    return v.ix.select("interaction_id", token.alias("token")).select("*", code.alias("code"), answer.alias("answer"))


@query(
    "g4_pad_sequences",
    f"WITH {_TRIM.format(m=200)} SELECT learner_id, string_agg(correct::VARCHAR, ',' ORDER BY place) || repeat(',-1', 200 - count(*)::INTEGER) AS corrects, string_agg(skill_id, ',' ORDER BY place) || repeat(',', 200 - count(*)::INTEGER) AS skills, count(*)::INTEGER AS n FROM tr GROUP BY 1", "ix",
)
def _(v: Views):
    padded = features.pad_sequences(features.learner_sequences(v.ix, 200), 200)
    return padded.select("learner_id", F.array_join(F.transform("corrects", lambda c: c.cast("string")), ",").alias("corrects"), F.array_join("skills", ",").alias("skills"), "n")


@query(
    "g5_prior_features",
    """SELECT interaction_id, skill_id, coalesce(sum(correct) OVER w, 0)::BIGINT AS prior_correct, count(*) OVER w AS prior_attempts, coalesce(sum(correct) OVER w, 0)::DOUBLE / greatest(count(*) OVER w, 1) AS success_rate FROM ix
WINDOW w AS (PARTITION BY learner_id, skill_id ORDER BY timestamp, interaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "ix", digits=("success_rate",),
)
def _(v: Views):
    return features.prior_features(v.ix).select("interaction_id", "skill_id", "prior_correct", "prior_attempts", "success_rate")


def _lr_rows(v: Views):
    split = v.keep().split
    degrees = graph.degree_feature(v.co.withColumn("relation_type", F.lit("co")), v.train, ["co"])
    return materialize(features.prior_features(split, degrees).withColumn("skill_code", F.col("skill_id").cast("double")))


@query("g6_lr_predict", None)
def _(v: Views):
    rows = _lr_rows(v)
    return features.lr_predict(rows.where("split = 'train'"), rows.where("split = 'test'"))


# At the optimum the fitted probabilities give each feature the sum that the correct answers give it, less the pull of
# its weight; SQL knows that sum without the fit. Shares of it are compared, as the fit ends within a tolerance.
@query(
    "g6_lr_moments",
    """WITH dg AS (SELECT skill_id, coalesce(d, 0)::DOUBLE / (max(coalesce(d, 0)) OVER ()) AS degree FROM fq LEFT JOIN (SELECT skill_id, count(*) AS d FROM (SELECT unnest([src, dst]) AS skill_id FROM co) GROUP BY 1) USING (skill_id)),
pr AS (SELECT skill_id, correct, coalesce(sum(correct) OVER w, 0)::DOUBLE / greatest(count(*) OVER w, 1) AS success_rate, count(*) OVER w AS prior_attempts FROM train WINDOW w AS (PARTITION BY learner_id, skill_id ORDER BY timestamp, interaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feature, sum(x * correct) AS observed, 1.0::DOUBLE AS expected_share FROM (
SELECT correct, unnest(['skill_code', 'success_rate', 'prior_attempts', 'degree', 'intercept']) AS feature, unnest([skill_id::DOUBLE, success_rate, prior_attempts::DOUBLE, coalesce(degree, 0), 1.0::DOUBLE]) AS x FROM pr LEFT JOIN dg USING (skill_id)) GROUP BY 1""",
    "fq", "co", digits={"observed": 4, "expected_share": 3},
)
def _(v: Views):
    moments = features.lr_moments(_lr_rows(v).where("split = 'train'"))
    return moments.select("feature", "observed", (F.col("expected") / F.col("observed")).alias("expected_share"))


@query(
    "g7_export_predictions",
    "SELECT interaction_id, skill_id, y_true, y_pred, learner_id AS user_id, question_id AS item_id, 'tpch' AS dataset, 0 AS fold, 'proxy' AS backbone FROM tp JOIN test USING (interaction_id, skill_id) WHERE variant = 'full' AND seed = 7", "tp", "test",
)
def _(v: Views):
    preds = v.test_preds.where("variant = 'full' and seed = 7").select("interaction_id", "skill_id", "y_true", "y_pred")
    return features.export_predictions(preds, v.test, {"dataset": "tpch", "fold": 0, "backbone": "proxy"})
