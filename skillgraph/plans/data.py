"""Queries of ingestion, splits and profiles (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._session import materialize, shared_folder
from ..functions.columns import epoch_of, normalize_correct, normalize_id
from ..operators import profile, splits
from ..sources import tables
from .fixtures import SEED, Views, query, unit_sql

_N = "count(*)"


@query("a1_read_interactions", "SELECT interaction_id, learner_id, question_id, skill_id, timestamp, correct, NULL::VARCHAR AS dataset FROM ix", "ix")
def _(v: Views):
    path = shared_folder(v.spark, "interactions")
    columns = ["interaction_id", "learner_id", "question_id", "skill_id", "timestamp", "correct", F.lit(None).cast("string").alias("dataset")]
    v.ix.select(*columns).write.option("header", True).csv(path)
    return tables.read_interactions(v.spark, path)


@query("a2_read_q_matrix", "SELECT * FROM q", "q")
def _(v: Views):
    path = shared_folder(v.spark, "q-matrix") + "/q.parquet"
    tables.write_table(v.q.withColumn("is_train_only", F.lit(False)), path, [])
    return tables.read_q_matrix(v.spark, path)


@query("a3_normalize_id", "SELECT o_orderkey, o_custkey::VARCHAR AS learner_id, (o_custkey::BIGINT + 123456789)::VARCHAR AS long_id FROM orders")
def _(v: Views):
    as_float = lambda c: normalize_id(c.cast("double"))
    return v.table("orders").select("o_orderkey", as_float(F.col("o_custkey")).alias("learner_id"), as_float(F.col("o_custkey") + 123_456_789).alias("long_id"))


@query("a4_drop_incomplete", "SELECT user_id, count(*) AS n_rows FROM (SELECT user_id, CASE WHEN value >= 10 THEN value END AS v FROM events) WHERE v IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def _(v: Views):
    df = v.table("events").select("user_id", F.when(F.col("value") >= 10, F.col("value")).alias("v"))
    return tables.drop_incomplete(df, ["user_id", "v"]).groupBy("user_id").agg(F.count("*").alias("n_rows"))


@query("a5_to_epoch_seconds", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS timestamp FROM orders")
def _(v: Views):
    df = v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return df.select("o_orderkey", epoch_of("at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("a5_row_order_fallback", "SELECT c_custkey, 999 + row_number() OVER (ORDER BY c_custkey) AS timestamp FROM customer")
def _(v: Views):
    return tables.to_epoch_seconds(v.table("customer").select("c_custkey", "c_name"), "c_name", ["c_custkey"]).select("c_custkey", "timestamp")


@query("a6_normalize_correct", "SELECT l_returnflag, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS n_correct, count(*) AS n_rows FROM lineitem GROUP BY 1")
def _(v: Views):
    raw = F.when(F.col("l_returnflag") == "R", F.lit("True")).when(F.col("l_returnflag") == "A", F.lit("0.0"))
    return v.table("lineitem").select("l_returnflag", normalize_correct(raw).alias("c")).groupBy("l_returnflag").agg(F.sum("c").alias("n_correct"), F.count("*").alias("n_rows"))


@query(
    "a7_map_skills",
    """SELECT coalesce(CASE WHEN p_size > 10 THEN p_brand END, CASE WHEN p_size > 5 THEN p_type END, 'Unknown') AS skill_id, count(*) AS n_rows FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_size < 40 GROUP BY 1""",
)
def _(v: Views):
    content = v.table("part").where("p_size < 40").select(F.col("p_partkey").alias("question_id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("level2_id"), F.when(F.col("p_size") > 5, F.col("p_type")).alias("subject"))
    log = v.table("lineitem").select(F.col("l_partkey").alias("question_id"))
    return tables.map_skills(log, content).groupBy("skill_id").agg(F.count("*").alias("n_rows"))


@query(
    "a8_explode_skills",
    "SELECT skill_id, count(*) AS n_rows FROM (SELECT trim(unnest(string_split(p_brand || '~~ ' || p_type || '~~', '~~'))) AS skill_id FROM part) WHERE skill_id <> '' GROUP BY 1",
)
def _(v: Views):
    df = v.table("part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("~~ "), F.col("p_type"), F.lit("~~")).alias("skill_id"))
    return tables.explode_skills(df).groupBy("skill_id").agg(F.count("*").alias("n_rows"))


@query("a9_encode_ids_sorted", "SELECT DISTINCT question_id, dense_rank() OVER (ORDER BY question_id) - 1 AS code FROM ix", "ix")
def _(v: Views):
    return tables.encode_ids(v.ix.select("question_id"), "question_id", "code").distinct()


@query(
    "a9_encode_ids_first_seen",
    "SELECT skill_id, row_number() OVER (ORDER BY t, skill_id) - 1 AS code FROM (SELECT skill_id, min(timestamp) AS t FROM ix GROUP BY 1)", "ix",
)
def _(v: Views):
    return tables.encode_ids(v.ix.select("skill_id", "timestamp"), "skill_id", "code", "timestamp").select("skill_id", "code").distinct()


@query("a10_derive_q_matrix", "SELECT DISTINCT question_id, skill_id, 'train_only_derived' AS source, '1' AS source_version, 'true' AS is_train_only FROM train", "train")
def _(v: Views):
    return tables.derive_q_matrix(v.train)


@query("a11_min_sequence_filter", "SELECT learner_id, count(*) AS n_rows FROM ix GROUP BY 1 HAVING count(*) >= 30", "ix")
def _(v: Views):
    return tables.min_sequence_filter(v.ix, 30).groupBy("learner_id").agg(F.count("*").alias("n_rows"))


@query("a12_reassign_interaction_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS interaction_id FROM orders")
def _(v: Views):
    return tables.reassign_interaction_ids(v.table("orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "interaction_id")


@query("a13_head_sample", "SELECT * FROM ix ORDER BY timestamp, interaction_id LIMIT 500", "ix")
def _(v: Views):
    return tables.head_sample(v.ix, 500, ["timestamp", "interaction_id"])


@query("a14_resolve_columns", "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def _(v: Views):
    df = v.table("lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("score"))
    return tables.resolve_columns(df, "co_occurrence")


@query("a14_resolve_scores", "SELECT l_suppkey AS src, l_partkey AS dst, max(l_quantity)::DOUBLE AS score, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def _(v: Views):
    # a table with score and weight: prerequisite scores take the first, co-occurrence would take the second
    df = v.table("lineitem").groupBy(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("Target")).agg(F.max("l_quantity").cast("double").alias("score"), F.count("*").alias("weight"))
    return tables.resolve_columns(df, "prerequisite_scores")


@query("a14_resolve_predictions", "SELECT interaction_id, skill_id, y_true, y_pred, variant AS target FROM tp WHERE seed = 7", "tp")
def _(v: Views):
    df = v.test_preds.where("seed = 7").select("interaction_id", F.col("skill_id").alias("concept_id"), F.col("y_true").alias("label"), F.col("y_pred").alias("prob"), F.col("variant").alias("target"))
    return tables.resolve_columns(df, "predictions")


@query("a14_resolve_interactions", "SELECT learner_id, question_id, skill_id, interaction_id AS learner_id_given, correct FROM train", "train")
def _(v: Views):
    # user_id comes before learner_id, which is another column here and steps aside
    df = v.train.select(F.col("learner_id").alias("user_id"), F.col("interaction_id").alias("learner_id"), F.col("question_id").alias("problem_id"), F.col("skill_id").alias("KC_id"), "correct")
    return tables.resolve_columns(df, "interactions")


@query("a14_resolve_degree_edges", "SELECT src, dst, step AS src_given FROM pre", "pre")
def _(v: Views):
    df = v.pre.select(F.col("src").alias("src_skill_id"), F.col("dst").alias("target"), F.col("step").alias("src"))
    return tables.resolve_columns(df, "degree_edges")


_TREE = "dataset", "fold", "seed", "model", "variant"


@query("a16_read_run_tree", f"SELECT concat_ws('_', {', '.join(_TREE)}) AS run_id, variant, seed::VARCHAR AS seed, valid_auc, test_auc FROM runs", "runs", digits=("valid_auc", "test_auc"))
def _(v: Views):
    path = shared_folder(v.spark, "run-tree")
    v.runs.select(*_TREE, "valid_auc", "test_auc").write.partitionBy(*_TREE).option("header", True).csv(path)
    return tables.read_run_tree(v.spark, path).select("run_id", "variant", "seed", "valid_auc", "test_auc")


@query("a19_append_runs", "SELECT dataset, variant, 2 * count(*) AS n_rows, avg(test_auc) AS test_auc FROM runs GROUP BY 1, 2", "runs", digits=("test_auc",))
def _(v: Views):
    path, runs = shared_folder(v.spark, "runs"), materialize(v.runs)
    tables.write_table(runs, path, ["dataset"])
    tables.append_runs(runs, path)
    return v.spark.read.parquet(path).groupBy("dataset", "variant").agg(F.count("*").alias("n_rows"), F.avg("test_auc").alias("test_auc"))


@query(
    "a17_parse_run_log",
    "SELECT 'tpch' AS dataset, (event_id % 2)::INTEGER AS fold, user_id::INTEGER AS seed, 'm' || (event_id % 3) AS model, event_type AS variant, CASE WHEN value >= 5 THEN floor(value * 100) / 100 END AS valid_auc, floor(value * 50) / 100 AS test_auc FROM events WHERE event_id % 5 <> 0",
    digits=("valid_auc", "test_auc"),
)
def _(v: Views):
    two = lambda c: (F.floor(c * 100) / 100).cast("string")
    auc = F.when(F.col("value") >= 5, two(F.col("value"))).otherwise("nan")
    line = F.concat(
        F.lit("[2026-01-01 00:00:00]   [tpch fold "), F.col("event_id") % 2, F.lit(" seed "), F.col("user_id"), F.lit("] Model m"), F.col("event_id") % 3, F.lit(" Variant "), F.col("event_type"),
        F.lit(" -> Val AUC: "), auc, F.lit(", Test AUC: "), (F.floor(F.col("value") * 50) / 100).cast("string"),
    )
    lines = v.table("events").select(F.when(F.col("event_id") % 5 == 0, F.lit("[2026-01-01 00:00:00] epoch done")).otherwise(line).alias("value"))
    return tables.parse_run_log(lines)


@query(
    "a18_union_edge_tables",
    "SELECT relation_type, count(*) AS n_edges, sum(support_count)::BIGINT AS support, min(construction_method) AS construction_method, count(DISTINCT src) AS sources FROM (SELECT 'sim' AS relation_type, src, support_count, 'default' AS construction_method FROM sim UNION ALL SELECT 'co', src, 0, 'pmi' FROM co) GROUP BY 1",
    "sim", "co",
)
def _(v: Views):
    a = v.sim_once.withColumn("relation_type", F.lit("sim"))
    b = v.co_once.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("weight").alias("pmi"), F.lit("co").alias("relation_type"), F.lit("pmi").alias("construction_method"))
    names = tables.schemas.CONTEXTS["prerequisite_scores"]
    both = tables.union_edge_tables(a, b, renamed={"src": names["src"], "dst": names["dst"], "weight": tables.schemas.CONTEXTS["co_occurrence"]["weight"]}, defaults={"support_count": 0, "construction_method": "default"})
    return both.groupBy("relation_type").agg(F.count("*").alias("n_edges"), F.sum("support_count").alias("support"), F.min("construction_method").alias("construction_method"), F.countDistinct("src").alias("sources"))


@query(
    "a20_pending_runs",
    """SELECT DISTINCT 'm' || (event_id % 7) AS model, (user_id % 10)::INTEGER AS seed FROM events EXCEPT
SELECT 'm' || (event_id % 7), (user_id % 10)::INTEGER FROM events WHERE (event_id % 7 + user_id % 10) % 3 <> 0 OR event_type = 'view' GROUP BY 1, 2 HAVING count(DISTINCT event_type) >= 4""",
)
def _(v: Views):
    e = v.table("events").select(F.concat(F.lit("m"), F.col("event_id") % 7).alias("model"), (F.col("user_id") % 10).cast("int").alias("seed"), F.col("event_type").alias("variant"), (F.col("event_id") % 7 + F.col("user_id") % 10).alias("n"))
    return tables.pending_runs(e.select("model", "seed").distinct(), e.where("n % 3 <> 0 or variant = 'view'"), 4)  # a third of the runs have one variant only


@query("b1_learner_split", "SELECT split, count(*) AS n_rows, count(DISTINCT learner_id) AS n_learners, min(interaction_id) AS first_id FROM sp GROUP BY 1", "sp")
def _(v: Views):
    return v.split.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("learner_id").alias("n_learners"), F.min("interaction_id").alias("first_id"))


@query(
    "b2_make_folds",
    f"""SELECT learner_id, fold, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (
SELECT learner_id, fold, row_number() OVER (PARTITION BY fold ORDER BY md5(learner_id || '|' || ({SEED} + fold)), learner_id) AS rn, count(*) OVER (PARTITION BY fold) AS n
FROM (SELECT DISTINCT learner_id FROM ix), (VALUES (0), (1), (2)) f(fold))""", "ix",
)
def _(v: Views):
    return splits.make_folds(v.ix, 3, SEED)


@query(
    "b3_temporal_split",
    "SELECT split, count(*) AS n_rows, min(timestamp) AS first_time, max(timestamp) AS last_time FROM (SELECT ix.*, CASE WHEN timestamp <= c1 THEN 'train' WHEN timestamp <= c2 THEN 'valid' ELSE 'test' END AS split FROM ix, (SELECT quantile_cont(timestamp, 0.8) AS c1, quantile_cont(timestamp, 0.9) AS c2 FROM ix)) GROUP BY 1",
    "ix",
)
def _(v: Views):
    return splits.temporal_split(v.ix).groupBy("split").agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))


@query(
    "b3_temporal_split_per_learner",
    """SELECT split, count(*) AS n_rows, min(interaction_id) AS first_id FROM (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM (
SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY timestamp, interaction_id) AS rn, count(*) OVER (PARTITION BY learner_id) AS n FROM ix)) GROUP BY 1""", "ix",
)
def _(v: Views):
    return splits.temporal_split(v.ix, per_learner=True).groupBy("split").agg(F.count("*").alias("n_rows"), F.min("interaction_id").alias("first_id"))


@query("b4_split_report", "SELECT split, count(*) AS n_rows FROM sp GROUP BY 1", "sp")
def _(v: Views):
    return splits.split_report(v.split)


_PART = "('0x' || substr(md5(concat_ws('|', interaction_id, learner_id, skill_id, correct)), {}, 7))::BIGINT"


@query("b5_fingerprint", f"SELECT split, count(*) AS n_rows, sum({_PART.format(1)})::BIGINT AS fingerprint_a, sum({_PART.format(9)})::BIGINT AS fingerprint_b FROM sp GROUP BY 1", "sp")
def _(v: Views):
    return splits.fingerprint(v.split, ["split"], ["interaction_id", "learner_id", "skill_id", "correct"])


def _digest_sql(rows: str, keys: str, columns: list[str]) -> str:
    """The order-free SHA-256 of ``rows`` per ``keys``: sums of 16-bit limbs, carried from the last to the first."""
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)
    sums = ", ".join(f"sum(('0x' || substr(h, {4 * i + 1}, 4))::BIGINT)::BIGINT AS v{i}" for i in range(16))
    sql = f"SELECT {keys}, count(*) AS n_rows, {sums} FROM (SELECT {keys}, sha256({text}) AS h FROM {rows}) GROUP BY ALL"
    for i in reversed(range(15)):
        sql = f"SELECT * REPLACE (v{i} + v{i + 1} // 65536 AS v{i}) FROM ({sql})"
    digits = " || ".join(f"format('{{:04x}}', v{i} % 65536)" for i in range(16))
    return f"SELECT {keys}, n_rows, sha256(n_rows || '|' || {digits}) AS sha256 FROM ({sql})"


_ROW_COLUMNS = ["interaction_id", "learner_id", "question_id", "skill_id", "timestamp", "correct"]
_EDGE_COLUMNS = ["src", "dst", "support_count"]


@query("b5_content_digest", _digest_sql("sp", "fold, split", _ROW_COLUMNS), "sp")
def _(v: Views):
    return splits.content_digest(v.split, ["fold", "split"], _ROW_COLUMNS)


def _manifest_sql(edges: str) -> str:
    splits_of = ", ".join(f"max(sha256) FILTER (split = '{s}') AS {s}_hash" for s in ("train", "valid", "test"))
    return f"""SELECT fold, relation_type, coalesce(e.n_rows, 0) AS num_edges, coalesce(e.sha256, sha256('0|' || repeat('0', 64))) AS edges_sha256, train_interactions_count, train_hash, valid_hash, test_hash
FROM (SELECT fold, max(n_rows) FILTER (split = 'train') AS train_interactions_count, {splits_of} FROM ({_digest_sql("sp", "fold, split", _ROW_COLUMNS)}) GROUP BY 1)
CROSS JOIN (VALUES ('pre'), ('sim'), ('co'), ('none')) r(relation_type) LEFT JOIN ({_digest_sql(edges, "fold, relation_type", _EDGE_COLUMNS)}) e USING (fold, relation_type)"""


_FOLD_EDGES = "(SELECT 0 AS fold, * FROM edges)"


@query("b5_provenance_manifest", _manifest_sql(_FOLD_EDGES), "edges", "sp")
def _(v: Views):
    return splits.provenance_manifest(v.edges.withColumn("fold", F.lit(0)), v.split, ["fold"], ["pre", "sim", "co", "none"], _EDGE_COLUMNS)


_OTHER_EDGES = "(SELECT 0 AS fold, * REPLACE (CASE WHEN relation_type = 'co' THEN support_count + 1 ELSE support_count END AS support_count) FROM edges)"


@query(
    "b5_compare_manifests",
    f"""SELECT fold, relation_type, CASE WHEN a.edges_sha256 = b.edges_sha256 THEN 'SAME' ELSE 'CHANGED' END AS edges, CASE WHEN a.train_hash = b.train_hash THEN 'SAME' ELSE 'CHANGED' END AS train,
CASE WHEN a.edges_sha256 = b.edges_sha256 AND a.train_hash = b.train_hash THEN 'PASS' ELSE 'CHANGED' END AS status FROM ({_manifest_sql(_FOLD_EDGES)}) a JOIN ({_manifest_sql(_OTHER_EDGES)}) b USING (fold, relation_type)""",
    "edges", "sp",
)
def _(v: Views):
    # the same graphs after the supports of one relation were changed
    split, edges = v.keep().split, materialize(v.edges.withColumn("fold", F.lit(0)))
    other = edges.withColumn("support_count", F.when(F.col("relation_type") == "co", F.col("support_count") + 1).otherwise(F.col("support_count")))
    manifest = lambda e: splits.provenance_manifest(e, split, ["fold"], ["pre", "sim", "co", "none"], _EDGE_COLUMNS)
    return splits.compare_manifests(manifest(edges), manifest(other), ["fold"])


@query(
    "b6_split_overlap_audit",
    """SELECT c AS id_column, count(*) FILTER (n > 1) AS overlapping, CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
SELECT 'interaction_id' AS c, count(DISTINCT split) AS n FROM sp GROUP BY interaction_id UNION ALL SELECT 'learner_id', count(DISTINCT split) FROM sp GROUP BY learner_id UNION ALL SELECT 'skill_id', count(DISTINCT split) FROM sp GROUP BY skill_id) GROUP BY 1""",
    "sp",
)
def _(v: Views):
    return splits.split_overlap_audit(v.split, ("interaction_id", "learner_id", "skill_id"))


@query(
    "b7_dataset_stats",
    "SELECT count(DISTINCT learner_id) AS n_learners, count(DISTINCT question_id) AS n_questions, count(DISTINCT skill_id) AS n_skills, count(*) AS n_interactions, count(*)::DOUBLE / count(DISTINCT learner_id) AS avg_sequence_length, 'provided_static' AS q_source FROM ix",
    "ix", digits=("avg_sequence_length",),
)
def _(v: Views):
    return profile.dataset_stats(v.ix)


_B8 = ", ".join(
    f"count(*) FILTER (split = '{s}') AS interactions_{s}, " + ", ".join(f"count(DISTINCT {c}) FILTER (split = '{s}') AS {l}_{s}" for l, c in (("users", "learner_id"), ("questions", "question_id"), ("skills", "skill_id")))
    for s in ("train", "valid", "test")
)


@query(
    "b8_split_stats",
    f"""SELECT b.*, u.* EXCLUDE (fold), s.* EXCLUDE (fold), interactions_total < 100000 AS subsampled FROM (
SELECT fold, count(*) AS interactions_total, count(DISTINCT learner_id) AS users_total, count(DISTINCT question_id) AS questions_total, count(DISTINCT skill_id) AS skills_total, {_B8} FROM sp GROUP BY 1) b
JOIN (SELECT fold, avg(c) AS mean_per_user, median(c) AS median_per_user FROM (SELECT fold, learner_id, count(*) AS c FROM sp GROUP BY 1, 2) GROUP BY 1) u USING (fold)
JOIN (SELECT fold, avg(c) AS mean_per_skill, median(c) AS median_per_skill, {", ".join(f"count(*) FILTER (c <= {t}) AS skills_le_{t}" for t in (50, 100, 200, 500))}, count(*) FILTER (c > 500) AS skills_gt_500
FROM (SELECT fold, skill_id, count(*) AS c FROM sp GROUP BY 1, 2) GROUP BY 1) s USING (fold)""",
    "sp", digits=("mean_per_user", "median_per_user", "mean_per_skill", "median_per_skill"),
)
def _(v: Views):
    return profile.split_stats(materialize(v.split))


@query("b9_cell_intensity", "SELECT count(*)::DOUBLE / (count(DISTINCT learner_id) * count(DISTINCT skill_id)) AS cell_intensity FROM train", "train", digits=("cell_intensity",))
def _(v: Views):
    return profile.cell_intensity(v.train)


@query(
    "b10_scale_audit",
    "SELECT metric, value, target, CASE WHEN value >= target THEN 'PASS' ELSE 'WARN' END AS status FROM (SELECT unnest(['n_learners', 'n_interactions', 'n_skills']) AS metric, unnest([count(DISTINCT learner_id), count(*), count(DISTINCT skill_id)]) AS value, unnest([1000, 100000, 50])::BIGINT AS target FROM ix)",
    "ix",
)
def _(v: Views):
    return profile.scale_audit(profile.dataset_stats(v.ix), {"n_learners": 1000, "n_interactions": 100000, "n_skills": 50})


@query("b11_skill_frequency_distribution", "SELECT (c // 20) * 20 AS bin_start, count(*) AS n_skills FROM (SELECT skill_id, count(*) AS c FROM ix_sparse GROUP BY 1) GROUP BY 1", "ix_sparse")
def _(v: Views):
    return profile.skill_frequency_distribution(v.ix_sparse, 20)


_PROFILE = "SELECT skill_id, count(*) AS n_interactions, count(DISTINCT learner_id) AS n_learners, avg(correct) AS avg_correct, count(DISTINCT question_id) AS n_questions FROM trains GROUP BY 1"


@query("c1_skill_profile", _PROFILE, "trains", digits=("avg_correct",))
def _(v: Views):
    return profile.skill_profile(v.train_sparse)


_PCT = f"SELECT p.*, CASE WHEN n_interactions <= a THEN 'sparse' WHEN n_interactions <= b THEN 'medium' ELSE 'dense' END AS strata FROM ({_PROFILE}) p, (SELECT quantile_cont(n_interactions, 0.33) AS a, quantile_cont(n_interactions, 0.66) AS b FROM ({_PROFILE}))"


@query("c2_strata_percentile", _PCT, "trains", digits=("avg_correct",))
def _(v: Views):
    return profile.strata_percentile(profile.skill_profile(v.train_sparse))


@query("c3_strata_rank", "SELECT * FROM strata", "strata")
def _(v: Views):
    return v.strata


@query("c4_strata_absolute", "SELECT skill_id, count(*) AS n_interactions, CASE WHEN count(*) <= 50 THEN 'very_sparse' WHEN count(*) <= 100 THEN 'sparse' WHEN count(*) <= 500 THEN 'medium' ELSE 'frequent' END AS stratum FROM trains GROUP BY 1", "trains")
def _(v: Views):
    return profile.strata_absolute(v.train_sparse)


@query("c5_strata_bins", "SELECT skill_id, count(*) AS n_interactions, CASE WHEN count(*) < 20 THEN 'very_sparse' WHEN count(*) < 100 THEN 'sparse' WHEN count(*) < 500 THEN 'medium' ELSE 'dense' END AS stratum FROM trains GROUP BY 1", "trains")
def _(v: Views):
    bins = profile.bins_table(v.spark, [("very_sparse", 0, 20), ("sparse", 20, 100), ("medium", 100, 500), ("dense", 500, None)])
    return profile.strata_bins(v.train_sparse, bins)


@query("c6_frequency_bins", "SELECT CASE WHEN count(*) <= 50 THEN 'le50' WHEN count(*) <= 100 THEN '51-100' WHEN count(*) <= 200 THEN '101-200' WHEN count(*) <= 500 THEN '201-500' ELSE 'gt500' END AS bin, skill_id, count(*) AS n_interactions FROM trains GROUP BY skill_id", "trains")
def _(v: Views):
    return profile.frequency_bins(v.train_sparse)


@query(
    "c6_frequency_bins_cumulative",
    "SELECT bin, count(*) AS n_skills, sum(c)::BIGINT AS n_rows FROM (SELECT skill_id, count(*) AS c FROM trains GROUP BY 1) JOIN (VALUES ('le50', 0, 50), ('le100', 0, 100), ('le200', 0, 200), ('gt500', 501, 1000000000)) b(bin, lo, hi) ON c BETWEEN lo AND hi GROUP BY 1",
    "trains",
)
def _(v: Views):
    return profile.frequency_bins(v.train_sparse, cumulative=True).groupBy("bin").agg(F.count("*").alias("n_skills"), F.sum("n_interactions").alias("n_rows"))


@query("c7_strata_summary", f"SELECT strata AS stratum, count(*) AS n_skills, avg(n_interactions) AS avg_interactions, min(n_interactions) AS min_interactions, max(n_interactions) AS max_interactions FROM ({_PCT}) GROUP BY 1", "trains", digits=("avg_interactions",))
def _(v: Views):
    return profile.strata_summary(profile.strata_percentile(profile.skill_profile(v.train_sparse)))


@query(
    "c8_strata_box_stats",
    f"SELECT strata AS stratum, min(n_interactions)::DOUBLE AS low, quantile_cont(n_interactions, 0.25) AS q25, median(n_interactions) AS median, quantile_cont(n_interactions, 0.75) AS q75, max(n_interactions)::DOUBLE AS high FROM ({_PCT}) GROUP BY 1",
    "trains", digits=("q25", "median", "q75"),
)
def _(v: Views):
    return profile.strata_box_stats(profile.strata_percentile(profile.skill_profile(v.train_sparse)))
