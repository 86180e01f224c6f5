"""Queries of relation construction and graph measures (D, E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .._session import materialize, written
from ..functions.columns import hashed_unit
from ..functions.ranking import global_row_number
from ..operators import graph, relations, similarity
from .fixtures import SEED, Views, four_places_sql, query, unit_sql


@query("d1_e_pre_raw", "SELECT a.skill_id AS src, b.skill_id AS dst, 1.0::DOUBLE AS weight, 0.5::DOUBLE AS confidence FROM rk a JOIN rk b ON a.t < b.t", "rk")
def _(v: Views):
    return relations.e_pre_raw(v.links)


@query("d2_top_k_out", "SELECT src, dst, weight, support_count FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY support_count DESC, dst) AS r FROM sim) WHERE r <= 5", "sim")
def _(v: Views):
    return relations.top_k_out(v.sim, 5, ("support_count",)).drop("weight").join(v.sim.select("src", "dst", "weight"), ["src", "dst"])


@query("d1_2_e_pre_topk", "SELECT src, dst, weight, step FROM pre", "pre")
def _(v: Views):
    return v.pre


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _cyclic_edges(v: Views):
    """From the supplier of each line of an order to that of the next line, weighted by how often; full of cycles."""
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER))
    steps = v.table("lineitem").select(F.col("l_suppkey").cast("string").alias("src"), after.cast("string").alias("dst")).where("src <> dst")
    return steps.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


_CYCLIC = f"""e AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT l_suppkey::VARCHAR AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)})::VARCHAR AS dst FROM lineitem) WHERE src <> dst GROUP BY 1, 2)"""


@query(
    "d3_cyclic_core",
    f"""WITH RECURSIVE {_CYCLIC}, up(n, x) AS (SELECT src, dst FROM e UNION SELECT up.n, e.dst FROM up JOIN e ON up.x = e.src),
cyc AS (SELECT DISTINCT n FROM up WHERE n = x), fwd AS (SELECT n AS x FROM cyc UNION SELECT up.x FROM up JOIN cyc ON up.n = cyc.n), bwd AS (SELECT n AS x FROM cyc UNION SELECT up.n FROM up JOIN cyc ON up.x = cyc.n)
SELECT src, dst, weight FROM e WHERE src IN (SELECT x FROM fwd) AND src IN (SELECT x FROM bwd) AND dst IN (SELECT x FROM fwd) AND dst IN (SELECT x FROM bwd)""",
)
def _(v: Views):
    return graph.cyclic_core(_cyclic_edges(v))


@query("d4_break_cycles", None)
def _(v: Views):
    return graph.break_cycles(_cyclic_edges(v))


@query("d5_transitive_reduction", "SELECT a.skill_id AS src, b.skill_id AS dst FROM rk a JOIN rk b ON b.r = a.r + 1", "rk")
def _(v: Views):
    return graph.transitive_reduction(v.pre.select("src", "dst"))


@query("d5_e_pre_chain", "SELECT a.skill_id AS src, b.skill_id AS dst FROM rk a JOIN rk b ON b.r = a.r + 1", "rk")
def _(v: Views):
    return relations.e_pre_chain(v.links)


@query("d6_e_pre_support", "SELECT src, dst, weight, a.n + b.n AS support_count FROM pre JOIN fq a ON a.skill_id = src JOIN fq b ON b.skill_id = dst", "pre", "fq")
def _(v: Views):
    return relations.e_pre_support(v.pre.drop("step"), v.train)


@query("d7_support_hash", f"SELECT src, dst, substr(sha256(src || '_' || dst || '_' || support_count || '_' || {four_places_sql('weight')}), 1, 16) AS support_hash FROM sim", "sim")
def _(v: Views):
    return relations.support_hash(v.sim).select("src", "dst", "support_hash")


#: Confidence of a pair: its rank by similarity among all, from above 0 to 1.
_CONFIDENCE = "round(cume_dist() OVER (ORDER BY weight, src, dst), 6)"


@query(
    "d8_e_pre_variants",
    f"""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, weight DESC, dst) AS r FROM (SELECT src, dst, weight, {_CONFIDENCE} AS confidence FROM sim)),
t5 AS (SELECT src, dst FROM x WHERE r <= 5), p(a, b) AS (SELECT src, dst FROM t5 UNION SELECT p.a, t5.dst FROM p JOIN t5 ON p.b = t5.src),
y AS (SELECT 'raw' AS variant, src, dst FROM x UNION ALL SELECT 'top' || k || '_out', src, dst FROM x JOIN (VALUES (3), (5), (10)) ks(k) ON r <= k UNION ALL SELECT printf('confidence_%.2f', c), src, dst FROM x JOIN (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) cs(c) ON confidence >= c
UNION ALL SELECT 'top5_transitive_reduced', src, dst FROM t5 WHERE NOT EXISTS (SELECT 1 FROM t5 f JOIN p ON p.a = f.dst WHERE f.src = t5.src AND p.b = t5.dst))
SELECT variant, nodes, m AS edges, m::DOUBLE / (nodes * (nodes - 1)) AS density, m::DOUBLE / nodes AS avg_out_degree, dag, CASE WHEN m::DOUBLE / (nodes * (nodes - 1)) <= 0.05::DOUBLE THEN 'PASS' ELSE 'DENSE' END AS status
FROM (SELECT variant, count(*) AS m, bool_and(src < dst) AS dag FROM y GROUP BY 1), (SELECT count(DISTINCT u) AS nodes FROM (SELECT unnest([src, dst]) AS u FROM x))""",
    "sim", digits=("density", "avg_out_degree"),
)
def _(v: Views):
    # the similarity's pairs run from the smaller to the larger name, so they have no cycle
    sim = v.sim.select("src", "dst", "weight")
    ranked = global_row_number(sim, ["weight", "src", "dst"]).crossJoin(sim.agg(F.count("*").alias("n")))
    return relations.e_pre_variants(ranked.select("src", "dst", "weight", F.round(F.col("rn") / F.col("n"), 6).alias("confidence")))


@query("d9_e_sim", "SELECT * FROM sim", "sim", digits=("weight",))
def _(v: Views):
    return v.sim


# learners as sets of questions, and a copy of each that lacks about a tenth of them
_COPIES = f"""lq AS (SELECT DISTINCT learner_id AS skill_id, question_id FROM ix UNION ALL SELECT DISTINCT learner_id || '-copy', question_id FROM ix WHERE {unit_sql("learner_id || '|' || question_id")} >= 0.1::DOUBLE),
lqn AS (SELECT skill_id, count(*) AS n FROM lq GROUP BY 1)"""
_THETA = 0.7


def _learner_sets(v: Views):
    own = v.ix.select(F.col("learner_id").alias("skill_id"), "question_id").distinct()
    copies = own.where(hashed_unit(F.col("skill_id"), F.col("question_id")) >= 0.1).withColumn("skill_id", F.concat("skill_id", F.lit("-copy")))
    return own.unionByName(copies)


_SHARING = """(SELECT a.skill_id AS src, b.skill_id AS dst, x.n AS n1, y.n AS n2, count(*) AS c FROM lq a JOIN lq b ON a.question_id = b.question_id AND a.skill_id < b.skill_id
JOIN lqn x ON x.skill_id = a.skill_id JOIN lqn y ON y.skill_id = b.skill_id GROUP BY 1, 2, 3, 4)"""


@query(
    "d9_e_sim_prefix",
    f"WITH {_COPIES} SELECT src, dst, c::DOUBLE / (n1 + n2 - c) AS weight, c AS support_count FROM {_SHARING} WHERE c::DOUBLE / (n1 + n2 - c) >= {_THETA}::DOUBLE", "ix", digits=("weight",),
)
def _(v: Views):
    return relations.e_sim(_learner_sets(v), _THETA)


_LEAST = f"ceil({_THETA / (1 + _THETA)!r}::DOUBLE * (n1 + n2) * (1 - 1e-12::DOUBLE))"


@query(
    "d9_similarity_work",
    f"""WITH {_COPIES}, pl AS (SELECT skill_id, question_id, n, row_number() OVER (PARTITION BY skill_id ORDER BY f, question_id) - 1 AS pos FROM lq JOIN lqn USING (skill_id) JOIN (SELECT question_id, count(*) AS f FROM lq GROUP BY 1) USING (question_id)),
px AS (SELECT * FROM pl WHERE pos < n - ceil({_THETA}::DOUBLE * n * (1 - 1e-12::DOUBLE)) + 4),
mt AS (SELECT * FROM (SELECT a.skill_id AS src, b.skill_id AS dst, a.n AS n1, b.n AS n2, a.pos AS i, b.pos AS j FROM px a JOIN px b ON a.question_id = b.question_id AND a.skill_id < b.skill_id)
WHERE least(n1, n2) >= {_THETA}::DOUBLE * greatest(n1, n2) * (1 - 1e-12::DOUBLE) AND least(i, j) + least(n1 - i, n2 - j) >= {_LEAST})
SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM mt)) AS pairs_met,
(SELECT count(*) FROM (SELECT src, dst, n1, n2, count(*) AS c, max(i) AS i, max(j) AS j FROM mt GROUP BY ALL) WHERE c >= least(4, {_LEAST}) AND c + least(n1 - i, n2 - j) - 1 >= {_LEAST}) AS pairs_verified,
(SELECT count(*) FROM {_SHARING} WHERE c::DOUBLE / (n1 + n2 - c) >= {_THETA}::DOUBLE) AS pairs_at_theta, (SELECT count(*) FROM {_SHARING}) AS pairs_sharing_a_question""", "ix",
)
def _(v: Views):
    sets = materialize(_learner_sets(v))
    return similarity.similarity_work(sets, _THETA).crossJoin(relations.pair_counts(sets, "question_id")[0].agg(F.count("*").alias("pairs_sharing_a_question")))


@query("d10_e_sim_topk", "SELECT src, dst, weight, support_count FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sim) WHERE r <= 20", "sim", digits=("weight",))
def _(v: Views):
    return relations.e_sim_topk(v.sim, 20)


@query(
    "d11_e_sim_trace",
    """SELECT (SELECT count(DISTINCT skill_id) FROM train) AS n_skills, (SELECT count(*) FROM (SELECT question_id FROM train GROUP BY 1 HAVING count(DISTINCT skill_id) > 1)) AS multi_skill_questions,
(SELECT count(*) FROM simall) AS candidate_pairs, (SELECT count(*) FROM sim) AS pairs_at_theta, (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sim) WHERE r <= 20) AS edges_after_topk,
CASE WHEN NOT EXISTS (SELECT 1 FROM train GROUP BY question_id HAVING count(DISTINCT skill_id) > 1) THEN 'no shared questions' WHEN NOT EXISTS (SELECT 1 FROM sim) THEN 'all below theta' ELSE 'active' END AS reason""",
    "simall", "sim",
)
def _(v: Views):
    return relations.e_sim_trace(v.links, v.theta, 20)


@query("d12_e_co", "SELECT * FROM co", "co", digits=("weight",))
def _(v: Views):
    return v.co


@query("entry_e_co", "SELECT src, dst, weight, support_count FROM co ORDER BY weight DESC, src, dst LIMIT 100", "co", digits=("weight",))
def _(v: Views):
    return v.co.orderBy(F.desc("weight"), "src", "dst").limit(100)


@query(
    "d13_mirror_edges",
    "SELECT src, dst, weight, support_count, is_mirrored FROM (SELECT src, dst, weight, support_count, false AS is_mirrored FROM co UNION ALL SELECT dst, src, weight, support_count, true FROM co)", "co", digits=("weight",),
)
def _(v: Views):
    return relations.mirror_edges(v.co)


def _controlled(k: int, p: float, top: int, pairs: str = "pairs") -> str:
    return f"""SELECT DISTINCT src, dst, weight, support_count FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY weight DESC, src, dst) AS r FROM (
SELECT src, dst, pmi AS weight, support_count, unnest([src, dst]) AS u FROM {pairs} WHERE support_count >= {k} AND pmi > 0 AND pmi >= {p}::DOUBLE)) WHERE r <= {top}"""


@query(
    "d14_e_co_controlled",
    f"SELECT src, dst, weight, support_count, false AS is_mirrored FROM ({_controlled(3, 0.005, 20)}) UNION ALL SELECT dst, src, weight, support_count, true FROM ({_controlled(3, 0.005, 20)})",
    "pairs", digits=("weight",),
)
def _(v: Views):
    return relations.e_co_controlled(v.links, 3, 0.005, 20)


#: k_min, pmi_min, top_k (0: none) of the surveyed configurations (fixed values).
_GRID = [
    (2, 0.0, 0), (2, 0.25, 10), (2, 1.0, 20), (3, 0.25, 50), (3, 1.0, 100), (5, 0.25, 0), (5, 0.5, 10), (10, 0.0, 20),
    (10, 0.5, 50), (20, 0.0, 100), (20, 0.5, 0), (20, 1.0, 10), (50, 0.25, 20), (50, 1.0, 50), (100, 0.25, 100), (100, 1.0, 0),
]


def _configured(i: int, k: int, p: float, top: int) -> str:
    kept = f"({_controlled(k, p, top or 2**31 - 1, 'pairss')})"
    return f"""SELECT {k} AS k_min, {p}::DOUBLE AS pmi_min, {top} AS top_k, (SELECT count(*) FROM pairss WHERE support_count >= {k} AND pmi > 0 AND pmi >= {p}) AS support_rows, count(*) AS edges, 2.0::DOUBLE * count(*) / any_value(n * (n - 1)) AS density,
avg(weight) AS pmi_mean, median(weight) AS pmi_median, quantile_cont(weight, 0.25) AS pmi_p25, quantile_cont(weight, 0.75) AS pmi_p75, (SELECT count(DISTINCT u) FROM (SELECT unnest([src, dst]) AS u FROM {kept}))::DOUBLE / any_value(n) AS covered_share
FROM (SELECT count(DISTINCT skill_id) AS n FROM trains) LEFT JOIN {kept} ON true"""


@query(
    "d15_e_co_sensitivity",
    "SELECT * REPLACE (coalesce(edges, 0) AS edges), density < 0.8::DOUBLE AS density_lt_80, density < 0.5::DOUBLE AS density_lt_50, density < 0.25::DOUBLE AS density_lt_25 FROM ("
    + " UNION ALL ".join(_configured(i, *c).replace("count(*) AS edges, 2.0::DOUBLE * count(*)", "count(src) AS edges, 2.0::DOUBLE * count(src)") for i, c in enumerate(_GRID)) + ")",
    "pairss", digits=("density", "pmi_mean", "pmi_median", "pmi_p25", "pmi_p75", "covered_share"),
)
def _(v: Views):
    return relations.e_co_sensitivity(v.links_sparse, _GRID)


@query(
    "d16_retention_curve",
    """SELECT step, top * step / 29.0::DOUBLE AS threshold, (SELECT count(*) FROM co WHERE weight >= top * step / 29.0::DOUBLE - 1e-12::DOUBLE) AS edges, (SELECT count(*) FROM co WHERE weight >= top * step / 29.0::DOUBLE - 1e-12::DOUBLE)::DOUBLE / total AS share
FROM (SELECT max(weight) AS top, count(*) AS total FROM co), (SELECT unnest(range(0, 30))::INTEGER AS step)""",
    "co", digits=("threshold", "share"),
)
def _(v: Views):
    return relations.retention_curve(v.co)


@query(
    "d17_weight_histogram",
    "SELECT least(floor((weight - lo) / (hi - lo) * 20), 19)::INTEGER AS bin, count(*) AS edges FROM sim, (SELECT min(weight) AS lo, max(weight) AS hi FROM sim) GROUP BY 1", "sim",
)
def _(v: Views):
    return relations.weight_histogram(v.sim)


@query("d17_weight_cdf", "SELECT DISTINCT support_count::DOUBLE AS weight, count(*) OVER (ORDER BY support_count)::DOUBLE / (SELECT count(*) FROM sim) AS cdf FROM sim", "sim", digits=("cdf",))
def _(v: Views):
    return relations.weight_cdf(v.sim_once.select(F.col("support_count").cast("double").alias("weight")))


_HIT = f"{unit_sql(f"interaction_id || '|' || skill_id || '|{SEED}'")} < 0.1::DOUBLE"


@query("d18_inject_label_noise", f"SELECT interaction_id, skill_id, CASE WHEN {_HIT} THEN 1 - correct ELSE correct END AS correct, {_HIT} AS noisy FROM train", "train")
def _(v: Views):
    return relations.inject_label_noise(v.train, 0.1, SEED).select("interaction_id", "skill_id", "correct", "noisy")


@query(
    "d18_inject_edge_noise",
    f"""WITH nd AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM (SELECT src AS node FROM sim UNION SELECT dst FROM sim)),
p AS (SELECT *, {unit_sql(f"src || '|' || dst || '|{SEED}'")} < 0.2::DOUBLE AS noisy, floor({unit_sql(f"dst || '|' || src || '|{SEED + 1}'")} * (SELECT max(n) FROM nd))::BIGINT AS i FROM sim)
SELECT src, CASE WHEN noisy AND node <> src THEN node ELSE dst END AS dst, support_count, noisy FROM p LEFT JOIN nd USING (i)""", "sim",
)
def _(v: Views):
    return relations.inject_edge_noise(v.sim.select("src", "dst", "support_count"), 0.2, SEED)


@query("d19_edge_drop", f"SELECT src, dst, support_count FROM sim WHERE {unit_sql(f"src || '|' || dst || '|{SEED}'")} >= 0.3::DOUBLE", "sim")
def _(v: Views):
    return relations.edge_drop(v.sim.select("src", "dst", "support_count"), 0.3, SEED)


@query("d19_node_drop", f"SELECT src, dst, support_count FROM sim WHERE {unit_sql(f"src || '|{SEED}'")} >= 0.2::DOUBLE AND {unit_sql(f"dst || '|{SEED}'")} >= 0.2::DOUBLE", "sim")
def _(v: Views):
    return relations.node_drop(v.sim.select("src", "dst", "support_count"), 0.2, SEED)


@query(
    "d20_topk_similarity_table",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sim), x AS (SELECT k, src, dst, weight FROM r JOIN (VALUES (3), (5), (10), (20)) ks(k) ON r <= k)
SELECT k, nodes, edges, edges::DOUBLE / (nodes * (nodes - 1)) AS density, avg_score, median_score FROM (SELECT k, count(*) AS edges, avg(weight) AS avg_score, median(weight) AS median_score FROM x GROUP BY 1)
JOIN (SELECT k, count(DISTINCT u) AS nodes FROM (SELECT k, unnest([src, dst]) AS u FROM x) GROUP BY 1) USING (k)""", "sim", digits=("density", "avg_score", "median_score"),
)
def _(v: Views):
    return relations.topk_similarity_table(v.sim)


_STATS = "SELECT nodes, m AS edges, {f} * m::DOUBLE / (nodes * (nodes - 1)) AS density, 2.0::DOUBLE * m / nodes AS avg_degree, weight_min, weight_max, weight_mean, weight_std FROM (SELECT count(*) AS m, min(weight) AS weight_min, max(weight) AS weight_max, avg(weight) AS weight_mean, stddev_samp(weight) AS weight_std FROM {e}), (SELECT count(DISTINCT u) AS nodes FROM (SELECT unnest([src, dst]) AS u FROM {e}))"
_W = ("density", "avg_degree", "weight_min", "weight_max", "weight_mean", "weight_std")


@query("e1_graph_stats", _STATS.format(f=2, e="co"), "co", digits=_W)
def _(v: Views):
    return graph.graph_stats(relations.both_ways(v.co), directed=False)


@query("e1_graph_stats_directed", _STATS.format(f=1, e="pre"), "pre", digits=_W)
def _(v: Views):
    return graph.graph_stats(v.pre)


@query("e2_connected_components", None)
def _(v: Views):
    lines = v.table("lineitem").join(v.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.connected_components(lines.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct())


@query(
    "e2_connected_components_places",
    """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(n, x) AS (SELECT src, src FROM b UNION SELECT r.n, b.dst FROM r JOIN b ON r.x = b.src) SELECT n AS node, min(x) AS component FROM r GROUP BY 1""",
)
def _(v: Views):
    named = lambda table, a, p, b, q: v.table(table).select(F.concat(F.lit(p), a).alias("src"), F.concat(F.lit(q), b).alias("dst"))
    return graph.connected_components(named("customer", "c_custkey", "c", "c_nationkey", "n").unionByName(named("supplier", "s_suppkey", "s", "s_nationkey", "n")).unionByName(named("nation", "n_nationkey", "n", "n_regionkey", "r")))


@query(
    "e3_edge_provenance_audit",
    """WITH m AS (SELECT * FROM edges UNION ALL SELECT relation_type, dst, src, weight, support_count, directed, source_split FROM edges WHERE relation_type = 'co')
SELECT relation_type, count(*) AS raw_rows, count(DISTINCT src || '>' || dst) AS unique_directed, count(DISTINCT least(src, dst) || '>' || greatest(src, dst)) AS unique_undirected,
CASE WHEN relation_type = 'co' THEN count(*) // 2 ELSE 0 END AS mirrored_pairs, sum((src = dst)::INTEGER)::BIGINT AS self_loops, count(*) - count(DISTINCT src || '>' || dst) AS duplicate_rows, sum(support_count)::BIGINT AS support_sum, avg(support_count) AS support_mean, median(support_count) AS support_median,
min(weight) AS weight_min, max(weight) AS weight_max, avg(weight) AS weight_mean, any_value(nodes) AS nodes, count(DISTINCT least(src, dst) || '>' || greatest(src, dst)) <= any_value(nodes) * (any_value(nodes) - 1) // 2 AS within_limit,
CASE WHEN relation_type = 'co' THEN 'mirrored' ELSE 'one row per edge' END AS interpretation
FROM m JOIN (SELECT relation_type, count(DISTINCT u) AS nodes FROM (SELECT relation_type, unnest([src, dst]) AS u FROM edges) GROUP BY 1) USING (relation_type) GROUP BY 1""",
    "edges", digits=("support_mean", "support_median", "weight_min", "weight_max", "weight_mean"),
)
def _(v: Views):
    return graph.edge_provenance_audit(relations.both_ways(v.edges, F.col("relation_type") == "co"))


@query(
    "e4_relation_availability",
    """SELECT r AS relation_type, m AS edges, d AS density, CASE WHEN m = 0 THEN 'absent' WHEN d < 0.05::DOUBLE THEN 'sparse' WHEN d < 0.5::DOUBLE THEN 'moderate' WHEN d < 0.8::DOUBLE THEN 'dense' ELSE 'very_dense' END AS flag FROM (
SELECT r, count(src) AS m, CASE WHEN r = 'pre' THEN 1 ELSE 2 END * count(src)::DOUBLE / (n * (n - 1)) AS d FROM (VALUES ('pre'), ('sim'), ('co'), ('other')) x(r) LEFT JOIN edges ON relation_type = r, (SELECT count(*) AS n FROM fq) GROUP BY r, n)""",
    "edges", "fq", digits=("density",),
)
def _(v: Views):
    n = v.links.agg(F.countDistinct("skill_id").alias("n_skills"))
    return graph.relation_availability(v.edges, n, [("pre", True), ("sim", False), ("co", False), ("other", False)])


_DEG = "(SELECT skill_id, count(*) AS degree FROM (SELECT unnest([u, w]) AS skill_id FROM (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS w FROM {e} WHERE src <> dst)) GROUP BY 1)"
_SPARSE = _controlled(3, 0.6, 5, "pairss")
_PAIRSS = """lss AS (SELECT DISTINCT learner_id, skill_id FROM trains),
pairss AS (SELECT src, dst, c AS support_count, ln(c::DOUBLE * (SELECT count(DISTINCT learner_id) FROM lss) / (x.n::DOUBLE * y.n)) AS pmi FROM (
SELECT a.skill_id AS src, b.skill_id AS dst, count(*) AS c FROM lss a JOIN lss b ON a.learner_id = b.learner_id AND a.skill_id < b.skill_id GROUP BY 1, 2)
JOIN (SELECT skill_id, count(*) AS n FROM lss GROUP BY 1) x ON x.skill_id = src JOIN (SELECT skill_id, count(*) AS n FROM lss GROUP BY 1) y ON y.skill_id = dst)"""


def _sparse_edges(v: Views):
    return relations.e_co_controlled(v.links_sparse, 3, 0.6, 5, mirrored=False)


@query(
    "e5_graph_coverage",
    f"""WITH {_PAIRSS}, z AS ({_SPARSE}), d AS (SELECT f.skill_id, f.n, coalesce(degree, 0) AS degree FROM (SELECT skill_id, count(*) AS n FROM trains GROUP BY 1) f LEFT JOIN {_DEG.format(e='z')} USING (skill_id))
SELECT count(*) AS n_skills, count(*) FILTER (degree > 0) AS covered, count(*) FILTER (degree = 0) AS isolated, avg((degree > 0)::INTEGER) AS covered_ratio, avg(degree) AS mean_degree, median(degree) AS median_degree,
avg(degree) FILTER (degree > 0) AS mean_degree_covered, median(degree) FILTER (degree > 0) AS median_degree_covered, {", ".join(f"avg((degree > 0)::INTEGER) FILTER (n <= {c}) AS covered_le_{c}" for c in (50, 100, 200))}, (SELECT count(*) FROM z) AS edges FROM d""",
    "trains", digits=("covered_ratio", "mean_degree", "median_degree", "mean_degree_covered", "median_degree_covered", "covered_le_50", "covered_le_100", "covered_le_200"),
)
def _(v: Views):
    return graph.graph_coverage(materialize(_sparse_edges(v)), v.links_sparse)


@query(
    "e6_sparse_coverage",
    f"WITH {_PAIRSS}, z AS ({_SPARSE}) SELECT count(*) AS sparse_skills, count(degree) AS covered, count(degree)::DOUBLE / count(*) AS sparse_coverage FROM (SELECT skill_id, count(*) AS n FROM trains GROUP BY 1 HAVING count(*) <= 40) LEFT JOIN {_DEG.format(e='z')} USING (skill_id)",
    "trains", digits=("sparse_coverage",),
)
def _(v: Views):
    return graph.sparse_coverage(_sparse_edges(v), v.links_sparse, 40)


_D3 = "(SELECT skill_id, " + ", ".join(f"count(*) FILTER (relation_type = '{r}') AS d_{r}" for r in ("pre", "sim", "co")) + " FROM (SELECT relation_type, unnest([u, w]) AS skill_id FROM (SELECT DISTINCT relation_type, least(src, dst) AS u, greatest(src, dst) AS w FROM edges)) GROUP BY 1)"


@query(
    "e7_stratum_degree_support",
    f"""SELECT stratum, count(*) AS n_skills, avg(coalesce(d_pre, 0)) AS mean_degree_pre, avg(coalesce(d_sim, 0)) AS mean_degree_sim, avg(coalesce(d_co, 0)) AS mean_degree_co, avg((d_pre IS NOT NULL)::INTEGER) AS coverage, avg((d_pre IS NULL)::INTEGER) AS isolation_rate,
sum(coalesce(n_test, 0))::BIGINT AS test_interactions, median(coalesce(d_co, 0)) AS median_degree_co FROM strata LEFT JOIN {_D3} USING (skill_id) LEFT JOIN (SELECT skill_id, count(*) AS n_test FROM test GROUP BY 1) USING (skill_id) GROUP BY 1""",
    "edges", "strata", "test", digits=("mean_degree_pre", "mean_degree_sim", "mean_degree_co", "coverage", "isolation_rate", "median_degree_co"),
)
def _(v: Views):
    return graph.stratum_degree_support(v.edges, v.strata, v.test)


@query(
    "e8_degree_feature",
    "SELECT skill_id, coalesce(d, 0) AS degree, coalesce(d, 0)::DOUBLE / (max(coalesce(d, 0)) OVER ()) AS degree_norm FROM fq LEFT JOIN (SELECT skill_id, count(*) AS d FROM (SELECT unnest([src, dst]) AS skill_id FROM edges WHERE relation_type IN ('pre', 'co')) GROUP BY 1) USING (skill_id)",
    "edges", "fq", digits=("degree_norm",),
)
def _(v: Views):
    return graph.degree_feature(v.edges, v.links, ["pre", "co"])


_GATES = [("no_graph", 0.0, 0.0, 0.0), ("pre", 1.0, 0.0, 0.0), ("sim+co", 0.0, 1.0, 1.0), ("full", 1.0, 1.0, 1.0)]
_BETAS = [0.0, 0.25, 0.5]
_GRID_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{g}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for g, a, b, c in _GATES) + ") g(variant, alpha_pre, alpha_sim, alpha_co), (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in _BETAS) + ") b(beta))"


@query(
    "e9_gated_degree",
    f"""WITH rare AS (SELECT skill_id FROM strata WHERE stratum IN ('very_sparse', 'sparse')), w AS (SELECT relation_type, weight, (src IN (SELECT * FROM rare) OR dst IN (SELECT * FROM rare)) AS rare, unnest([src, dst]) AS skill_id FROM edges),
s AS (SELECT variant, beta, skill_id, sum(CASE relation_type WHEN 'pre' THEN alpha_pre WHEN 'sim' THEN alpha_sim ELSE alpha_co END * weight * CASE WHEN rare THEN 1 + beta ELSE 1 END) AS d FROM w, {_GRID_SQL} GROUP BY 1, 2, 3),
x AS (SELECT variant, beta, skill_id, coalesce(d, 0) AS degree FROM fq CROSS JOIN {_GRID_SQL} LEFT JOIN s USING (variant, beta, skill_id))
SELECT *, CASE WHEN max(degree) OVER w2 > 0 THEN degree / max(degree) OVER w2 ELSE 0 END AS degree_norm FROM x WINDOW w2 AS (PARTITION BY variant, beta)""",
    "edges", "strata", "fq", digits=("degree", "degree_norm"),
)
def _(v: Views):
    return graph.gated_degree(v.edges, graph.gate_grid(v.spark, _GATES, _BETAS), v.strata, v.links)


@query("e10_gate_grid", f"SELECT variant, beta, count(*) AS n_edges, sum(alpha_pre + alpha_sim + alpha_co) AS gates FROM {_GRID_SQL}, edges GROUP BY 1, 2", "edges", digits=("gates",))
def _(v: Views):
    grid = graph.gate_grid(v.spark, _GATES, _BETAS)
    # all edges have the same gates, so they are counted before the grid is laid over them
    n = v.edges_once.agg(F.count("*").alias("n_edges")).where("n_edges > 0")
    return grid.crossJoin(F.broadcast(n)).groupBy("variant", "beta").agg(F.sum("n_edges").alias("n_edges"), F.sum((F.col("alpha_pre") + F.col("alpha_sim") + F.col("alpha_co")) * F.col("n_edges")).alias("gates"))


@query(
    "e11_density_audit",
    """SELECT relation_type, m AS edges, c AS covered, 2.0::DOUBLE * m / (n * (n - 1)) AS density, c::DOUBLE / n AS coverage FROM (SELECT relation_type, count(DISTINCT least(src, dst) || '>' || greatest(src, dst)) AS m FROM edges GROUP BY 1)
JOIN (SELECT relation_type, count(DISTINCT u) AS c FROM (SELECT relation_type, unnest([src, dst]) AS u FROM edges) GROUP BY 1) USING (relation_type), (SELECT count(*) AS n FROM fq)""",
    "edges", "fq", digits=("density", "coverage"),
)
def _(v: Views):
    return graph.density_audit(v.edges, v.links)
