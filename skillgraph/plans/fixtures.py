"""Views of the driver's tables as interaction logs, predictions and runs, in Spark and in DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._session import written
from ..functions.columns import hashed_unit
from ..operators import features, metrics, relations, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 2026

#: variant, alpha_pre, alpha_sim, alpha_co, place in the candidate order, complexity, reach of its shift
VARIANTS = [("no_graph", 0.0, 0.0, 0.0, 0, 0, 0.0), ("pre", 1.0, 0.0, 0.0, 1, 1, 0.02), ("sim", 0.0, 1.0, 0.0, 2, 1, 0.05), ("co", 0.0, 0.0, 1.0, 3, 1, 0.1), ("full", 1.0, 1.0, 1.0, 4, 3, 0.2)]
SEEDS = [7, 11, 13]


def unit_sql(text: str) -> str:
    """The md5 number in [0, 1) of a SQL text expression."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def four_places_sql(x: str) -> str:
    """A SQL number of 0 or more with four decimals, from whole ten-thousandths."""
    return f"(floor({x} * 10000 + 0.500001::DOUBLE)::BIGINT // 10000)::VARCHAR || '.' || lpad((floor({x} * 10000 + 0.500001::DOUBLE)::BIGINT % 10000)::VARCHAR, 4, '0')"


class Views:
    """The views over one folder of tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._kept = spark, sf_dir, False

    def keep(self) -> Views:
        """Writes the split once, for views and queries that read it several times; each then reads the columns it needs."""
        if not self._kept:
            self.split, self._kept = written(self.split), True
            for name in ("train", "test", "links"):
                vars(self).pop(name, None)
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _lines(self) -> DataFrame:
        epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
        price = F.round(F.col("l_extendedprice") * 100).cast("long")
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], epoch.cast("string"), price.cast("string"))
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            key.alias("interaction_id"), F.col("o_custkey").cast("string").alias("learner_id"), F.col("l_partkey").cast("string").alias("question_id"),
            F.col("l_suppkey").cast("string").alias("skill_id"), epoch.alias("timestamp"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("correct"), "l_partkey",
        )

    @cached_property
    def ix(self) -> DataFrame:
        return self._lines.drop("l_partkey")

    @cached_property
    def ix_sparse(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("sk"))
        return self._lines.join(part, "l_partkey").withColumn("skill_id", F.col("sk")).drop("sk", "l_partkey")

    @cached_property
    def split(self) -> DataFrame:
        return splits.learner_split(self.ix, seed=SEED)

    @cached_property
    def train(self) -> DataFrame:
        return self.split.where("split = 'train'").drop("fold", "split")

    @cached_property
    def test(self) -> DataFrame:
        return self.split.where("split = 'test'").drop("fold", "split")

    @cached_property
    def links(self) -> DataFrame:
        """Learner, question, skill and time of the train rows, which relations are built from, written once."""
        return written(self.train.select("learner_id", "question_id", "skill_id", "timestamp"))

    @cached_property
    def train_sparse(self) -> DataFrame:
        return splits.learner_split(self.ix_sparse, seed=SEED).where("split = 'train'").drop("fold", "split")

    @cached_property
    def links_sparse(self) -> DataFrame:
        """Learner and skill of the train rows by brand and size, written once."""
        return written(self.train_sparse.select("learner_id", "skill_id"))

    @cached_property
    def q(self) -> DataFrame:
        pairs = self.ix.select("question_id", "skill_id").distinct()
        return pairs.withColumns({"source": F.lit("provided_static"), "source_version": F.lit("1"), "is_train_only": F.lit("false")})

    @cached_property
    def pre(self) -> DataFrame:
        return written(relations.e_pre_topk(self.links, 5))

    @cached_property
    def theta(self) -> float:
        """The Jaccard similarity expected of two skills spread over the questions by chance; about half of all pairs reach it."""
        n = self.links.agg(F.count("*"), F.countDistinct("question_id"), F.countDistinct("skill_id")).first()
        p = 1 - math.exp(-n[0] / max(1, n[1] * n[2]))
        return p / (2 - p)

    @cached_property
    def sim_once(self) -> DataFrame:
        """Similarity for queries that read it once, and so need not write it."""
        return relations.e_sim(self.links, self.theta)

    @cached_property
    def sim(self) -> DataFrame:
        return written(self.sim_once)

    @cached_property
    def co_once(self) -> DataFrame:
        """Co-occurrence for queries that read it once."""
        return relations.e_co(self.links)

    @cached_property
    def co(self) -> DataFrame:
        return written(self.co_once)

    @cached_property
    def edges_once(self) -> DataFrame:
        """``edges`` for queries that read them once."""
        return self._edges(self.sim_once, self.co_once)

    @cached_property
    def edges(self) -> DataFrame:
        return self._edges(self.sim, self.co)

    def _edges(self, sim: DataFrame, co: DataFrame) -> DataFrame:
        """All relations: relation_type, src, dst, weight, support_count, directed, source_split."""
        pre = relations.e_pre_support(self.pre.drop("step"), self.links).select(F.lit("pre").alias("relation_type"), "src", "dst", "weight", "support_count", F.lit(True).alias("directed"))
        named = lambda df, name: df.select(F.lit(name).alias("relation_type"), "src", "dst", "weight", "support_count", F.lit(False).alias("directed"))
        return pre.unionByName(named(sim, "sim")).unionByName(named(co, "co")).withColumn("source_split", F.lit("train"))

    @cached_property
    def preds(self) -> DataFrame:
        """Predictions on valid and test rows under run keys: prior success rate, shifted per variant by a bounded md5 amount."""
        held = self.split.where("split <> 'train'")
        base = features.prior_features(held).withColumn("base", (F.col("prior_correct") + 1).cast("double") / (F.col("prior_attempts") + 2))
        variants = F.array(*[F.struct(F.lit(v[0]).alias("variant"), F.lit(v[6]).alias("reach")) for v in VARIANTS])
        grid = base.select("interaction_id", "skill_id", "learner_id", "split", F.col("correct").alias("y_true"), "base", F.explode(variants).alias("v"), F.lit(0).alias("_"))
        grid = grid.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
        shift = (hashed_unit(F.col("interaction_id"), F.col("v.variant"), F.col("seed")) - 0.5 + 0.1 * F.col("y_true")) * F.col("v.reach")
        score = F.round(F.greatest(F.least(F.col("base") + shift, F.lit(0.999)), F.lit(0.001)), 3)
        fold = F.floor(hashed_unit(F.col("learner_id")) * 2).cast("int")
        return grid.select("interaction_id", "skill_id", "y_true", score.alias("y_pred"), F.lit("tpch").alias("dataset"), fold.alias("fold"), "seed", F.lit("proxy").alias("model"), F.col("v.variant").alias("variant"), "split")

    RUN = ["dataset", "fold", "seed", "model", "variant"]

    @cached_property
    def test_preds(self) -> DataFrame:
        return self.preds.where("split = 'test'").drop("split")

    @cached_property
    def runs(self) -> DataFrame:
        rows = metrics.metrics(self.preds, [*self.RUN, "split"]).select(*self.RUN, "split", *[F.round(m, 4).alias(m) for m in ("auc", "acc", "nll")])
        aggs = [F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("valid", "test") for m in ("auc", "acc", "nll")]
        info = self.spark.createDataFrame(VARIANTS, "variant string, alpha_pre double, alpha_sim double, alpha_co double, order int, complexity int, reach double").drop("reach")
        return rows.groupBy(*self.RUN).agg(*aggs).join(F.broadcast(info), "variant").withColumn("beta", F.lit(0.0))

    @cached_property
    def strata(self) -> DataFrame:
        from ..operators.profile import strata_rank

        return strata_rank(self.links)

    @cached_property
    def logs(self) -> DataFrame:
        """Epoch curves derived from the events table: one run per user, one epoch per day of the month."""
        e = self.table("events").select("user_id", "ts", "value", "event_id")
        rows = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("v"))
        return rows.select("run_id", "epoch", (F.col("v") / 100 + 1.0 / F.col("epoch")).alias("train_loss"), (F.col("v") / 100 + 1.1 / F.col("epoch")).alias("valid_loss"), (F.col("v") / 200 + 0.25).alias("valid_auc"), F.col("v").alias("grad_norm"))


_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch(l_shipdate)::BIGINT, round(l_extendedprice * 100)::BIGINT)"
_ROW = f"{_KEY} AS interaction_id, o_custkey::VARCHAR AS learner_id, l_partkey::VARCHAR AS question_id, {{skill}} AS skill_id, epoch(l_shipdate)::BIGINT AS timestamp, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS correct"


def _split_cte(name: str, rows: str) -> str:
    return f"""{name}_lr AS (SELECT learner_id, row_number() OVER (ORDER BY md5(learner_id || '|{SEED}'), learner_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT learner_id FROM {rows})),
{name} AS (SELECT {rows}.*, 0 AS fold, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM {rows} JOIN {name}_lr USING (learner_id))"""


#: Common table expressions by name; each may use those before it.
CTES = {
    "ix": f"ix AS (SELECT {_ROW.format(skill='l_suppkey::VARCHAR')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "ix_sparse": f"ix_sparse AS (SELECT {_ROW.format(skill="p_brand || '/' || p_size")} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)",
    "sp": _split_cte("sp", "ix"),
    "sps": _split_cte("sps", "ix_sparse"),
    "train": "train AS (SELECT * EXCLUDE (fold, split) FROM sp WHERE split = 'train')",
    "test": "test AS (SELECT * EXCLUDE (fold, split) FROM sp WHERE split = 'test')",
    "trains": "trains AS (SELECT * EXCLUDE (fold, split) FROM sps WHERE split = 'train')",
    "q": "q AS (SELECT DISTINCT question_id, skill_id, 'provided_static' AS source, '1' AS source_version, 'false' AS is_train_only FROM ix)",
    "rk": "rk AS (SELECT skill_id, t, row_number() OVER (ORDER BY t, skill_id) AS r FROM (SELECT skill_id, median(timestamp) AS t FROM train GROUP BY 1))",
    "pre": "pre AS (SELECT a.skill_id AS src, b.skill_id AS dst, 1.0::DOUBLE AS weight, b.r - a.r AS step FROM rk a JOIN rk b ON b.r > a.r AND b.r <= a.r + 5)",
    "fq": "fq AS (SELECT skill_id, count(*) AS n FROM train GROUP BY 1)",
    "own": "own AS (SELECT DISTINCT skill_id, question_id FROM train)",
    "simall": """simall AS (SELECT src, dst, c::DOUBLE / (x.n + y.n - c) AS weight, c AS support_count FROM (
SELECT a.skill_id AS src, b.skill_id AS dst, count(*) AS c FROM own a JOIN own b ON a.question_id = b.question_id AND a.skill_id < b.skill_id GROUP BY 1, 2)
JOIN (SELECT skill_id, count(*) AS n FROM own GROUP BY 1) x ON x.skill_id = src JOIN (SELECT skill_id, count(*) AS n FROM own GROUP BY 1) y ON y.skill_id = dst)""",
    "th": "th AS (SELECT p / (2 - p) AS theta FROM (SELECT 1 - exp(-count(*)::DOUBLE / (count(DISTINCT question_id) * count(DISTINCT skill_id))) AS p FROM train))",
    "sim": "sim AS (SELECT * FROM simall WHERE weight >= (SELECT theta FROM th))",
    "ls": "ls AS (SELECT DISTINCT learner_id, skill_id FROM train)",
    "pairs": """pairs AS (SELECT src, dst, c AS support_count, ln(c::DOUBLE * (SELECT count(DISTINCT learner_id) FROM ls) / (x.n::DOUBLE * y.n)) AS pmi FROM (
SELECT a.skill_id AS src, b.skill_id AS dst, count(*) AS c FROM ls a JOIN ls b ON a.learner_id = b.learner_id AND a.skill_id < b.skill_id GROUP BY 1, 2)
JOIN (SELECT skill_id, count(*) AS n FROM ls GROUP BY 1) x ON x.skill_id = src JOIN (SELECT skill_id, count(*) AS n FROM ls GROUP BY 1) y ON y.skill_id = dst)""",
    "lss": "lss AS (SELECT DISTINCT learner_id, skill_id FROM trains)",
    "co": "co AS (SELECT src, dst, pmi AS weight, support_count FROM pairs WHERE support_count >= 2 AND pmi > 0)",
    "edges": """edges AS (SELECT 'pre' AS relation_type, src, dst, weight, a.n + b.n AS support_count, true AS directed, 'train' AS source_split FROM pre JOIN fq a ON a.skill_id = src JOIN fq b ON b.skill_id = dst
UNION ALL SELECT 'sim', src, dst, weight, support_count, false, 'train' FROM sim UNION ALL SELECT 'co', src, dst, weight, support_count, false, 'train' FROM co)""",
    "strata": """strata AS (SELECT skill_id, n AS n_interactions, CASE WHEN r <= floor(m * 0.1::DOUBLE) THEN 'very_sparse' WHEN r <= floor(m * 0.33::DOUBLE) THEN 'sparse' WHEN r <= floor(m * 0.66::DOUBLE) THEN 'medium' ELSE 'frequent' END AS stratum
FROM (SELECT skill_id, n, row_number() OVER (ORDER BY n, skill_id) AS r, count(*) OVER () AS m FROM fq))""",
    "vs": "vs(variant, alpha_pre, alpha_sim, alpha_co, \"order\", complexity, reach) AS (VALUES " + ", ".join(f"('{v[0]}', {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}, {v[5]}, {v[6]}::DOUBLE)" for v in VARIANTS) + ")",
    "held": """held AS (SELECT *, coalesce(sum(correct) OVER w, 0)::BIGINT AS prior_correct, count(*) OVER w AS prior_attempts FROM sp WHERE split <> 'train'
WINDOW w AS (PARTITION BY learner_id, skill_id ORDER BY timestamp, interaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "preds": f"""preds AS (SELECT interaction_id, skill_id, correct AS y_true, round(greatest(least((prior_correct + 1)::DOUBLE / (prior_attempts + 2)
 + ({unit_sql("interaction_id || '|' || variant || '|' || seed")} - 0.5::DOUBLE + 0.1::DOUBLE * correct) * reach, 0.999::DOUBLE), 0.001::DOUBLE), 3) AS y_pred,
'tpch' AS dataset, floor({unit_sql("learner_id")} * 2)::INTEGER AS fold, seed, 'proxy' AS model, variant, split FROM held, vs, (VALUES {", ".join(f"({s})" for s in SEEDS)}) s(seed))""",
    "tp": "tp AS (SELECT * EXCLUDE (split) FROM preds WHERE split = 'test')",
}


def auc_sql(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) END AS auc FROM (
SELECT {keys}, y_pred, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY y_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
SELECT {keys}, y_pred, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {rows} GROUP BY {keys}, y_pred)) GROUP BY {keys})"""


P_SQL = "greatest(least(y_pred, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE)"
ACC_SQL = "avg(CASE WHEN (y_pred >= 0.5::DOUBLE) = (y_true = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
NLL_SQL = f"-avg(CASE WHEN y_true = 1 THEN ln({P_SQL}) ELSE ln(1 - {P_SQL}) END)"
RMSE_SQL = "sqrt(avg((y_pred - y_true) * (y_pred - y_true)))"
RUN_SQL = "dataset, fold, seed, model, variant"

CTES["pairss"] = CTES["pairs"].replace("pairs AS", "pairss AS", 1).replace("FROM ls", "FROM lss").replace("JOIN ls", "JOIN lss")
CTES["runs"] = f"""rm AS (SELECT {RUN_SQL}, split, round(auc, 4) AS auc, round(acc, 4) AS acc, round(nll, 4) AS nll FROM (SELECT {RUN_SQL}, split, {ACC_SQL} AS acc, {NLL_SQL} AS nll FROM preds GROUP BY {RUN_SQL}, split)
JOIN {auc_sql('preds', RUN_SQL + ', split')} USING ({RUN_SQL}, split)),
runs AS (SELECT r.*, alpha_pre, alpha_sim, alpha_co, "order", complexity, 0.0::DOUBLE AS beta FROM (SELECT {RUN_SQL}, """ + ", ".join(f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in ("valid", "test") for m in ("auc", "acc", "nll")) + f""" FROM rm GROUP BY {RUN_SQL}) r JOIN vs USING (variant))"""
CTES["logs"] = """logs AS (SELECT run_id, epoch, v / 100 + 1.0::DOUBLE / epoch AS train_loss, v / 100 + 1.1::DOUBLE / epoch AS valid_loss, v / 200 + 0.25::DOUBLE AS valid_auc, v AS grad_norm
FROM (SELECT 'u' || user_id AS run_id, day(ts)::INTEGER AS epoch, round(avg(value), 6) AS v FROM events GROUP BY 1, 2))"""

_NEEDS = {
    "ix": [], "ix_sparse": [], "sp": ["ix"], "sps": ["ix_sparse"], "train": ["sp"], "test": ["sp"], "trains": ["sps"], "q": ["ix"], "rk": ["train"], "pre": ["rk"], "fq": ["train"], "own": ["train"],
    "simall": ["own"], "th": ["train"], "sim": ["simall", "th"], "ls": ["train"], "pairs": ["ls"], "lss": ["trains"], "pairss": ["lss"], "co": ["pairs"], "edges": ["pre", "fq", "sim", "co"], "strata": ["fq"], "vs": [], "held": ["sp"], "preds": ["held", "vs"],
    "tp": ["preds"], "runs": ["preds"], "logs": [],
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the common table expressions it names and those they need."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    if not wanted:
        return sql
    views = ",\n".join(CTES[n] for n in wanted)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql[len(start):]}"
    return f"WITH {views}\n{sql}"


def query(name: str, sql: str | None, *views: str, digits: dict[str, int] | tuple[str, ...] = ()):
    """Register ``fn(Views) -> DataFrame`` with its SQL. Columns in ``digits`` are rounded to 6 places on both sides,
    since engines add doubles in different orders."""
    places = digits if isinstance(digits, dict) else {c: 6 for c in digits}

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Views(spark, sf_dir))
            return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()}) if places else df

        QUERIES[name] = run
        if sql is not None:
            body = with_views(sql.strip(), *views)
            if places:
                body = "SELECT * REPLACE (" + ", ".join(f"round({c}, {n}) + 0.0::DOUBLE AS {c}" for c, n in places.items()) + f") FROM ({body})"
            ORACLES[name] = body
        return fn

    return register
