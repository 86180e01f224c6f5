"""Dataset statistics, skill profiles and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from ..functions.ranking import global_row_number


def dataset_stats(df: DataFrame, q_source: str = "provided_static") -> DataFrame:
    learners, rows = F.countDistinct("learner_id"), F.count("*")
    return df.agg(
        learners.alias("n_learners"), F.countDistinct("question_id").alias("n_questions"), F.countDistinct("skill_id").alias("n_skills"),
        rows.alias("n_interactions"), safe_ratio(rows, learners).alias("avg_sequence_length"), F.lit(q_source).alias("q_source"),
    )


def split_stats(splits: DataFrame, min_rows: int = 100_000) -> DataFrame:
    """Per fold: users, questions, skills and interactions in total and per split; per-user and per-skill sizes; skill size classes."""
    names = {"users": "learner_id", "questions": "question_id", "skills": "skill_id"}
    aggs = [F.count("*").alias("interactions_total")]
    for label, col in names.items():
        aggs.append(F.countDistinct(col).alias(f"{label}_total"))
    for split in ("train", "valid", "test"):
        here = F.col("split") == split
        aggs.append(F.sum(F.when(here, 1).otherwise(0)).alias(f"interactions_{split}"))
        aggs += [F.countDistinct(F.when(here, F.col(col))).alias(f"{label}_{split}") for label, col in names.items()]
    base = splits.groupBy("fold").agg(*aggs)
    users = splits.groupBy("fold", "learner_id").count().groupBy("fold").agg(F.avg("count").alias("mean_per_user"), F.median("count").alias("median_per_user"))
    n = F.col("count")
    skills = splits.groupBy("fold", "skill_id").count().groupBy("fold").agg(
        F.avg(n).alias("mean_per_skill"), F.median(n).alias("median_per_skill"),
        *[F.sum(F.when(n <= t, 1).otherwise(0)).alias(f"skills_le_{t}") for t in (50, 100, 200, 500)],
        F.sum(F.when(n > 500, 1).otherwise(0)).alias("skills_gt_500"),
    )
    return base.join(users, "fold").join(skills, "fold").withColumn("subsampled", F.col("interactions_total") < min_rows)


def cell_intensity(train: DataFrame) -> DataFrame:
    """Interactions per (user, skill) cell; 0 when there is no cell."""
    cells = F.countDistinct("learner_id") * F.countDistinct("skill_id")
    return train.agg(F.coalesce(safe_ratio(F.count("*"), cells), F.lit(0.0)).alias("cell_intensity"))


def scale_audit(stats: DataFrame, targets: dict[str, int]) -> DataFrame:
    """(metric, value, target, status): PASS where a statistic reaches its target, else WARN."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value"), F.lit(v).cast("long").alias("target")) for k, v in targets.items()])
    rows = stats.select(F.explode(pairs).alias("r")).select("r.*")
    return rows.withColumn("status", F.when(F.col("value") >= F.col("target"), "PASS").otherwise("WARN"))


def skill_frequency_distribution(df: DataFrame, width: int = 100) -> DataFrame:
    """Skills per bin of ``width`` interactions."""
    sizes = df.groupBy("skill_id").count()
    return sizes.groupBy((F.floor(F.col("count") / width) * width).alias("bin_start")).agg(F.count("*").alias("n_skills"))


def skill_profile(train: DataFrame) -> DataFrame:
    return train.groupBy("skill_id").agg(
        F.count("*").alias("n_interactions"), F.countDistinct("learner_id").alias("n_learners"), F.avg("correct").alias("avg_correct"), F.countDistinct("question_id").alias("n_questions")
    )


def strata_percentile(profile: DataFrame, low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Profile with strata: up to the low percentile sparse, up to the high one medium, else dense.

    The percentile holds one entry per distinct size, of which n rows have about sqrt(2 n) at most.
    """
    cuts = profile.agg(F.percentile("n_interactions", F.array(F.lit(low), F.lit(high))).alias("__c"))
    n = F.col("n_interactions")
    return profile.crossJoin(F.broadcast(cuts)).withColumn("strata", F.when(n <= F.col("__c")[0], "sparse").when(n <= F.col("__c")[1], "medium").otherwise("dense")).drop("__c")


def strata_rank(train: DataFrame, cuts: tuple[float, float, float] = (0.10, 0.33, 0.66)) -> DataFrame:
    """(skill_id, n_interactions, stratum) by rank of frequency, ties by id; slices end at int(q n).

    Skills are ranked over range partitions. A table without rows gives none.
    """
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n_interactions"))
    placed = global_row_number(sizes, ["n_interactions", "skill_id"], "__r")
    ranked = placed.crossJoin(F.broadcast(placed.agg(F.max("__r").alias("__n"))))  # one row
    stratum = F.lit("frequent")
    for name, q in reversed(list(zip(("very_sparse", "sparse", "medium"), cuts))):
        stratum = F.when(F.col("__r") <= F.floor(F.col("__n") * F.lit(q)), name).otherwise(stratum)
    return ranked.select("skill_id", "n_interactions", stratum.alias("stratum"))


def strata_absolute(train: DataFrame, cuts: tuple[int, int, int] = (50, 100, 500)) -> DataFrame:
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n_interactions"))
    n = F.col("n_interactions")
    return sizes.withColumn("stratum", F.when(n <= cuts[0], "very_sparse").when(n <= cuts[1], "sparse").when(n <= cuts[2], "medium").otherwise("frequent"))


def bins_table(spark: SparkSession, bins: list[tuple[str, int, int | None]]) -> DataFrame:
    return spark.createDataFrame([(b, lo, hi) for b, lo, hi in bins], "stratum string, low long, high long")


def strata_bins(train: DataFrame, bins: DataFrame) -> DataFrame:
    """(skill_id, n_interactions, stratum) by range join to a small table of named [low, high) bins."""
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n_interactions"))
    n = F.col("n_interactions")
    return sizes.join(bins, (n >= F.col("low")) & (F.col("high").isNull() | (n < F.col("high")))).select("skill_id", "n_interactions", "stratum")


def frequency_bins(train: DataFrame, cumulative: bool = False) -> DataFrame:
    """(bin, skill_id, n_interactions): disjoint size classes, or cumulative ones in which a skill stands in every bin that holds it."""
    sizes = train.groupBy("skill_id").agg(F.count("*").alias("n_interactions"))
    n = F.col("n_interactions")
    if not cumulative:
        name = F.when(n <= 50, "le50").when(n <= 100, "51-100").when(n <= 200, "101-200").when(n <= 500, "201-500").otherwise("gt500")
        return sizes.select(name.alias("bin"), "skill_id", "n_interactions")
    named = F.array(*[F.when(n <= t, F.lit(f"le{t}")) for t in (50, 100, 200)], F.when(n > 500, F.lit("gt500")))
    return sizes.select(F.explode(F.array_compact(named)).alias("bin"), "skill_id", "n_interactions")


def strata_summary(strata: DataFrame, col: str = "strata") -> DataFrame:
    n = F.col("n_interactions")
    return strata.groupBy(F.col(col).alias("stratum")).agg(
        F.count("*").alias("n_skills"), F.avg(n).alias("avg_interactions"), F.min(n).alias("min_interactions"), F.max(n).alias("max_interactions")
    )


def strata_box_stats(strata: DataFrame, col: str = "strata") -> DataFrame:
    """Five-number summary of skill sizes per stratum."""
    q = F.percentile("n_interactions", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("low", "q25", "median", "q75", "high")
    return strata.groupBy(F.col(col).alias("stratum")).agg(q.alias("q")).select("stratum", *[F.col("q")[i].alias(c) for i, c in enumerate(names)])
