"""Exact set similarity at high thresholds, without building the pairs that cannot reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._session import materialize
from ..functions.ranking import prefix_sums
from .relations import pairs_sharing

#: Bounds are loosened by this share, so that rounding never excludes a pair; the final comparison is exact.
_SLACK = 1 - 1e-12
#: Questions that the prefixes of two similar skills must share. One would do with shorter prefixes, but each pair that
#: shares one by chance is then looked up in whole; few share four.
AGREE = 4


def _at_least(x: Column) -> Column:
    """The smallest whole number that is not below ``x``, or one less where ``x`` is a whole number but for rounding."""
    return F.ceil(x * F.lit(_SLACK))


def _placed(train: DataFrame, theta: float) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs of skill and question, prefixes: question_id, skill_id, n, pos).

    The questions of a skill are put in one order for all skills, rare ones first; n is their number and pos a
    question's place from 0. Two sets of similarity theta share ceil(theta n) questions or more of either, so AGREE of
    them, or all if fewer, are among the first n - ceil(theta n) + AGREE of both. A question of a single skill leads to
    nobody.
    Places come from range partitions, so a skill with most of the rows spans many tasks.
    """
    own = materialize(train.select("skill_id", "question_id").na.drop().distinct())
    known = own.groupBy("question_id").agg(F.count("*").alias("f"))
    sizes = own.groupBy("skill_id").agg(F.count("*").alias("n"))
    ordered = prefix_sums(own.join(known, "question_id").withColumn("one", F.lit(1)), ["skill_id"], ["f", "question_id"], ["one"])
    sized = ordered.join(sizes, "skill_id").select("question_id", "skill_id", "f", "n", F.col("before_one").alias("pos"))
    return own, sized.where((F.col("pos") < F.col("n") - _at_least(theta * F.col("n")) + AGREE) & (F.col("f") > 1)).drop("f")


def _needed(theta: float) -> Column:
    """The least intersection with which sets of n1 and n2 elements reach theta."""
    return _at_least(F.lit(theta / (1 + theta)) * (F.col("n1") + F.col("n2")))


def _met(prefixes: DataFrame, theta: float) -> DataFrame:
    """One row per pair of skills and common question of their prefixes that leaves the pair a chance.

    Sizes must agree to theta, and the questions before and after the common one must suffice for the intersection.
    """
    rows = pairs_sharing(prefixes, "question_id", ("n", "pos")).withColumnsRenamed({"src_n": "n1", "dst_n": "n2"})
    i, j = F.col("src_pos"), F.col("dst_pos")
    reach = F.least(i, j) + 1 + F.least(F.col("n1") - i, F.col("n2") - j) - 1
    return rows.where((F.least("n1", "n2") >= theta * F.greatest("n1", "n2") * _SLACK) & (reach >= _needed(theta)))


def _candidates(met: DataFrame, theta: float) -> DataFrame:
    """(src, dst, n1, n2) of pairs that share enough prefix questions, and with all that follow the last of them would suffice."""
    counts = met.groupBy("src", "dst", "n1", "n2").agg(F.count("*").alias("c"), F.max("src_pos").alias("i"), F.max("dst_pos").alias("j"))
    rest = F.least(F.col("n1") - F.col("i"), F.col("n2") - F.col("j")) - 1
    return counts.where((F.col("c") >= F.least(F.lit(AGREE), _needed(theta))) & (F.col("c") + rest >= _needed(theta))).select("src", "dst", "n1", "n2")


def _verified(candidates: DataFrame, own: DataFrame, theta: float) -> DataFrame:
    """The candidates with their whole intersections, looked up question by question from the smaller set."""
    first = F.col("n1") <= F.col("n2")
    sides = candidates.select("*", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("small"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("large"))
    asked = sides.join(own.select(F.col("skill_id").alias("small"), "question_id"), "small")
    shared = asked.join(own.select(F.col("skill_id").alias("large"), "question_id"), ["large", "question_id"])
    counts = shared.groupBy("src", "dst", "n1", "n2").agg(F.count("*").alias("support_count"))
    weight = F.col("support_count").cast("double") / (F.col("n1") + F.col("n2") - F.col("support_count"))
    return counts.select("src", "dst", weight.alias("weight"), "support_count").where(F.col("weight") >= theta)


def similar_sets(train: DataFrame, theta: float) -> DataFrame:
    """(src, dst, weight, support_count): all pairs of skills whose question sets have a Jaccard similarity of ``theta`` or more.

    The rows are those of the join on every common question. Here pairs meet by the rare questions of their prefixes
    only, are dropped where sizes or places rule them out, and the few that are left are looked up in whole. Repeated
    rows count once; rows without a skill or a question do not count; an empty table has no pairs. Frequent questions
    come last in every set, so they seldom are in a prefix; one that is, is dealt out in blocks.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be above 0 and at most 1")
    own, prefixes = _placed(train, theta)
    return _verified(_candidates(_met(prefixes, theta), theta), own, theta)


def similarity_work(train: DataFrame, theta: float) -> DataFrame:
    """One row: pairs_met in prefixes, pairs_verified after all bounds, pairs_at_theta."""
    if not 0 < theta <= 1:
        raise ValueError("theta must be above 0 and at most 1")
    own, prefixes = _placed(train, theta)
    met = _met(prefixes, theta)
    pairs = materialize(_candidates(met, theta))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(met.select("src", "dst").distinct(), "pairs_met").crossJoin(count(pairs, "pairs_verified")).crossJoin(count(_verified(pairs, own, theta), "pairs_at_theta"))
