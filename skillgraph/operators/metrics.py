"""Prediction metrics, grouped by any run keys. An undefined metric is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import exact_mean, safe_ratio
from ..functions.ranking import prefix_sums


def auc(preds: DataFrame, keys: list[str]) -> DataFrame:
    """ROC AUC per key, ties averaged, null where only one class stands.

    Rows are counted per distinct score first; those counts are summed over range partitions of (keys, score).
    """
    return _scored(preds, keys).groupBy(*keys).agg(_auc_of_scores().alias("auc"))


def _scored(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_pred, rows, pos, neg, before_neg): one row per distinct score, with the negatives below it."""
    counts = preds.groupBy(*keys, "y_pred").agg(F.count("*").alias("rows"), F.sum("y_true").alias("pos"), F.sum(1 - F.col("y_true")).alias("neg"))
    return prefix_sums(counts, keys, ["y_pred"], ["neg"])


def _auc_of_scores() -> Column:
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    return safe_ratio(won, F.sum("pos").cast("double") * F.sum("neg"))


def _clipped(eps: float) -> Column:
    p = F.col("y_pred")
    return F.when(p.isNotNull(), F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps)))  # greatest and least pass over nulls


def accuracy_of(cut: float = 0.5, strict: bool = False) -> Column:
    over = F.col("y_pred") > cut if strict else F.col("y_pred") >= cut
    return F.avg((over.cast("int") == F.col("y_true")).cast("double"))


def nll_of(eps: float = 1e-7) -> Column:
    p = _clipped(eps)
    return -F.avg(F.when(F.col("y_true") == 1, F.log(p)).when(F.col("y_true") == 0, F.log(1 - p)))


def brier_of() -> Column:
    return F.avg(F.pow(F.col("y_pred") - F.col("y_true"), F.lit(2.0)))


def rmse_of() -> Column:
    return F.sqrt(brier_of())


def accuracy(preds: DataFrame, keys: list[str], cut: float = 0.5, strict: bool = False) -> DataFrame:
    return preds.groupBy(*keys).agg(accuracy_of(cut, strict).alias("acc"))


def nll(preds: DataFrame, keys: list[str], eps: float = 1e-7) -> DataFrame:
    return preds.groupBy(*keys).agg(nll_of(eps).alias("nll"))


def rmse(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(rmse_of().alias("rmse"))


def brier(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(brier_of().alias("brier"))


def metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """n, AUC, accuracy, NLL and RMSE per key, from one pass: ``preds`` are counted per distinct score and label.

    Rows without a score or label count in n only.
    """
    p = _clipped(1e-7)
    known = F.sum(F.when(F.col("y_pred").isNotNull(), F.col("pos") + F.col("neg")))
    mean = lambda of_one, of_zero: safe_ratio(F.sum(F.col("pos") * of_one + F.col("neg") * of_zero), known)
    over = (F.col("y_pred") >= 0.5).cast("double")
    square = lambda label: F.pow(F.col("y_pred") - label, F.lit(2.0))
    return _scored(preds, keys).groupBy(*keys).agg(
        F.sum("rows").alias("n"), mean(over, 1 - over).alias("acc"), (-mean(F.log(p), F.log(1 - p))).alias("nll"), F.sqrt(mean(square(1), square(0))).alias("rmse"), _auc_of_scores().alias("auc"),
    )


def reliability_table(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(bin, n, accuracy, confidence) of equal-width score bins; a score of 1 is in the last. Means do not depend on the order of rows."""
    place = F.least(F.floor(F.col("y_pred") * bins), F.lit(bins - 1)).cast("int")
    return preds.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.avg("y_true").alias("accuracy"), exact_mean("y_pred").alias("confidence"))


def ece(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps between accuracy and confidence, weighted by their rows."""
    table = reliability_table(preds, keys, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence")))
    return table.groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def prediction_stats(preds: DataFrame, keys: list[str]) -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("y_pred").alias("pred_mean"), F.stddev_pop("y_pred").alias("pred_std"), F.min("y_pred").alias("pred_min"), F.max("y_pred").alias("pred_max"),
        F.avg("y_true").alias("positive_rate"),
    )


def stratified_metrics(preds: DataFrame, strata: DataFrame, keys: list[str]) -> DataFrame:
    """``metrics`` per key and stratum; strata without rows have n = 0 and null metrics."""
    placed = preds.join(strata.select("skill_id", "stratum"), "skill_id", "left")
    found = metrics(placed, [*keys, "stratum"])  # skills without a stratum keep their keys here and meet no stratum below
    every = found.select(*keys).distinct().crossJoin(strata.select("stratum").distinct())
    joined = every.join(found, [*keys, "stratum"], "left")
    return joined.select(*keys, "stratum", F.coalesce("n", F.lit(0)).alias("n"), "auc", "acc", "nll", "rmse")


def reliability_flag(n: Column, strict: bool = False) -> Column:
    high, low = (n > 1000, n > 100) if strict else (n >= 1000, n >= 100)
    return F.when(high, "Reliable").when(low, "Limited").otherwise("Insufficient")
