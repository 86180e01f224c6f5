"""Sequence features, prior-performance features and the logistic predictor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._session import materialize
from ..functions.ranking import prefix_sums


def _trimmed(df: DataFrame, max_seq: int) -> DataFrame:
    """The last ``max_seq`` interactions of learners with two or more, with their place from 1.

    Lengths are counted map-side and the bound is a literal, so each task keeps ``max_seq`` rows of a learner before the
    shuffle, and a learner with most of the rows sends few. Rows without a learner do not count.
    """
    back = Window.partitionBy("learner_id").orderBy(F.desc("timestamp"), F.desc("interaction_id"))
    last = df.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= max_seq)
    lengths = df.groupBy("learner_id").agg(F.count("*").alias("__n")).where("__n >= 2")
    return last.join(lengths, "learner_id").withColumn("place", F.least(F.col("__n"), F.lit(max_seq)) - F.col("__back") + 1).drop("__back", "__n")


def learner_sequences(df: DataFrame, max_seq: int = 200) -> DataFrame:
    """(learner_id, skills, corrects, n): arrays in time order, at most ``max_seq`` long."""
    step = F.struct("place", "skill_id", "correct")
    rows = _trimmed(df, max_seq).groupBy("learner_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return rows.select("learner_id", F.col("s.skill_id").alias("skills"), F.col("s.correct").alias("corrects"), F.size("s").alias("n"))


def next_step_examples(df: DataFrame, max_seq: int = 200) -> DataFrame:
    """(learner_id, place, skill_id, correct, next_skill, next_correct, next_interaction): each step and the one after it."""
    w = Window.partitionBy("learner_id").orderBy("place")
    rows = _trimmed(df, max_seq).withColumns(
        {"next_skill": F.lead("skill_id").over(w), "next_correct": F.lead("correct").over(w), "next_interaction": F.lead("interaction_id").over(w)}
    )
    return rows.where(F.col("next_interaction").isNotNull()).select("learner_id", "place", "skill_id", "correct", "next_skill", "next_correct", "next_interaction")


def encode_token(code: Column, correct: Column, n_skills: Column | int) -> Column:
    """code + correct x skills + 1; 0 is left for padding."""
    return code + correct * n_skills + 1


def decode_token(token: Column, n_skills: int) -> tuple[Column, Column]:
    """(skill code, correct) of a token; null for padding."""
    real = F.when(token > 0, token - 1)
    return F.pmod(real, F.lit(n_skills)), F.floor(real / n_skills).cast("int")


def pad(array: Column, length: int, value: Column) -> Column:
    return F.concat(array, F.array_repeat(value, F.greatest(F.lit(length) - F.size(array), F.lit(0))))


def pad_sequences(sequences: DataFrame, length: int) -> DataFrame:
    """Right-padded copies: skills with '', corrects with -1."""
    return sequences.withColumns({"skills": pad(F.col("skills"), length, F.lit("")), "corrects": pad(F.col("corrects"), length, F.lit(-1))})


#: Rows of one learner on one skill that one task orders; more are summed over range partitions.
LONG_HISTORY = 1_000_000


def _with_priors(df: DataFrame) -> DataFrame:
    keys, order = ["learner_id", "skill_id"], ["timestamp", "interaction_id"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = lambda rows: rows.withColumns({"prior_correct": F.coalesce(F.sum("correct").over(w), F.lit(0)), "prior_attempts": F.count("*").over(w)})
    long = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > LONG_HISTORY).select(*[F.col(k).alias(f"__{k}") for k in keys])
    if long.isEmpty():
        return plain(df)
    long = materialize(long)  # fewer than one row in LONG_HISTORY
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    summed = prefix_sums(df.join(long, same, "left_semi").withColumn("attempts", F.lit(1).cast("long")), keys, order, ["correct", "attempts"])
    summed = summed.withColumnsRenamed({"before_correct": "prior_correct", "before_attempts": "prior_attempts"}).drop("attempts")
    return plain(df.join(long, same, "left_anti")).unionByName(summed)


def prior_features(df: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """``df`` with prior corrects and attempts of the learner on the skill, their rate, and the skill's degree.

    Without history all are 0. ``timestamp`` and ``interaction_id`` must tell the rows of a learner on a skill apart.
    A learner with more than LONG_HISTORY rows on a skill spans many tasks: each range of time is summed by itself, and
    the totals of the ranges before it are added. The rows are the same.
    """
    rows = _with_priors(df).withColumn("success_rate", F.col("prior_correct").cast("double") / F.greatest(F.col("prior_attempts"), F.lit(1)))
    if degrees is None:
        return rows.withColumn("degree", F.lit(0.0))
    return rows.join(degrees.select("skill_id", F.col("degree_norm").alias("degree")), "skill_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))


FEATURES = ["skill_code", "success_rate", "prior_attempts", "degree"]


def _fitted(train: DataFrame, features: list[str], n: int):
    """The logistic model of ``train`` and the assembler of its features: L2 penalty of 1/n on the weights, none on the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=features, outputCol="__x")
    model = LogisticRegression(featuresCol="__x", labelCol="correct", maxIter=100, tol=1e-10, regParam=1.0 / n, standardization=False)
    return model.fit(assemble.transform(train)), assemble


def _probability(model, assemble, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(assemble.transform(rows)).withColumn("__p", vector_to_array("probability")[1])


def _classes(train: DataFrame):
    return train.agg(F.count("*").alias("n"), F.avg("correct").alias("rate"), F.countDistinct("correct").alias("classes")).first()


def lr_predict(train: DataFrame, evaluate: DataFrame, features: list[str] = FEATURES, eps: float = 1e-6) -> DataFrame:
    """(interaction_id, skill_id, y_true, y_pred): logistic regression with an L2 penalty of 1/n, clipped.

    Both frames hold the features and ``correct``; with one class in train every prediction is its rate.
    """
    counts = _classes(train)
    if counts["classes"] < 2:
        evaluate = evaluate.withColumn("__p", F.lit(counts["rate"]).cast("double"))
    else:
        evaluate = _probability(*_fitted(train, features, counts["n"]), evaluate)
    clipped = F.greatest(F.least("__p", F.lit(1 - eps)), F.lit(eps))
    return evaluate.select("interaction_id", "skill_id", F.col("correct").alias("y_true"), clipped.alias("y_pred"))


def lr_moments(train: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(feature, observed, expected): the first-order condition of the fitted regression, one row per feature and one for the intercept.

    ``observed`` is the sum of the feature over the correct answers. ``expected`` is its sum weighted by the fitted
    probabilities, plus the pull of the penalty, which is the feature's weight. At the optimum both are equal, and as the
    penalised likelihood is strictly concave in the weights, only there. With one class in train there is no optimum and no row.
    """
    counts = _classes(train)
    if counts["classes"] < 2:
        return train.sparkSession.createDataFrame([], "feature string, observed double, expected double")
    model, assemble = _fitted(train, features, counts["n"])
    named = {**{f: F.col(f).cast("double") for f in features}, "intercept": F.lit(1.0)}
    pull = {**dict(zip(features, (float(w) for w in model.coefficients))), "intercept": 0.0}
    values = F.array(*[F.struct(F.lit(f).alias("feature"), x.alias("x"), F.lit(pull[f]).alias("pull")) for f, x in named.items()])
    rows = _probability(model, assemble, train).select("correct", "__p", F.explode(values).alias("v"))
    return rows.groupBy("v.feature", "v.pull").agg(
        F.sum(F.col("v.x") * F.col("correct")).alias("observed"), F.sum(F.col("v.x") * F.col("__p")).alias("weighted")
    ).select("feature", "observed", (F.col("weighted") + F.col("pull")).alias("expected"))


def export_predictions(preds: DataFrame, interactions: DataFrame, run: dict[str, object]) -> DataFrame:
    """Predictions with user, item and run keys, joined on (interaction_id, skill_id)."""
    known = interactions.select("interaction_id", "skill_id", F.col("learner_id").alias("user_id"), F.col("question_id").alias("item_id")).dropDuplicates(["interaction_id", "skill_id"])
    return preds.join(known, ["interaction_id", "skill_id"], "left").withColumns({k: F.lit(v) for k, v in run.items()})
