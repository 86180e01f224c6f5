"""Reading, normalising and writing interaction logs, question-skill maps, edge tables and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import epoch_of, normalize_correct, with_columns_named
from ..functions.ranking import global_row_number


def _read(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions from Parquet or CSV: ids as strings, ``correct`` as int, time as long."""
    df = _read(spark, path, schemas.INTERACTIONS)
    ids = [F.col(c).cast("string") for c in ("interaction_id", "learner_id", "question_id", "skill_id")]
    rest = [F.col("dataset").cast("string")] if "dataset" in df.columns else [F.lit(None).cast("string").alias("dataset")]
    return df.select(*ids, F.col("timestamp").cast("long"), F.col("correct").cast("int"), *rest)


def read_q_matrix(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, schemas.Q_MATRIX)
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def to_epoch_seconds(df: DataFrame, col: str, order: list[str], out: str = "timestamp", pattern: str | None = None) -> DataFrame:
    """Epoch seconds of ``col``; if no value at all can be read, 1000, 1001, ... in the given order.

    A column that can be read in part keeps its nulls.
    """
    parsed = df.withColumn(out, epoch_of(col, pattern))
    if parsed.where(F.col(out).isNotNull()).limit(1).count():
        return parsed
    return global_row_number(df, order, out).withColumn(out, F.col(out) + 999)


def map_skills(log: DataFrame, content: DataFrame, key: str = "question_id", levels: tuple[str, ...] = ("level2_id", "subject"), unknown: str = "Unknown") -> DataFrame:
    """``log`` with the skill of its question: the first level that is present, else ``unknown``; questions without content are dropped."""
    skills = content.select(key, F.coalesce(*[F.col(c).cast("string") for c in levels], F.lit(unknown)).alias("skill_id")).dropDuplicates([key])
    return log.join(skills, key, "left").where(F.col("skill_id").isNotNull())


def explode_skills(df: DataFrame, col: str = "skill_id", sep: str = "~~") -> DataFrame:
    """One row per skill of a delimited field; skills are trimmed and empty ones skipped."""
    parts = F.split(F.col(col), "\\Q" + sep + "\\E")
    return df.withColumn(col, F.explode(parts)).withColumn(col, F.trim(F.col(col))).where(F.col(col) != "")


def encode_ids(df: DataFrame, col: str, out: str, first_seen_by: str | None = None) -> DataFrame:
    """``df`` with a dense id from 0 per distinct value: in sorted order, or in order of its least ``first_seen_by``."""
    if first_seen_by is None:
        distinct, order = df.select(col).where(F.col(col).isNotNull()).distinct(), [col]
    else:
        distinct, order = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(first_seen_by).alias("__first")), ["__first", col]
    codes = global_row_number(distinct, order, out).select(col, (F.col(out) - 1).alias(out))
    return df.join(codes, col, "left")


def derive_q_matrix(interactions: DataFrame, source: str = "train_only_derived", version: str = "1", train_only: bool = True) -> DataFrame:
    pairs = interactions.select("question_id", "skill_id").distinct()
    return pairs.withColumns({"source": F.lit(source), "source_version": F.lit(version), "is_train_only": F.lit(str(train_only).lower())})


def min_sequence_filter(df: DataFrame, n: int = 3, key: str = "learner_id") -> DataFrame:
    """Rows of learners with at least ``n`` interactions."""
    enough = df.groupBy(key).count().where(F.col("count") >= n).select(key)
    return df.join(enough, key, "left_semi")


def reassign_interaction_ids(df: DataFrame, order: list[str], out: str = "interaction_id") -> DataFrame:
    """Sequential ids 1..n in a stated total order, over range partitions."""
    return global_row_number(df.drop(out) if out not in order else df.withColumnRenamed(out, "__old"), [("__old" if c == out else c) for c in order], out).drop("__old")


def head_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of a stated order."""
    return df.orderBy(*order).limit(n)


def resolve_columns(df: DataFrame, context: str) -> DataFrame:
    """``df`` with the columns of a kind of table (``schemas.CONTEXTS``) under their standard names.

    The first alternative that is present is taken, in any case of letters. Where the standard name belongs to another
    column, that one moves to ``<name>_given``. Columns of other kinds stay: ``target`` is an end of an edge in edge
    tables and nothing in predictions. What is missing is told by ``missing_columns``.
    """
    have = {c.lower(): c for c in df.columns}
    chosen = {have[found.lower()]: name for name, found in _chosen(df, context).items()}
    taken = {name.lower() for name in chosen.values()}
    return df.select(*[F.col(f"`{c}`").alias(chosen[c] if c in chosen else c + "_given" if c.lower() in taken else c) for c in df.columns])


def missing_columns(df: DataFrame, context: str) -> list[str]:
    """Standard names of a kind of table for which ``df`` has no column, in the order of the kind; only the schema is read."""
    found = _chosen(df, context)
    return [name for name in schemas.CONTEXTS[context] if name not in found]


def _chosen(df: DataFrame, context: str) -> dict[str, str]:
    have = {c.lower() for c in df.columns}
    firsts = {name: next((n for n in names if n.lower() in have), None) for name, names in schemas.CONTEXTS[context].items()}
    return {name: found for name, found in firsts.items() if found is not None}


def read_run_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows of all CSV files root/dataset/fold/seed/model/variant/*.csv with keys from their path and a run_id.

    Folders may be plain names or ``key=value``, as partitioned writers name them.
    """
    df = spark.read.option("header", True).option("inferSchema", True).csv(f"{root}/*/*/*/*/*/*.csv")
    place = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)/[^/]+$", 0)
    keys = {k: F.regexp_extract(place, "^" + "(?:[^/=]*=)?([^/]+)/" * 5, i + 1) for i, k in enumerate(("dataset", "fold", "seed", "model", "variant"))}
    return df.withColumns(keys).withColumn("run_id", F.concat_ws("_", "dataset", "fold", "seed", "model", "variant"))


def _number(text: Column) -> Column:
    return F.when(F.lower(text) == "nan", None).otherwise(text.try_cast("double"))


def parse_run_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Records (dataset, fold, seed, model, variant, valid_auc, test_auc) of the lines
    '[time] [dataset fold f seed s] Model m Variant v -> Val AUC: x, Test AUC: y'; 'nan' is null, other lines are dropped."""
    number = r"(nan|[-.\d]+)"
    pattern = rf"\[[^\]]*\]\s+\[(\w+)\s+fold\s+(\d+)\s+seed\s+(\d+)\]\s+Model\s+(\w+)\s+Variant\s+(\w+)\s+->\s+Val\s+AUC:\s+{number},\s+Test\s+AUC:\s+{number}"
    part = lambda i: F.regexp_extract(F.col(col), pattern, i)
    return lines.where(F.col(col).rlike(pattern)).select(
        part(1).alias("dataset"), part(2).cast("int").alias("fold"), part(3).cast("int").alias("seed"), part(4).alias("model"), part(5).alias("variant"),
        _number(part(6)).alias("valid_auc"), _number(part(7)).alias("test_auc"),
    )


def union_edge_tables(*tables: DataFrame, renamed: dict[str, list[str]] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """Union by name after renaming drifted columns; missing or null columns take their default."""
    found = None
    for table in tables:
        table = with_columns_named(table, renamed or {})
        found = table if found is None else found.unionByName(table, allowMissingColumns=True)
    for name, value in (defaults or {}).items():
        found = found.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in found.columns else F.lit(value))
    return found


def write_table(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """Parquet partitioned by dataset, fold or whatever ``keys`` name."""
    df.write.partitionBy(*keys).mode(mode).parquet(path)


def append_runs(df: DataFrame, path: str) -> None:
    write_table(df, path, ["dataset"], "append")


def completed_runs(runs: DataFrame, n_variants: int = 4) -> DataFrame:
    """(model, seed) pairs that have at least ``n_variants`` variants."""
    return runs.groupBy("model", "seed").agg(F.countDistinct("variant").alias("variants")).where(F.col("variants") >= n_variants)


def pending_runs(grid: DataFrame, runs: DataFrame, n_variants: int = 4) -> DataFrame:
    return grid.join(completed_runs(runs, n_variants), ["model", "seed"], "left_anti")
