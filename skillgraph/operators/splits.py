"""Learner and time splits, fingerprints and overlap audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number, quantiles


def _named(rn, n, ratios: tuple[float, float, float]):
    train, valid = F.floor(n * F.lit(ratios[0])), F.floor(n * F.lit(ratios[1]))
    return F.when(rn <= train, "train").when(rn <= train + valid, "valid").otherwise("test")


def learner_split(df: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 2026, fold: int = 0) -> DataFrame:
    """``df`` with fold and split: learners in an order shuffled by seed + fold, the first int(n r) train, and so on.

    The order is that of md5(learner|seed + fold), so any engine finds the same split; learners are
    ranked over range partitions.
    """
    learners = df.select("learner_id").distinct().withColumn("__h", F.md5(F.concat(F.col("learner_id"), F.lit(f"|{seed + fold}"))))
    ranked = global_row_number(learners, ["__h", "learner_id"])
    total = ranked.agg(F.max("rn").alias("__n"))
    named = ranked.crossJoin(F.broadcast(total)).select("learner_id", F.lit(fold).alias("fold"), _named(F.col("rn"), F.col("__n"), ratios).alias("split"))
    return df.join(named, "learner_id")


def make_folds(df: DataFrame, folds: int, seed: int = 2026, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(learner_id, fold, split) of ``folds`` independent reshuffles; folds are not disjoint."""
    learners = df.select("learner_id").distinct().select("learner_id", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    learners = learners.withColumn("__h", F.md5(F.concat(F.col("learner_id"), F.lit("|"), (F.col("fold") + seed).cast("string"))))
    ranked = global_row_number(learners, ["fold", "__h", "learner_id"])
    sizes = ranked.groupBy("fold").agg(F.count("*").alias("__n"))
    first = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("fold")) - F.col("__n"))  # one row per fold
    placed = ranked.join(first, "fold")
    return placed.select("learner_id", "fold", _named(F.col("rn") - F.col("__before"), F.col("__n"), ratios).alias("split"))


def temporal_split(df: DataFrame, train: float = 0.8, valid: float = 0.1, per_learner: bool = False, dataset: str | None = None) -> DataFrame:
    """``df`` with a split by time: cut times are exact percentiles per dataset, or places in each learner's sequence."""
    if per_learner:
        w = Window.partitionBy("learner_id")
        place = F.row_number().over(w.orderBy("timestamp", "interaction_id"))
        return df.withColumn("split", _named(place, F.count("*").over(w), (train, valid, 1 - train - valid)))
    keys = [dataset] if dataset else []
    cuts = quantiles(df, keys, "timestamp", {"__first": train, "__second": train + valid})
    placed = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))  # one row
    ts = F.col("timestamp")
    return placed.withColumn("split", F.when(ts <= F.col("__first"), "train").when(ts <= F.col("__second"), "valid").otherwise("test")).drop("__first", "__second")


def split_report(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count("*").alias("n_rows"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free content fingerprint per key: rows, and two sums of 30-bit slices of each row's md5."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    part = lambda at: F.conv(F.substring(row, at, 7), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(part(1)).alias("fingerprint_a"), F.sum(part(9)).alias("fingerprint_b"))


def _row_text(columns: list[str]) -> Column:
    """One text per row that tells its values apart: the length and the value of each column, '-' for a null."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


#: A SHA-256 is summed in this many limbs of 16 bits, so that a long holds the sums of 2^47 rows.
LIMBS = 16


def content_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_rows, sha256): a digest of the rows of each key as a multiset, whatever their order and partitions.

    It is the SHA-256 of "rows|sum", where the sum adds the SHA-256 of every row modulo 2^256: limbs are added map-side
    and carried once at the end, so a key with most of the rows is no burden. Repeated rows count, nulls differ from
    empty texts, and values never run into each other. Without keys an empty table has one row with 0 rows. Numbers are
    hashed as Spark prints them; give doubles as whole numbers or texts where other engines shall agree. It finds any
    accidental change; it isn't meant against somebody who may choose rows freely.
    """
    hashed = df.select(*keys, F.sha2(_row_text(columns), 256).alias("__h"))
    limb = lambda i: F.conv(F.substring("__h", 4 * i + 1, 4), 16, 10).cast("long")
    sums = hashed.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(limb(i)), F.lit(0).cast("long")).alias(f"__{i}") for i in range(LIMBS)])

    def carry(acc: Column, limb_sum: Column) -> Column:
        total = acc["carry"] + limb_sum
        digits = F.lpad(F.lower(F.hex(F.pmod(total, F.lit(65536)))), 4, "0")
        return F.struct(F.concat(digits, acc["text"]).alias("text"), F.shiftright(total, 16).alias("carry"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("carry"))
    total = F.aggregate(F.array(*[F.col(f"__{i}") for i in reversed(range(LIMBS))]), start, carry)["text"]
    return sums.select(*keys, "n_rows", F.sha2(F.concat(F.col("n_rows").cast("string"), F.lit("|"), total), 256).alias("sha256"))


SPLITS = ("train", "valid", "test")
TRAIN_COLUMNS = ["interaction_id", "learner_id", "question_id", "skill_id", "timestamp", "correct"]


def provenance_manifest(
    edges: DataFrame, rows: DataFrame, keys: list[str], relations: list[str], edge_columns: list[str], row_columns: list[str] = TRAIN_COLUMNS
) -> DataFrame:
    """One row per key and relation: num_edges and edges_sha256, train_interactions_count, and the hash of each split.

    ``edges`` holds keys and ``relation_type``, ``rows`` holds keys and ``split``; both are read once. A relation or a
    split without rows counts 0 and has the digest of an empty table; keys are those of ``rows``. What is joined is one
    row per key and relation or split.
    """
    empty = F.sha2(F.lit("0|" + "0" * 64), 256)
    by_split = content_digest(rows.where(F.col("split").isin(*SPLITS)), [*keys, "split"], row_columns)
    pick = lambda column, s: F.max(F.when(F.col("split") == s, F.col(column)))
    wide = by_split.groupBy(*keys).agg(
        F.coalesce(pick("n_rows", "train"), F.lit(0).cast("long")).alias("train_interactions_count"), *[F.coalesce(pick("sha256", s), empty).alias(f"{s}_hash") for s in SPLITS]
    )
    wanted = wide.withColumn("relation_type", F.explode(F.array(*[F.lit(r) for r in relations])))
    built = content_digest(edges, [*keys, "relation_type"], edge_columns).withColumnsRenamed({"n_rows": "num_edges", "sha256": "edges_sha256"})
    found = wanted.join(built, [*keys, "relation_type"], "left")
    return found.select(
        *keys, "relation_type", F.coalesce("num_edges", F.lit(0).cast("long")).alias("num_edges"), F.coalesce("edges_sha256", empty).alias("edges_sha256"),
        "train_interactions_count", *[f"{s}_hash" for s in SPLITS],
    )


def compare_manifests(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, relation_type, edges, train, status) of two manifests, matched by key and relation.

    ``edges`` and ``train`` are SAME or CHANGED by their hashes. The status is PASS if both are the same, STALE where the
    train rows changed and the edges did not (they were built from other rows), CHANGED otherwise, and MISSING or NEW
    where only the recorded or only the current manifest has the row.
    """
    on = [*keys, "relation_type"]
    side = lambda df, name: df.select(*on, F.col("edges_sha256").alias(f"__e_{name}"), F.col("train_hash").alias(f"__t_{name}"), F.lit(True).alias(f"__{name}"))
    both = side(recorded, "old").join(side(current, "new"), on, "full_outer")
    told = lambda c: F.when(F.col("__old") & F.col("__new"), F.when(F.col(f"{c}_old") == F.col(f"{c}_new"), "SAME").otherwise("CHANGED"))
    named = both.withColumns({"edges": told("__e"), "train": told("__t")})
    status = (
        F.when(F.col("__new").isNull(), "MISSING").when(F.col("__old").isNull(), "NEW").when((F.col("edges") == "SAME") & (F.col("train") == "SAME"), "PASS")
        .when((F.col("edges") == "SAME") & (F.col("train") == "CHANGED"), "STALE").otherwise("CHANGED")
    )
    return named.select(*on, "edges", "train", status.alias("status"))


def split_overlap_audit(splits: DataFrame, columns: tuple[str, ...] = ("interaction_id", "learner_id")) -> DataFrame:
    """Per id column, the ids that stand in more than one split, and PASS or FAIL."""
    found = None
    for c in columns:
        over = splits.groupBy(c).agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).alias("overlapping"))
        over = over.select(F.lit(c).alias("id_column"), "overlapping", F.when(F.col("overlapping") == 0, "PASS").otherwise("FAIL").alias("status"))
        found = over if found is None else found.unionByName(over)
    return found
