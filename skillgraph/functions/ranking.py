"""Row numbers over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._session import materialize, written


def global_row_number(df: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """``df`` with its 1-based place in a total order, by range partitioning.

    Each partition numbers its own rows; the rows of the partitions before it, one count each, are
    added by a join. ``order`` must name all ties apart for the numbers to be reproducible.
    """
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    inside = F.col("__at") - F.shiftleft("__part", 33)
    return joined.withColumn(name, inside + F.col("__offset") + 1).drop("__at", "__part", "__offset")


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``before_<column>``: the sum of a column over the rows of the same keys that come before in ``order``.

    Rows are range-partitioned by keys and order; each partition sums its own rows, and the totals of the partitions
    before, one row per partition and keys, are added by a join. So one key with most of the rows spans many tasks.
    """
    by = [*keys, *order]
    placed = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__part", *keys).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns])
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).join(offsets, same)
    return joined.select(*df.columns, *[(F.col(f"before_{c}") + F.col(f"__{c}")).alias(f"before_{c}") for c in columns])


def quantiles(df: DataFrame, keys: list[str], column: str, shares: dict[str, float], times: str | None = None) -> DataFrame:
    """(keys, a column per share): exact interpolated quantiles of the non-null values of ``column``; a row stands for ``times`` rows.

    Values are counted map-side and only distinct ones are ordered, over range partitions, so no group is gathered.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg((F.sum(times) if times else F.count("*")).alias("__c"))
    placed = prefix_sums(counts, keys, [column], ["__c"])
    total = placed.groupBy(*keys).agg(F.sum("__c").alias("__n"))  # of the counted table, so ``df`` is read once
    if keys:
        total = total.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__n")
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__t_{k}"))
        placed = placed.join(total, same)
    else:
        placed = placed.crossJoin(F.broadcast(total))  # one row
    holds = lambda at: (F.col("before___c") <= at) & (at < F.col("before___c") + F.col("__c"))
    aggs, out = [], []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__n") - 1)
        aggs += [F.max(F.when(holds(f(at)), F.col(column))).alias(f"__{name}_{i}") for i, f in enumerate((F.floor, F.ceil))] + [F.max(at - F.floor(at)).alias(f"__{name}_f")]
        low, high = F.col(f"__{name}_0").cast("double"), F.col(f"__{name}_1").cast("double")
        out.append(F.when(low == high, low).otherwise((1 - F.col(f"__{name}_f")) * low + F.col(f"__{name}_f") * high).alias(name))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, *out)


#: Rows of a group whose quantiles one task finds.
GROUP_ROWS = 1_000_000


def quantiles_of_many(df: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """``quantiles`` of many groups: those of at most GROUP_ROWS rows each in a task of its own, by exact percentiles of
    counted values, and the larger ones over range partitions. ``df`` is read three times at most."""
    known = df.where(F.col(column).isNotNull())
    large = written(known.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > GROUP_ROWS).select(*[F.col(k).alias(f"__k_{k}") for k in keys]))
    percentiles = lambda rows: rows.groupBy(*keys).agg(*[F.percentile(column, F.lit(float(share))).alias(name) for name, share in shares.items()])
    if large.isEmpty():
        return percentiles(known)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return percentiles(known.join(large, same, "left_anti")).unionByName(quantiles(known.join(large, same, "left_semi"), keys, column, shares))
