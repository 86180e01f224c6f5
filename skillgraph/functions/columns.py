"""Column rules of ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_id(col: Column | str) -> Column:
    """String id without the ``.0`` that a float column leaves at its end; whole numbers that print as 1.2E7 are written out."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(text.rlike(r"^-?\d\.\d+E\d+$"), text.try_cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(text, r"\.0$", ""))


def normalize_correct(col: Column | str) -> Column:
    """1 for true, 1 or 1.0 in any case, else 0; null counts as 0."""
    text = F.lower((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.when(text.isin("true", "1", "1.0"), 1).otherwise(0)


def epoch_of(col: str, pattern: str | None = None) -> Column:
    """Seconds since 1970 of a text time, null where it cannot be read; independent of the session's zone."""
    parsed = f"try_to_timestamp({col}, '{pattern}')" if pattern else f"try_to_timestamp({col})"
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({parsed} as timestamp_ntz))")


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by '|': the same in any engine, for seeded choices."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom in double, null where the bottom is zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def four_places(x: Column) -> Column:
    """A number with four decimals, half up, from whole ten-thousandths: doubles a hair under a half, as sums leave them, round up too."""
    whole = F.floor(F.abs(x) * 10_000 + 0.500001)
    sign = F.when((x < 0) & (whole > 0), "-").otherwise("")
    return F.concat(sign, F.floor(whole / 10_000).cast("string"), F.lit("."), F.lpad((whole % 10_000).cast("string"), 4, "0"))


def with_columns_named(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename the first present alternative of each target column; a present target stays."""
    have = {c.lower(): c for c in df.columns}
    for target, names in aliases.items():
        found = next((have[n.lower()] for n in [target, *names] if n.lower() in have), None)
        if found is not None and found != target:
            df = df.withColumnRenamed(found, target)
    return df


def exact_mean(x: str) -> Column:
    """The mean of a double column, summed in decimals of 18 places, so that it doesn't depend on the order of rows.

    Values of a billion or more and those that are not finite are added as doubles; nulls do not count.
    """
    fits = F.abs(F.col(x)) < 1e9
    n = F.count(x).cast("decimal(18,0)")
    exact = F.sum(F.when(fits, F.col(x)).cast("decimal(28,18)"))
    rest = F.sum(F.when(~fits, F.col(x)))
    return F.when(rest.isNull(), F.try_divide(exact, n).cast("double")).otherwise((F.coalesce(exact, F.lit(0)).cast("double") + rest) / F.count(x))
