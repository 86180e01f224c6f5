"""Line dedup over content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: A chunk may end after a line with probability one in so many.
DIVISOR = 2
#: Chunks of fewer lines are never removed.
MIN_LINES = 2


def _chunks(text: Column, divisor: int, bodies: bool) -> Column:
    """Array of (idx, lines, hash[, body]) of the chunks of a text.

    A chunk may end after line i where the hash of the line hashes i-1 and i, which rolls over the text, is divisible by
    ``divisor``. Of such ends in a row every second one counts, so a chunk has two lines or more (but for the last).
    An end depends on the lines back to the last place that is none only, so lines added before a passage move no
    ends beyond its first few lines.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda line: F.xxhash64(line))

    def ends(h: Column) -> Column:
        # a flag per line; of a run of ones, read from the left, every second stays
        may_end = lambda i: (i > 1) & (F.pmod(F.xxhash64(F.get(h, i - 2), F.get(h, i - 1)), F.lit(divisor)) == 0)
        flags = F.transform(F.sequence(F.lit(1), F.size(h)), lambda i: F.when(may_end(i), "1").otherwise("0"))
        return F.split(F.regexp_replace(F.array_join(flags, ""), "11", "10"), "")

    def starts(e: Column, n: Column) -> Column:
        # line i (from 1) opens a chunk if the one before it ends one
        return F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(e, i - 2) == "1"))

    def build(s: Column, all_lines: Column) -> Column:
        end = lambda i: F.coalesce(F.get(s, i + 1), F.size(all_lines) + 1)

        def chunk(start: Column, i: Column) -> Column:
            body = F.array_join(F.slice(all_lines, start, end(i) - start), "\n")
            fields = [i.alias("idx"), (end(i) - start).alias("lines"), body.alias("body")]
            return F.struct(*fields)

        return F.transform(s, chunk)

    # one pass each: bind the arrays so that they are not computed again for every element
    bound = F.transform(F.array(F.struct(lines.alias("l"), hashes.alias("h"))), lambda x: F.struct(x["l"].alias("l"), ends(x["h"]).alias("e")))
    bound = F.transform(bound, lambda x: F.struct(x["l"].alias("l"), starts(x["e"], F.size(x["l"])).alias("s")))
    made = F.transform(bound, lambda x: build(x["s"], x["l"]))[0]
    if bodies:
        return made
    return F.transform(made, lambda c: F.struct(c["idx"].alias("idx"), c["lines"].alias("lines"), F.xxhash64(c["body"]).alias("hash")))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the chunks of ``min_lines`` lines or more that stand earlier elsewhere.

    Texts are cut at content-defined boundaries; of equal chunks in all documents, and within one, the
    first by (id, text hash, place) stays. Chunks are first counted by hash; only those of a repeated
    hash move with their bytes, and one is removed only if its bytes equal those of the first.

    Null texts stay null. Rows of equal id and text are one document and are treated alike; a null id
    is smaller than any other. A text all of whose chunks are removed becomes empty. Other columns
    pass through unchanged.
    """
    doc, mark = F.col(id_col).alias("__doc"), F.xxhash64(F.col(text_col)).alias("__mark")
    keyed = docs.where(F.col(text_col).isNotNull()).select(doc, mark, F.col(text_col).alias("__text"))

    def exploded(bodies: bool) -> DataFrame:
        rows = keyed.select("__doc", "__mark", F.explode(_chunks(F.col("__text"), divisor, bodies)).alias("c"))
        rows = rows.select("__doc", "__mark", "c.*").where(F.col("lines") >= min_lines)
        if bodies:
            rows = rows.withColumn("hash", F.xxhash64("body"))
        return rows.withColumn("own", F.struct("__doc", "__mark", "idx")).select("hash", "own", *(["body"] if bodies else []))

    # tables of their own and merge joins, so that both joins on the hash read plain shuffles at any size, which the skew join can split for a chunk
    # that a great many documents share
    repeated = written(exploded(False).groupBy("hash").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first"), "repeated")
    candidates = written(exploded(True).join(repeated.hint("merge"), "hash"), "chunks")
    firsts = written(candidates.where("own = first").groupBy("hash").agg(F.any_value("body").alias("first_body")), "firsts")
    same = candidates.where("own <> first").join(firsts.hint("merge"), "hash").where("body = first_body")
    removed = same.groupBy(F.col("own.__doc").alias("__doc"), F.col("own.__mark").alias("__mark")).agg(F.collect_set("own.idx").alias("__removed"))
    # the row travels as one column, so no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("__d"), F.xxhash64(F.col(text_col)).alias("__k"))
    joined = rows.join(removed, F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__k") == F.col("__mark")), "left")
    whole = F.col("row").getField(text_col)
    kept = F.filter(_chunks(whole, divisor, True), lambda c: ~F.array_contains(F.col("__removed"), c["idx"]))
    text = F.when(F.col("__removed").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda c: c["body"]), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
