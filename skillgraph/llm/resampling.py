"""Importance resampling towards a target corpus, by hashed n-gram counts from the running CRCs of each text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number

BUCKETS = 10_000
#: Words whose running CRCs a task holds at a time.
PART = 200_000

#: A-Z to a-z; ASCII characters other than letters and digits to spaces.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb" [^ ]+")
_POLYNOMIAL = 0xEDB88320  # fixed: CRC-32, lowest bit first


def _times_x(crc: np.ndarray, bits: int) -> np.ndarray:
    """Each CRC's polynomial times x to the power of ``bits``."""
    for _ in range(bits):
        crc = np.where(crc & 1, crc >> 1 ^ _POLYNOMIAL, crc >> 1)
    return crc


@cache
def _shift_tables(power: int) -> np.ndarray:
    """Tables by byte (of 4) and its value of a CRC shifted by 2**power zero bytes; shifts are linear over GF(2)."""
    values = np.arange(256, dtype=np.int64)[None, :] << 8 * np.arange(4)[:, None]
    return _times_x(values, 8) if power == 0 else _looked_up(_looked_up(values, power - 1), power - 1)


def _looked_up(crc: np.ndarray, power: int) -> np.ndarray:
    tables = _shift_tables(power)
    out = tables[0][crc & 255]
    for i in (1, 2, 3):
        out = out ^ tables[i][crc >> 8 * i & 255]
    return out


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC as it counts in the CRC of a text that goes on for a number of bytes: of those of ``lengths`` bit by bit."""
    crc, power = crc.copy(), 0
    while (lengths >> power).any():
        at = np.flatnonzero(lengths >> power & 1)
        crc[at] = _looked_up(crc[at], power)
        power += 1
    return crc


def feature_crcs(text: str | None, longest: int) -> Iterator[np.ndarray]:
    """The CRC-32 of every run of 1 to ``longest`` words, joined by a space, in parts.

    The normal text, each word with a space before it, is read once, and the CRC of its beginning is kept at the end of
    each word. That of a run is the CRC up to the run's end less that up to its start, shifted by the run's length.
    """
    words = _WORD.finditer(b" " + (text or "").encode().translate(_NORMAL))
    crc = 0
    starts = ends = lengths = np.empty(0, dtype=np.int64)  # of the last words of the part before
    while part := [m.group() for m in islice(words, PART)]:
        running = np.fromiter(accumulate(part, lambda c, w: crc32(w, c), initial=crc), dtype=np.int64, count=len(part) + 1)
        crc = int(running[-1])
        held = len(ends)
        # up to a run's start: the CRC up to the word before, and the space, which is one more byte
        space = np.frombuffer(b" ", dtype=np.uint8)[0]
        before = running[:-1] ^ 0xFFFFFFFF
        starts = np.append(starts, _looked_up((before ^ space) & 255, 0) ^ before >> 8 ^ 0xFFFFFFFF)
        ends = np.append(ends, running[1:])
        lengths = np.append(lengths, np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
        sums = np.append(0, np.cumsum(lengths))
        for n in range(1, longest + 1):
            last = np.arange(max(held, n - 1), len(ends))
            if len(last):
                first = last - n + 1
                yield ends[last] ^ shifted(starts[first], sums[last + 1] - sums[first] - 1)
        keep = max(0, len(ends) - longest + 1)
        starts, ends, lengths = starts[keep:], ends[keep:], lengths[keep:]


def count_words(text: str | None) -> int:
    return len((text or "").encode().translate(_NORMAL).split())


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): the features of all ``texts(text)`` by the CRC of their bytes modulo ``buckets``; a task sends a row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for crcs in feature_crcs(text.as_py(), longest):
                    total += np.bincount(crcs % buckets, minlength=buckets) if len(crcs) * 8 > buckets else 0
                    if len(crcs) * 8 <= buckets:
                        np.add.at(total, crcs % buckets, 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """Each bucket's whole gain: 1000 times the logarithm of its smoothed share in the target over that in the documents.

    Two counts per bucket reach the driver, whatever the size of the tables.
    """
    counts = []
    for table in (docs, target):
        own = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(table.select(F.col(text_col).alias("text")), longest, buckets).collect():
            own[r["bucket"]] = r["n"]
        counts.append(own)
    (s, t), (all_s, all_t) = counts, (int(c.sum()) for c in counts)
    ratio = lambda b: (float(t[b] + 1) * float(all_s + buckets)) / (float(s[b] + 1) * float(all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


_WEIGHT = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gains: np.ndarray, longest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every whole text: the sum of the gains of its features."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n = weight = n_words = 0
                for i, crcs in enumerate(feature_crcs(text, longest)):
                    n += len(crcs)
                    weight += int(gains[crcs % len(gains)].sum())
                    n_words += len(crcs) if longest == 1 else 0
                rows.append((n_words if longest == 1 else count_words(text), n, weight))
            columns = np.array(rows, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, _WEIGHT)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; the drawn ones have a rank, from 1 on.

    Features are all runs of 1 to ``longest`` words (a-z, 0-9 and non-ASCII characters, A-Z lower-cased), repeats counted,
    hashed into ``buckets``. A document's weight is the sum of its features' gains, its score the weight plus Gumbel noise
    from SHA-256 of seed and id; the ``percent`` of highest scores among the documents of ``min_words`` or more are drawn,
    which is a draw without replacement in proportion to exp(weight / 1000). Ties go to the smaller id.

    Null and empty texts have no features and weight 0. Rows that repeat an id are documents of their own with equal
    noise. Rows with a null id have no score and are not drawn, but their texts count. An empty target or no documents
    are smoothed like any other. Other columns are ignored. No rows give no rows.
    """
    weighed = weigh(docs, bucket_gains(docs, target, longest, buckets, text_col), longest, id_col, text_col)
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long"))
    takes_part = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    # one row of numbers per document is ordered, by range partitions
    placed = global_row_number(scored.withColumn("out", ~F.coalesce(takes_part, F.lit(False))), ["out", F.desc("score"), "doc_id", "weight", "n_features"], "rank")
    size = placed.agg(F.floor(F.sum(F.when(~F.col("out"), 1).otherwise(0)) * percent / 100).alias("drawn"))
    drawn = ~F.col("out") & (F.col("rank") <= F.col("drawn"))
    return placed.crossJoin(F.broadcast(size)).select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("rank")).cast("long").alias("rank"))
