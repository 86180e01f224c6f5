"""SimHash near-dedup: generalised pigeonhole over correlated bit partitions with unequal thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize, sorted_groups, spanning_edges
from .components import connected_components

BITS = 64
#: Rows of one bucket that are compared in one task; larger buckets are cut into pairs of such blocks.
BLOCK = 2048


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is set if it is set in over half of the XXH64 (seed 42) of the text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    columns = [words[i:] for i in range(width)]
    hashes = np.array([digest(b" ".join(s), 42) for s in zip(*columns)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text; fp holds the 64 bits as a signed long. Null texts count as empty."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, ones per bit, ones per pair of bits) over all fingerprints; only 64 x 65 sums reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total[:BITS] += bits.T @ bits
            total[BITS, 0] += len(bits)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "total"])

    rows = distinct.select("fp").mapInArrow(sums, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros((BITS + 1) * BITS)
    for row in rows:
        flat[row["at"]] = row["total"]
    both = flat.reshape(BITS + 1, BITS)[:BITS]
    return int(flat[BITS * BITS]), np.diag(both).copy(), both


def correlated_parts(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the 64 bits of near-equal width, each grown from a bit by its strongest correlations."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = (len(free) + m - k - 1) // (m - k)
        pool = sorted(free)
        part = [pool[int(np.argmax(related[np.ix_(pool, pool)].sum(axis=1)))]]
        while len(part) < width:
            rest = sorted(free - set(part))
            part.append(rest[int(np.argmax(related[np.ix_(rest, part)].mean(axis=1)))])
        parts.append(sorted(part))
        free -= set(part)
    return parts


def estimated_candidates(n: int, ones: np.ndarray, part: list[int], radius: int) -> float:
    """Expected pairs that differ in at most ``radius`` bits of ``part``, and the probes to find them."""
    if radius < 0:
        return 0.0
    p = ones[part] / max(n, 1)
    differ = 2 * p * (1 - p)
    at = np.zeros(radius + 1)  # probability of each number of differing bits
    at[0] = 1.0
    for q in differ:
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return n * n / 2 * float(at.sum()) + PROBE_COST * n * probes(len(part), radius)


#: Cost of sending one probe, in comparisons of candidates.
PROBE_COST = 20.0


def probes(width: int, radius: int) -> int:
    found, total = 1, 0
    for r in range(radius + 1):
        total += found
        found = found * (width - r) // (r + 1)
    return total


def allocate(n: int, ones: np.ndarray, parts: list[list[int]], distance: int, most: int | None = None) -> tuple[float, list[int]]:
    """Thresholds per part, each -1 (skipped) or more (``most`` at most), of sum distance - m + 1 at the least estimated cost.

    By the generalised pigeonhole principle two fingerprints within ``distance`` then differ by no more
    than its threshold in some part. Dynamic programming over parts and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        now: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for radius in range(-1, (distance if most is None else min(most, distance)) + 1):
                made = cost + estimated_candidates(n, ones, part, radius)
                if total + radius not in now or made < now[total + radius][0]:
                    now[total + radius] = (made, [*chosen, radius])
        best = now
    return best[distance - len(parts) + 1]


def probe_plan(n: int, ones: np.ndarray, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe, over the numbers of parts up to distance + 2; always exact."""
    plans = []
    for m in range(1, distance + 3):
        parts = correlated_parts(n, ones, both, m)
        cost, radii = allocate(n, ones, parts, distance)
        plans.append((cost, [(part, r) for part, r in zip(parts, radii) if r >= 0]))
    return min(plans, key=lambda p: p[0])[1]


def _masks(bits: list[int], radius: int) -> list[int]:
    """All flips of at most ``radius`` of ``bits``, as signed longs, the empty one first."""
    masks = [0]
    ring = [(0, -1)]
    for _ in range(radius):
        ring = [(mask | 1 << b, i) for mask, last in ring for i, b in enumerate(bits) if i > last]
        masks += [mask for mask, _ in ring]
    return np.array(masks, dtype=np.uint64).view(np.int64).tolist()


def linked_fingerprints(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within ``distance`` bits.

    Every such pair meets in a bucket and is compared there; a bucket gives the edges of a spanning
    forest of its pairs, so a large group of near copies gives as many edges as it has members.
    """
    n, ones, both = bit_statistics(distinct)
    plan = probe_plan(n, ones, both, distance)
    keyed = None
    for k, (bits, radius) in enumerate(plan):
        mask = int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])
        value = F.col("fp").bitwiseAND(F.lit(mask))
        flips = F.explode(F.array(*[F.lit(x).cast("long") for x in _masks(bits, radius)]))
        rows = distinct.select("fp", value.alias("value"), flips.alias("flip")).select(
            F.lit(k).alias("part"), F.col("value").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") != 0).cast("int").alias("probe"), "fp"
        )
        keyed = rows if keyed is None else keyed.unionByName(rows)
    counts = keyed.groupBy("part", "value").agg(F.count("*").alias("n"))
    hot = materialize(counts.where(F.col("n") > BLOCK))
    one = F.array(F.lit(0).cast("long"))
    if hot.isEmpty():
        placed = keyed.select("*", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    else:
        chunks = F.ceil(F.col("n") / (BLOCK // 2))
        salted = keyed.join(hot, ["part", "value"], "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), chunks), F.lit(0).cast("long")))
        others = F.when(F.col("n").isNull(), one).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
        placed = salted.select("part", "value", "probe", "fp", "own", F.explode(others).alias("other")).select(
            "part", "value", "probe", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
        )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(frames, ["part", "value", "i", "j"], smallest=2):
            values = group["fp"].to_numpy()
            if group["probe"].to_numpy().min() > 0:
                continue  # these only differ from the bucket's value; each finds its partners elsewhere
            near = np.bitwise_count(np.bitwise_xor.outer(values, values).view(np.uint64)) <= distance
            edges = spanning_edges(near)
            if edges:
                left, right = np.array(edges).T
                yield pd.DataFrame({"a": values[left], "b": values[right]})

    keys = ["part", "value", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    Texts are compared by the SimHash of their lower-cased word shingles, repeats included; documents
    link at ``distance`` or fewer differing bits, and component_id is the smallest doc_id reachable.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one
    class, so copies are never compared. Rows with a null id belong to their fingerprint's component
    (null if no other row has an id); repeated rows each give a row. No rows give no rows.
    """
    rows = materialize(fingerprints(docs, width, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(linked_fingerprints(classes.select("fp"), distance))
    # the least fp that names a component is no doc_id; the smallest doc_id of its members is
    named = classes.join(joined, classes["fp"] == joined["node"], "left").select(
        classes["fp"], "least", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")
