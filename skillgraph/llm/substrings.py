"""Near-duplicate passages by compact windows: Cartesian trees of token min-hashes, interval join, verification."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shingle and of the shortest passage, least Jaccard similarity of two passages' shingles.
SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions. A window's signature is the shingle of its least hash with ten words before it, or ten words after it.
HASHES = 3
#: Shingles, counted from the centre, that make a signature, and those further out by which windows of one signature are told apart.
NEAR, WIDE = (0, 5, 10), (15, 20, 25, 30, 35, 40)
#: Windows gathered by a task before it links those that share a signature and sends the first and last of each on.
COMBINE = 400_000

_MIX = np.random.default_rng(5).integers(1, 2**63, size=(16, 2), dtype=np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space; A-Z count as a-z."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash per run of ``width`` words; none for shorter texts."""
    if len(words) < width:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    base = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + base[i : i + n]
    return out ^ (out >> np.uint64(32))


def compact_windows(values: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(low, centre, high) of the Cartesian tree of ``values``, down to windows of ``shortest`` values.

    All subsequences within [low, high) that contain the centre have their minimum there, and each
    subsequence of ``shortest`` values or more belongs to exactly one window.
    """
    out, stack = [], [(0, len(values))]
    while stack:
        low, high = stack.pop()
        if high - low < shortest:
            continue
        centre = low + int(values[low:high].argmin())
        out.append((low, centre, high))
        stack.append((low, centre))
        stack.append((centre + 1, high))
    return out


#: A window or, with l_doc, a link of a window to an earlier one. ``key`` is the signature, and in its last CTX_BITS bits
#: the wider context; ``at`` packs a centre, whether the window still needs a link, and its reach to the left and right.
_ROW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("l_doc", pa.int64()), ("l_at", pa.int64())])
_ROW_SQL = "key long, doc long, at long, l_doc long, l_at long"
CTX_BITS = 24
_NEED = 1 << 14


def _pack(windows: np.ndarray) -> np.ndarray:
    """(low, centre, high) as one number each; a reach is rounded up to a power of the fourth root of two."""
    low, centre, high = windows.T
    step = lambda reach: np.ceil(4 * np.log2(np.maximum(reach, 1))).astype(np.int64)
    return centre << 15 | _NEED | step(centre - low) << 7 | step(high - centre)


def _unpack(at: int) -> tuple[int, int, int]:
    """(centre, reach to the left, reach to the right)."""
    return at >> 15, int(2 ** ((at >> 7 & 127) / 4) + 1), int(2 ** ((at & 127) / 4) + 1)


def _context(base: np.ndarray, centres: np.ndarray, offsets: tuple[int, ...], way: int) -> np.ndarray:
    """One hash of the shingles at ``offsets`` before (way -1) or after (1) each centre."""
    out = np.full(len(centres), way + 2, dtype=np.uint64)
    for offset in offsets:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + base[centres + way * offset]
    return out ^ (out >> np.uint64(31))


def _all_windows(base: np.ndarray, shortest: int, hashes: int) -> np.ndarray:
    """(low, centre, high) of a text's compact windows under all hash functions."""
    found = []
    for fn in range(hashes):
        values = (base * _MIX[fn, 0] + _MIX[fn, 1]) ^ (base >> np.uint64(31))
        found += compact_windows(values * _MIX[fn, 1], shortest)
    return np.array(found, dtype=np.int64)


def _signatures(docs: list[int], bases: list[np.ndarray], found: list[np.ndarray]) -> np.ndarray:
    """(key, doc, at) of the texts' windows, for both sides of the centre; places outside a text count as 0."""
    gap = np.zeros(WIDE[-1], dtype=np.uint64)
    together = np.concatenate([x for base in bases for x in (gap, base)] + [gap])
    starts = np.cumsum([len(gap)] + [len(base) + len(gap) for base in bases[:-1]])
    counts = [len(w) for w in found]
    windows = np.concatenate(found)
    centres = windows[:, 1] + np.repeat(starts, counts)
    table = np.empty((2, len(windows), 3), dtype=np.int64)
    for side, way in enumerate((-1, 1)):
        near, wide = (_context(together, centres, offsets, way) for offsets in (NEAR, WIDE))
        table[side, :, 0] = (near >> np.uint64(CTX_BITS) << np.uint64(CTX_BITS) | wide >> np.uint64(64 - CTX_BITS)).view(np.int64)
    table[:, :, 1], table[:, :, 2] = np.repeat(np.array(docs, dtype=np.int64), counts), _pack(windows)
    return table.reshape(-1, 3)


def _predecessors(table: np.ndarray, shortest: int) -> np.ndarray:
    """For rows (key, doc, at), sorted: the row of the same key before each, or -1.

    That is the row just before, or, if it lies within ``shortest`` words in the same document, the last row of the document before.
    """
    at = np.arange(len(table))
    new = np.append(True, table[1:, 0] != table[:-1, 0])
    start = np.maximum.accumulate(np.where(new, at, 0))
    document = np.maximum.accumulate(np.where(new | np.append(True, table[1:, 1] != table[:-1, 1]), at, 0))
    before = at - 1
    near = np.append(False, (table[1:, 1] == table[:-1, 1]) & ((table[1:, 2] >> 15) - (table[:-1, 2] >> 15) < shortest))
    before = np.where(near, document - 1, before)
    return np.where(before >= start, before, -1)


def _links(docs: DataFrame, shortest: int, hashes: int) -> DataFrame:
    """(doc, at, l_doc, l_at): links of windows to earlier ones of the same signature.

    Windows of one signature are ordered by their wider context, then by document. Each is linked to the one
    before it if that has the same wider context, and else to the first of the signature; so exact copies meet
    even where other documents share the words next to the centre only, and links stay linear in windows.
    """

    def batch_of(table: np.ndarray, others: np.ndarray | None) -> pa.RecordBatch:
        columns = [pa.array(table[:, i]) for i in range(3)]
        for i in (1, 2):
            columns.append(pa.nulls(len(table), pa.int64()) if others is None else pa.array(others[:, i]))
        return pa.RecordBatch.from_arrays(columns, schema=_ROW)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = [], [], []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = _signatures(*held)
            table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
            before = _predecessors(table, shortest)
            rows = np.flatnonzero(before >= 0)
            links = table[rows]
            table[rows, 2] &= ~_NEED
            new = np.append(True, table[1:, 0] != table[:-1, 0])
            yield batch_of(table[new | np.append(new[1:], True)], None)  # the middle ones are linked, and of no use to others
            if len(rows):
                # links travel anywhere
                links[:, 0] ^= rows * 0x9E3779B97F4A7C
                yield batch_of(links, table[before[rows]])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                base = shingle_hashes(words_of(text.as_py()))
                if len(base) < shortest:
                    continue
                found = _all_windows(base, shortest, hashes)
                for part, item in zip(held, (doc, base, found)):
                    part.append(item)
                count += 2 * len(found)
                if count >= COMBINE:
                    yield from flush()
                    held, count = ([], [], []), 0
        if count:
            yield from flush()

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "at", "l_doc", "l_at"]
        last = first = None  # the row before, and the first row of its signature
        for frame in frames:
            made = frame["l_doc"].notna().to_numpy()
            if made.any():
                yield frame.loc[made, names].astype(np.int64)
            table = frame.loc[~made, ["key", "doc", "at"]].to_numpy(dtype=np.int64)
            if not len(table):
                continue
            held = 0 if last is None else 2
            table = np.concatenate([np.array([first, last])[:held].reshape(-1, 3), table]) if held else table
            signature = table[:, 0] >> CTX_BITS
            new = np.append(True, signature[1:] != signature[:-1])
            leader = np.maximum.accumulate(np.where(new, np.arange(len(table)), 0))
            before = _predecessors(table, shortest)
            before[:held] = -1
            apart = (before < 0) & (leader < np.arange(len(table))) & (table[:, 1] != table[leader, 1])
            before = np.where(apart, leader, before)
            before[(table[:, 2] & _NEED == 0)] = -1
            before[:held] = -1
            rows = np.flatnonzero(before >= 0)
            a, b = table[rows][:, 1:], table[before[rows]][:, 1:]
            later = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
            yield pd.DataFrame(np.concatenate([np.where(later[:, None], a, b), np.where(later[:, None], b, a)], axis=1), columns=names)
            last, first = table[-1], table[leader[-1]]

    rows = docs.select("doc", "text").mapInArrow(windows, _ROW_SQL)
    return rows.repartition(F.shiftright("key", CTX_BITS)).sortWithinPartitions("key", "doc", "at").mapInPandas(link, "doc long, at long, l_doc long, l_at long")


def _regions(links: list[tuple[int, int]], same: bool, shortest: int, similarity: float) -> list[list[int]]:
    """[a0, a1, b0, b1] regions, in shingles, of two documents (or one, ``same``) that may share a passage, from their linked windows.

    Both windows hold the passage, so it reaches no further from the centre than the shorter side, and on the other
    side by what insertions allow. Regions that overlap on both sides are joined: sorted by one side and cut where the
    running end is passed, then by the other side, and again.
    """
    out = []
    for at, l_at in set(links):
        (c, left, right), (d, l_left, l_right) = _unpack(at), _unpack(l_at)
        left, right = (int(min(x) / similarity) + SHINGLE + 1 for x in ((left, l_left), (right, l_right)))
        out.append([max(0, c - left), c + right, max(0, d - left), d + right])
    groups = [out]
    for axis in (0, 2, 0, 2):
        now = []
        for group in groups:
            group.sort(key=lambda r: r[axis])
            part, end = [group[0]], group[0][axis + 1]
            for r in group[1:]:
                if r[axis] >= end:
                    now.append(part)
                    part = []
                part.append(r)
                end = max(end, r[axis + 1]) if len(part) > 1 else r[axis + 1]
            now.append(part)
        groups = now
    joined = [[f(r[i] for r in g) for i, f in enumerate((min, max, min, max))] for g in groups]
    if same:  # the earlier and the later words of one document
        for r in joined:
            if r[3] + SHINGLE - 1 > r[0]:
                middle = (r[0] + r[3]) // 2
                r[0], r[3] = max(r[0], middle + SHINGLE), min(r[3], middle)
    return [r for r in joined if min(r[1] - r[0], r[3] - r[2]) >= shortest * similarity]


def similar_passages(
    a: list[bytes], b: list[bytes], shortest: int, similarity: float
) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (from, to in a, from, to in b, similarity), in words, from the left, each as long as it reaches.

    Runs of a's shingles that stand in b, each along the diagonal nearest to the one before, are joined
    over gaps; of the spans that start at a run the longest whose shingle sets have a Jaccard
    similarity of ``similarity`` or more, counted exactly as the spans grow, is a passage. A run that lies elsewhere in b
    counts in a only, and a span grows until shingles of a that b lacks rule the similarity out for all longer ones. Runs
    from which they rule it out for every span are passed over.
    """
    number: dict[tuple[bytes, ...], int] = {}
    ids = lambda w: [number.setdefault(s, len(number)) for s in zip(*(w[k:] for k in range(SHINGLE)))]
    theirs = ids(b)
    known = len(number)  # shingles that b lacks have this number or a later one
    mine = ids(a)
    place: list[list[int]] = [[] for _ in range(known)]
    for j, s in enumerate(theirs):
        place[s].append(j)
    runs: list[tuple[int, int, int, int]] = []  # from, to in a's shingles; from, to in b's
    # shingles of a that b lacks, each where it first stands: in a passage they are a share of 1 - similarity at most, so from
    # a run on only ends count whose excess over that share is no larger than at its start
    excess: list[tuple[float, float]] = []
    i, lacked = 0, 0
    while i < len(mine):
        if mine[i] >= known:
            lacked = max(lacked, mine[i] - known + 1)
            i += 1
            continue
        at = place[mine[i]]
        ahead = runs[-1][3] + i - runs[-1][1] if runs else i
        if len(at) == 1:
            j = at[0]
        else:
            k = bisect_left(at, ahead)
            j = min(at[max(0, k - 1) : k + 1], key=lambda x: abs(x - ahead))
        n = 1
        while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
            n += 1
        runs.append((i, i + n, j, j + n))
        excess.append((lacked - (1 - similarity) * i, lacked - (1 - similarity) * (i + n)))
        i += n
    least = list(accumulate((e for _, e in reversed(excess)), min))[::-1]
    out, k = [], 0
    while k < len(runs):
        last = bisect_right(least, excess[k][0] + 1e-6)  # later ends are out of reach
        if last <= k or runs[last - 1][1] - runs[k][0] < shortest:
            k += 1
            continue
        x0, x1, y0, y1 = runs[k][0], runs[k][0], runs[k][2], runs[k][2]
        p: set[int] = set()
        q: set[int] = set()
        shared, lacking, taken = 0, 0, None
        for m in range(k, last):
            new = {*mine[x1 : runs[m][1]]} - p
            shared += len(new & q)
            if x1 < runs[m][0]:
                lacking += sum(s >= known for s in new)
            p |= new
            x1 = runs[m][1]
            # a union holds what is lacking, and grows by the shingles that are left at most
            if lacking > (1 - similarity) * (len(p) + len(q) - shared + len(mine) - x1 + len(theirs) - (y1 - y0)) + 1e-9:
                break
            low, high = min(y0, runs[m][2]), max(y1, runs[m][3])
            if high - low > (runs[m][1] - x0) / similarity + 2 * SHINGLE and high - low > shortest / similarity:
                continue  # the run lies elsewhere in b
            new = {*theirs[low:y0], *theirs[y1:high]} - q
            shared += len(new & p)
            q |= new
            y0, y1 = low, high
            jaccard = shared / (len(p) + len(q) - shared)
            if jaccard >= similarity and x1 - x0 >= shortest:
                taken = m, (x0, x1 + SHINGLE - 1, y0, y1 + SHINGLE - 1, jaccard)
        if taken:
            out.append(taken[1])
            k = taken[0]
        k += 1
    return out


_PASSAGE = "doc long, mark long, start long, words long, similarity double, source_doc long, source_start long"


def _passages(docs: DataFrame, min_words: int, similarity: float, hashes: int) -> DataFrame:
    shortest = min_words - SHINGLE + 1
    links = _links(docs, shortest, hashes)

    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, l_doc, ats in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(doc, l_doc, *r) for r in _regions([(x["at"], x["l_at"]) for x in ats], doc == l_doc, shortest, similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc", "l_doc", "a0", "a1", "b0", "b1"])

    # interval join: linked windows of one pair of documents that overlap on both sides make one candidate
    pairs = links.groupBy("doc", "l_doc").agg(F.collect_list(F.struct("at", "l_at")).alias("ats"))
    candidates = pairs.mapInArrow(regions, "doc long, l_doc long, a0 long, a1 long, b0 long, b1 long").select(F.struct("doc", "l_doc", "a0", "b0").alias("pair"), "*")
    side = lambda n, doc, low, high: F.struct(F.lit(n).alias("side"), F.col(doc).alias("d"), F.col(low).cast("int").alias("from"), (F.col(high) - F.col(low) + SHINGLE - 1).cast("int").alias("n"))
    sides = candidates.select("pair", F.explode(F.array(side(0, "doc", "a0", "a1"), side(1, "l_doc", "b0", "b1"))).alias("s")).select("pair", "s.*")
    # each document's words are split once and all its sides cut out
    cuts = sides.groupBy("d").agg(F.collect_list(F.struct("pair", "side", "from", "n")).alias("cuts"))
    split = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    taken = F.transform(F.array(split), lambda w: F.transform("cuts", lambda c: F.struct(c["pair"].alias("pair"), c["side"].alias("side"), F.array_join(F.slice(w, c["from"] + 1, c["n"]), " ").alias("words"))))[0]
    cut = docs.join(cuts, F.col("d") == docs["doc"]).select(F.xxhash64("text").alias("mark"), F.explode(taken).alias("c")).select("mark", "c.*")
    of = lambda n: F.max(F.when(F.col("side") == n, F.struct("mark", "words")))
    both = cut.groupBy("pair").agg(of(0).alias("mine"), of(1).alias("theirs"))
    both = both.select("pair.*", F.col("mine.mark").alias("mark"), F.col("mine.words").alias("mine"), F.col("theirs.words").alias("theirs"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, l_doc, a, b, mark, mine, theirs in zip(*batch.columns):
                for x0, x1, y0, _, jaccard in similar_passages(words_of(mine.as_py()), words_of(theirs.as_py()), shortest, similarity):
                    rows.append((doc.as_py(), mark.as_py(), a.as_py() + x0, x1 - x0, jaccard, l_doc.as_py(), b.as_py() + y0))
            if rows:
                types = [pa.float64() if i == 4 else pa.int64() for i in range(7)]
                names = [c.split()[0] for c in _PASSAGE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return both.mapInArrow(verify, _PASSAGE)


def near_duplicate_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, words, similarity, source_doc_id, source_start): passages that stand earlier, in another document or the same.

    A passage has ``min_words`` words or more; its set of five-word shingles has a Jaccard similarity
    of ``similarity`` or more with that of a passage of a document of smaller id, counted exactly.
    Places are in words of the whole text. A passage shared by many documents is compared with the
    copy before it, not by all pairs, so each later copy is linked to an earlier one. A passage that
    stands earlier in the same document is reported with that document as its source.

    Null texts and ids take no part; shorter texts have no passages. Rows that repeat an id and text
    are one document; of rows with one id and different texts the one of the largest text hash is
    verified and reported.
    """
    slim = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")
    )
    found = _passages(slim, min_words, similarity, hashes)
    return found.select(
        F.col("doc").alias("doc_id"), "start", "words", "similarity", F.col("source_doc").alias("source_doc_id"), "source_start", "mark"
    )


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` (from, to) and the white space after them."""
    gone: set[int] = set()
    for low, high in spans:
        gone.update(range(low, high))
    out, at = [], 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i in gone:
            out.append(text[at : m.start()])
            at = m.end()
            while at < len(text) and text[at] in " \t\n\r\x0b\x0c":
                at += 1
    out.append(text[at:])
    return "".join(out)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all rows and columns, without the passages of ``near_duplicate_passages``; the earliest copy stays."""
    spans = near_duplicate_passages(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("words")).alias("end"))).alias("spans")
    )
    columns, at_text, schema = docs.columns, docs.columns.index(text_col), docs.schema
    # the row travels as one column, so no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(id_col).cast("long").alias("d"), F.xxhash64(F.col(text_col)).alias("k"))
    joined = rows.join(spans.alias("s"), (F.col("d") == F.col("s.doc_id")) & (F.col("k") == F.col("s.mark")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t.as_py() if not s.is_valid else without_words(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()])
                for t, s in zip(batch.column(at_text), batch.column(len(columns)))
            ]
            arrays = [pa.array(texts, batch.column(i).type) if i == at_text else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.select("row.*", F.col("s.spans").alias("spans of the passage stage")).mapInArrow(cut, schema)
