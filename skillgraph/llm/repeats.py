"""Exact repeats of byte strings across documents, by a radix sort of sampled suffixes that ends at the threshold length.

A plain suffix array orders every byte's suffix, which moves each byte of the corpus ``length`` times. Here a suffix is
sorted only where it starts at an *anchor*: of the grams (``gram`` bytes) of each string of ``length`` bytes the one of
least hash, the leftmost of several. Equal strings have their anchors at the same place, so two strings are equal exactly
if their anchors' suffixes and the bytes before these agree, and there is one anchor to about 15 bytes. The passes go
from the most significant digit on, and end where ``length`` bytes are compared:

1. the anchor's gram. Anchors whose gram stands in one document only leave (two thirds of them in prose);
2. all bytes of the strings around an anchor at once. Where a smaller document has the same, all of them are repeated;
3. the single strings of the anchors that differ there, so of the first and last bytes of a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 50
#: Bytes hashed at a time, anchors gathered by a task before it compares them with each other and sends them on.
CHUNK, COMBINE = 1 << 17, 1_000_000
#: Differing neighbourhoods of one gram that a task compares string by string; of more, each string is sent by itself.
LIMIT = 1000

_MOD = 1 << 64
# two polynomial hashes: a random odd number per byte value, and a base that is 5 modulo 8
_BYTES = np.random.default_rng(11).integers(1, 2**63, size=(2, 256), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C1D, 0xD1B54A32D192ED05)


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse."""
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, _MOD)):
        p = np.full(CHUNK + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _prefixes(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[which][data] * _powers(which)[0][: len(data)], out=out[1:])
    return out


def _hashes(prefixes: np.ndarray, low: np.ndarray, high: np.ndarray, which: int) -> np.ndarray:
    """One hash of the bytes [low, high) each, wherever they stand."""
    return _mixed((prefixes[high] - prefixes[low]) * _powers(which)[1][low])


def gram_of(length: int) -> int:
    """Bytes of the gram by which strings of ``length`` bytes are sampled; a gram is the anchor of 62 strings at most."""
    if length < 8:
        raise ValueError("length must be 8 or more")
    return max(2 * length // 5, length - 61)


def _segments(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) of all strings of the texts, at most CHUNK bytes together; pieces of a long text overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK - length + 1):
            piece = text[at : at + CHUNK]
            if size + len(piece) > CHUNK:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def anchors(texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Rows (row, low, n, gram, around) of the anchors of the texts, in order, as unsigned 64-bit numbers.

    The strings of ``length`` bytes that start at low, low+1, ... low+n-1 have one anchor; ``gram`` is its hash and
    ``around`` that of all bytes of these strings.
    """
    gram, found = gram_of(length), []
    window = length - gram + 1
    for segments in _segments(texts, length):
        data = np.frombuffer(b"".join(s for _, _, s in segments), dtype=np.uint8)
        sizes = np.array([len(s) for _, _, s in segments])
        ends = np.cumsum(sizes)
        first, second = _prefixes(data, 0), _prefixes(data, 1)
        at = np.arange(len(data) - gram + 1, dtype=np.uint64)
        grams = _mixed((first[gram:] - first[:-gram]) * _powers(0)[1][: len(at)])
        # 40 bits of the hash, then the place: the least is the leftmost of least hash
        least = grams >> np.uint64(24) << np.uint64(24) | at
        step = 1
        while step * 2 <= window:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if window > step:
            least = np.minimum(least[: step - window], least[window - step :])
        anchor = least & np.uint64(0xFFFFFF)
        inside = np.ones(len(anchor), dtype=bool)  # strings within one text
        for end in ends.tolist():
            inside[max(0, end - length + 1) : end] = False
        same = (anchor[1:] == anchor[:-1]) & inside[1:] & inside[:-1]
        low = np.flatnonzero(inside & ~np.append(False, same))
        n = np.flatnonzero(inside & ~np.append(same, False)) - low + 1
        segment = np.searchsorted(ends, low, side="right")
        row, offset = (np.array([s[i] for s in segments])[segment] for i in (0, 1))
        gram_of_each = grams[anchor[low].astype(np.int64)]
        columns = [row, low - (ends - sizes)[segment] + offset, n, gram_of_each, _hashes(second, low, low + n - 1 + length, 1)]
        found.append(np.stack([c.astype(np.uint64) for c in columns], axis=1))
    return np.concatenate(found) if found else np.empty((0, 5), dtype=np.uint64)


# A place in a text: 25 bits of the text's hash, which tell rows of one id apart, 31 bits of the place, a bit that is set
# if the anchor is known to be repeated, and 6 bits of its number of strings.
_DONE = 64


def _place(mark: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (mark & 0x1FFFFFF) << 38 | low << 7 | n


def _parts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 38, at >> 7 & 0x7FFFFFFF, at & 63


def _batch(names: str, *columns: np.ndarray | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[n.split()[0] for n in names.split(", ")])


def _first(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _zipped(texts: DataFrame) -> DataFrame:
    """(doc, mark, body): texts compressed, as they are shuffled whole."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            body = [packer.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield _batch(_BODY, batch.column(0), batch.column(1), body)

    return texts.mapInArrow(pack, _BODY).where(F.col("doc").isNotNull())


_BODY = "doc long, mark long, body binary"


def _unzipped(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b) for b in column.to_pylist()]


# Pass 1: the anchor's gram.

#: A row's key is 48 bits of the gram's hash and what is to be done: the row is judged; it tells that its gram stands in
#: several documents; its own anchor is known to be one of those.
_JUDGE, _TELL, _KNOWN = 0, 1, 2
_DIGIT = "key long, doc long"


def _gram_rows(texts: DataFrame, length: int) -> DataFrame:
    """(key, doc), once per document and gram. What a task sees in several documents it sends on once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            digit, doc = np.concatenate(held, axis=1)
            order = np.lexsort((doc, digit))
            digit, doc = digit[order], doc[order]
            keep = _first(digit, doc)
            digit, doc = digit[keep], doc[keep]
            start = np.flatnonzero(_first(digit))
            size = np.diff(np.append(start, len(digit)))
            several = np.repeat(size > 1, size)
            told = start[size > 1]
            # in the order of documents, so that rows side by side compress
            own = np.argsort(doc, kind="stable")
            yield _batch(_DIGIT, (digit << 2 | np.where(several, _KNOWN, _JUDGE))[own], doc[own])
            yield _batch(_DIGIT, digit[told] << 2 | _TELL, doc[told])

        count = 0
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, 512):
                texts = [(t or "").encode() for t in batch.column(2).slice(at, 512).to_pylist()]
                found = anchors(texts, length)
                held.append(np.stack([(found[:, 3] >> np.uint64(16)).astype(np.int64), docs[at : at + 512][found[:, 0].astype(np.int64)]]))
                count += len(found)
                if count >= COMBINE:
                    yield from flush()
                    held, count = [], 0
        if count:
            yield from flush()

    return texts.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).mapInArrow(rows, _DIGIT)


def _shared_grams(rows: DataFrame) -> DataFrame:
    """(doc, digit): the grams of each document that stand in another one too. A task holds one row of an open group."""
    out = "doc long, digit long"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = np.empty(0, dtype=np.int64)
        open_doc = np.empty(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate([open_key, batch.column(0).to_numpy()])
            doc = np.concatenate([open_doc, batch.column(1).to_numpy()])
            known = key & 3 == _KNOWN
            if known.any():
                yield _batch(out, doc[known], key[known] >> 2)
                key, doc = key[~known], doc[~known]
            if not len(key):
                open_key, open_doc = key, doc
                continue
            digit = key >> 2
            start = np.flatnonzero(_first(digit))
            size = np.diff(np.append(start, len(key)))
            low, high = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
            several = (low < high) | (np.maximum.reduceat(key & 3, start) == _TELL)
            take = np.repeat(several, size) & (key & 3 == _JUDGE)
            if take.any():
                yield _batch(out, doc[take], digit[take])
            # the last group may go on: one row stands for it, which is a teller if it is known to stand in several documents
            open_key, open_doc = key[-1:].copy(), doc[-1:].copy()
            if several[-1]:
                open_key[0] = digit[-1] << 2 | _TELL

    route = F.when(F.col("key").bitwiseAND(3) == _KNOWN, F.xxhash64("doc")).otherwise(F.shiftright("key", 2))
    return rows.repartition(route).sortWithinPartitions("key", "doc").mapInArrow(judge, out)


# Pass 2: all strings around an anchor.

_AROUND = "gram long, around long, doc long, at long"


def _around_rows(found: DataFrame, length: int) -> DataFrame:
    """(gram, around, doc, at) of the anchors left, once per text and content; those that a task has seen in a smaller document are marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            table = np.concatenate(held)
            table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))]
            keep = _first(table[:, 0], table[:, 1], table[:, 2], table[:, 3] >> 38)  # one of those alike in a text
            table = table[keep]
            start = np.flatnonzero(_first(table[:, 0], table[:, 1]))
            least = np.repeat(table[start, 2], np.diff(np.append(start, len(table))))
            table[:, 3] |= np.where(table[:, 2] > least, _DONE, 0)
            return _batch(_AROUND, *table[np.argsort(table[:, 2], kind="stable")].T)

        count = 0
        for batch in batches:
            docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                table = anchors(_unzipped(part.column(2)), length)
                row = table[:, 0].astype(np.int64)
                digit = (table[:, 3] >> np.uint64(16)).astype(np.int64)
                lists = part.column(3)
                wanted, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
                # (row, digit) pairs as sorted keys: digits have 48 bits, rows of a part 10
                pairs = np.sort(owner << 48 | wanted)
                own = row << 48 | digit
                near = np.minimum(np.searchsorted(pairs, own), max(0, len(pairs) - 1))
                take = pairs[near] == own if len(pairs) else np.zeros(len(own), dtype=bool)
                table, row = table[take], row[take]
                if len(table):
                    at = _place(marks[s + row], table[:, 1].astype(np.int64), table[:, 2].astype(np.int64))
                    held.append(np.stack([table[:, 3].view(np.int64), table[:, 4].view(np.int64), docs[s + row], at], axis=1))
                    count += len(table)
                if count >= COMBINE:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return found.select("doc", "mark", "body", "digits").mapInArrow(rows, _AROUND)


#: An anchor all of whose strings are repeated (step 0), or one to be compared string by string: with the others of its
#: gram (1), or, if these are more than LIMIT, each string for itself (2).
_JUDGED = "doc long, at long, gram long, step int"


def _compare_around(rows: DataFrame) -> DataFrame:
    """Rows sorted by (gram, around, doc): of equal bytes the first document keeps them, and the others' are repeated.

    The first of each content go on if they belong to several documents. A task holds LIMIT rows of an open group.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), dtype=np.int64)  # the first of each content in the open group, or the last one of them
        split = None  # the open group's gram, if its rows have been sent on for comparison string by string

        def out(table: np.ndarray, step: np.ndarray | int) -> pa.RecordBatch:
            return _batch(_JUDGED, table[:, 2], table[:, 3] & ~_DONE, table[:, 0], pa.array(np.broadcast_to(step, len(table)).astype(np.int32)))

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and split is None and held[:, 2].min() < held[:, 2].max():
                yield out(held, 1)

        for batch in batches:
            table = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            done = table[:, 3] & _DONE > 0
            if done.any():
                yield out(table[done], 0)
                table = table[~done]
            if not len(table):
                continue
            if len(held) and held[0, 0] != table[0, 0]:
                yield from close()
                held, split = held[:0], None
            old = len(held)
            table = np.concatenate([held, table])
            start = np.flatnonzero(_first(table[:, 0], table[:, 1]))
            least = np.repeat(table[start, 2], np.diff(np.append(start, len(table))))
            repeated = table[:, 2] > least
            if repeated.any():
                yield out(table[repeated], 0)
            kept, is_new = table[~repeated], (np.arange(len(table)) >= old)[~repeated]
            groups = np.flatnonzero(_first(kept[:, 0]))
            sizes = np.diff(np.append(groups, len(kept)))
            several = np.minimum.reduceat(kept[:, 2], groups) < np.maximum.reduceat(kept[:, 2], groups)
            step = np.where(sizes > LIMIT, 2, np.where(several, 1, 0))
            if split is not None and kept[0, 0] == split:
                step[0] = 2
            last = groups[-1]
            step_of = np.repeat(step, sizes)
            ends = np.arange(len(kept)) < last  # groups that have ended
            send = (step_of > 0) & (ends | (step_of == 2)) & (is_new | (split is None) | (kept[:, 0] != (split or 0)))
            if send.any():
                yield out(kept[send], step_of[send])
            held, split = kept[last:], kept[last, 0] if step[-1] == 2 else None
            if split is not None:
                held = held[-1:]
        if len(held):
            yield from close()

    waits = F.col("at").bitwiseAND(_DONE) == 0
    route = F.when(waits, F.col("gram")).otherwise(F.xxhash64("doc"))
    return rows.repartition(route).sortWithinPartitions("gram", "around", "doc", "at").mapInArrow(judge, _JUDGED)


# Pass 3: the single strings.

_STRINGS = "key long, twin long, doc long, at long, string int, content binary"
_ANSWERS = "doc long, at long, mask long"


def _string_rows(found: DataFrame, length: int) -> DataFrame:
    """The bytes around each anchor that is left, for comparison within its gram; or, for a gram with very many of them,
    a row per string, by the string's two hashes. Of equal ones in a task the smallest document's goes on, and the others'
    are repeated (string is then the number of the string with its sign turned)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain: list[tuple] = []
            single: list[np.ndarray] = []
            for doc, mark, body, todo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                text = zstandard.ZstdDecompressor().decompress(body.as_py())
                for item in todo:
                    own, low, n = _parts(item["at"])
                    if own != mark & 0x1FFFFFF:
                        continue
                    content = text[low : low + n - 1 + length]
                    if item["step"] == 1:
                        plain.append((item["gram"], doc, item["at"], content))
                        continue
                    data = np.frombuffer(content, dtype=np.uint8)
                    i = np.arange(n)
                    a, b = (_hashes(_prefixes(data, f), i, i + length, f).view(np.int64) for f in (0, 1))
                    single.append(np.stack([a, b, np.full(n, doc), np.full(n, item["at"]), i], axis=1))
            if plain:
                gram, doc, at, content = zip(*plain)
                yield _batch(_STRINGS, list(gram), np.zeros(len(gram), dtype=np.int64), list(doc), list(at), np.full(len(gram), -1, dtype=np.int32), list(content))
            if single:
                table = np.concatenate(single)
                table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
                start = np.flatnonzero(_first(table[:, 0], table[:, 1]))
                later = table[:, 2] > np.repeat(table[start, 2], np.diff(np.append(start, len(table))))
                number = np.where(later, -2 - table[:, 4], table[:, 4]).astype(np.int32)
                yield _batch(_STRINGS, *table[:, :4].T, number, pa.nulls(len(table), pa.binary()))

    return found.select("doc", "mark", "body", "todo").mapInArrow(rows, _STRINGS)


def _compare_strings(rows: DataFrame, length: int) -> DataFrame:
    """(doc, at, mask): the strings of an anchor, by bits of ``mask``, that stand in a smaller document."""

    def of_groups(key: np.ndarray, doc: np.ndarray, at: np.ndarray, content: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = at & 63
        sizes = n - 1 + length
        row = np.repeat(np.arange(len(key)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        hashes = np.empty((2, len(row)), dtype=np.uint64)
        begin = 0
        while begin < len(key):  # as many rows at a time as the tables of powers reach
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), CHUNK, side="right")))
            data = np.frombuffer(b"".join(content[begin:end]), dtype=np.uint8)
            mine = (row >= begin) & (row < end)
            low = (np.cumsum(sizes[begin:end]) - sizes[begin:end])[row[mine] - begin] + number[mine]
            for f in (0, 1):
                hashes[f, mine] = _hashes(_prefixes(data, f), low, low + length, f)
            begin = end
        order = np.lexsort((doc[row], hashes[1], hashes[0], key[row]))
        row, number = row[order], number[order]
        start = np.flatnonzero(_first(key[row], hashes[0][order], hashes[1][order]))
        later = doc[row] > np.repeat(doc[row[start]], np.diff(np.append(start, len(row))))
        if later.any():
            mask = np.zeros(len(key), dtype=np.int64)
            np.bitwise_or.at(mask, row[later], np.int64(1) << number[later])
            hit = np.flatnonzero(mask)
            yield _batch(_ANSWERS, doc[hit], at[hit], mask[hit])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the open group's rows, LIMIT at most
        last = None  # (key, twin, doc) of the open group of single strings
        for batch in batches:
            key, twin, doc, at, string = (batch.column(i).to_numpy() for i in range(5))
            done = string <= -2
            if done.any():
                yield _batch(_ANSWERS, doc[done], at[done], np.int64(1) << (-2 - string[done]).astype(np.int64))
            one = string >= 0
            if one.any():
                table = np.stack([key[one], twin[one], doc[one], at[one], string[one]], axis=1)
                fresh = _first(table[:, 0], table[:, 1])
                least = np.repeat(table[fresh, 2], np.diff(np.append(np.flatnonzero(fresh), len(table))))
                if last is not None and last[:2] == (table[0, 0], table[0, 1]):
                    least[: np.append(np.flatnonzero(fresh), len(table))[1]] = last[2]
                later = table[:, 2] > least
                if later.any():
                    yield _batch(_ANSWERS, table[later, 2], table[later, 3], np.int64(1) << table[later, 4])
                last = (table[-1, 0], table[-1, 1], least[-1])
            whole = np.flatnonzero(string == -1)
            if len(whole):
                held += zip(key[whole].tolist(), doc[whole].tolist(), at[whole].tolist(), batch.column(5).take(pa.array(whole)).to_pylist())
                ended = len(held)
                while ended and held[ended - 1][0] == held[-1][0]:
                    ended -= 1
                if ended:
                    k, d, a, c = zip(*held[:ended])
                    yield from of_groups(np.array(k), np.array(d), np.array(a), list(c))
                    held = held[ended:]
        if held:
            k, d, a, c = zip(*held)
            yield from of_groups(np.array(k), np.array(d), np.array(a), list(c))

    route = F.when(F.col("string") <= -2, F.xxhash64("doc", "at")).otherwise(F.col("key"))
    return rows.repartition(route).sortWithinPartitions("key", "twin", "doc").mapInArrow(compare, _ANSWERS)


# The result.

_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _covered(text: bytes, table: np.ndarray, at: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """True for each byte of ``text`` in a repeated string; ``table`` are its anchors, ``at`` and ``mask`` those with repeated strings."""
    low, n = table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)
    _, alike = np.unique(table[:, 3] * np.uint64(_BASES[0]) ^ table[:, 4], return_inverse=True)
    bits = np.zeros(alike.max() + 1, dtype=np.int64)
    np.bitwise_or.at(bits, alike[np.searchsorted(low, _parts(at)[1])], mask)  # also for its likes in this text
    number = np.arange(63)
    hit = (bits[alike][:, None] >> number & 1).astype(bool) & (number < n[:, None])
    starts = np.zeros(len(text) + 1, dtype=np.int32)
    starts[(low[:, None] + number)[hit] + 1] = 1
    starts = np.cumsum(starts)
    place = np.arange(len(text))
    return starts[place + 1] > starts[np.maximum(place + 1 - length, 0)]


def _results(answered: DataFrame, length: int) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts, marks = _unzipped(part.column(2)), part.column(1).to_numpy()
                found: list[tuple[np.ndarray, np.ndarray] | None] = []
                for mark, answers in zip(marks, part.column(3)):
                    if not answers.is_valid:
                        found.append(None)
                        continue
                    at, mask = (np.asarray(answers.values.field(i)) for i in (0, 1))
                    own = at >> 38 == mark & 0x1FFFFFF
                    found.append((at[own], mask[own]) if own.any() else None)
                table = anchors([t if f else b"" for t, f in zip(texts, found)], length)
                ends = np.searchsorted(table[:, 0], np.arange(len(texts) + 1).astype(np.uint64))
                spans, kept = [], []
                for i, (text, own) in enumerate(zip(texts, found)):
                    if own is None:
                        spans.append([])
                        kept.append(text)
                        continue
                    gone = _covered(text, table[ends[i] : ends[i + 1]], *own, length)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                    kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
                yield _batch(_RESULT, part.column(0), np.array([len(t) for t in texts], dtype=np.int64), pa.array(spans, _SPANS), pa.array(kept, pa.binary()))

    return answered.select("doc", "mark", "body", "answers").mapInArrow(apply, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each document: the byte runs [start, end) of its UTF-8 text that are covered by a
    string of ``length`` bytes that also starts in a document of smaller id, and the other bytes in one piece.

    Strings are compared over whole texts as given, so what is removed elsewhere counts too, and none crosses documents.
    Two strings are equal if two 64-bit hashes of all their bytes are.

    Null texts are empty; texts under ``length`` bytes stay whole. Rows of one id are documents of their own that remove
    nothing from each other; rows that repeat id and text have equal results. Rows with a null id stay whole, and no other
    row loses anything to them. Other columns are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    bodies = _zipped(texts)
    in_lists = lambda found, item, name: found.repartition("doc").groupBy("doc").agg(F.collect_list(item).alias(name))
    grams = _shared_grams(_gram_rows(texts, length))
    judged = _compare_around(_around_rows(bodies.join(in_lists(grams, F.col("digit"), "digits"), "doc"), length))
    todo = in_lists(judged.where("step > 0"), F.struct("at", "gram", "step"), "todo")
    strings = _compare_strings(_string_rows(bodies.join(todo, "doc"), length), length)
    whole = judged.where("step = 0").select("doc", "at", F.lit(-1).cast("long").alias("mask"))
    answers = in_lists(whole.unionByName(strings), F.struct("at", "mask"), "answers")
    kept = _results(bodies.join(answers, "doc", "left"), length)
    nameless = texts.where(F.col("doc").isNull()).select(
        F.col("doc").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.encode("text", "UTF-8").alias("kept")
    )
    return kept.unionByName(nameless)


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
