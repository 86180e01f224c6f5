"""BPE encoding and decoding by tree concatenation: segments are encoded apart, and windows around each join anew until both sides agree."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import sorted_groups
from .packing import byte_alphabet

#: Characters of a segment that is encoded at once, and of a text whose segments are dealt out over the cluster.
SEGMENT, LONG_TEXT = 1024, 65_536
#: Words of a generation of the cache; two are kept.
CACHED_WORDS = 250_000
#: Ends a word in the fast encoding; settled texts do not hold it.
END = "\x00"
#: Code points whose letter, digit, space and lower-case rules no Unicode version or library disputes.
_SETTLED_RANGES = r"\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-ž‐-‧‰-⁞"
_SETTLED = re.compile(f"[{_SETTLED_RANGES}]*+")


def _settled_class(kind: str) -> str:
    """The settled characters of a Unicode category, for a pattern's brackets."""
    member = re.compile(f"[{_SETTLED_RANGES}]")
    return "".join(chr(c) for c in range(0x2100) if unicodedata.category(chr(c))[0] == kind and member.match(chr(c)))


class Codec:
    """Encodes and decodes exactly as the tokenizers library does with the file ``path``.

    Texts of settled characters go word by word through a bounded cache that the library fills; all
    others, and tokenizers of another build than lower-casing word BPE, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.specials = [t["content"] for t in described["added_tokens"]]
        self.words = self._word_pattern(described)
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(vocab.values()) + 1)
        for content, i in vocab.items():
            self.token[i] = content
        suffix = described["model"].get("end_of_word_suffix")
        self.word_end = np.array([bool(suffix) and t.endswith(suffix) for t in self.token])
        self.fast = self._fast_words(described)
        self.joined = described["decoder"] is None  # without a decoder, tokens are joined by spaces
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _word_pattern(described: dict):
        """The pattern of words that the model sees one by one, or None if the tokenizer is not of that kind."""
        steps = (described["normalizer"] or {}).get("normalizers", [])
        parts = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        if not kinds or not parts[0]["invert"] or parts[0]["behavior"] != "Removed" or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return None
        pattern = parts[0]["pattern"]["Regex"]
        if set(re.findall(r"\\(p\{\w+\}|\w)", pattern)) - {"p{L}", "p{N}", "s"}:
            return None
        return re.compile(pattern.replace(r"\p{L}", _settled_class("L")).replace(r"\p{N}", _settled_class("N")))

    def settled(self, text: str) -> bool:
        return self.words is not None and _SETTLED.fullmatch(text) is not None and not any(x in text for x in self.specials)

    def by_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str, segment: int = SEGMENT) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit numbers; a text of over ``segment`` characters as a tree."""
        if self.settled(text):
            lower = text.lower()
            if len(lower) <= segment:
                return b"".join(self._ids_of(self.words.findall(lower)))
            return b"".join(self.tree_of_words(lower, segment)[1])
        if len(text) > segment:
            normal = self.normalized(text)
            if not any(x in text or x in normal for x in self.specials):
                ends = cuts(normal, segment)
                return self.tree(normal, [(a, b, self.leaf(normal, a, b)) for a, b in zip([0, *ends], ends)])
        return np.array(self.by_library(text), dtype="<u4").tobytes()

    def _ids_of(self, words: list[str]) -> list[bytes]:
        young = self.young
        fresh = {w for w in words if w not in young}
        if fresh:
            if len(young) > CACHED_WORDS:
                self.old, self.young = young, {}
                young, fresh = self.young, set(words)
            old = self.old
            kept = [w for w in fresh if w in old]
            young.update((w, old[w]) for w in kept)
            fresh.difference_update(kept)
            young.update(self._encoded_words(list(fresh)))
        return [young[w] for w in words]

    # Tree concatenation of texts that are taken word by word.

    def tree_of_words(self, lower: str, segment: int, low: int = 0, high: int | None = None) -> tuple[list, list]:
        """(spans, ids) of the words of lower[low:high]: those of its halves, joined."""
        high = len(lower) if high is None else high
        if high - low <= segment:
            spans = [m.span() for m in self.words.finditer(lower, low, high)]
            return spans, self._ids_of([lower[a:b] for a, b in spans])
        cut = (low + high) // 2
        return self._join_words(lower, self.tree_of_words(lower, segment, low, cut), self.tree_of_words(lower, segment, cut, high), low, cut, high)

    def _join_words(self, lower: str, left: tuple[list, list], right: tuple[list, list], low: int, cut: int, high: int) -> tuple[list, list]:
        """The words of lower[low:high] from those of its halves, which the cut may have severed.

        A window around the cut is taken anew and doubled until one of its words, clear of its edges, ends before the
        cut and is also one of the left half, and another one begins after it and is one of the right half. From a
        word that both have on, both go on alike, since a word depends on its start and the text behind it only.
        """
        reach = 64
        while True:
            a, b = max(low, cut - reach), min(high, cut + reach)
            window = [m.span() for m in self.words.finditer(lower, a, b)]
            head, first = (0, 0) if a == low else _same_word(window, left[0], a + 1, cut - 1)
            tail, last = (len(right[0]), len(window)) if b == high else _same_word(window, right[0], cut, b - 1)
            if head is not None and tail is not None:
                if a > low:
                    head, first = head + 1, first + 1
                middle = window[first:last]
                return left[0][:head] + middle + right[0][tail:], left[1][:head] + self._ids_of([lower[x:y] for x, y in middle]) + right[1][tail:]
            reach *= 2

    def _fast_words(self, described: dict):
        """(tiktoken encoding of words ended by END, id of each of its ranks), or None if the merges do not allow it.

        The end mark joins the last byte before any merge, as the model's own suffix does; each merge
        must make a token of its own, so that a pair is known by what it makes.
        """
        model, alphabet = described["model"], byte_alphabet()
        suffix = model.get("end_of_word_suffix")
        raw = lambda t: bytes(alphabet[c] for c in t.removesuffix(suffix)) + (END.encode() if t.endswith(suffix) else b"")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = ["".join((x.removesuffix(suffix) if i == 0 else x) for i, x in enumerate(p)) for p in pairs] if suffix else []
        vocab = model["vocab"]
        if self.words is None or not made or len(set(made)) < len(made) or not all(t in vocab for t in made):
            return None
        single = {bytes([v]): c for c, v in alphabet.items()}
        order = [(x + END.encode(), c + suffix) for x, c in single.items()] + list(single.items()) + [(raw(t), t) for t in made]
        ranks = {x: i for i, (x, _) in enumerate(order)}
        if len(ranks) < len(order) or not all(t in vocab for _, t in order):
            return None
        encoding = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})
        return encoding, np.array([vocab[t] for _, t in order], dtype="<u4")

    def _encoded_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids: all in one call, told apart by the tokens that end a word."""
        if self.fast is not None:
            encoding, id_of = self.fast
            ids = id_of[encoding.encode_to_numpy("".join([w + END for w in words]), disallowed_special=())]
            ends = (4 * (np.flatnonzero(self.word_end[ids]) + 1)).tolist()
            if len(ends) == len(words) and (not ends or ends[-1] == 4 * len(ids)):
                raw = ids.tobytes()
                return zip(words, (raw[a:b] for a, b in zip([0, *ends], ends)))
        encoded = self.library.encode_batch_fast(words, add_special_tokens=False)
        return ((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(words, encoded))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if not self.joined:
            return self.library.decode(numbers, skip_special_tokens=False)
        token = self.token
        return " ".join([token[i] for i in numbers])

    def normalized(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    # Tree concatenation of other texts, token by token. Tokens are rows (id, from, to) of an array.

    def leaf(self, text: str, start: int, end: int) -> np.ndarray:
        """The tokens of text[start:end] taken alone."""
        encoded = self.library.encode(text[start:end], add_special_tokens=False)
        spans = np.array(encoded.offsets, dtype=np.int32).reshape(-1, 2) + start
        return np.column_stack([np.array(encoded.ids, dtype=np.int32), spans.astype(np.int32)])

    def join(self, text: str, left: np.ndarray, right: np.ndarray, low: int, cut: int, high: int) -> np.ndarray:
        """The tokens of text[low:high] from those of text[low:cut] and text[cut:high].

        A window around the cut is encoded anew and doubled until it agrees with the left tokens on a
        run of tokens before the cut and with the right tokens after it: two tokens of the text with a
        word boundary between them, or a run of ``AGREE`` tokens where the text has none. A window
        that reaches both ends is the encoding itself.
        """
        reach = 64
        while True:
            a, b = max(low, cut - reach), min(high, cut + reach)
            window = self.leaf(text, a, b)
            before = 0 if a == low else self._agreement(text, left[_index(left, a) :], window, cut, forward=False)
            after = 0 if b == high else self._agreement(text, right[: _index(right, b)], window, cut, forward=True)
            if before is not None and after is not None:
                head = left[:0] if a == low else left[: _index(left, before)]
                tail = right[:0] if b == high else right[_index(right, after) :]
                middle = window if a == low else window[_index(window, before) :]
                middle = middle if b == high else middle[: _index(middle, after)]
                return np.concatenate([head, middle, tail])
            reach *= 2

    AGREE = 16

    def _agreement(self, text: str, side: np.ndarray, window: np.ndarray, cut: int, forward: bool) -> int | None:
        """A token start at which ``side`` and ``window`` may be spliced, or None.

        It must be one around which both have the same tokens: for a run of AGREE tokens, or on both
        sides of white space, over which no token reaches.
        """
        starts = {(i, p, q) for i, p, q in side.tolist() if (p >= cut if forward else q <= cut)}
        run: list[tuple[int, int, int]] = []
        tokens = list(map(tuple, window.tolist()))
        edge = len(text) if not tokens else (tokens[-1][2] if forward else tokens[0][1])
        for t in tokens if forward else reversed(tokens):
            inside = t[1] >= cut if forward else t[2] <= cut
            if not inside:
                continue
            if t[2] == edge if forward else t[1] == edge:
                return None  # the window's own end may have shaped this token
            if t not in starts:
                run = []
                continue
            if run:
                a, b = (run[-1], t) if forward else (t, run[-1])
                if b[1] > a[2] and text[a[2] : b[1]].isspace():
                    return b[1]
                if b[1] != a[2]:
                    run = []
            run.append(t)
            if len(run) == self.AGREE:
                middle = run[self.AGREE // 2]
                return middle[1]
        return None

    def tree(self, text: str, leaves: list[tuple[int, int, np.ndarray]]) -> bytes:
        """Ids of the concatenation of (from, to, tokens) of neighbouring segments, pair by pair, level by level."""
        while len(leaves) > 1:
            level = []
            for i in range(0, len(leaves) - 1, 2):
                (low, cut, left), (_, high, right) = leaves[i], leaves[i + 1]
                level.append((low, high, self.join(text, left, right, low, cut, high)))
            leaves = level + leaves[len(level) * 2 :]
        return leaves[0][2][:, 0].astype("<u4").tobytes() if leaves else b""


def _same_word(window: list[tuple[int, int]], side: list[tuple[int, int]], low: int, high: int) -> tuple[int | None, int]:
    """(place in ``side``, place in ``window``) of the first word within low..high that both hold; (None, 0) if there is none."""
    for at, span in enumerate(window):
        if span[0] >= low and span[1] <= high:
            k = bisect_left(side, span)
            if k < len(side) and side[k] == span:
                return k, at
    return None, 0


def _index(tokens: np.ndarray, start: int) -> int:
    """The first token that starts at ``start`` or later; several may share it where one character has many bytes."""
    return int(np.searchsorted(tokens[:, 1], start))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(text: str, segment: int) -> list[int]:
    """Ends of halves of halves down to ``segment`` characters, never before a combining mark."""

    def split(low: int, high: int) -> list[int]:
        if high - low <= segment:
            return [high]
        middle = (low + high) // 2
        while middle < high and not (text[middle].isascii() and text[middle - 1].isascii()) and middle - low < (high - low) * 3 // 4:
            middle += 1
        return split(low, middle) + split(middle, high)

    return split(0, len(text)) if text else []


_OUT = "doc_id long, n_tokens long, ids binary, decoded string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_BATCH = 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if size >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def encode_documents(
    docs: DataFrame, tokenizer: str, long_text: int = LONG_TEXT, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text; ``ids`` is little-endian unsigned 32-bit.

    A text is cut into halves of halves of at most ``segment`` characters, wherever that is, which are
    encoded apart and concatenated as a tree. Texts of at most ``long_text`` characters stay in the
    task that reads them, without a shuffle; the segments of longer ones, sixteen times that size, are
    dealt out over the cluster and meet as arrays, one text per group.

    Null texts count as empty: no ids, an empty decoded text. Each repeated row and each row with a
    null id gives a row of its own. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    ids = code.encode(text.as_py(), segment)
                    yield doc.as_py(), len(ids) // 4, ids, code.decode(ids)

        yield from _batches(rows(), _OUT_ARROW)

    segments_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("until", pa.int64()), ("text", pa.string())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, doc, text in zip(*(batch.column(i) for i in range(3))):
                    normal, low = code.normalized(text.as_py()), 0
                    if any(s in text.as_py() or s in normal for s in code.specials):
                        yield row.as_py(), doc.as_py(), -1, len(normal), text.as_py()
                        continue
                    for high in cuts(normal, 16 * segment):
                        yield row.as_py(), doc.as_py(), low, high, normal[low:high]
                        low = high

        yield from _batches(rows(), segments_schema)

    tokens_schema = pa.schema([*segments_schema, ("ids", pa.binary()), ("tokens", pa.binary())])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row, doc, at, until, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if at < 0:
                        yield row, doc, at, until, text, np.array(code.by_library(text), dtype="<u4").tobytes(), b""
                    else:
                        yield row, doc, at, until, text, b"", code.leaf(text, 0, len(text)).astype("<i4").tobytes()

        yield from _batches(rows(), tokens_schema)

    def concatenate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = codec(tokenizer)
        for group in sorted_groups(frames, ["row"]):
            first = group.iloc[0]
            if first["at"] < 0:
                ids = first["ids"]
            else:
                text, parts = "".join(group["text"]), []
                for at, until, raw in zip(group["at"], group["until"], group["tokens"]):
                    parts.append((at, until, np.frombuffer(raw, dtype="<i4").reshape(-1, 3) + np.array([0, at, at], dtype="<i4")))
                ids = code.tree(text, parts)
            doc = None if pd.isna(first["doc_id"]) else int(first["doc_id"])
            yield pd.DataFrame({"doc_id": pd.array([doc], dtype="Int64"), "n_tokens": [len(ids) // 4], "ids": [ids], "decoded": [code.decode(ids)]})

    is_long = F.char_length("text") > long_text
    short = slim.where(~is_long).mapInArrow(whole, _OUT)
    numbered = slim.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, at long, until long, text string"
    dealt = numbered.mapInArrow(segments, schema).repartition("row", "at")
    encoded = dealt.mapInArrow(leaves, schema + ", ids binary, tokens binary")
    long = encoded.repartition("row").sortWithinPartitions("row", "at").mapInPandas(concatenate, _OUT)
    return short.unionByName(long)
