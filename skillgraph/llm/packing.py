"""Packing by power-of-two decomposition: every piece is a sequence of its own, of a power-of-two length."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies, by its rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function text -> uint32 ids of the byte-level BPE vocabulary in ``path``.

    Where the file is a plain byte-level BPE (no normalizer, the byte-level pattern, added tokens without
    flags, ids that ascend with merge ranks) the same vocabulary runs in tiktoken, several times faster than
    the tokenizers library; any text that it refuses, and any other vocabulary, goes to tokenizers.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def plain(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    vocab, merges = described["model"]["vocab"], described["model"]["merges"]
    parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocab.get("".join(m), -1) for m in parts]
    alphabet = byte_alphabet()
    step, added = described["pre_tokenizer"] or {}, described["added_tokens"]
    byte_level = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space")
    flagged = any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word"))
    unlike = described["normalizer"] is not None or not byte_level or flagged or described["model"].get("continuing_subword_prefix") or described["model"].get("end_of_word_suffix")
    if unlike or made != sorted(made) or -1 in made or any(set(t) - set(alphabet) for t in vocab if t not in special):
        return plain
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except BaseException as error:  # a refusal of the native regex is not an Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return plain(text)

    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """Binary pieces of ``n`` ids, longest first: whole pieces of ``longest``, then the bits of the rest."""
    lengths, rest = [longest] * (n // longest), n % longest
    while rest:
        lengths.append(1 << (rest.bit_length() - 1))
        rest -= lengths[-1]
    return lengths


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def pack_documents(
    docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, bucket, offset) of all documents.

    ``ids`` holds little-endian unsigned 32-bit ids. A document's ids, ended by ``end_id``, are cut
    into the powers of two of its length (whole ``max_tokens`` first); each piece is one sequence, so
    no sequence crosses documents and none is padded. ``bucket`` is the piece's length: sequences of
    one bucket make batches of equal length (``write_buckets``). There is no shuffle.

    Null and empty texts: one piece that holds ``end_id``. Repeated rows and null ids: each row is
    packed on its own. ``max_tokens`` must be a power of two. Other columns are ignored.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                raw, start, doc_id = ids.astype("<u4", copy=False).tobytes(), 0, doc.as_py()
                for length in piece_lengths(len(ids), max_tokens):
                    rows.append((doc_id, start, length, raw[4 * start : 4 * (start + length)], len(ids)))
                    start += length
                held += len(raw)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, _SCHEMA)
    return pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.col("length").alias("bucket"), F.lit(0).cast("long").alias("offset")
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences as Parquet folders of equal length, ready to be batched without padding."""
    pieces.write.partitionBy("bucket").mode("overwrite").parquet(path)
