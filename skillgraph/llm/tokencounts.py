"""Token counts under a unigram vocabulary: one forward score per shared prefix of the distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mark of a word's start, as the vocabulary writes it.
START = "▁"
#: Pre-tokens whose counts a worker keeps, and characters of text whose new pre-tokens share one trie walk.
CACHED, WALK_CHARS = 300_000, 4_000_000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], float]:
    """(score of each piece, score of an unknown character) from a SentencePiece model file.

    The file's scores are merge ranks, so a piece's log probability is taken by Zipf's law from its
    rank; an unknown character scores ten below the least.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
    return scores, min(scores.values()) - 10


class TrieCounter:
    """Counts of the best segmentation of pre-tokens: the most probable one, of equal ones the shortest.

    The distinct new pre-tokens, sorted, are their trie in preorder: the walk keeps the forward score
    (log probability, pieces) of every prefix on the path to the current one, so a prefix that many
    share is scored once, and only the path is in memory. Counts of terminals are stored.
    """

    def __init__(self, scores: dict[str, float], unknown: float):
        self.scores, self.unknown = scores, unknown
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}

    def insert(self, words: set[str]) -> None:
        scores, unknown, longest, counts = self.scores, self.unknown, self.longest, self.counts
        best, pieces, path = [0.0], [0], ""
        for word in sorted(words):
            token = START + word
            shared, most = 0, min(len(path), len(token))
            while shared < most and path[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                top, fewest = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = scores.get(token[start:end])
                    if score is None:
                        if start != end - 1:
                            continue
                        score = unknown
                    score += best[start]
                    if score > top or (score == top and pieces[start] + 1 < fewest):
                        top, fewest = score, pieces[start] + 1
                best.append(top)
                pieces.append(fewest)
            path = token
            counts[word] = pieces[-1]

    def count(self, texts: list[list[str]]) -> list[int]:
        """Pieces of each list of pre-tokens."""
        counts = self.counts
        new = {w for words in texts for w in words if w not in counts}
        if len(counts) + len(new) > CACHED:
            counts.clear()
            new = {w for words in texts for w in words}
        self.insert(new)
        return [sum(map(counts.__getitem__, words)) for words in texts]


@lru_cache(maxsize=2)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(*vocabulary(path))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text, where it is read.

    Pre-tokens are runs without white space, each scored with a start mark. Null and empty texts have
    no tokens. Each repeated row and null id gives a row. Other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            at, ids, texts = 0, batch.column(0), batch.column(1)
            while at < batch.num_rows:
                words, size, low = [], 0, at
                while at < batch.num_rows and size < WALK_CHARS:
                    text = texts[at].as_py() or ""
                    words.append(text.split())
                    size, at = size + len(text), at + 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, at - low), pa.array([len(w) for w in words], pa.int64()), pa.array(counter.count(words), pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
