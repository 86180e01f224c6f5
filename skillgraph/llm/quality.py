"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration."""

from __future__ import annotations

import ctypes
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Labelled rows the model is fitted on at most, and characters of all of them together.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 64_000_000
MIN_WORD_COUNT, MAX_WORDS, MAX_SHAPES = 8, 50_000, 4096
#: Words whose ids a worker keeps, or the driver while it fits, and characters of the longest of them.
CACHED_WORDS, FITTING_WORDS, CACHED_CHARS = 400_000, 80_000, 256


def shape(word: str) -> str:
    """A word's outline: runs of capitals X, small letters x, digits 9; doubled marks are marked by +."""
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
        elif kind not in "Xx9" and (len(out) < 2 or out[-1] != "+"):
            out.append("+")
    return "".join(out)


def index_vector(key: str) -> np.ndarray:
    """The sparse ternary random index vector of a word or shape: eight signed ones, chosen by its hash."""
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    bits = xxhash.xxh128_intdigest(key.encode())
    for k in range(8):
        part = bits >> (16 * k)
        out[part % DIMENSIONS] += 1 if part >> 15 & 1 else -1
    return out


@dataclass
class Model:
    """Word vectors and network. ``constant`` is the score of every text where nothing could be fitted."""

    words: dict[str, int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    word_vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, DIMENSIONS), dtype=np.float32))
    shape_vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, DIMENSIONS), dtype=np.float32))
    layers: tuple = ()
    temperature: float = 1.0
    constant: float = 0.5

    def __post_init__(self):
        self.cache: dict[str, tuple[int, int]] = {}
        self.room = CACHED_WORDS

    def ids(self, word: str) -> tuple[int, int]:
        if len(self.cache) > self.room:
            self.cache.clear()
        found = self.words.get(word.lower(), 0), self.shapes.get(shape(word), 0)
        if len(word) <= CACHED_CHARS:
            self.cache[word] = found
        return found

    def pooled(self, text: str | None) -> np.ndarray:
        """The mean vectors of a text's words and shapes; a word that repeats the one before has a shape of its own."""
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(2 * DIMENSIONS + 1, dtype=np.float32)
        get, total = self.cache.get, np.zeros(2 * DIMENSIONS + 1, dtype=np.float64)
        for at in range(0, len(tokens), 20_000):
            part = tokens[at : at + 20_000]
            pairs = np.array([get(w) or self.ids(w) for w in part], dtype=np.int64)
            pairs[1:, 1][np.array([a == b for a, b in zip(part, part[1:])], dtype=bool)] = 1
            words = np.bincount(pairs[:, 0])
            shapes = np.bincount(pairs[:, 1])
            w, s = np.flatnonzero(words), np.flatnonzero(shapes)
            total[:DIMENSIONS] += words[w] @ self.word_vectors[w]
            total[DIMENSIONS:-1] += shapes[s] @ self.shape_vectors[s]
        total /= len(tokens)
        total[-1] = np.log1p(len(tokens)) / 10
        return total.astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.maximum((x - mean) / scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.constant)
        z = self.logits(np.array([self.pooled(t) for t in texts]).reshape(len(texts), -1)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))


def fit_vectors(texts: list[str]) -> Model:
    """Random indexing: a word's vector sums the index vectors of its neighbours' shapes, with its own."""
    words, shapes = Counter(), Counter()
    for text in texts:
        tokens = text.split()
        words.update(t.lower() for t in tokens)
        shapes.update(map(shape, set(tokens)))
    known = [w for w, n in words.most_common(MAX_WORDS) if n >= MIN_WORD_COUNT]
    outlines = [s for s, n in shapes.most_common(MAX_SHAPES) if n >= 2]
    # id 0: unknown; shape id 1: a word equal to the one before
    model = Model({w: i + 1 for i, w in enumerate(known)}, {s: i + 2 for i, s in enumerate(outlines)})
    model.room = FITTING_WORDS
    del words, shapes
    own = np.array([index_vector("?"), index_vector("="), *map(index_vector, outlines)])
    context = np.zeros((len(known) + 1, DIMENSIONS), dtype=np.float32)
    around = np.zeros_like(own)
    for text in texts:
        tokens = text.split()
        if not tokens:
            continue
        pairs = np.array([model.cache.get(t) or model.ids(t) for t in tokens])
        pairs[1:, 1][np.array([a == b for a, b in zip(tokens, tokens[1:])], dtype=bool)] = 1
        vectors = own[pairs[:, 1]]
        beside = np.zeros_like(vectors)
        beside[1:] += np.roll(vectors[:-1], 1, axis=1)
        beside[:-1] += vectors[1:]
        np.add.at(context, pairs[:, 0], beside)
        np.add.at(around, pairs[:, 1], beside)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
    context[0] = 0
    model.word_vectors = unit(context) + np.array([np.zeros(DIMENSIONS), *map(index_vector, known)], dtype=np.float32) / 3
    model.shape_vectors = own + unit(around)
    return model


def fit(texts: list[str], labels: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Model:
    """Fit vectors, network (Adam on logistic loss) and temperature; a fifth of the rows only calibrates."""
    if len(texts) < 20 or len(set(labels.tolist())) < 2:
        return Model(constant=float((labels.sum() + 0.5) / (len(labels) + 1)))
    model = fit_vectors(texts)
    x, y = np.array([model.pooled(t) for t in texts], dtype=np.float64), labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 128):
            rows = used[at : at + 128]
            h = z[rows] @ params[0] + params[1]
            a = np.maximum(h, 0)
            error = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (h > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), a.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                params[i] = params[i] - 0.003 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    model.layers = (mean, scale, *params)
    raw, truth = model.logits(x[aside]), y[aside]

    def loss(t: float) -> float:
        p = 1 / (1 + np.exp(-np.clip(raw / t, -30, 30)))
        return float(-np.mean(truth * np.log(p + 1e-12) + (1 - truth) * np.log(1 - p + 1e-12)))

    model.temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    model.cache, model.room = {}, CACHED_WORDS
    return model


def _give_back() -> None:
    """Freed memory back to the system, where the C library can; else the driver would keep what the fit took."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most ``rows`` labelled texts that are not held out: those of the smallest hash of doc_id.

    Only this bounded sample reaches the driver, in that order and with ``chars`` characters or fewer together: a text
    that does not fit beside those before it is left out of the fit, and those after it are not, so one very long text
    costs the model no other. Labels other than 0 and 1 and contradictory labels of one doc_id are left out. The model
    knows MAX_WORDS words and MAX_SHAPES outlines of words at most, the most frequent ones of the sample.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows + rows // 4)
    order = (F.xxhash64("doc_id"), "doc_id", "mark")
    joined = texts.join(chosen.select("doc_id", "label"), "doc_id").withColumn("mark", F.xxhash64("text"))
    taken, left = [], chars
    for r in joined.select("doc_id", "mark", F.char_length("text").alias("n")).orderBy(*order).limit(rows).collect():  # ids and lengths only
        if r["n"] <= left:
            taken.append((r["doc_id"], r["mark"]))
            left -= r["n"]
    fitting = docs.sparkSession.createDataFrame(taken, "doc_id long, mark long").distinct()
    found = joined.join(F.broadcast(fitting), ["doc_id", "mark"]).orderBy(*order).limit(len(taken)).collect()
    sample, truth = [r["text"] for r in found], np.array([r["label"] for r in found], dtype=np.int64)
    del found
    model = fit(sample, truth)
    del sample
    _give_back()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, where it is read. Null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = fitted.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 from ``threshold`` on.

    Scores see the text alone. Repeated rows and null ids each give a row; a null id is not held out.
    Without two classes of labels every score is the share of label 1 seen (0.5 if none).
    """
    scored = score_documents(docs, train(docs, labels, label_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``.

    Null and empty texts score as texts of no words do, so they stay or go together. Repeated rows share their fate;
    no rows give no rows. Without two classes of labels all rows score the share of label 1 (0.5 if there are none).
    """
    model = train(docs, labels)
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, at_text = shared.value, columns.index("text")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = fitted.scores(part.column(at_text).to_pylist()) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
