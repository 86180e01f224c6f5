"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import struct
import time
import zlib
from base64 import b32encode

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skillgraph.llm import ann, bpe, components, linededup, nearcopies, packing, quality, simhash, substrings, tokencounts, vectordedup, warc

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators might use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, hash string, fp string, __mark string, mark string, idx int, component_id int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs_of(spark, texts, start=0):
    rows = [(None if i is None else i, t, "en", "s", 1, "h", "f", "m", "k", 0, 0) for i, t in (texts if isinstance(texts[0], tuple) else enumerate(texts, start))]
    return spark.createDataFrame(rows, CLASH)


ODD = [
    None, "", " ", "a", "héllo wörld ÀÉ", "日本語 テキスト", "É é ŉ ſ İI", "<|endoftext|> and <|startoftext|>", "x" * 3000, " \n\t ", "It's they'LL 123 45!!'s", "ﬁ ² ½ ª ΑΣ Σ", "🙂" * 40, "a b c\x85d", "\x1c\x1d x\x0by",
]


def empty(spark):
    return spark.createDataFrame([], CLASH)


# Packing.


def test_packing_returns_every_id_once(spark):
    rng = random.Random(1)
    texts = [*ODD, words(rng, 3000), words(rng, 3000)]
    pieces = packing.pack_documents(docs_of(spark, texts), BYTE, 64).toPandas()
    library = Tokenizer.from_file(BYTE)
    assert pieces["sequence_id"].is_unique and (pieces["offset"] == 0).all()
    assert all(n & (n - 1) == 0 and n <= 64 for n in pieces["length"])
    for i, t in enumerate(texts):
        own = pieces[pieces["doc_id"] == i].sort_values("start")
        ids = np.frombuffer(b"".join(own["ids"]), dtype="<u4").tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]


def test_packing_odd_tables(spark, tmp_path):
    assert packing.pack_documents(empty(spark), BYTE).count() == 0
    twice = packing.pack_documents(docs_of(spark, [(1, "a b"), (1, "a b"), (None, "a")]), BYTE).toPandas()
    assert twice["doc_tokens"].tolist().count(3) == 4 and twice["doc_id"].isna().sum() == 1
    with pytest.raises(ValueError):
        packing.pack_documents(empty(spark), BYTE, 100)
    packing.write_buckets(packing.pack_documents(docs_of(spark, ["a b c"]), BYTE), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {"bucket=4"}


# Token counts.


def brute_count(word, scores, unknown):
    word, best = "▁" + word, [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in scores or end - start == 1:
                options.append((best[start][0] + scores.get(piece, unknown), -(best[start][1] + 1)))
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts_match_brute_force(spark):
    rng = random.Random(2)
    texts = [*ODD, "the theory there these", words(rng, 500)]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.count_tokens(docs_of(spark, texts), PIECE).collect()}
    scores, unknown = tokencounts.vocabulary(PIECE)
    short = [(i, t) for i, t in enumerate(texts) if len(t or "") < 3000 or " " in t]
    assert {i: sum(brute_count(w, scores, unknown) for w in (t or "").split()) for i, t in short} == {i: got[i] for i, _ in short}
    assert tokencounts.count_tokens(empty(spark), PIECE).count() == 0


def test_trie_scores_each_shared_prefix_once_and_survives_a_full_cache(monkeypatch):
    scores = {"▁a": -1.0, "b": -1.0, "▁ab": -1.5, "c": -1.0}
    counter = tokencounts.TrieCounter(scores, -20.0)
    assert counter.count([["ab", "abc"], ["zz"], []]) == [1 + 2, 3, 0]
    monkeypatch.setattr(tokencounts, "CACHED", 1)
    assert counter.count([["ab", "abc", "a"]]) == [1 + 2 + 1]


def test_token_counts_of_repeated_rows_and_null_ids(spark):
    got = tokencounts.count_tokens(docs_of(spark, [(1, "a b"), (1, "a b"), (None, "a"), (2, None)]), PIECE).collect()
    assert sorted((str(r["doc_id"]), r["n_pretokens"]) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("None", 1)]


# Embeddings.


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node int, size int")


def brute_links(x, ids, threshold):
    x = np.array(x, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


def test_vector_dedup_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    near = base[:1] + rng.normal(size=(120, 16)) * 0.03  # denser than a window
    chain = [base[5] * np.cos(a) + base[6] / np.linalg.norm(base[6]) * np.linalg.norm(base[5]) * np.sin(a) for a in np.linspace(0, 1.4, 12)]
    x = np.concatenate([base, near, base[:20], chain]).astype(np.float32)
    monkeypatch.setattr(vectordedup, "WINDOW", 8)
    monkeypatch.setattr(vectordedup, "BLOCK", 16)
    ids = rng.permutation(len(x)).tolist()
    got = vectordedup.near_duplicate_vectors(vectors_of(spark, [(i, v.tolist(), 0, 0, 0) for i, v in zip(ids, x)]), miss=1e-5).toPandas().set_index("vec_id")
    links, label = brute_links(x, ids, 0.95)
    assert got.loc[ids, "component_id"].tolist() == label.tolist()
    assert got.loc[ids, "n_links"].sum() >= 0.999 * links.sum() and (got.loc[ids, "n_links"].to_numpy() <= links).all()
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_vectors_around_a_hub_keep_their_links(spark, monkeypatch):
    rng = np.random.default_rng(13)
    centre = rng.normal(size=32)
    tight = centre + rng.normal(size=(50, 32)) * 0.01
    around = centre + rng.normal(size=(600, 32)) * 0.3  # near the hub, mostly not near each other
    x = np.concatenate([tight, around, rng.normal(size=(100, 32))]).astype(np.float32)
    monkeypatch.setattr(vectordedup, "WINDOW", 16)
    monkeypatch.setattr(vectordedup, "BLOCK", 32)
    monkeypatch.setattr(vectordedup, "CHUNK", 100)
    got = vectordedup.near_duplicate_vectors(vectors_of(spark, [(i, v.tolist(), 0, 0, 0) for i, v in enumerate(x)])).toPandas().set_index("vec_id")
    links, label = brute_links(x, list(range(len(x))), 0.95)
    assert 20_000 < links.sum() < 650**2 / 2
    n = got["n_links"].sort_index().to_numpy()
    assert (n <= links).all() and n.sum() >= 0.99 * links.sum()
    assert got["component_id"].sort_index().tolist() == label.tolist()


def test_vector_dedup_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [])]
    got = vectordedup.near_duplicate_vectors(vectors_of(spark, [(i, v, 0, 0, 0) for i, v in rows])).toPandas()
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.itertuples() if r.vec_id == r.vec_id}
    assert len(got) == len(rows)
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 8, 10))
    assert by[6] == (3, 6, True) and by[7] == (3, 6, False) and by[9] == (3, 6, False)
    assert got[got["vec_id"].isna()][["n_links", "kept"]].values.tolist() == [[0, False]]
    assert vectordedup.near_duplicate_vectors(vectors_of(spark, [(1, [1.0], 0, 0, 0)]).limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (301, 300), (None, 4)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300}


# Nearest neighbours.


def test_neighbours_reach_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[100:140] = x[99]  # ties
    v = vectors_of(spark, [(i, r.tolist(), 0, 0, 0) for i, r in enumerate(x)])
    got = ann.nearest_neighbours(v, v.where("vec_id % 20 = 0"), leaf_rows=64).toPandas()
    y, hit, total = x.astype(np.float64), 0, 0
    for q, own in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:20]
        hit, total = hit + len(set(best) & set(own["vec_id"])), total + 20
        assert own.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], [float(np.dot(y[q], y[i])) for i in own["vec_id"]], atol=1e-12)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True])["rank"].tolist() == list(range(1, 21))
    assert total == 75 * 20 and hit / total >= 0.93


def test_outlying_queries_get_all_ranks(spark, monkeypatch):
    rng = np.random.default_rng(23)
    centres = np.eye(12) * 50
    x = np.concatenate([c + rng.normal(size=(50, 12)) * 0.1 for c in centres]).astype(np.float32)
    x[0] = -np.eye(12)[0] * 300  # alone in a leaf
    x[1] = -np.eye(12)[1] * 300
    nodes = np.concatenate([np.zeros((1, 12)), centres, x[:2]])
    tree = ann.Tree(nodes, [list(range(1, 15)), *[[] for _ in range(14)]], [-1, *range(14)], 14)
    monkeypatch.setattr(ann, "fit_tree", lambda sample, leaves: tree)
    v = vectors_of(spark, [(i, r.tolist(), 0, 0, 0) for i, r in enumerate(x)])
    got = ann.nearest_neighbours(v, v.where("vec_id % 20 = 0")).toPandas()
    assert {q: sorted(own["rank"]) for q, own in got.groupby("query_id")} == {q: list(range(1, 21)) for q in range(0, len(x), 20)}


def test_a_query_comes_once_to_each_task(spark, monkeypatch):
    """A query that visits many leaves was sent once for each of them, all rows of 1,024 queries in one batch."""
    monkeypatch.setattr(ann, "TASK_ROWS", 300, raising=False)
    rng = np.random.default_rng(31)
    x = rng.normal(size=(1200, 8))
    x[900:] = x[900]  # one vector many times, over several chunks
    monkeypatch.setattr(ann, "CHUNK", 128)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    df = ann.nearest_neighbours(v, v.where("vec_id % 20 = 0"), k=5, recall=1.0, leaf_rows=8)
    got = df.toPandas().groupby("query_id")["vec_id"].apply(list)
    scores = x @ x.T
    hit = [len(set(got[q]) & set(sorted((i for i in range(1200) if i != q), key=lambda i: (-round(scores[q, i], 9), i))[:5])) for q in range(0, 1200, 20)]
    assert sum(hit) >= 0.97 * 5 * 60

    text = df._jdf.queryExecution().executedPlan().toString()
    assert "leaf" not in "".join(line for line in text.splitlines() if "Exchange" in line) and "Exchange" in text


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (40, None)]
    v = vectors_of(spark, [(i, r, 0, 0, 0) for i, r in rows])
    got = ann.nearest_neighbours(v, v.where("vec_id % 20 = 0")).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)}
    assert ann.nearest_neighbours(v.limit(0), v.limit(0)).count() == 0
    assert ann.nearest_neighbours(v, v.where("vec_id = 40")).count() == 0


# Quality classifier.


def junk(rng, n):
    return " ".join(f"w{rng.randrange(200)}###" for _ in range(n))


def test_classifier_held_out_accuracy(spark):
    rng = random.Random(5)
    texts = [junk(rng, 60) if i % 4 == 0 else words(rng, 80) for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas().set_index("doc_id")
    truth = pd.Series([int(i % 4 != 0) for i in range(400)])
    held = pd.Series([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(400)])
    assert (got["held_out"].sort_index().to_numpy() == held.to_numpy()).all()
    assert (got["predicted"].sort_index() == truth)[held].mean() >= 0.97
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    # a label of a held-out row is never learned
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs, flipped).toPandas().set_index("doc_id")
    assert np.allclose(again["score"].sort_index(), got["score"].sort_index())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(got["predicted"].sum())


def test_scores_match_a_plain_version(spark):
    rng = random.Random(17)
    texts = [junk(rng, 60) if i % 3 == 0 else words(rng, 80) for i in range(120)] + ODD + ["A" * 5000 + "9!" * 400 + " " + words(rng, 30_000)]
    model = quality.fit(texts[:120], np.array([int(i % 3 != 0) for i in range(120)]))
    assert model.layers

    def plain(text):
        tokens = (text or "").split()
        x = np.zeros(2 * quality.DIMENSIONS + 1)
        for i, w in enumerate(tokens):
            x[: quality.DIMENSIONS] += model.word_vectors[model.words.get(w.lower(), 0)]
            x[quality.DIMENSIONS : -1] += model.shape_vectors[1 if i and tokens[i - 1] == w else model.shapes.get(quality.shape(w), 0)]
        if tokens:
            x /= len(tokens)
            x[-1] = np.log1p(len(tokens)) / 10
        mean, scale, w1, b1, w2, b2 = model.layers
        z = sum(max(0.0, float(((x - mean) / scale) @ w1[:, k] + b1[k])) * w2[k] for k in range(len(w2))) + b2[0]
        return 1 / (1 + np.exp(-np.clip(z / model.temperature, -30, 30)))

    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs_of(spark, texts), model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts], atol=1e-5)
    assert quality.shape("AAa9!!..x" + "ab9" * 100) == "Xx9!+.+" + "x9" * 100


def test_long_labelled_texts_train_within_the_sum_of_characters(spark):
    rng = random.Random(18)
    texts = [words(rng, 20) if i else words(rng, 9000) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    seen = []
    fit, quality.fit = quality.fit, lambda found, y: seen.append([len(t) for t in found]) or fit(found, y)
    try:
        for chars in (10**6, 200):
            quality.train(docs_of(spark, texts), labels, chars=chars)
    finally:
        quality.fit = fit
    assert max(seen[0]) == len(texts[0]) and len(seen[0]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(12))
    assert sum(seen[1]) <= 200


def test_a_text_above_the_bound_in_first_place_costs_no_other(spark):
    rng = random.Random(19)
    texts = [junk(rng, 8) if i % 4 == 0 else words(rng, 8) for i in range(300)]
    order = [r["doc_id"] for r in spark.range(300).withColumnRenamed("id", "doc_id").where(~quality.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).collect()]
    for i in (order[0], order[40]):
        texts[i] = words(rng, 30_000)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.train(docs_of(spark, texts), labels, chars=20_000)
    assert len(model.layers) and model.scores([junk(rng, 20)])[0] < 0.5 < model.scores([words(rng, 20)])[0]
    seen = []
    fit, quality.fit = quality.fit, lambda found, y: seen.extend(found) or fit(found, y)
    try:
        quality.train(docs_of(spark, texts), labels, chars=20_000)
    finally:
        quality.fit = fit
    assert seen == [texts[i] for i in order if i not in (order[0], order[40])]


def test_classifier_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs_of(spark, [(None, None), (1, ""), (1, ""), (2, "x" * 100_000)]), none).toPandas()
    assert got["score"].tolist() == [0.5] * 4 and not got["held_out"].iloc[0]
    assert quality.classify(empty(spark), none).count() == 0


# Line dedup.


def brute_lines(texts, divisor=linededup.DIVISOR, least=linededup.MIN_LINES):
    h = lambda *v: xxhash.xxh64_intdigest(v[0].encode(), 42)

    def signed(n):
        return n - 2**64 if n >= 2**63 else n

    def chunks(text):
        lines, out, now = text.split("\n"), [], []
        hashes = [signed(h(x)) for x in lines]
        ended = False
        for i, line in enumerate(lines):
            now.append(line)
            ended = i >= 1 and pair(hashes[i - 1], hashes[i]) % divisor == 0 and not ended
            if ended or i == len(lines) - 1:
                out.append(now)
                now = []
        return out

    def pair(a, b):  # xxhash64 of two longs: the second is hashed with the first's hash as seed
        first = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), first))

    seen, out = set(), {}
    order = sorted((i, signed(h(t)), t) for i, t in texts if t is not None)
    for i, _, text in order:
        kept = []
        for chunk in chunks(text):
            key = tuple(chunk)
            if len(chunk) >= least and key in seen:
                continue
            seen.add(key) if len(chunk) >= least else None
            kept.append("\n".join(chunk))
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    passage = "\n".join(words(rng, 6) for _ in range(12))
    texts = ["\n".join(words(rng, 6) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [t + "\n" + passage + "\n" + t[::-1] if i % 3 == 0 else t for i, t in enumerate(texts)] + ["", "\n\n\n\n\n\n", None, passage, passage, "a\nb", "\n".join(["same"] * 3000)]
    got = linededup.dedup_lines(docs_of(spark, texts))
    assert got.dtypes == docs_of(spark, texts).dtypes and got.select("__mark", "hash").distinct().collect() == [("m", "h")]
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(found) == len(texts) and found[texts.index(None)] is None
    want = brute_lines(list(enumerate(texts)))
    assert {i: t for i, t in found.items() if t is not None} == want
    assert sum(map(len, want.values())) < sum(len(t) for t in texts if t) * 0.95


def test_most_of_a_repeated_block_goes(spark):
    rng = random.Random(19)
    block, gone, texts = 20, 0, []
    for _ in range(60):
        lines = "\n".join(words(rng, 6, 5000) for _ in range(block))
        texts += [f"{words(rng, 5)}\n{lines}\n{words(rng, 5)}", f"{words(rng, 5)}\n{words(rng, 5)}\n{lines}\n{words(rng, 5)}"]
    kept = {r["doc_id"]: r["text"].count("\n") for r in linededup.dedup_lines(docs_of(spark, texts)).collect()}
    assert all(kept[i] == block + 1 for i in range(0, 120, 2))
    gone = sum(block + 2 - kept[i] for i in range(1, 120, 2)) / (60 * block)
    assert gone >= 0.7


def test_line_dedup_odd_tables(spark):
    assert linededup.dedup_lines(empty(spark)).count() == 0
    text = "\n".join(f"line {i} of it" for i in range(30))
    got = linededup.dedup_lines(docs_of(spark, [(None, text), (1, text), (1, text), (2, "short")])).collect()
    by = [(r["doc_id"], r["text"]) for r in got]
    assert (None, text) in by and (2, "short") in by and len(by) == 4
    assert all(len(t) < len(text) for i, t in by if i == 1)


# BPE.


def test_bpe_equals_the_library(spark):
    rng = random.Random(7)
    letters = "abcdefghij"
    texts = [*ODD, words(rng, 2000), "".join(rng.choice(letters) for _ in range(4000)), "ab" * 3000, "".join(rng.choice("!?é日🙂a1 ") for _ in range(3000)), "x" * 2500 + " " + "y" * 2500, ("é" * 900)]
    library = Tokenizer.from_file(WORD)
    for long_text, segment in ((65_536, 1024), (65_536, 40), (300, 12)):
        got = bpe.encode_documents(docs_of(spark, texts), WORD, long_text, segment).toPandas().set_index("doc_id")
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(got.loc[i, "ids"], dtype="<u4").tolist() == ids, (i, long_text)
            assert got.loc[i, "decoded"] == library.decode(ids, skip_special_tokens=False) and got.loc[i, "n_tokens"] == len(ids)
    assert bpe.encode_documents(empty(spark), WORD).count() == 0


def test_bpe_repeated_rows(spark):
    got = bpe.encode_documents(docs_of(spark, [(1, "ab " * 200), (1, "ab " * 200), (None, "x" * 500)]), WORD, 100, 50).toPandas()
    assert sorted(got["n_tokens"].tolist())[1:] == [200, 200] and got["doc_id"].isna().sum() == 1


# SimHash.


def brute_fingerprint(text):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, 150) for _ in range(25)]
    texts = [*ODD, *base]
    for t in base:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0]] * 3
    got = simhash.near_duplicates(docs_of(spark, texts)).toPandas().set_index("doc_id")
    prints = [brute_fingerprint(t) for t in texts]
    assert [int(got.loc[i, "fp"]) % 2**64 for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    changed = True
    while changed:
        new = [min(label[j] for j in range(len(texts)) if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in range(len(texts))]
        changed, label = new != label, new
    assert got["component_id"].sort_index().tolist() == label


def test_pigeonhole_buckets_find_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)] + [rng.getrandbits(64) | 0xFFFFFF for _ in range(30)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(12)}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2}

    def groups(pairs):
        parent = {v: v for v in signed}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return {v: root(v) for v in signed}

    plain = simhash.probe_plan
    for block in (2048, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        for m in (None, 1, 2, 3, 4):
            if m is not None:
                parts = lambda n, ones, both, distance, m=m: (lambda p: [(b, r) for b, r in zip(p, simhash.allocate(n, ones, p, distance)[1]) if r >= 0])(simhash.correlated_parts(n, ones, both, m))
                monkeypatch.setattr(simhash, "probe_plan", parts)
            found = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.linked_fingerprints(frame).collect()}
            assert found <= want and groups(found) == groups(want), (block, m)
            monkeypatch.setattr(simhash, "probe_plan", plain)


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    got = simhash.near_duplicates(docs_of(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)])).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "5", "None"]


# Near copies of the pipeline.


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(a, b):
    return len(a & b) / max(1, len(a | b))


def test_pipeline_removes_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [words(rng, rng.randrange(60, 400), 5000) for _ in range(40)]
    for t in texts[:40]:
        for edits in (1, 2, 4, 8):
            w = t.split()
            for at in rng.sample(range(len(w)), edits):
                w[at] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[1].upper(), "", None, "a b c", "A b  c"]
    sets = [shingles(t) for t in texts]
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs_of(spark, texts), "").collect()}
    label, changed = list(range(len(texts))), True
    near = [[j for j in range(len(texts)) if j == i or similar(sets[i], sets[j]) >= 0.8 or not sets[i] and not sets[j]] for i in range(len(texts))]
    while changed:
        new = [min(label[j] for j in near[i]) for i in range(len(texts))]
        changed, label = new != label, new
    want = {i for i, own in enumerate(label) if own == i}
    assert 40 < len(want) < len(texts) - 60
    assert want <= kept and len(kept) - len(want) <= 0.02 * (len(texts) - len(want))


def test_near_copies_in_one_bucket_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    monkeypatch.setattr(nearcopies, "_masks", lambda classes, count, parts: [(0, 0, 0)])  # one bucket for all
    rng = random.Random(22)
    texts = [words(rng, 60, 5000) for _ in range(12)]
    texts += [t + " more" for t in texts[4:]] + [t + " and more" for t in texts[8:]]
    docs = docs_of(spark, texts)
    assert {r["doc_id"] for r in nearcopies.one_of_each_group(docs).collect()} == set(range(12))


def test_a_chain_of_near_copies_is_one_group(spark):
    rng = random.Random(24)
    w, texts = words(rng, 200, 5000).split(), []
    for step in range(8):
        texts.append(" ".join(w))
        for at in range(step * 20, step * 20 + 20, 5):
            w[at] = f"edit{at}"
    texts = texts[::2] + texts[1::2] + [words(rng, 200, 5000)]
    assert similar(shingles(texts[0]), shingles(texts[4])) >= 0.8 > similar(shingles(texts[0]), shingles(texts[1]))
    assert {r["doc_id"] for r in nearcopies.one_of_each_group(docs_of(spark, texts)).collect()} == {0, 8}


def test_candidates_of_the_least_similarity_are_not_ruled_out(spark):
    rng, texts = random.Random(26), []
    for _ in range(400):
        w = words(rng, 94, 5000).split()
        texts += [" ".join(w), " ".join(w[:-10] + [f"edit{rng.randrange(10**6)}" for _ in range(10)])]
    assert similar(shingles(texts[0]), shingles(texts[1])) == 0.8
    docs = docs_of(spark, texts).select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("mark"), "text")
    classes = nearcopies._classes(docs, nearcopies.PRINTS).cache()
    none = spark.createDataFrame([], "a long, b long")
    found = nearcopies._other_pairs(classes, [(0, 0, 0)], none, none, classes.select("key"), nearcopies.most_differing(0.8), 0.8)
    doc = {r["key"]: r["doc"] for r in classes.select("key", "doc").collect()}
    assert {(i, i + 1) for i in range(0, 800, 2)} <= {tuple(sorted((doc[r["a"]], doc[r["b"]]))) for r in found.collect()}


def test_near_copies_among_short_texts(spark):
    rng, texts = random.Random(27), []
    for n in (8, 8, 8, 12, 16, 30):  # a word more: 4 and 5 shingles have a similarity of exactly 0.8
        for _ in range(60):
            w = words(rng, n + 1, 5000).split()
            texts += [" ".join(w[:-1]), " ".join(w)]
    kept = nearcopies.one_of_each_group(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(texts), 2))


def test_near_copies_odd_tables(spark):
    rng = random.Random(23)
    text = words(rng, 60, 5000)
    rows = docs_of(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, text), (6, text), (7, "")])
    kept = nearcopies.one_of_each_group(rows)
    assert kept.columns == rows.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("None", "a b c d"), ("5", "a b c d"), ("5", text), ("7", "")])
    assert nearcopies.one_of_each_group(empty(spark)).count() == 0
    assert nearcopies.one_of_each_group(docs_of(spark, [None, "", " "])).count() == 1


def test_fingerprints_match_brute_force():
    rng = np.random.default_rng(25)
    for n in (1, 7, 255, 256, 1000):
        s = rng.integers(0, 2**63, n, dtype=np.uint64)
        got = nearcopies.fingerprints(s, 3)
        for k in range(3):
            h = (s ^ nearcopies._SEEDS[k]) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
            assert int(got[k]) % 2**64 == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


# WARC.


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x", 0), (2, "http://b\r\nc", "é\r\n\r\nWARC/1.1\r\n", 0), (3, None, "x", 0), (4, "u", None, 0), (5, "u", "", 0), (None, "u", "x", 0), (7, "u", "y" * 200_000, 0)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    warc.write_archive(frame, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).toPandas()
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 4 and len(got) == 7
    for r in got.itertuples():
        if r.page_id == r.page_id:
            html = next(h for i, _, h, _ in pages if i == r.page_id) or ""
            assert bytes(r.payload) == html.encode() and r.payload_digest == b32encode(hashlib.sha1(html.encode()).digest()).decode()
            body = b"" if r.record_type == "revisit" else html.encode()
            assert bytes(r.record) == bytes(r.header) + body + b"\r\n\r\n" and f"Content-Length: {len(body)}\r\n".encode() in bytes(r.header)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got.itertuples() if r.page_id == r.page_id}
    assert kinds[1] == ("revisit", 3.0) and kinds[3][0] == "response" and kinds[4] == ("revisit", 5.0) and kinds[5][0] == "response"
    warc.export_warc(warc.read_archive(spark, str(tmp_path / "w")), str(tmp_path / "files"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert raw.count(b"\r\n\r\nWARC/1.1\r\nWARC-Type: ") + raw.startswith(b"WARC/1.1") == 7
    warc.write_archive(frame.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_of_repeated_page_ids(spark, tmp_path):
    pages = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (2, "v", "z"), (3, "u", "y"), (3, "u", "y")]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "r"))
    got = sorted((r["page_id"], bytes(r["payload"]).decode(), r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "r")).collect())
    assert got == [(1, "x", "revisit", 2), (1, "x", "revisit", 2), (2, "x", "response", None), (2, "z", "response", None), (3, "y", "response", None), (3, "y", "response", None)]


def test_warc_notices_damage(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    headers, payloads = warc.archive_records(frame)
    headers.write.parquet(str(tmp_path / "d/headers"))
    payloads.withColumn("payload", F.lit(b"z")).write.parquet(str(tmp_path / "d/payloads"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, str(tmp_path / "d")).collect()


# Passages.


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(10)
    values = rng.integers(0, 12, 40).astype(np.uint64)
    found = substrings.compact_windows(values, 5)
    for i in range(40):
        for j in range(i + 5, 41):
            holding = [(lo, c, hi) for lo, c, hi in found if lo <= i and j <= hi and i <= c < j]
            assert len(holding) == 1 and values[holding[0][1]] == values[i:j].min()


def planted(rng, n=60):
    passages = [words(rng, 70, 5000) for _ in range(6)]
    texts, where = [], {}
    for i in range(n):
        t = words(rng, rng.randrange(20, 200), 5000)
        if i % 4 == 0:
            p = i // 4 % len(passages)
            w = passages[p].split()
            if i % 8 == 0:
                w[35] = "edited"
            where.setdefault(p, []).append(i)
            t = t + "\n" + " ".join(w) + "\n" + words(rng, 30, 5000)
        texts.append(t)
    return texts, where


def test_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(11)
    texts, where = planted(rng)
    docs = docs_of(spark, texts)
    got = substrings.near_duplicate_passages(docs).toPandas()
    want = {i for own in where.values() for i in own[1:]}
    assert set(got["doc_id"]) == want
    for r in got.itertuples():
        assert r.source_doc_id < r.doc_id and r.words >= 50 and r.similarity >= 0.8
        a = texts[r.doc_id].split()[r.start : r.start + r.words]
        grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        other = texts[r.source_doc_id].split()
        assert len(grams(a) & grams(other)) >= 0.8 * len(grams(a))
    cut = {r["doc_id"]: r["text"] for r in substrings.remove_passages(docs).collect()}
    assert {i for i, t in cut.items() if t != texts[i]} == want
    assert all(len(cut[i].split()) <= len(texts[i].split()) - 50 for i in want)


def test_passages_of_large_groups_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(substrings, "COMBINE", 50)
    rng = random.Random(12)
    line, passage = words(rng, 12, 5000), words(rng, 60, 5000)
    texts = [words(rng, 60, 5000) + " " + (passage if i % 2 else line) + " " + words(rng, 60, 5000) for i in range(80)]
    got = substrings.near_duplicate_passages(docs_of(spark, texts)).toPandas()
    assert set(got["doc_id"]) == set(range(3, 80, 2))
    assert substrings.near_duplicate_passages(empty(spark)).count() == 0
    long = words(rng, 30_000, 5000)
    rows = [(None, passage), (1, None), (2, ""), (3, passage), (3, passage), (4, passage.upper()), (5, long), (6, long)]
    odd = substrings.near_duplicate_passages(docs_of(spark, rows)).toPandas()
    assert {(r.doc_id, r.source_doc_id) for r in odd.itertuples()} == {(4, 3), (6, 5)}
    assert odd[odd["doc_id"] == 6]["words"].tolist() == [30_000]
    kept = substrings.remove_passages(docs_of(spark, rows))
    assert kept.count() == len(rows) and kept.columns == docs_of(spark, rows).columns


def shared_spans(a, b, shortest=46, similarity=0.8):
    """Whether spans of ``shortest`` shingles of the word lists have the similarity: all pairs of spans, counted by box sums."""
    one, two = (np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)], dtype=np.int64) for w in (a, b))
    if len(one) < shortest or len(two) < shortest:
        return False
    total = np.zeros((len(one) + 1, len(two) + 1), dtype=np.int64)
    total[1:, 1:] = (one[:, None] == two[None, :]).cumsum(axis=0).cumsum(axis=1)
    n = shortest
    shared = total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]
    return bool((shared / (2 * n - shared) >= similarity).any())


def edited(rng, text, edits):
    w = text.split()
    for at in np.linspace(7, len(w) - 8, edits).astype(int):
        w[at + rng.randrange(-3, 4)] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_passages_of_all_document_pairs(spark):
    rng = random.Random(14)
    around = lambda text: f"{words(rng, rng.randrange(5, 60), 5000)} {text} {words(rng, rng.randrange(5, 60), 5000)}"
    texts = []
    for _ in range(40):  # the second has most of the third, the first less of it
        p = words(rng, 100, 5000)
        texts += [around(edited(rng, p, 3)), around(edited(rng, p, 1)), around(p)]
    for _ in range(20):  # a line that stands in front of other texts, then whole copies that begin with it
        p = words(rng, 70, 5000)
        texts += [around(" ".join(p.split()[:30])) for _ in range(3)] + [around(p), around(" ".join(p.split()[:40])), around(p)]
    split = [t.split() for t in texts]
    want = {j for j in range(len(texts)) for i in range(j) if shared_spans(split[j], split[i])}
    got = {r["doc_id"] for r in substrings.near_duplicate_passages(docs_of(spark, texts)).collect()}
    assert 90 <= len(want) and len(want - got) <= 0.02 * len(want)


def test_third_documents_meet_the_second_when_the_first_resembles_less(spark):
    rng = random.Random(15)
    texts = []
    for _ in range(60):
        p = words(rng, 60, 5000)
        texts += [edited(rng, p, 2), edited(rng, p, 1), edited(rng, p, 1)]
        texts[-1] = texts[-2]
    got = substrings.near_duplicate_passages(docs_of(spark, texts)).toPandas()
    whole = got[(got["doc_id"] % 3 == 2) & (got["source_doc_id"] == got["doc_id"] - 1) & (got["words"] == 60)]
    assert whole["doc_id"].nunique() == 60


def test_repeats_within_a_document(spark):
    rng = random.Random(16)
    p = words(rng, 80, 5000)
    once, twice = f"{words(rng, 50, 5000)} {p} {words(rng, 50, 5000)}", f"{words(rng, 20, 5000)} {p} {words(rng, 70, 5000)} {p}"
    lines = " ".join(["same line here of six words"] * 200)
    got = substrings.near_duplicate_passages(docs_of(spark, [twice, words(rng, 300, 5000), lines, once])).toPandas()
    assert {(r.doc_id, r.source_doc_id) for r in got.itertuples() if r.doc_id != 2} == {(0, 0), (3, 0)}
    own = got[got["doc_id"] == 0].iloc[0]
    assert own["start"] == 170 and own["source_start"] == 20 and own["words"] == 80


def test_without_words_keeps_the_rest():
    assert substrings.without_words(" a  b\nc d ", [(1, 3)]) == " a  d "
    assert substrings.without_words("a b", [(0, 2)]) == ""


def test_passages_with_stray_runs_and_low_starts_are_whole():
    """A run that lies elsewhere in the other text, or a stretch of low similarity, doesn't end a passage that is similar as a whole."""
    from skillgraph.llm.substrings import similar_passages

    words = lambda name, n: [f"{name}{i}".encode() for i in range(n)]
    stray = words("stray", 6)
    # halves of 45 words are no passages alone
    a, b = words("x", 45) + stray + words("y", 45), words("x", 45) + words("y", 45) + words("z", 400) + stray
    assert [p[:4] for p in similar_passages(a, b, 46, 0.8)] == [(0, 96, 0, 90)]
    a, b = (words("h", 20) + words(other, 40) + words("t", 410) for other in ("n", "m"))
    assert [p[:4] for p in similar_passages(a, b, 46, 0.8)] == [(0, 470, 0, 470)]
    # what cannot become similar any more is left
    a, b = (words("h", 60) + words(other, 900) + words("t", 60) for other in ("n", "m"))
    assert [p[:4] for p in similar_passages(a, b, 46, 0.8)] == [(0, 60, 0, 60), (960, 1020, 960, 1020)]


def test_hopeless_starts_are_passed_over():
    """Runs from which the lacking words rule a passage out cost no look at the runs behind them; passages stay as they are."""
    alone = [b"u%d" % i for i in range(60_000)]
    shared = [b"s%d" % i for i in range(60)]
    mine, theirs = [], []
    for i in range(0, 60_000, 20):  # five shared words after every twenty of its own, 3,000 times
        mine += [*alone[i : i + 20], *(b"r%d.%d" % (i, j) for j in range(5))]
        theirs += [b"t%d" % i, *(b"r%d.%d" % (i, j) for j in range(5))]
    began = time.process_time()
    assert substrings.similar_passages(mine + shared, theirs + shared, 46, 0.8)[-1][:2] == (len(mine) - 5, len(mine) + 60)  # the last five shared words stand before it
    assert time.process_time() - began < 5
