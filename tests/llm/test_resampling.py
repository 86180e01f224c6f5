"""Importance resampling against a plain version, and its CRCs against zlib's."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from skillgraph.llm import resampling

SCHEMA = "doc_id long, text string, score long, rank long, out boolean, weight long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, True, 3) for i, t in rows], SCHEMA)


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent=10, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in rows for f in features(x, longest)) for rows in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        own = features(x, longest)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words_of(x))])
    drawn = sorted((r for r in out if r[5] >= min_words and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for place, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


ODD = [None, "", " ", "a", "A-B_c 9", "héllo Éa ÀÉ", "日本語 テキスト, 日本語", "É İI ſ", "x" * 5000, "a\x00b\x7fc\x85d", "  lead and trail  ", "1 2 3 " * 30]


def rows_of(seed, n, words):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{rng.integers(words)}" for _ in range(rng.integers(1, 60))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "part"), [(1, 200_000), (2, 200_000), (3, 7), (1, 4)])
def test_matches_a_plain_version(spark, monkeypatch, longest, part):
    monkeypatch.setattr(resampling, "PART", part)
    docs = list(enumerate([*ODD, *rows_of(1, 150, 300)])) + [(None, "words of a row without an id " * 5), (5, "repeated id"), (5, "repeated id")]
    target = list(enumerate(rows_of(2, 20, 40)))
    got = resampling.resample(docs_of(spark, docs), docs_of(spark, target), longest=longest, buckets=97)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str) == brute(docs, target, longest, 97)


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_crcs_of_runs_are_those_of_zlib(monkeypatch, part):
    monkeypatch.setattr(resampling, "PART", part)
    for text in [*ODD, *rows_of(3, 20, 50)]:
        got = Counter(int(c) for crcs in resampling.feature_crcs(text, 4) for c in crcs)
        assert got == Counter(zlib.crc32(f.encode()) for f in features(text, 4))


def test_shift_is_that_of_a_longer_text():
    a, b = b"first part", b"and a second one of another length"
    crc = resampling.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(crc[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert resampling.resample(none, none).count() == 0
    docs = [(1, "a b c " * 10), (2, None)]
    got = {r["doc_id"]: (r["n_features"], r["weight"]) for r in resampling.resample(docs_of(spark, docs), none).collect()}
    assert got == {i: (n, w) for i, n, w, _, _ in brute(docs, [], 1, 10_000)}


def test_a_tenth_of_the_long_enough_documents_is_drawn_in_order(spark):
    docs = list(enumerate(rows_of(4, 300, 100)))
    got = resampling.resample(docs_of(spark, docs), docs_of(spark, docs[:5])).toPandas()
    drawn = got[got["rank"].notna()].sort_values("rank")
    assert drawn["rank"].tolist() == list(range(1, (got["n_words"] >= 20).sum() // 10 + 1)) and (drawn["n_words"] >= 20).all()
    assert (-drawn["score"]).is_monotonic_increasing
