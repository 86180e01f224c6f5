"""Exact repeats against all strings of all documents, and on odd texts and tables."""

import random

import pytest
from pyspark.sql import functions as F

from skillgraph.llm import repeats

SCHEMA = "doc_id long, text string, lang string, doc long, mark long, key long, at long, spans string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "s", "k") for i, t in rows], SCHEMA)


def brute(rows, length):
    """(id, bytes, removed runs, kept bytes) of each row."""
    bodies = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in bodies:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        edges = [p for p in range(len(b) + 1) if (p > 0 and gone[p - 1]) != (p < len(b) and gone[p])]
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def found(spark, rows, length=repeats.LENGTH):
    got = repeats.remove_repeats(docs_of(spark, rows), length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str)


def texts(rng, n, vocabulary=60):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(1 + rng.randrange(4))) + str(rng.randrange(vocabulary)) for _ in range(n))


def planted(rng):
    passage, block = texts(rng, 40), texts(rng, 200)
    out = [texts(rng, 80) for _ in range(12)]
    out += [f"{texts(rng, 20)} {passage} {texts(rng, 10)}" for _ in range(6)]
    out += [passage[k : k + 49 + k % 3] + texts(rng, 9) for k in range(0, 30, 2)]  # around the threshold
    out += [block, block, block[:300] + "x" + block[301:], block[7:], "ab" * 90, "ab" * 70 + "c", "x" * 400, "y" + "x" * 60, "x" * 49, "x" * 50]
    out += [passage + " " + passage, passage[5:] + passage[:60], "", None, "日本語テキスト" * 20, "本語テキスト日" * 12]
    rng.shuffle(out)
    return list(zip(rng.sample(range(1000), len(out)), out))


@pytest.mark.parametrize("length", [50, 8, 90])
def test_matches_brute_force(spark, length):
    rows = planted(random.Random(length))
    assert found(spark, rows, length) == brute(rows, length)


def test_matches_brute_force_in_small_pieces(spark, monkeypatch):
    """Texts above the chunk, several flushes of a task, and grams with more neighbourhoods than a task compares."""
    rows = planted(random.Random(5))
    common = "the same twenty-five bytes"
    rng = random.Random(6)
    rows += [(2000 + i, f"{rng.choice('pq')}{rng.choice('rstu')}{'-' * (i % 9)}{common}{rng.choice('uv')}{rng.choice('wxyz')}{'+' * 20}{i % 7}") for i in range(60)]
    want = brute(rows, 50)
    for chunk, combine, limit in ((300, 40, 3), (1 << 20, 1_000_000, 2)):
        for name, value in (("CHUNK", chunk), ("COMBINE", combine), ("LIMIT", limit)):
            monkeypatch.setattr(repeats, name, value)
        repeats._powers.cache_clear()
        assert found(spark, rows) == want
    repeats._powers.cache_clear()


def test_groups_that_go_on_over_batches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", 4)
    rng = random.Random(9)
    rows = [(i, f"{i % 5}{'=' * 30}{i % 11}{texts(rng, 6)}{'=' * 45}{i % 3}") for i in range(120)] + [(i, "all the same " * 9) for i in range(500, 600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows) == brute(rows, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    same = "a passage that is a good deal longer than fifty bytes, to be sure"
    rows = [(1, same), (1, same), (1, "x " + same), (2, same + "!"), (None, same), (None, same), (None, None), (3, None), (0, "short"), (4, same), (4, same)]
    assert found(spark, rows) == brute(rows, 50)
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, [], b""), (2, 0, [], b"")]
    with pytest.raises(ValueError):
        repeats.gram_of(7)


def test_sampling_is_one_anchor_to_many_bytes_and_alike_in_all_places():
    rng = random.Random(4)
    text = texts(rng, 3000).encode()
    table = repeats.anchors([text, b"zz" + text[1000:3000]])
    assert len(table) < len(text) / 10
    first, second = ({(int(r[3]), int(r[4])) for r in table if r[0] == k} for k in (0, 1))
    assert len(second - first) <= 4  # all but those at the ends
    covered = sorted((int(r[1]) + i) for r in table if r[0] == 0 for i in range(int(r[2])))
    assert covered == list(range(len(text) - repeats.LENGTH + 1))


def test_a_hot_passage_goes_to_no_single_task(spark):
    """Each task sends a content once, however many of its documents hold it."""
    same = "words that are in every single one of the documents of this test, " * 3
    docs = docs_of(spark, [(i, f"{same}{i}") for i in range(400)]).coalesce(2)
    rows = repeats._gram_rows(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), "text"), 50).toPandas()
    judged = rows[rows["key"] % 4 != repeats._KNOWN]
    assert judged.groupby(judged["key"] // 4).size().max() <= 2
