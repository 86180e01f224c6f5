"""The registered queries of the subpackage and the pipeline, on the smallest tables and against plain versions."""

import random

from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.queries() if n.startswith("op"))


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in NAMES} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    assert found
    if name in entry.oracle_sql():
        con = duckdb.connect()
        for path in Path(SF).iterdir():
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert sorted(found, key=str) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "substring dedup", "packing"]
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(pieces["doc_id"])
    assert kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not [i for i in kept if labels.get(i, 1) == 0]
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark long, row string, __k string"


def tables_of(spark, folder, texts, labels):
    rows = [(i, t, "en", "s", len(t or ""), 7, "r", "k") for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    words = lambda n: " ".join(f"w{rng.randrange(20_000)}" for _ in range(n))
    passage, block = words(80), "\n".join(words(5) for _ in range(40))
    texts = [words(200) for _ in range(12)]
    texts[3] = f"{words(40)} {passage} {words(60)}"
    texts[7] = f"{words(90)} {passage} {words(30)}"  # a passage that stands earlier
    near = texts[5].split()
    near[100] = "edited"
    texts.append(" ".join(near))  # a near copy
    texts += [texts[1], texts[1].upper(), "", None, "short text"]
    texts += [words(30) + "\n" + block, words(60) + "\n" + block]  # repeated lines
    labels = [(i, 1, 0) for i in range(12)]  # one class: all documents score alike, above the threshold
    tables_of(spark, tmp_path, list(enumerate(texts)), labels)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for (name, stage), key in zip(corpus_pipeline.STAGES[:-1], ("good", "lines", "near", "passages")):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        path = str(tmp_path / key)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after[key] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert after["good"] == dict(enumerate(texts))
    lines = after["lines"]
    assert {i for i in lines if lines[i] != texts[i]} == {19} and lines[19].startswith(texts[19].split("\n")[0]) and len(lines[19]) < len(texts[19]) - len(block) / 2
    gone = {12, 13, 14, 16}  # the near copy, two copies, and the null text, which is alike the empty one
    assert set(after["near"]) == set(range(20)) - gone
    passages, cut = after["passages"], texts[7].split()
    assert passages[7] == " ".join(cut[:90] + cut[170:])
    assert all(passages[i] == lines[i] for i in passages if i != 7)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(pieces["doc_id"]) == set(passages)
    for i, own in pieces.groupby("doc_id"):
        ids = np.frombuffer(b"".join(own.sort_values("start")["ids"]), dtype="<u4").tolist()
        assert ids == [*library.encode(passages[i] or "", add_special_tokens=False).ids, 1]


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    (tmp_path / "empty").mkdir()
    tables_of(spark, tmp_path / "empty", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "odd").mkdir()
    long = "\n".join(f"line {i} of a very long text" for i in range(40_000))
    odd = [(None, "a b c"), (None, None), (1, None), (1, ""), (2, "same text"), (2, "same text"), (3, long), (4, " \n\t ")]
    tables_of(spark, tmp_path / "odd", odd, [(i, 1, 0) for i in range(30)] + [(None, 1, 0), (2, None, None)])
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).toPandas()
    assert set(pieces["doc_id"].dropna()) == {1, 2, 3} and pieces["doc_id"].isna().sum() >= 2
