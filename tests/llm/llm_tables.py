"""Shared small tables: nulls, empty and very long texts, ties, repeated rows,
and extra columns whose names clash with those the operators use."""

import random

import pytest

SF001 = "/root/testdata/sf0.001"

CLASH = ["n", "size", "node", "part", "block", "bits", "kind", "component", "score", "shard",
         "slot", "piece", "length", "lo", "hi", "a", "b", "p", "ids", "word", "label"]


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("aeioulnrt") for _ in range(r.randint(2, 7))) for _ in range(n)]


def edge_rows():
    base = words(1, 220)
    near = list(base)
    near[50], near[120] = "changed", "words"
    half = base[:110] + words(2, 110)
    passage = " ".join(words(3, 60))
    long = " ".join(words(4, 30_000))
    return [
        (0, None), (1, ""), (2, " \t\n "), (3, "one two three"), (4, "ONE  two\tthree"),
        (5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(half)),
        (9, "Ünïcödé 日本 😀 «quote» " + passage + " tail é"), (10, "head è " + passage),
        (11, long), (12, passage + " " + passage), (None, "a text without an id " + passage),
        (5, " ".join(base)), (13, "<|endoftext|> hi <|startoftext|>there"), (14, "x" * 5000),
        (15, "ab" * 300), (16, "you are a stupid idiot. he said: you idiot!"),
        (17, "a\u001cb\u0085c  d\u00a0e İ Σας ﬁ ½"), (18, "one two three"),
    ]


def frame(spark, rows):
    extra = ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(
        [(i, t, "en", f"src{k % 3}", len(t or ""), *["clash"] * len(CLASH))
         for k, (i, t) in enumerate(rows)],
        f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The table as files, as queries read it."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    frame(spark, edge_rows()).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    frame(spark, []).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def small_docs():
    """Documents of sf0.001 as (doc_id, text)."""
    import duckdb
    return duckdb.connect().execute(
        "select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by 1").fetchall()
