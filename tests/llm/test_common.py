import os
import random

import pytest
from helpers import DOCS, frame
from pyspark.sql import functions as F

from netlens.llm import capfilter, common, linededup, ngram_join, pii, warc
from netlens.sources import files


def corpus(spark):
    rng = random.Random(2)
    vocab = [f"word{k}" for k in range(60)]
    line = lambda: " ".join(rng.choices(vocab, k=9))
    lines = [line() for _ in range(12)]
    rows = [(k if k % 9 else None, "\n".join([rng.choice(lines), line() + f" p{k % 4}@m.example", rng.choice(lines)])) for k in range(60)]
    return frame(spark, rows + rows[:5])


def results(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: (F.pmod(F.xxhash64("text", k), F.lit(3)) - 1).cast("float")).alias("embedding"))
    out = {
        "op1": pii.pii_spans(docs), "op3": warc.round_trip(pages), "op5": linededup.dedup_lines(docs), "op6": capfilter.near_duplicates(vectors), "op7": ngram_join.ngram_components(docs, 3, (60, 100)),
        "keep": ngram_join.keep_first(docs),
    }
    return {k: sorted(map(str, v.collect())) for k, v in out.items()}


def test_results_without_any_broadcast(spark, monkeypatch):
    docs = corpus(spark)
    want = results(spark, docs)
    for module in (pii, warc, linededup, capfilter, ngram_join):
        monkeypatch.setattr(module, "bounded", lambda df: df)
    monkeypatch.setattr(pii, "BROADCAST", -1)
    assert results(spark, docs) == want


def test_only_checkpoints_are_left_behind(spark):
    folder = files.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    results(spark, corpus(spark))
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("netlens-")]


def test_weights_and_bounds(spark):
    df = spark.createDataFrame([(1, "abc", [1, 2], None), (2, None, None, b"xyz")], "a long, b string, c array<int>, d binary")
    rows, size = common.weight(df)
    assert rows == 2 and 100 < size < 400
    assert common.weight(spark.createDataFrame([], DOCS)) == (0, 0)
    assert "broadcast" in common.bounded(df)._jdf.queryExecution().logical().toString() and "broadcast" not in common.bounded(df, 10)._jdf.queryExecution().logical().toString()


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_folder(Session)


def test_components_by_rounds(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 300) if k % 50] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    s = common.Scratch(spark)
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), s).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    s.clear()
