"""Extra columns whose names clash with those inside the operators."""

import pytest
from pyspark.sql import functions as F

from helpers import frame

NAMES = ("_d", "_t", "_size", "_part", "_lines", "_gone", "gone", "node", "n", "key", "h", "at", "source_size", "_order", "_s", "spans", "base", "_h", "ids", "grp", "i", "a.b", "size", "mult", "filters", "y", "_keep", "text_hash")


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, [(k, f"some words stand in this line here {k % 3}\nanother line of text {k}") for k in range(12)] + [(99, None)], ["s", "t", None] * 4 + ["s"])
    return df.select("*", *[F.lit(7).alias(n) for n in NAMES])


def test_stages_keep_clashing_columns(spark, docs):
    from netlens.llm.linededup import dedup_lines
    from netlens.llm.mixing import mix, mixed_texts
    from netlens.llm.ngram_join import keep_first
    from netlens.llm.toxicity import keep_clean, train

    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("y", F.lit(1))
    for out in (dedup_lines(docs).drop("_lines", "_gone", "_dropped"), keep_first(docs), mixed_texts(docs), keep_clean(docs, train(docs, labels))):
        rows = out.collect()
        assert rows and all(r["a.b"] == 7 and r["mult"] == 7 and r["n"] == 7 for r in rows)
        assert [c for c in out.columns if c not in ("_lines", "_gone")] == [c for c in docs.columns if c not in ("_lines", "_gone")]
    assert mix(docs).count() == 13


def test_operators_ignore_clashing_columns(spark, docs):
    from netlens.llm.avi import media_columns
    from netlens.llm.capfilter import near_duplicates
    from netlens.llm.ngram_join import ngram_components
    from netlens.llm.packing import pack
    from netlens.llm.pii import pii_spans
    from netlens.llm.secrets import secret_spans
    from netlens.llm.toxicity import Model, score
    from netlens.llm.warc import round_trip

    import numpy as np

    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(3, 40.0))
    for out in (ngram_components(docs), pii_spans(docs), secret_spans(docs), media_columns(docs), score(docs, none)):
        assert out.count() == 13
    assert pack(docs).count() >= 13
    extra = [F.lit(7).alias(n) for n in NAMES]
    assert round_trip(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").select("*", *extra)).count() == 1
    assert near_duplicates(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>").select("*", *extra)).count() == 1
