import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from helpers import DOCS, frame
from tokenizers import Tokenizer

from netlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check(rows, texts, tokenizer, loose):
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] > 0 and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        docs[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(docs) == set(ids)
    for k, parts in docs.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[k])
    sizes = []
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
        assert at <= 2048
    assert sum(n & (n - 1) != 0 for n in sizes) <= loose
    return sizes


def test_query_over_a_table(spark, sf_dir, tokenizer):
    from netlens.llm.queries import op10_hierarchical_packing

    df = op10_hierarchical_packing(spark, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = df.collect()
    sizes = check(rows, texts, tokenizer, 1)
    assert Counter(sizes)[2048] > len(sizes) // 3
    load = Counter()
    for r in {r["sequence_id"]: r for r in rows}.values():
        load[r["step_group"]] += r["tier"]
    assert max(load.values()) - min(load.values()) <= 2048


def test_awkward_texts(spark, tokenizer):
    texts = {1: "", 2: None, 3: "x", 4: "a" * 5000, 5: "word " * 9000, 6: "日本語 тест <|endoftext|> 😀", 7: "  \n\n tabs\t\tand  spaces ", 8: "don't I'll", None: "null id", 9: "  odd spaces\u0085"}
    rows = packing.pack(frame(spark, list(texts.items())).coalesce(1), with_ids=True).collect()
    check(rows, texts, tokenizer, 1)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack(frame(spark, [(1, "same text"), (1, "same text")]).coalesce(1)).collect()
    assert sum(r["length"] for r in rows) == 2 * rows[0]["doc_tokens"]


@pytest.mark.parametrize("length", [1, 30, 63, 100, 2047])
def test_the_end_of_a_task_is_not_padded(spark, length):
    rows = packing.pack(frame(spark, [(1, "a " * (length - 2) + "a" * (length > 1))]).coalesce(1)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert sum(sizes.values()) == rows[0]["doc_tokens"] and all(n & (n - 1) == 0 for n in sizes.values())


def test_encoders_agree_on_every_character_of_the_fast_range(tokenizer):
    import random

    import pyarrow as pa

    rng = random.Random(7)
    chars = [chr(c) for c in range(1, 0x240)]
    texts = ["".join(rng.choices(chars + [" ", "a", "'s", "\n"] * 40, k=rng.randrange(1, 60))) for _ in range(6000)]
    texts += [f"a{c}b {c} {c}{c}" for c in chars]
    got = packing.Encoder().encode(pa.array(texts))
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(g.tolist() == e.ids for g, e in zip(got, want, strict=True))


def test_encoder_agrees_with_the_library(tokenizer):
    import pyarrow as pa

    texts = ["plain ascii text, with 123 numbers!", "Übergröße façade ñandú", "a\tb\n\nc   d", "", "x" * 3000, "price: 5€ – ok", "tail  "]
    got = list(packing.Encoder().encode(pa.array(texts)))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
