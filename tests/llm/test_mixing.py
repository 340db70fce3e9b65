import pytest
from helpers import DOCS, frame

from netlens.llm import mixing


def water(sizes):
    """Targets by the rule itself: clamp, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = sum(w[s] for s in free)
        target = {s: (total - sum(full.values())) * w[s] / share for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return full | target
        full |= {s: 3.0 * sizes[s] for s in over}


CASES = {
    "plain": [("a", 100, 7), ("b", 50, 9), ("c", 3, 4), (None, 10, 2)],
    "hot": [("src0", 400, 5), ("src1", 3, 3), ("src2", 2, 1), ("src3", 1, 1)],
    "empty": [("a", 4, 0), ("b", 3, 0)],
    "one": [("a", 9, 3)],
    "codepoints": [("é", 20, 3), ("z", 20, 3), ("😀", 20, 3), ("Z", 20, 3), ("", 20, 3)],
}


def table(spark, case):
    rows, sources = [], []
    for s, n, words in CASES[case]:
        for k in range(n):
            rows.append((len(rows), None if words == 0 and k % 2 else "w \t\n" * (words + k % 3 if words else 0)))
            sources.append(s)
    return frame(spark, rows, sources)


@pytest.mark.parametrize("case", CASES)
def test_targets_and_taken_words(spark, case):
    rows = mixing.mix(table(spark, case)).collect()
    sizes = {}
    for r in rows:
        assert r["_size"] == len((r["text"] or "").split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_size"]
    want = water(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["_target"] == pytest.approx(want[s]) and r["_source_size"] == sizes[s] for r in own)
        taken = [r["_whole"] * r["_size"] + r["_part"] for r in own]
        assert abs(sum(taken) - want[s]) <= 1
        assert all(0 <= t <= 3 * r["_size"] for t, r in zip(taken, own, strict=True))


def test_reruns_and_partitions_agree(spark):
    df = table(spark, "plain").union(table(spark, "plain").limit(5))
    key = lambda d: sorted((r["doc_id"], r["_whole"], r["_part"]) for r in mixing.mix(d).collect())
    assert key(df) == key(df.repartition(7))


def test_texts_hold_the_words_taken(spark):
    df = table(spark, "plain")
    taken = {}
    for r in mixing.mix(df).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["_whole"] * r["_size"] + r["_part"]
    out = mixing.mixed_texts(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
