import random
from itertools import permutations

import pytest
from helpers import DOCS, components, frame

from netlens.llm import ngram_join as ng


def sets(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{n}" for n in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 200]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 12)):
                t[rng.randrange(len(t))] = rng.choice(vocab).upper()
            texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    return texts


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, k, num):
    texts = corpus(k)
    rows = [(len(texts) * 3 - 3 * i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE  two"), (1005, "é É ß x y z" * 3), (1006, "b " * 30_000)]
    got = {r["doc_id"]: r for r in ng.ngram_components(frame(spark, rows), k, (num, 100)).collect()}
    own = {i: sets(t, k) for i, t in rows}
    want = components(sorted(own), lambda a, b: bool(own[a] and own[b]) and 100 * len(own[a] & own[b]) >= num * len(own[a] | own[b]))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(x) for i, x in own.items()}


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    own = {i: sets(t, 5) for i, t in rows}
    want = components(sorted(own), lambda a, b: 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]))
    df = frame(spark, rows)
    for block, most in ((ng.BLOCK, ng.ROWS), (2000, ng.ROWS), (2000, 5)):
        monkeypatch.setattr(ng, "BLOCK", block)
        monkeypatch.setattr(ng, "ROWS", most)
        assert {r["doc_id"]: r["component_id"] for r in ng.ngram_components(df, 5, (80, 100)).collect()} == want


def test_null_ids_repeats_and_empty(spark):
    text = "a b c d e f g"
    got = ng.ngram_components(frame(spark, [(None, text), (5, text), (5, text), (7, text.upper()), (None, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got if r["n_shingles"]) == [("5", 5), ("5", 5), ("7", 5), ("None", 5)]
    assert ng.ngram_components(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_first(spark):
    a, b = "a b c d e f g h", "other words are in this text here"
    df = frame(spark, [(3, a), (1, a), (1, a), (2, b), (4, ""), (5, None), (None, b)])
    out = ng.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, a), (2, b), (4, ""), (5, None)]


def test_null_and_repeated_ids_hold_distinct_and_near_texts(spark):
    words = lambda tag: [f"{tag}{k}" for k in range(40)]
    near = lambda tag: " ".join([*words(tag), "more"])
    for same in (None, 7):
        rows = [(same, t) for tag in ("a", "b", "c", "d") for t in (" ".join(words(tag)), near(tag))]
        df = frame(spark, rows)
        kept = [r["text"] for r in ng.keep_first(df).collect()]
        assert sorted(t[0] for t in kept) == ["a", "b", "c", "d"], kept
    rows += [(1, "a0 " + near("a")), (9, " ".join(words("e"))), (None, near("e"))]
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in ng.ngram_components(frame(spark, rows)).collect()}
    assert len(got) == 11 and sorted(got.values()) == [1] * 3 + [7] * 6 + [9] * 2


def test_links_do_not_depend_on_the_order_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{t}{k}" for k in range(100)) for t in "ab")
    near = lambda t: t + " more"
    for null in (True, False):  # each order has words and ids of its own; a null id is shared by all
        rows, want = [], {}
        for k, order in enumerate(permutations(range(4))):
            own = lambda t, k=k: t.replace("a", f"a{k}x").replace("b", f"b{k}x")
            same, five, six = (None if null else 10 * k + 1), 10 * k + 5, 10 * k + 6
            four = [(same, own(a)), (same, own(b)), (five, own(near(a))), (six, own(near(b)))]
            rows += [four[j] for j in order]
            want |= {five: five if null else same, six: six if null else same}
        df = frame(spark, rows).coalesce(1)
        got = ng.ngram_components(df).select("doc_id", "component_id").collect()
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in want} == want
        assert sorted(r["component_id"] for r in got) == sorted(2 * list(want.values()))
        kept = [r["text"].split("x")[0] for r in ng.keep_first(df).collect()]
        assert sorted(kept) == sorted(f"{t}{k}" for t in "ab" for k in range(24))
