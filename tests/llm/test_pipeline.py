"""Each stage against what its own input says, on a small table."""

import random
from collections import Counter

import pytest

cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from netlens.llm.common import Scratch

    d, s = "/root/testdata/sf0.01", Scratch(spark)
    docs = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(s.cut(stage(spark, docs[-1], d), name))
    yield docs
    s.clear()


def test_columns_and_ids(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        ids = [r["doc_id"] for r in df.select("doc_id").collect()]
        assert len(ids) == len(set(ids))


def test_toxic_documents_go(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {r["doc_id"] for r in stages[1].collect()}
    assert all(i in left for i, t in labels.items() if t == 0)
    assert sum(i not in left for i, t in labels.items() if t == 1) > 0.75 * sum(labels.values())


def test_no_line_repeats(stages):
    from netlens.llm.linededup import SHORTEST

    seen = Counter(x.strip() for r in stages[2].collect() for x in r["text"].split("\n") if len(x.strip()) >= SHORTEST)
    assert max(seen.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_no_near_copies_are_left(stages):
    from test_ngram_join import sets

    own = {r["doc_id"]: sets(r["text"], 5) for r in stages[3].collect()}
    post = {}
    for i, x in own.items():
        for h in x:
            post.setdefault(h, []).append(i)
    for i, x in own.items():
        for j, n in Counter(j for h in x for j in post[h] if j < i).items():
            assert 100 * n < 80 * len(x | own[j]), (i, j)


def test_mix_takes_the_target_words(stages):
    from test_mixing import water

    before, after = Counter(), Counter()
    for r in stages[3].collect():
        before[r["source"]] += len(r["text"].split())
    for r in stages[4].collect():
        after[r["source"]] += len(r["text"].split())
    want = water(dict(before))
    assert all(abs(after[s] - want[s]) <= 2 for s in want)


def test_pieces_cover_documents(stages):
    have = Counter()
    for r in stages[5].collect():
        have[r["doc_id"]] += r["length"]
    assert set(have) == {r["doc_id"] for r in stages[4].collect()}
    assert all(have[r["doc_id"]] == r["doc_tokens"] for r in stages[5].collect())


def awkward():
    """(doc_id, text, source): copies, near copies, lines within two edits, null and repeated ids, null and empty texts."""
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(300)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    long, foot = line(120), "this footer line stands under very many texts"
    rows = [(k, line(30) + "\n" + foot + rng.choice(["", "!", "s."]) + "\n" + line(12), rng.choice("ab")) for k in range(30)]
    rows += [(40, long, "a"), (41, long + " more", "b"), (None, long.replace(" ", "  "), None), (None, line(40), "a"), (None, line(40), "a"), (7, line(50), "b"), (7, line(50), "b")]
    rows += [(50, None, "a"), (51, "", "b"), (52, " \n ", None), (53, "vile scum " * 8, "a"), (54, "vile words and scum", "b")]
    return rows + rows[:2] + rows[-3:-2]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    from netlens.llm.common import Scratch

    d, s = str(tmp_path_factory.mktemp("odd")), Scratch(spark)
    rows = awkward()
    toxic = [(200 + k, "some plain words " + "vile scum " * (1 + k % 5), "a") for k in range(40)]
    clean = [(300 + k, f"plain words of text number {k} " * 2, "b") for k in range(40)]
    every = [(i, t, "en", c, None if t is None else len(t)) for i, t, c in rows + toxic + clean]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 300)) for i, _, _ in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = [spark.read.parquet(f"{d}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(s.cut(stage(spark, docs[-1], d), name))
    yield d, [sorted(map(tuple, x.collect()), key=str) if k < 5 else x.collect() for k, x in enumerate(docs)]
    s.clear()


def test_awkward_toxicity(spark, odd):
    from netlens.llm import toxicity as tx

    d, out = odd
    docs = spark.read.parquet(f"{d}/documents.parquet")
    judged = tx.score(docs, tx.train(docs, spark.read.parquet(f"{d}/labels.parquet"))).collect()
    assert len(out[1]) == sum(not r["is_toxic"] for r in judged)
    kept = Counter(out[1])
    assert all(kept[r] == n for r, n in Counter(out[0]).items() if not r[1] or "vile" not in r[1])
    assert not any(r[1] and "scum" in r[1] for r in out[1])


def test_awkward_line_dedup(odd):
    from helpers import components, edits

    from netlens.llm.linededup import LAST, SHORTEST

    _, out = odd
    texts = sorted({r[:2] for r in out[1]}, key=str)
    place = {}
    for i, t in texts:
        for k, x in enumerate((t or "").split("\n")):
            if len(x.strip()) >= SHORTEST:
                place.setdefault(x.strip(), []).append((LAST if i is None else i, k))
    root = components(sorted(place), lambda a, b: abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)
    first = {}
    for x, at in place.items():
        first[root[x]] = min([first.get(root[x], (LAST, LAST)), *at])
    ties = {k for k, n in Counter(p for at in place.values() for p in at).items() if n > 1}

    def left(i, t):
        if t is None:
            return None
        own = LAST if i is None else i
        return "\n".join(x for k, x in enumerate(t.split("\n")) if x.strip() not in place or first[root[x.strip()]] == (own, k))

    assert not ties & {first[r] for r in first if sum(root[x] == r for x in place) > 1}  # no class begins at a place that two texts share
    want = [(r[0], left(*r[:2]), *r[2:4]) for r in out[1]]
    want = [w for w, r in zip(want, out[1], strict=True) if w[1] == r[1] or w[1].strip()]
    assert Counter(r[:4] for r in out[2]) == Counter(want)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in out[2])


def test_awkward_near_copies(odd):
    from helpers import components
    from test_ngram_join import sets

    _, out = odd
    rows = sorted({r[:2] for r in out[2]}, key=str)
    own = [sets(t, 5) for _, t in rows]
    root = components(list(range(len(rows))), lambda a, b: bool(own[a] and own[b]) and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]))
    kept = Counter(r[:2] for r in out[3])
    assert set(kept.values()) == {1} and set(kept) <= set(rows)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root[k], []).append(r)
    for group in groups.values():
        here = [r for r in group if r in kept]
        assert len(here) == 1 and here[0][0] == min((i for i, _ in group if i is not None), default=None)


def test_awkward_mix_and_pack(odd):
    from test_mixing import water

    _, out = odd
    before, after = Counter(), Counter()
    for r in out[3]:
        before[r[3]] += len((r[1] or "").split())
    for r in out[4]:
        after[r[3]] += len(r[1].split())
    want = water(dict(before))
    assert all(abs(after[s] - want[s]) <= 2 for s in want)
    words = {}
    for r in out[3]:
        words.setdefault((r[0], r[3]), set()).update((r[1] or "").split())
    assert all(r[1].split() and set(r[1].split()) <= words[r[0], r[3]] for r in out[4])
    tokens, pieces = Counter(), Counter()
    for r in out[5]:
        pieces[r["doc_id"]] += r["length"]
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert set(pieces) == {r[0] for r in out[4]}
    assert all(n % size == 0 for (_, size), n in tokens.items())


def test_empty_tables_pass_every_stage(spark, odd):
    d, _ = odd
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, d).count() == 0


def test_run_gives_the_last_stage(spark, odd):
    d, out = odd
    got = cp.run(spark, d).collect()
    assert sum(r["length"] for r in got) == sum(r["length"] for r in out[5]) and {r["doc_id"] for r in got} == {r["doc_id"] for r in out[5]}
