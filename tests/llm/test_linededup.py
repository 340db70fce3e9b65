import random

from helpers import DOCS, components, edits, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from netlens.llm import linededup as ld


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 3))
def test_within_is_the_edit_distance(a, b, k):
    assert ld.within(a, b, k) == (edits(a, b) <= k)


def brute(rows):
    """doc -> (lines, gone) by comparing all lines."""
    place, texts = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t else []):
            x = line.strip(" \t\r\x0b\x0c")
            if len(x) >= ld.SHORTEST:
                place.setdefault(x, []).append((ld.LAST if i is None else i, k))
        texts[i] = t
    names = sorted(place)
    root = components(names, lambda a, b: abs(len(a) - len(b)) <= ld.EDITS and (a[:-1] == b[: len(a) - 1] if len(a) > 200 else edits(a, b) <= ld.EDITS))
    first = {}
    for x in names:
        first[root[x]] = min([first.get(root[x], (ld.LAST, ld.LAST)), *place[x]])
    out = {}
    for i, t in texts.items():
        keep = []
        for k, line in enumerate((t or "").split("\n") if t else []):
            x = line.strip(" \t\r\x0b\x0c")
            if x not in place or first[root[x]] == (ld.LAST if i is None else i, k):
                keep.append(line)
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ü😀") for _ in range(rng.choice([18, 20, 21, 25, 40, 90]))) for _ in range(25)]

    def vary(x):
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(x))
            x = rng.choice([x[:p] + x[p + 1 :], x[:p] + "z" + x[p:], x[:p] + "y" + x[p + 1 :]])
        return x

    rows = [(d, "\n".join(vary(rng.choice(base)) for _ in range(rng.randrange(1, 8)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "short\n\nshort"), (None, "\n".join(base[:3])), (103, "x" * 9_000 + "\n" + "x" * 9_001)]
    got = {r["doc_id"]: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, t in want.items():
        assert got[i]["text"] == t, i
    texts = dict(rows)
    for r in got.values():
        for x in r["_dropped"] or ():
            own, first = r["doc_id"], None if x["doc_id"] == ld.LAST else x["doc_id"]
            lines = texts[own].split("\n")[x["line"]].strip(), texts[first].split("\n")[x["first_line"]].strip()
            assert len(lines[0]) >= ld.SHORTEST and len(lines[1]) >= ld.SHORTEST and (own, x["line"]) != (first, x["first_line"])
        assert r["_gone"] == len(r["_dropped"] or ())
    assert got[100]["_lines"] == got[101]["_lines"] == 0 and got[102]["_gone"] == 0 and got[103]["_gone"] == 1


def test_lists_and_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, f"2024-01-01 request {rng.randrange(1000):03d} was served by host {rng.randrange(100):02d} in time") for k in range(150)]
    want = brute(rows)
    for most in (ld.ROWS, 7):
        monkeypatch.setattr(ld, "ROWS", most)
        assert {r["doc_id"]: r["text"] for r in ld.dedup_lines(frame(spark, rows)).collect()} == want


def test_a_segment_that_all_lines_share_makes_no_pairs(spark):
    s, n = ld.Scratch(spark), 16_000
    rng = random.Random(4)
    lines = [f"request {rng.randrange(10**12):012d} served by the host in the usual time {k:05d}" for k in range(n)]
    keyed = ld._keyed(frame(spark, [(k, "\n".join(lines[k :: 40])) for k in range(40)]))
    places = s.cut(keyed.mapInArrow(ld._places(ld.SHORTEST), "_d long, _t long, at int, h long"), "places")
    firsts = s.cut(places.groupBy("h").agg(ld.F.min(ld.F.struct("_d", "at", "_t")).alias("first"), ld.F.count("*").alias("n")), "firsts")
    links = ld.line_links(keyed, firsts, s, ld.SHORTEST)
    assert links.count() < 30
    made = {p.rsplit("netlens-", 1)[1].split("-")[0]: spark.read.parquet(p).count() for p in s.paths}
    assert max(made.values()) <= 20 * n, made
    s.clear()


def test_a_text_of_very_many_lines(spark):
    text = "\n".join(f"{k * 7919 % 10**6:06d} {k * 104729 % 10**9:09d} {k * 7907 % 10**8:08d}" for k in range(200_000))
    out = ld.dedup_lines(frame(spark, [(1, text + "\n" + text[: len(text) // 4]), (0, text[len(text) // 2 : len(text) // 2 + 24_000])])).orderBy("doc_id").collect()
    assert out[1]["_lines"] == 250_000 and out[1]["_gone"] >= 50_000 + 900 and out[0]["_gone"] == 0


def test_shorter_lines_by_parameter(spark):
    out = ld.dedup_lines(frame(spark, [(1, "abcdefgh\nab\n"), (2, "abcdefgh\nabcdxfgh\nab\nother tx")]), shortest=4).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["abcdefgh\nab\n", "ab\nother tx"]


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough"
    out = ld.dedup_lines(frame(spark, [(1, line), (1, line), (2, line)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(1, line), (1, line), (2, "")]


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame([], DOCS)
    out = ld.dedup_lines(df)
    assert out.count() == 0 and out.columns == [*df.columns, *ld.ADDED]


def test_query_against_brute_force(spark, tmp_path):
    """Every column of the registered query over a table with repeats, near repeats, null texts and a null id."""
    import hashlib

    from netlens.llm.queries import op5_line_dedup

    rng = random.Random(12)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "épsilon", "zeta"], k=6)) for _ in range(10)]
    rows = [(d, "\n".join([*(rng.choice(base) + rng.choice(["", "", "x", "yz", "xyz!"]) for _ in range(rng.randrange(5))), "tail", ""])) for d in range(50)]
    rows += [(60, None), (61, ""), (None, "\n".join(base)), (62, "\n\n \n")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_line_dedup(spark, str(tmp_path)).collect()}
    want, texts = brute(rows), dict(rows)
    place = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t else []):
            if len(line.strip()) >= ld.SHORTEST:
                place.setdefault(line.strip(), []).append((ld.LAST if i is None else i, k))
    root = components(sorted(place), lambda a, b: abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)
    first = {}
    for x, at in place.items():
        first[root[x]] = min([first.get(root[x], (ld.LAST, ld.LAST)), *at])
    assert set(got) == set(texts)
    for i, t in texts.items():
        lines = t.split("\n") if t else []
        own = ld.LAST if i is None else i
        gone = [(k, *first[root[x.strip()]]) for k, x in enumerate(lines) if x.strip() in place and first[root[x.strip()]] != (own, k)]
        r = got[i]
        assert (r["n_lines"], r["n_dropped"]) == (len(lines), len(gone)), i
        assert r["dropped"] == ",".join(":".join(map(str, g)) for g in gone), i
        assert r["text_sha256"] == hashlib.sha256((want[i] or "").encode()).hexdigest(), i
