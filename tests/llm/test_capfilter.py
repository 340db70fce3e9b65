import math
import random

import numpy as np
import pytest
from helpers import components

from netlens.llm import capfilter as cf

SCHEMA = "vec_id long, embedding array<float>, label int"


def close(a, b):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    if not ok(a) or not ok(b) or len(a) != len(b):
        return False
    x, y = np.array(a, np.float64), np.array(b, np.float64)
    return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9


def check(spark, rows):
    got = {r["vec_id"]: r for r in cf.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()}
    vecs = {i: None if v is None else [None if x is None else float(np.float32(x)) for x in v] for i, v in rows}
    want = components(sorted(vecs), lambda a, b: close(vecs[a], vecs[b]))
    links = {i: sum(close(vecs[i], vecs[j]) for j in vecs if j != i) for i in vecs}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == links
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(40):
        v = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append((i, (v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1])).tolist()))
            i += 1
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [1.0] * 15 + [math.nan]), (905, [1.0] * 15 + [math.inf]), (906, [1e38] * 16), (907, [1e-38] * 16), (908, [1.0] * 8), (909, [1.0] * 8)]
    random.Random(0).shuffle(rows)
    check(spark, rows)
    monkeypatch.setattr(cf, "MOST", 8)
    check(spark, rows)
    monkeypatch.setattr(cf, "HELD", 3)
    check(spark, rows)


def test_repeats_null_ids_and_empty(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (1, [0.0, 1.0], 1)], SCHEMA)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in cf.near_duplicates(df).collect()), key=str)
    assert got == [(1, 0, 1, True), (3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False)]
    assert cf.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_the_index_at_the_threshold():
    rng = np.random.default_rng(0)
    for count in (2000, 50_000):
        codes = cf.Codes(64, count // cf.SHARE)
        u = cf._unit(rng.standard_normal((600, 64)))
        w = rng.standard_normal((600, 64))
        w = cf._unit(w - (w * u).sum(1)[:, None] * u)
        pairs = zip(codes.decode(u), codes.decode(0.9 * u + math.sqrt(1 - 0.81) * w), strict=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.97


@pytest.mark.parametrize("dim", [8, 16, 24, 32, 64])
@pytest.mark.parametrize("count", [50_000, 1_000_000, 4_000_000, 20_000_000])
def test_recall_of_the_index_holds_at_every_size(dim, count):
    rng = np.random.default_rng(3)
    codes = cf.Codes(dim, count // cf.SHARE)
    u = cf._unit(rng.standard_normal((1500, dim)))
    w = rng.standard_normal((1500, dim))
    w = cf._unit(w - (w * u).sum(1)[:, None] * u)
    pairs = zip(codes.decode(u), codes.decode(0.9 * u + math.sqrt(1 - 0.81) * w), strict=True)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.97


def test_list_decoding_is_exhaustive():
    rng = np.random.default_rng(1)
    codes = cf.Codes(12, 400)
    x = cf._unit(rng.standard_normal((20, 12)))
    dots = [(x @ codes.turn)[:, a:b] @ c.T for a, b, c in zip(codes.cut[:-1], codes.cut[1:], codes.code, strict=True)]
    for r, got in enumerate(codes.decode(x)):
        every = (dots[0][r][:, None] + dots[1][r][None, :]).ravel()
        want = np.flatnonzero(every >= codes.least)
        assert set(want) <= set(got) and (len(want) >= cf.LEAST or len(got) == cf.LEAST)


def test_numbers_of_four_and_eight_bytes_and_zeros(spark):
    df = spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.1, -0.0]), (3, [0.5, 0.0]), (4, [-0.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in cf.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
