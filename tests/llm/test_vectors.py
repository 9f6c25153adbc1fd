"""Vector codes and exact search against plain searches, on odd rows too."""

import hashlib
import math

import numpy as np
import pytest

from cutloom.llm import exact_topk, vector_codes
from cutloom.llm.vectors import limit, usable

SCHEMA = "vec_id long, embedding array<double>, label int, v int, _code string, `a.b` map<string,int>"


def table_of(spark, rows, n=3):
    return spark.createDataFrame([(*r, 0, "x", {"k": 1}) for r in rows], SCHEMA).repartition(n)


def odd_rows(size=32, seed=3):
    rng = np.random.default_rng(seed)
    good = [(int(i) * 5, (rng.normal(size=size) / 4).round(2).tolist(), int(rng.integers(3)) if i % 7 else None) for i in range(90)]
    hot = [(1000 + i, good[4][1], 1) for i in range(60)]  # one vector on many rows
    big = [(2000, [300.0 * (-1) ** i for i in range(size)], 2), (None, good[3][1], 0), (15, good[9][1], None), (15, good[9][1], None)]
    bad = [(3, None, 1), (4, [None] + [0.0] * (size - 1), 1), (1, [math.nan] * size, 0), (2, [math.inf] + [1.0] * (size - 1), 0), (7, [0.5] * 16, 1), (8, [], 1), (9, [1e9] * size, 1)]
    return good + hot + big, bad


def whole(v):
    return [math.floor(256 * x) for x in v]


def plain_codes(rows, parts, entries, rounds):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([whole(r[1]) for r in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        e, _ = nearest()
        for p in range(parts):
            for k in set(e[:, p]):
                some = x[e[:, p] == k, p]
                books[p, k] = [int(s) // len(some) for s in some.sum(axis=0)]
    e, d = nearest()
    return sorted((repr(r[0]), "".join(f"{k:02x}" for k in c), int(s)) for r, c, s in zip(rows, e, d.sum(axis=1))), books


@pytest.mark.parametrize("entries", [1, 7, 64, 100])
def test_codes_equal_plain_search(spark, entries):
    good, bad = odd_rows()
    df = table_of(spark, good + bad)
    books = vector_codes.fit(df, 8, entries)
    want, plain = plain_codes(good, 8, entries, 2)
    assert (books == plain).all()
    got = vector_codes.encode(df, books)
    assert sorted((repr(r.vec_id), r._code.hex(), r._error) for r in got.collect()) == want
    assert got.columns == ["vec_id", "label", "v", "a.b", "_code", "_error"]
    restored = vector_codes.decode(got, books).first()
    assert len(restored.restored) == 32 and vector_codes.digest(books) == hashlib.sha256(",".join(map(str, plain.ravel())).encode()).hexdigest()


def test_boxes_hold_just_the_entries_within_the_radius():
    rng = np.random.default_rng(5)
    entries, points, radius = rng.integers(-9, 9, (130, 3)), rng.integers(-12, 12, (50, 3)), rng.integers(0, 6, 50)
    row, at = vector_codes.Slices(entries).box(points, radius)
    inside = (np.abs(points[:, None] - entries[None]) <= radius[:, None, None]).all(axis=2)
    assert (np.stack([row, at]) == np.stack(np.nonzero(inside))).all()


def plain_top(vectors, queries, k, own):
    out = []
    for n, (q, v, _) in enumerate(queries):
        found = [(-sum(a * b for a, b in zip(whole(v), whole(w))), i is None, i or 0, m) for m, (i, w, _) in enumerate(vectors)]
        if own:
            found.remove(next(f for f in found if f[3] == n))
        out += [(q, r + 1, None if f[1] else f[2], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("pending", [5, exact_topk.PENDING])
@pytest.mark.parametrize("own", [True, False])
def test_topk_equals_plain_search(spark, monkeypatch, pending, own):
    monkeypatch.setattr(exact_topk, "PENDING", pending)
    good, bad = odd_rows()
    df = table_of(spark, good + bad)
    asked = [r for r in good if r[0] is not None and r[0] % 2 == 0]
    vectors = asked + [r for r in good if r not in asked]
    got = exact_topk.top_k(df, df.filter("vec_id % 2 = 0"), 5, own)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_top(vectors, asked, 5, own)


def test_sums_of_products_fit(spark):
    for size in (1, 2, 3, 64, 65, 512):
        assert size * int(256 * limit(size)) ** 2 < 2**63 and size * (2 * int(256 * limit(size, 2))) ** 2 < 2**63
    far = 2.0**20 - 1
    df = spark.createDataFrame([(50, [far] * 64), (1, [-far] * 64), (2, [far + 2] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(df, df.filter("vec_id = 50"))
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(3, 0), (1, -64 * int(far * 256) ** 2)]


def test_fewer_rows_than_results_and_none(spark):
    df = table_of(spark, [(50, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [-1.0, 0.5], 1)])
    got = exact_topk.top_k(df, df.filter("vec_id = 50"))
    assert sorted(map(tuple, got.collect())) == [(50, 1, 1, 256 * 256 + 128 * 128), (50, 2, 2, -256 * 256 + 128 * 128)]
    assert exact_topk.top_k(df, df.limit(0)).count() == 0
    none = df.limit(0)
    assert exact_topk.top_k(none, none).count() == 0 and usable(none)[1] == 0
    assert vector_codes.encode(none, vector_codes.fit(none)).count() == 0
