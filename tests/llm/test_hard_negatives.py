import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldtrace.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, `a.b` int, key int"


def brute(rows):
    """The definition, by plain Python integers."""
    last = 1 << 63
    taken = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for i, label, v in taken:
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in taken]
        order = sorted(scored, key=lambda r: (-r[0], last if r[1] is None else r[1]))
        for ps, p, _ in [r for r in order if r[2] == label and r[1] != i][:5]:
            inside = [r for r in order if r[2] != label and 30 * ps <= 100 * r[0] <= 90 * ps][:10]
            found += [(i, p, rank + 1, n, ps, ns) for rank, (ns, n, _) in enumerate(inside)]
    return sorted(found, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def mined(spark, rows):
    found = hn.vectors(frame(spark, rows))
    got = hn.mine(found, found.where("id % 100 = 0"))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some_rows(seed, n, dim=6):
    pick = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in pick.normal(0.3, 1, dim)], int(pick.integers(3))) for i in range(n)]


def test_against_brute_force_with_odd_rows(spark):
    rows = some_rows(1, 350)
    rows += [
        (None, rows[3][1], 0), (400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, rows[1][1], None),
        (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (600, [], 1), (601, [2.0], 1),
        (700, [0.5] * 9, 2), (701, [0.5] * 9, 2), (-100, rows[7][1], 1), (None, rows[4][1], 1),
    ]
    rows += [(800 + i, [1.0] * 6, i % 2) for i in range(40)]  # ties, some of them anchors' own
    rows += [rows[0], rows[100], rows[5], rows[5]]  # repeated, anchors too
    want = brute(rows)
    assert len(want) > 200 and mined(spark, rows) == want


def test_empty_tables_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == []


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(spark, [(100, [1e30], 1), (2, [-1e30], 1)])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 1 << 30))
def test_strassen_is_exact(m, d, n, seed):
    pick = np.random.default_rng(seed)
    a, b = pick.integers(-(2**27), 2**27, (m, d)), pick.integers(-(2**27), 2**27, (d, n))
    want = a.astype(object) @ b.astype(object) if d else np.zeros((m, n))
    assert (hn.strassen(a, b, leaf=2) == want).all()


def test_strassen_takes_seven_products(monkeypatch):
    shapes, whole = [], hn.strassen

    def counted(a, b, leaf):
        shapes.append(a.shape)
        return whole(a, b, leaf)

    monkeypatch.setattr(hn, "strassen", counted)
    hn.strassen(np.ones((8, 8), np.int64), np.ones((8, 8), np.int64), 2)
    assert [shapes.count((n, n)) for n in (8, 4, 2)] == [1, 7, 49]


def test_tiles_cover_all_pairs(monkeypatch):
    monkeypatch.setattr(hn, "TILE", 512 * 24)
    pick = np.random.default_rng(2)
    a, b = pick.integers(-99, 99, (700, 5)), pick.integers(-99, 99, (130, 5))
    whole = np.zeros((700, 130), dtype=np.int64)
    for x, y, scores in hn._tiles(a, b):
        whole[x, y] = scores
    assert (whole == a @ b.T).all()


@pytest.mark.parametrize("large", [1, 1 << 58])
def test_best_and_merged_heaps(large):
    pick, heaps, rows = random.Random(3), hn.Heaps(4), []
    for _ in range(5):
        scores = np.array([[pick.randrange(6) * large for _ in range(30)] for _ in range(3)])
        allowed = np.array([[pick.random() < 0.4 for _ in range(30)] for _ in range(3)])
        ids = np.sort(np.array(pick.sample(range(1000), 30)))
        i, j = hn.best(scores, allowed, 4)
        heaps.merge(i, scores[i, j], ids[j])
        rows += [(o, -scores[o, c], ids[c]) for o in range(3) for c in range(30) if allowed[o, c]]
    want = [r for o in range(3) for r in sorted(rows)[:] if r[0] == o]
    want = [r for o in range(3) for r in [w for w in want if w[0] == o][:4]]
    assert [(o, -s, i) for o, s, i in heaps.rows.tolist()] == [tuple(map(int, r)) for r in want]
