import math
import random
from fractions import Fraction

import numpy as np
import pytest

from millgauge.llm import vectors as grid_module
from millgauge.llm.neighbours import distances, nearest, rounded
from millgauge.llm.top_scores import products, scaled, top_scores

KIND = "vec_id long, embedding array<float>, id string, v string"


def corpus(seed=0, n=700, d=9):
    draw = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in draw.normal(0, 0.2, d)]) for k in range(n)]
    common = rows[0][1]
    rows += [(1000 + k, list(common)) for k in range(300)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [float("nan")] * d), (2004, [float("inf")] + [1.0] * (d - 1))]
    rows += [(2005, [None] + [1.0] * (d - 1)), (None, list(common)), (2100, [1.0, 2.0]), (2101, [1.0, 2.5]), (3, rows[3][1]), (3, rows[3][1])]
    return [(a, b, "x", "y") for a, b in rows]


def usable(rows, zero):
    return [
        (i, v) for i, v, *_ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))
    ]


def brute(rows, score, zero, best):
    rows = usable(rows, zero)
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in rows if i % 100 == 0}):
        found = sorted((best(score(a, v)), i) for i, v in rows if i != q and len(v) == len(a))[:10]
        out += [(q, k + 1, i, best(s)) for k, (s, i) in enumerate(found)]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(grid_module, "QUERY_BLOCK", 5)
    monkeypatch.setattr(grid_module, "CANDIDATE_BLOCK", 150)


def test_nearest_equals_all_distances(frame, small_blocks):
    rows = corpus()
    found = sorted(tuple(r) for r in nearest(frame(rows, KIND)).collect())
    expected = brute(rows, lambda a, b: math.sqrt(sum((y - x) * (y - x) for x, y in zip(a, b))), False, lambda s: s)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], rtol=1e-14)


def test_top_scores_equal_all_products(frame, small_blocks):
    rows = corpus(1)
    found = sorted(tuple(r) for r in top_scores(frame(rows, KIND)).collect())
    dot = lambda a, b: sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))
    assert found == brute(rows, dot, True, lambda s: -s) or found == [(q, k, i, -s) for q, k, i, s in brute(rows, lambda a, b: -dot(a, b), True, lambda s: s)]


def test_few_or_no_vectors(frame):
    rows = [(0, [1.0, 0.5], "", ""), (1, [0.5, 1.0], "", ""), (2, [0.5, 1.0], "", "")]
    assert [r.vec_id for r in sorted(nearest(frame(rows, KIND)).collect(), key=lambda r: r.rank)] == [1, 2]
    assert [r.vec_id for r in sorted(top_scores(frame(rows, KIND)).collect(), key=lambda r: r.rank)] == [1, 2]
    assert nearest(frame([], KIND)).collect() == [] and top_scores(frame([], KIND)).collect() == []


@pytest.mark.parametrize("top", [3e30, 2.0**31])
def test_scores_of_any_size_are_ranked_exactly(frame, top):
    draw = random.Random(4)
    rows = [(k, [draw.choice([top, -top, 1.0, 0.0, top / 3, 2.0]) * draw.choice([1, 0.5]) for _ in range(3)], "", "") for k in range(40)]
    whole = {k: [math.floor(1024 * Fraction(x)) for x in v] for k, v, *_ in rows}
    exact = {k: sum(a * b for a, b in zip(whole[0], w)) for k, w in whole.items() if k}
    ranked = sorted(exact, key=lambda k: (-exact[k], k))[:10]
    found = sorted(top_scores(frame(rows, KIND.replace("float", "double"))).collect(), key=lambda r: r.rank)
    assert [r.vec_id for r in found] == ranked
    # what does not fit the result is the nearest number that does
    assert [r.score for r in found] == [min(max(exact[k], -(1 << 63)), (1 << 63) - 1) for k in ranked]


def test_rounding_bounds_hold():
    draw = random.Random(2)
    v = np.array([[draw.gauss(0, draw.choice((1e-3, 1, 50))) for _ in range(64)] for _ in range(200)])
    small, step, cut = rounded(v)
    near = small * step[:, None]
    for a in range(0, 200, 17):
        gap = abs(distances(v[a], v) - np.sqrt(np.square(near - near[a]).sum(1)))
        assert (gap <= cut + cut[a] + 1e-9).all()


def test_large_products_are_exact():
    far = scaled(np.array([[1e308, -0.3]]), 1024)
    assert far.tolist() == [[1024 * int(1e308), -308]]
    assert products(far, far)[0, 0] == (1024 * int(1e308)) ** 2 + 308**2
    a = np.array([[2.0**40, 3.0]])
    assert products(a, a)[0, 0] == (1 << 80) + 9
    b = np.array([[2.0**29, 1.0]])
    assert products(b, b)[0, 0] == (1 << 58) + 1
