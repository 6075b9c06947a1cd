"""Break points against a search over all of them."""

from itertools import combinations

import numpy as np
import pytest

from srcfacts.operators import regression as R


def sums_of(x, y):
    values, of = np.unique(x, return_inverse=True)
    part = lambda v: np.bincount(of, weights=v, minlength=len(values))
    return np.stack([part(np.ones_like(x)), part(x), part(y), part(x * x), part(x * y), part(y * y)], axis=1), values


def squares(x, y):
    if len(np.unique(x)) < 2:
        return float(((y - y.mean()) ** 2).sum())
    fit = np.polyfit(x, y, 1)
    return float(((np.polyval(fit, x) - y) ** 2).sum())


def searched(x, y, least):
    """(criterion, starts) of the best of all ways to cut between different values."""
    values, n, best = np.unique(x), len(x), None
    for k in range(n // least):
        for cut in combinations(range(1, len(values)), k):
            ends = [0, *cut, len(values)]
            parts = [(x >= values[a]) & (x <= values[b - 1]) for a, b in zip(ends, ends[1:], strict=False)]
            if any(p.sum() < least or b - a < 2 for p, a, b in zip(parts, ends, ends[1:], strict=False)):
                continue
            left = max(sum(squares(x[p], y[p]) for p in parts), 1e-12 * squares(x, y))
            score = n * np.log(left / n) + 3 * np.log(n) * (k + 1)
            if best is None or score < best[0] - 1e-9:
                best = (score, ends[:-1])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_optimum(seed):
    rng = np.random.default_rng(seed)
    n = 18
    x = np.sort(rng.integers(0, 14, n)).astype(float) if seed % 2 else np.arange(n, dtype=float)
    turns = np.sort(rng.choice(np.arange(3, 12), 2, replace=False))
    y = np.where(x < turns[0], 2 * x, np.where(x < turns[1], 9 - 3 * x, 40 + x)) + rng.normal(0, (0.0, 0.5, 3.0)[seed % 3], n)
    sums, values = sums_of(x - x.mean(), y - y.mean())
    least = 3
    starts = R.break_points(sums, least)
    score, wanted = searched(x, y, least)
    mine = [0, *starts[1:], len(values)]
    left = sum(squares(x[p], y[p]) for a, b in zip(mine, mine[1:], strict=False) for p in [(x >= np.unique(x)[a]) & (x <= np.unique(x)[b - 1])])
    assert starts == wanted or abs(n * np.log(max(left, 1e-12 * squares(x, y)) / n) + 3 * np.log(n) * len(starts) - score) < 1e-6


def test_noise_hides_no_break():
    rng = np.random.default_rng(1)
    x = np.arange(200.0)
    y = np.where(x < 100, x, 100 - 3 * (x - 100)) + rng.normal(0, 3, 200)
    sums, _ = sums_of(x - x.mean(), y - y.mean())
    starts = R.break_points(sums, 6)
    assert len(starts) == 2 and abs(starts[1] - 100) <= 3
    assert R.break_points(sums_of(x - x.mean(), rng.normal(0, 1, 200))[0], 6) == [0]


def test_blocks_then_moved():
    rng = np.random.default_rng(2)
    x = np.arange(3000.0)
    y = np.where(x < 1234, x, np.where(x < 2345, 5000 - x, 3 * x)) + rng.normal(0, 2, 3000)
    sums, _ = sums_of(x - x.mean(), y - y.mean())
    assert R.break_points(sums, 90, most=100) == R.break_points(sums, 90) == [0, 1234, 2345]


def test_few_rows():
    assert R.break_points(sums_of(np.arange(4.0), np.array([1.0, 5, 2, 9]))[0], 3) == [0]
    assert R.break_points(sums_of(np.array([1.0, 1, 2]), np.array([1.0, 5, 2]))[0], 3) == [0]


def test_breaks_of_many_stretches_at_once(monkeypatch):
    """The same breaks as one at a time, with few and many values, in one search and in several."""
    rng = np.random.default_rng(3)
    parts = []
    for k in range(60):
        v = int(rng.integers(3, 60))
        x, n = np.sort(rng.choice(500, v, replace=False)).astype(float), rng.integers(1, 9, v).astype(float)
        y = np.where(x < 200, 3 * x, 900 - 2 * x) * (k % 3) + rng.normal(0, 1 + k % 7, v)
        x -= x.mean()
        parts.append(np.stack([n, n * x, n * y, n * x * x, n * x * y, n * y * y + n * 0.1], axis=1))
    values = np.array([len(p) for p in parts])
    least = np.array([max(3, int(0.03 * p[:, 0].sum())) for p in parts])
    want = [R.break_points(p, int(m)) for p, m in zip(parts, least)]
    assert any(len(w) > 2 for w in want)
    for cells in (R.CELLS, 2000):
        monkeypatch.setattr(R, "CELLS", cells)
        assert [s.tolist() for s in R.many_break_points(np.concatenate(parts), np.cumsum(values) - values, values, least)] == want


def test_columns_and_arrays_agree(spark, monkeypatch):
    """Segments of different columns, tests with gaps, repeated keys: values as columns give what values as arrays give, and are not collected."""
    rows = []
    for seg in range(4):
        for t in range(30):
            x, z = t % 11, (t * 7 + seg) % 5
            vals = [("input", "a", x), ("input", "b", z), ("output", "y", 2 * x - z if seg < 2 else x * z), ("output", "w", abs(x - 5))] + ([("input", "c", t)] if seg == 3 and t % 4 else []) + ([("input", "a", x - 1)] if t == 3 else [])
            rows += [(seg, t, s, k, str(v)) for s, k, v in vals]
    trace = spark.createDataFrame([*rows, (9, 1, "input", "a", "x"), (9, 1, "input", "addr", "0x1")], "seg int, test int, side string, key string, value string")
    plain = lambda df: sorted(tuple(tuple(np.round(x, 6)) if isinstance(x, list) and x and isinstance(x[0], float) else str(x) if not isinstance(x, float) else round(x, 6) for x in r) for r in df.collect())
    made = lambda: [plain(f(trace)) for f in (R.least_squares, R.subset_regression, R.piecewise)]
    assert "collect_list" not in R.grams(trace, True)._jdf.queryExecution().optimizedPlan().toString()
    found = made()
    assert all(found)
    monkeypatch.setattr(R, "MOST_COLUMNS", 0)
    assert made() == found
