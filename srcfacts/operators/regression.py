"""Least-squares rules per segment, from sums alone.

Gram matrices are summed on Spark, so a fit never sees more than one small matrix. Piecewise fits take one row of sums for
each distinct value of the input, all of them, and search their breaks on running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.operators.mining import is_address_key, known, number


#: Columns up to which a test's values become columns of their own (their products, if asked for, included); with more they travel as arrays.
MOST_COLUMNS = 20


def _values(trace: DataFrame, *names: str) -> DataFrame:
    """The trace's number columns with their value v as double, null where it isn't a number."""
    return known(trace).where(~is_address_key(F.col("key"))).select("seg", "test", *names, number("value").cast("double").alias("v"))


def _few(rows: DataFrame, *names: str) -> list:
    """The distinct names that have numbers, MOST_COLUMNS + 1 at most."""
    return sorted(rows.where("v is not null").select(*names).distinct().limit(MOST_COLUMNS + 1).collect())


def grams(trace: DataFrame, products: bool = False) -> DataFrame:
    """(seg, keys, n, sums, products): sums over the tests that have all number columns of their segment.

    keys: side_key names, sorted, and behind them with ``products`` the products ``a*b`` of each two inputs, squares
    included; sums[i], products[i * k + j] by their order.

    Sums are taken for each set of columns that tests of a segment have; a segment's is the one with all its columns.
    """
    rows = _values(trace, F.concat_ws("_", "side", "key").alias("key"))
    names = [r.key for r in _few(rows, "key")]
    ins = [i for i, name in enumerate(names) if name.startswith("input_")]
    made = [(a, b) for k, a in enumerate(ins) for b in ins[k:]] if products else []
    k = len(names) + len(made)
    if not names or k > MOST_COLUMNS:
        return _long_grams(rows.where("v is not null").groupBy("seg", "test", "key").agg(F.max("v").alias("v")), products)
    tests = rows.groupBy("seg", "test").agg(*[F.max(F.when(F.col("key") == name, F.col("v"))).alias(f"c{i}") for i, name in enumerate(names)])
    mask = sum((F.when(F.col(f"c{i}").isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(names))), F.lit(0))
    wide = tests.select("seg", mask.alias("mask"), *[f"c{i}" for i in range(len(names))], *[(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"c{len(names) + i}") for i, (a, b) in enumerate(made)]).where("mask > 0")
    sums = wide.groupBy("seg", "mask").agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)])
    cells = sums.select("seg", "mask", "n", F.array(*[f"s{i}" for i in range(k)]).alias("s"), F.array(*[f"p{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k)]).alias("p"))
    full = cells.groupBy("seg").agg(F.bit_or("mask").alias("all"), F.max_by(F.struct("mask", "n", "s", "p"), "mask").alias("r")).where("r.mask = all").select("seg", "r.*")
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    here = F.array(*map(bit, range(len(names))), *[bit(a) & bit(b) for a, b in made])
    at = full.withColumn("at", F.filter(F.array(*map(F.lit, range(k))), lambda i: F.get(here, i)))
    keys = F.array(*map(F.lit, names), *[F.lit(f"{names[a]}*{names[b]}") for a, b in made])
    of = lambda c, i: F.get(F.col(c), i)
    return at.select(
        "seg", F.transform("at", lambda i: F.get(keys, i)).alias("keys"), F.flatten(F.transform("at", lambda i: F.transform(F.col("at"), lambda j: of("p", i * k + j)))).alias("products"), "n", F.transform("at", lambda i: of("s", i)).alias("sums")
    )


def _long_grams(rows: DataFrame, products: bool) -> DataFrame:
    """``grams`` of (seg, test, key, v), one row a key, for any number of names."""
    names = rows.groupBy("seg").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    tests = rows.groupBy("seg", "test").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("x"))
    full = tests.join(names, "seg").where(F.size("x") == F.size("keys"))
    if products:
        ins = F.filter("x", lambda x: F.startswith(x["key"], F.lit("input_")))
        made = F.flatten(F.transform(ins, lambda p, i: F.transform(F.slice(ins, i + 1, F.size(ins)), lambda q: F.struct(F.concat_ws("*", p["key"], q["key"]).alias("key"), (p["v"] * q["v"]).alias("v")))))
        full = full.withColumn("x", F.concat("x", made)).withColumn("keys", F.transform("x", lambda x: x["key"]))
    full = full.select("seg", "keys", F.transform("x", lambda x: x["v"]).alias("v"))
    cells = full.select("seg", "keys", F.posexplode(F.flatten(F.transform("v", lambda a: F.transform(F.col("v"), lambda b: a * b)))).alias("pos", "p"))
    squares = cells.groupBy("seg", "keys", "pos").agg(F.sum("p").alias("p")).groupBy("seg", "keys").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("products"))
    sums = full.select("seg", F.posexplode("v").alias("pos", "v")).groupBy("seg", "pos").agg(F.sum("v").alias("s"), F.count("*").alias("n")).groupBy("seg").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums"))
    return squares.join(sums, "seg")


def _constant(s: np.ndarray, p: np.ndarray, n: float, y: int) -> bool:
    return p[y, y] - s[y] ** 2 / n <= 1e-9 * max(1.0, p[y, y])


def _fit(n: float, s: np.ndarray, p: np.ndarray, y: int, xs: list[int]) -> tuple[float, list[float], float] | None:
    """(r2, slopes, intercept) from sums; None where y is constant or the inputs depend on each other."""
    c = p - np.outer(s, s) / n
    if _constant(s, p, n, y):
        return None
    if not xs:
        return 0.0, [], float(s[y] / n)
    a = c[np.ix_(xs, xs)]
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    if (scale <= 1e-9).any() or np.linalg.cond(a / np.outer(scale, scale)) > 1e10:
        return None
    k = np.linalg.solve(a, c[xs, y])
    return float(k @ c[xs, y] / c[y, y]), k.tolist(), float((s[y] - k @ s[xs]) / n)


COLUMNS = ["seg", "y", "xs", "slopes", "intercept", "r2", "n"]
RULE = "seg {seg}, y string, xs array<string>, slopes array<double>, intercept double, r2 double, n long"


def _per_segment(trace: DataFrame, sums: DataFrame, rules) -> DataFrame:
    """Rows that ``rules(keys, n, sums, products)`` gives for each segment, without its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = len(r.keys)
                out += [(r.seg, *row, r.n) for row in rules(list(r.keys), r.n, np.array(r.sums), np.array(r.products).reshape(k, k))]
            yield pd.DataFrame(out, columns=COLUMNS)

    return sums.mapInPandas(run, RULE.format(seg=trace.schema["seg"].dataType.simpleString()))


def least_squares(trace: DataFrame, least_r2: float = 0.90, least_rows: int = 3) -> DataFrame:
    """(seg, y, xs, slopes, intercept, r2, n): every output on all changing inputs of its segment, r2 above the bound; inputs
    that depend on earlier ones are left out. A constant output is a rule without inputs, r2 1."""

    def rules(keys: list[str], n: int, s: np.ndarray, p: np.ndarray) -> Iterator[tuple]:
        if n < least_rows:
            return
        chosen: list[int] = []
        for i in (i for i, name in enumerate(keys) if name.startswith("input_")):
            if _fit(n, s, p, i, []) is not None and (not chosen or (_fit(n, s, p, i, chosen) or (0,))[0] < 1 - 1e-9):
                chosen.append(i)
        for y in (i for i, name in enumerate(keys) if name.startswith("output_")):
            if _constant(s, p, n, y):
                yield keys[y], [], [], float(s[y] / n), 1.0
                continue
            found = _fit(n, s, p, y, chosen) if chosen and n > len(chosen) else None
            if found and found[0] > least_r2:
                yield keys[y], [keys[i] for i in chosen], found[1], found[2], found[0]

    return _per_segment(trace, grams(trace), rules)


def _fits(n: np.ndarray, s: np.ndarray, p: np.ndarray, y: int, xs: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_fit`` of the segments ``at`` of one list of columns: (those that have one, slopes, intercepts, r2)."""
    at = at[p[at, y, y] - s[at, y] ** 2 / n[at] > 1e-9 * np.maximum(1.0, p[at, y, y])]
    c = p[at][:, [*xs, y]][:, :, [*xs, y]] - s[at][:, [*xs, y], None] * s[at][:, None, [*xs, y]] / n[at][:, None, None]
    a, b, yy = c[:, :-1, :-1], c[:, :-1, -1], c[:, -1, -1]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0))
    ok = (scale > 1e-9).all(axis=1)
    ok[ok] = np.linalg.cond(a[ok] / (scale[ok, :, None] * scale[ok, None, :])) <= 1e10
    at, k = at[ok], np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
    return at, k, (s[at, y] - (k * s[at][:, xs]).sum(axis=1)) / n[at], (k * b[ok]).sum(axis=1) / yy[ok]


def subset_regression(trace: DataFrame, most_inputs: int = 4, least_r2: float = 0.8, least_rows: int = 3, polynomial: bool = True) -> DataFrame:
    """(seg, y, xs, slopes, intercept, r2, n): for every output all sets of up to ``most_inputs`` inputs with r2 at the bound.

    Where none is found, with ``polynomial``: one or two terms out of a, b, a*a, b*b and a*b of each two inputs, a
    product among them. Terms are named ``a*b``. Segments of the same columns are fitted together.
    """

    def rules(keys: list[str], n: np.ndarray, s: np.ndarray, p: np.ndarray) -> Iterator[tuple]:
        ins = [i for i, name in enumerate(keys) if name.startswith("input_") and "*" not in name]
        terms = [i for i, name in enumerate(keys) if "*" in name]
        of = {i: frozenset(keys[i].split("*")) for i in ins + terms}
        plain = [xs for size in range(1, min(most_inputs, len(ins)) + 1) for xs in combinations(ins, size)]
        bent = [xs for size in (1, 2) for xs in combinations(ins + terms, size) if any(i in terms for i in xs) and len(frozenset().union(*(of[i] for i in xs))) <= 2]
        for y in (i for i, name in enumerate(keys) if name.startswith("output_")):
            open_ = np.ones(len(n), bool)
            for sets in (plain, bent):
                left = open_.copy()
                for xs in sets:
                    at, k, rest, r2 = _fits(n, s, p, y, list(xs), np.nonzero(left & (n >= max(least_rows, len(xs) + 2)))[0])
                    good = r2 >= least_r2
                    open_[at[good]] = False
                    yield from ((i, keys[y], [keys[x] for x in xs], *row) for i, *row in zip(at[good], k[good].tolist(), rest[good].tolist(), r2[good].tolist(), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for keys, rows in b.groupby(b["keys"].map(tuple), sort=False):
                k, n, seg = len(keys), rows["n"].to_numpy(), rows["seg"].tolist()
                found = rules(list(keys), n.astype(float), np.stack(rows["sums"].to_list()), np.stack(rows["products"].to_list()).reshape(-1, k, k))
                out += [(seg[i], *row, int(n[i])) for i, *row in found]
            yield pd.DataFrame(out, columns=COLUMNS)

    return grams(trace, products=polynomial).mapInPandas(run, RULE.format(seg=trace.schema["seg"].dataType.simpleString()))


#: Distinct input values up to which breaks are the optimum over all places; more are taken in as many blocks first.
MOST_VALUES = 4096


def break_points(sums: np.ndarray, least: int, most: int = MOST_VALUES) -> list[int]:
    """Starts of the segments that a line each fits best, ``least`` rows and two values in each at least.

    For each number of segments the breaks with the least squares left, by dynamic programming over the last segment's start;
    of these the number with the least information criterion, n log(squares / n) + 3 log(n) a segment. sums: rows of (n, x, y, xx, xy, yy), one a
    value of x, ascending; running sums give the squares of any stretch. With over ``most`` values the optima are taken over the
    borders of ``most`` blocks of values, and every break then goes to the best place between its neighbours, until none moves.
    """
    run = np.concatenate([np.zeros((1, 6)), np.cumsum(sums, axis=0)])
    values = len(sums)
    places = np.arange(values + 1) if values <= most else np.unique(np.linspace(0, values, most + 1).astype(int))
    total, rows = run[-1, 0], run[places, 0]
    every = max(1, int(total // max(least, 1)))
    cost = np.full((every, len(places)), np.inf)
    back = np.zeros((every, len(places)), int)
    for j in range(1, len(places)):
        open_ = (rows[j] - rows[:j] >= least) & (places[j] - places[:j] >= 2)
        i = int(np.count_nonzero(open_))  # those that are far enough come first
        if i:
            left = rest_of(run[places[j]] - run[places[:i]])
            cost[0, j] = left[0]
            through = cost[:-1, :i] + left
            back[1:, j] = np.argmin(through, axis=1)
            cost[1:, j] = np.min(through, axis=1)
    # what rounding leaves of a perfect fit is no difference
    floor = 1e-12 * max(rest_of(run[-1:])[0], 1e-12 * run[-1, 5], 1e-300)
    found: list[tuple[float, list[int]]] = []
    for k in range(every):
        if np.isfinite(cost[k, -1]):
            at, starts = len(places) - 1, [0]
            for s in range(k, 0, -1):
                at = int(back[s, at])
                starts.insert(1, int(places[at]))
            starts = starts if values <= most else _moved(run, starts, least)
            left = rest_of(run[[*starts[1:], values]] - run[starts]).sum()
            found.append((total * np.log(max(left, floor) / total) + 3 * np.log(total) * (k + 1), starts))
    return min(found, default=(0.0, [0]))[1]


def _moved(run: np.ndarray, starts: list[int], least: int) -> list[int]:
    """Each break where the lines on both sides leave the least squares, in turns."""
    bounds, moved = [*starts, len(run) - 1], True
    while moved:
        moved = False
        for i in range(1, len(bounds) - 1):
            left, right = bounds[i - 1], bounds[i + 1]
            cuts = np.arange(left + 2, right - 1)
            cuts = cuts[(run[cuts, 0] - run[left, 0] >= least) & (run[right, 0] - run[cuts, 0] >= least)]
            squares = rest_of(run[cuts] - run[left]) + rest_of(run[right] - run[cuts])
            best = int(cuts[np.argmin(squares)])
            now = rest_of(run[[bounds[i]]] - run[left])[0] + rest_of(run[[right]] - run[bounds[i]])[0]
            if squares.min() < now * (1 - 1e-9):
                bounds[i], moved = best, True
    return bounds[:-1]


def rest_of(t: np.ndarray) -> np.ndarray:
    """Squares that the line of each row of sums leaves."""
    n, x, y, xx, xy, yy = t.T
    sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
    same = sxx <= 1e-12 * np.maximum(1.0, xx)
    return np.maximum(syy - np.where(same, 0.0, sxy * sxy / np.where(same, 1.0, sxx)), 0)


def r2_of(t: np.ndarray) -> np.ndarray:
    """Of rows of sums (n, x, y, xx, xy, yy): 1 for constant y, 0 for constant x."""
    n, x, y, xx, xy, yy = t.T
    sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
    flat = syy <= 1e-12 * np.maximum(1.0, yy)
    same = sxx <= 1e-12 * np.maximum(1.0, xx)
    fit = sxy * sxy / np.where(same | flat, 1.0, sxx * syy)
    return np.where(flat, 1.0, np.where(same, 0.0, fit))


#: Distinct input values up to which the breaks of many inputs are searched at once, and cells of such a search.
NARROW, CELLS = 256, 1 << 20


def many_break_points(sums: np.ndarray, first: np.ndarray, values: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """``break_points`` of many stretches of rows ``first`` to ``first + values``, each of NARROW values at most."""
    found: list[np.ndarray] = [np.zeros(1, int)] * len(first)
    total = np.add.reduceat(sums[:, 0], first) if len(first) else np.zeros(0)
    every = np.maximum(1, total // np.maximum(least, 1)).astype(int)
    order, begin = np.lexsort((every, values)), 0
    while begin < len(order):
        end = min(len(order), begin + max(1, CELLS // int((values[order[begin]] + 1) * every[order[begin:]].max())))
        while end > begin + 1 and (end - begin) * int((values[order[end - 1]] + 1) * every[order[begin:end]].max()) > CELLS:
            end = begin + (end - begin) // 2
        part, begin = order[begin:end], end
        v, e, far = values[part], every[part], int(values[part].max())
        place = np.arange(far)
        block = np.where((place < v[:, None])[:, :, None], sums[np.minimum(first[part][:, None] + place, len(sums) - 1)], 0.0)
        run = np.concatenate([np.zeros((len(part), 1, 6)), np.cumsum(block, axis=1)], axis=1)
        cost = np.full((len(part), int(e.max()), far + 1), np.inf)
        back = np.zeros(cost.shape, np.int32)
        for j in range(2, far + 1):
            open_ = run[:, j, None, 0] - run[:, : j - 1, 0] >= np.maximum(least[part], 1)[:, None]
            i = int(open_.sum(axis=1).max())
            if i:
                stretch = np.where(open_[:, :i, None], run[:, j, None] - run[:, :i], 1.0)
                left = np.where(open_[:, :i], rest_of(stretch.reshape(-1, 6)).reshape(len(part), i), np.inf)
                cost[:, 0, j] = left[:, 0]
                through = cost[:, :-1, :i] + left[:, None]
                back[:, 1:, j] = np.argmin(through, axis=2)
                cost[:, 1:, j] = np.min(through, axis=2)
        g = np.arange(len(part))
        last, whole, k = cost[g, :, v], run[g, v], np.arange(cost.shape[1])
        floor = 1e-12 * np.maximum(np.maximum(rest_of(whole), 1e-12 * whole[:, 5]), 1e-300)
        n = whole[:, 0, None]
        score = np.where(np.isfinite(last) & (k < e[:, None]), n * np.log(np.maximum(last, floor[:, None]) / n) + 3 * np.log(n) * (k + 1), np.inf)
        for x, (best, some) in enumerate(zip(np.argmin(score, axis=1), np.isfinite(score).any(axis=1), strict=True)):
            starts, at = [0], int(v[x])
            for s in range(int(best) if some else 0, 0, -1):
                at = int(back[x, s, at])
                starts.insert(1, at)
            found[part[x]] = np.array(starts)
    return found


def _pieces(rows: pa.Table, first: np.ndarray, least_share: float) -> pa.Table:
    """The best breaks of each stretch of rows (seg, x, y, a, n, b, bb), one (seg, x, y) each, ascending in a."""
    a, n, b, bb = (rows.column(c).to_numpy().astype(float) for c in ("a", "n", "b", "bb"))
    values = np.diff(np.append(first, len(a)))
    of = np.repeat(np.arange(len(first)), values)
    # centred, so that differences of running sums keep their digits
    weight = np.add.reduceat(n, first)
    u, cy = a - (np.add.reduceat(a, first) / values)[of], (np.add.reduceat(b, first) / weight)[of]
    sums = np.stack([n, n * u, b - n * cy, n * u * u, u * (b - n * cy), bb - 2 * cy * b + n * cy * cy], axis=1)
    open_ = (values >= 3) & (np.add.reduceat(sums[:, 5], first) > 1e-12 * np.maximum(1.0, np.add.reduceat(bb, first)))
    least = np.maximum(3, (least_share * weight).astype(int))
    at = np.nonzero(open_ & (values <= NARROW))[0]
    starts = dict(zip(at.tolist(), many_break_points(sums, first[at], values[at], least[at]) if len(at) else [], strict=True))
    starts |= {int(i): np.array(break_points(sums[first[i] : first[i] + values[i]], int(least[i]))) for i in np.nonzero(open_ & (values > NARROW))[0]}
    kept, breaks, scores = sorted(starts), [], []
    for i in kept:
        stretch = slice(first[i], first[i] + values[i])
        scores.append(round(float(r2_of(np.add.reduceat(sums[stretch], starts[i])).mean()), 9))
        breaks.append(a[stretch][starts[i][1:] - 1].tolist())
    named = rows.select(["seg", "y", "x"]).take(pa.array(first[kept] if kept else [], pa.int64()))
    return named.append_column("segments", pa.array([len(starts[i]) for i in kept], pa.int32())).append_column("breaks", pa.array(breaks, pa.list_(pa.float64()))).append_column("r2", pa.array(scores, pa.float64()))


def piecewise(trace: DataFrame, least_share: float = 0.03) -> DataFrame:
    """(seg, y, x, segments, breaks, r2): the input by which an output is piecewise linear best: mean r2 of the segments, each
    with ``least_share`` of the rows at least (and three of them); ties go to fewer segments, then by name. breaks: the last input
    value of every segment but the last, chosen by ``break_points``. Of a key that a test repeats the largest number counts.

    Sums of each distinct input value are combined before the shuffle; the values of one (seg, x, y) meet in a task, one row of sums each, and
    tasks search the breaks of many (seg, x, y) at once.
    """
    rows = _values(trace, "side", "key")
    names = _few(rows.where(F.col("side").isin("input", "output")), "side", "key")
    if names and len(names) <= MOST_COLUMNS:
        cells = {(r.side, r.key): f"c{i}" for i, r in enumerate(names)}
        tests = rows.groupBy("seg", "test").agg(*[F.max(F.when((F.col("side") == s) & (F.col("key") == k), F.col("v"))).alias(c) for (s, k), c in cells.items()])
        ins, outs = ({k: c for (s, k), c in cells.items() if s == which} for which in ("input", "output"))
        none = lambda fields: F.array().cast(f"array<struct<{fields}>>")
        asked = F.array(*[F.struct(F.lit(k).alias("x"), F.col(c).alias("a")) for k, c in ins.items()]) if ins else none("x:string,a:double")
        wide = tests.select("seg", *outs.values(), F.explode(asked).alias("i")).select("seg", "i.x", "i.a", *outs.values()).where("a is not null")
        wide = wide.groupBy("seg", "x", "a").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in outs.values() for n, f in (("n", F.count), ("b", F.sum), ("bb", lambda c: F.sum(F.col(c) * F.col(c))))])
        got = F.array(*[F.struct(F.lit(k).alias("y"), *[F.col(f"{n}_{c}").alias(n) for n in ("n", "b", "bb")]) for k, c in outs.items()]) if outs else none("y:string,n:bigint,b:double,bb:double")
        points = wide.repartition("seg", "x").select("seg", "x", "a", F.explode(got).alias("o")).select("seg", "x", "o.y", "a", "o.n", "o.b", "o.bb").where("n > 0")
    else:
        once = rows.where("v is not null").groupBy("seg", "test", "side", "key").agg(F.max("v").alias("v"))
        mine = lambda which: F.collect_list(F.when(F.col("side") == which, F.struct("key", "v")))
        tests = once.groupBy("seg", "test").agg(mine("input").alias("ins"), mine("output").alias("outs")).select("seg", "outs", F.explode("ins").alias("i")).select("seg", "i", F.explode("outs").alias("o"))
        a, b = F.col("i.v"), F.col("o.v")
        points = tests.groupBy("seg", F.col("i.key").alias("x"), F.col("o.key").alias("y"), a.alias("a")).agg(F.count("*").alias("n"), F.sum(b).alias("b"), F.sum(b * b).alias("bb")).repartition("seg", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # a stretch may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held and _key(held[0], 0) == _key(rows, rows.num_rows - 1):
                held.append(rows)
                continue
            rows = pa.concat_tables([*held, rows]).combine_chunks()
            first = _stretches(rows)
            if len(first) > 1:
                yield from _pieces(rows.slice(0, first[-1]), first[:-1], least_share).to_batches()
            held = [rows.slice(first[-1])]
        if held:
            yield from _pieces(pa.concat_tables(held).combine_chunks(), np.zeros(1, int), least_share).to_batches()

    seg = trace.schema["seg"].dataType.simpleString()
    found = points.sortWithinPartitions("seg", "x", "y", "a").mapInArrow(run, f"seg {seg}, y string, x string, segments int, breaks array<double>, r2 double")
    best = Window.partitionBy("seg", "y").orderBy(F.desc("r2"), "segments", "x")
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def _key(rows: pa.Table, at: int) -> tuple:
    return tuple(rows.column(c)[at].as_py() for c in ("seg", "x", "y"))


def _stretches(rows: pa.Table) -> np.ndarray:
    """Where a new (seg, x, y) begins."""
    new = np.zeros(rows.num_rows, bool)
    for c in ("seg", "x", "y"):
        code = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    new[0] = True
    return np.nonzero(new)[0]
