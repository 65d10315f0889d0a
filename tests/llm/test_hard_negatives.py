import math

import numpy as np
import pyarrow as pa

from tessel.llm import hard_negatives as h


def plain(rows):
    """rows (vec_id, vector, label): the result, in whole numbers of Python, over all pairs."""
    ok = lambda i, x, y: i is not None and y is not None and x and all(v is not None and math.isfinite(v) for v in x)
    held = [(i, (int(math.fmod(y + 1, 10)) if i % 7 == 0 else y), [math.floor(256 * max(-(2.0**18), min(2.0**18, v))) for v in x]) for i, x, y in rows if ok(i, x, y)]
    out = []
    for a, (i, y, x) in enumerate(held):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, z)), j, c == y) for b, (j, c, z) in enumerate(held) if b != a and len(z) == len(x)]
        for s, j, _ in sorted(t for t in scored if t[2])[:5]:
            hard = sorted((n, k) for n, k, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s)[:10]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(hard)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, "a", 1) for i, x, y in rows], "vec_id long, embedding array<double>, label int, block string, at int").repartition(3)


def rows_of(n=900, dim=5):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((9, dim))[rng.integers(0, 9, n)] + 0.3 * rng.standard_normal((n, dim))
    rows = [(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, rng.integers(0, 4, n)))]
    rows += [(1000 + i, rows[0][1], 1 + i % 2) for i in range(120)]  # a common vector, ties by id
    rows += [rows[0], rows[100], rows[100]]  # anchors that repeat
    rows += [(2000, [0.0] * dim, 1), (2100, [1e300] + [0.1] * (dim - 1), 2), (2101, [-1e300] + [0.1] * (dim - 1), 3), (2200, [0.5] * 3, 1), (2201, [0.4] * 3, 1), (2202, [0.25] * 3, 2)]
    bad = [None, [], [float("nan")] * dim, [None] + [1.0] * (dim - 1), [float("inf")] * dim]
    return rows + [(3000 + 100 * k, x, 1) for k, x in enumerate(bad)] + [(4000, [0.1] * dim, None), (None, [0.1] * dim, 1), (4100, [0.3, 0.1], 8), (4102, [0.3, 0.2], 9)]


def test_equals_brute_force(spark, monkeypatch):
    for name, value in {"BLOCK": 32, "GROUP": 300, "CHUNK": 8, "LEAST_SPAN": 3, "MOST_SPAN": 3}.items():
        monkeypatch.setattr(h, name, value)
    rows = rows_of()
    got = sorted(tuple(r) for r in h.mine(frame(spark, rows)).collect())
    want = sorted(plain(rows))
    assert len(want) > 300 and got == want


def test_one_block_holds_all(spark):
    rows = rows_of(150)
    assert sorted(tuple(r) for r in h.mine(frame(spark, rows)).collect()) == sorted(plain(rows))


def test_empty_and_lonely(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2)]
    assert h.mine(frame(spark, rows)).count() == 0
    assert h.mine(frame(spark, rows).limit(0)).count() == 0


def test_the_curve_steps_to_a_neighbour():
    """Cells in the order of the curve are all cells, each beside the last one."""
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = h.hilbert(cells, bits)
        assert len(set(keys)) == len(cells)
        order = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_the_products():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-200, 200, (60, 4)), rng.integers(-200, 200, (9, 4))
    low, high = x.min(axis=0)[None], x.max(axis=0)[None]
    least, most = h._bounds(a, low, high)
    assert (least <= (a @ x.T)).all() and ((a @ x.T) <= most).all()


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """In clusters far from each other, anchors read few blocks of the many; the result is that of all pairs."""
    monkeypatch.setattr(h, "BLOCK", 32)
    seen = []
    plain_sides = h._sides
    monkeypatch.setattr(h, "_sides", lambda left, right, cell: seen.append(right) or plain_sides(left, right, cell))
    rng = np.random.default_rng(6)
    x = np.repeat(3 * rng.standard_normal((30, 6)), 60, axis=0) + 0.02 * rng.standard_normal((1800, 6))
    rows = [(i, r.tolist(), i % 3) for i, r in enumerate(x)]
    assert sorted(tuple(r) for r in h.mine(frame(spark, rows)).collect()) == sorted(plain(rows))
    zones, read = seen[2].count(), seen[3]  # of the negatives: zone maps that met groups, and blocks read
    masks = sum(int(np.unpackbits(np.frombuffer(r.need, np.uint8)).sum()) for r in read.select("need").collect())
    assert masks < 0.5 * 18 * zones


def test_windows_and_their_ends():
    score, sure = np.array([[100, 99, 0, -5, 7]]), np.array([[True, True, True, True, False]])
    from_, to = h.windows_of(score, sure)
    assert from_[0, :3].tolist() == [30, 30, 0] and to[0, :3].tolist() == [90, 89, 0] and (from_[0, 3:] > to[0, 3:]).all()
    assert isinstance(h._no_choice()[0], pa.Array)
