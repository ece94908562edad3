"""Vectors that link, against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tillmark.llm.near_vectors import _cuts, Layout, near_vectors, unit, _Forest, _matrix


def brute(rows, threshold=0.9):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if len(a) != len(b):
            return False
        # by powers of two, so that nothing is rounded
        a, b = (np.ldexp(np.array(v, dtype=float), -math.frexp(max(map(abs, v)))[1]) for v in (a, b))
        return a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= threshold

    links = {i: set() for i in range(len(rows))}
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if usable(a) and usable(rows[j][1]) and linked(a, rows[j][1]):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(ids, default=None)
        out.append((str(vec_id), len(links[i]), component, vec_id is not None and vec_id == component))
    return sorted(out, key=str)


def some_vectors(seed, count, width=12, copies=5, noise=0.12):
    """Random directions, small groups around some of them, a large one around the first."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, width))
    near = [base[k] + noise * rng.normal(size=width) for k in range(10) for _ in range(copies)]
    crowd = [base[0] + noise / 2 * rng.normal(size=width) for _ in range(count // 3)]
    every = [*base, *near, *crowd]
    scale = rng.uniform(0.01, 100, size=len(every))
    return [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(every, scale))]


def found(spark, rows, kind="double", **options):
    schema = f"vec_id long, embedding array<{kind}>, id long, rows long, vector string, label int"
    given = spark.createDataFrame([(i, v, 1, 2, "clash", 0) for i, v in rows], schema).repartition(3)
    result = near_vectors(given, **options)
    assert result.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(((str(r[0]), *r[1:]) for r in result.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"cell": 25}, {"cell": 20, "blocks": 3, "sample": 60}, {"blocks": 40, "cell": 40}])
def test_links_equal_all_pairs(spark, options):
    rows = some_vectors(1, 120)
    assert found(spark, rows, **options) == brute(rows)


def test_awkward_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, float("nan"), 0.0]),
        (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0, 0.0]), (8, [2.0, -0.0, 0.0]),
        (None, [1.0, 0.1, 0.0]), (9, [-1.0, 0.0, 0.0]), (10, [1e300, 1e299, 0.0]), (11, [1e-300, 0.0, 0.0]),
        (12, [1.0, 0.0]), (13, [1.0, 0.0, 0.0, 0.0]), (14, [5.0, 0.0]), (15, [0.0, 1.0, 0.0]), (15, [0.0, 0.0, 1.0]),
        (None, [0.0, 0.0, -1.0]), (16, [9.0, 3.0, 3.0, 1.0]), (17, [0.0, 1.0, 0.0, 0.0]), (18, [9.0, 3.0, 3.0, 1.01]),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:6], "float") == brute(rows[:6])
    assert found(spark, []) == []


def test_equal_vectors_are_counted_not_paired(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000 + i, [1.0, 2.0, 3.0 + i / 100]) for i in range(3)]
    got = found(spark, rows, cell=10)
    assert {r[1] for r in got} == {3002} and {r[2] for r in got} == {0}


def test_vectors_alike_in_a_block_are_dealt_by_hash(spark):
    # the first four coordinates of all are zero, so no cut parts them there
    rng = np.random.default_rng(4)
    rows = [(i, [0.0] * 4 + v.tolist()) for i, v in enumerate(rng.normal(size=(90, 4)))]
    assert found(spark, rows, cell=10, blocks=4) == brute(rows)


def test_every_pair_within_a_share_meets_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    layout = Layout(np.eye(3), [(0, 3)], np.array([0.4]), [_cuts(x[::2], 0.5, 40)])
    lives, visits = {}, set()
    for cell, side, rows in layout.cells(0, x, np.arange(len(x))):
        for row in rows.tolist():
            if side:
                visits.add((row, cell))
            else:
                lives[row] = cell
    assert len(set(lives.values())) > 6 and len(lives) == len(x)
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i, j in np.argwhere(distance <= 0.4).tolist():
        if lives[i] < lives[j]:
            assert (i, lives[j]) in visits
    assert all(lives[row] < cell for row, cell in visits)


def test_rotated_rows_do_not_depend_on_their_batch():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(50, 16)))
    rotation = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    layout = Layout(rotation, [(0, 16)], np.array([0.2]), [[(0, 1)]])
    whole = layout.rotated(x)
    assert all((layout.rotated(x[k : k + 1])[0] == whole[k]).all() for k in range(50))
    assert np.allclose(whole, x @ rotation)


def test_forest_takes_one_link_less_than_members():
    rng = np.random.default_rng(7)
    forest = _Forest(200)
    a, b = rng.integers(0, 200, (2, 3000))
    taken = forest.join(a, b)
    assert len(taken) == 200 - len(set(forest.top.tolist())) and (forest.top[a] == forest.top[b]).all()
    assert len(forest.join(a, b)) == 0


def test_matrix_of_slices():
    column = pa.array([[1.0], [2.0, 3.0], [], [4.0, 5.0, 6.0]], pa.list_(pa.float32())).slice(1)
    out, size = _matrix(column, 3)
    assert size.tolist() == [2, 0, 3] and out.tolist() == [[2, 3, 0], [0, 0, 0], [4, 5, 6]]
