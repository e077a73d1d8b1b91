"""Products in single precision leave out no pair that double precision would take."""

import numpy as np
import pyarrow as pa

from groundwork.operators import similarity
from groundwork.operators.nearest import unit


def _sides(vectors, codes):
    ids = [f"t{i:05d}" for i in range(len(vectors))]
    columns = [pa.array(ids), pa.array(codes), pa.array(list(vectors), pa.list_(pa.float32()))]
    return (pa.table(columns, names=["ticket_id", "error_code", "embedding"]),
            pa.table(columns, names=["target_id", "target_code", "target_embedding"]))


def _brute(vectors, codes, limit, k):
    directions = unit(vectors.astype(np.float64))
    steps = np.floor((1.0 - directions @ directions.T) * 1e6 + 0.5)
    steps[(steps / 1e6 >= limit) | (np.array(codes)[:, None] == np.array(codes))] = np.inf
    order = np.argsort(steps, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i, row in enumerate(order) for j in row if np.isfinite(steps[i, j])}


def test_distances_a_few_millionths_apart_are_ranked_in_double_precision():
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(6, 64))
    vectors = (centre[rng.integers(0, 6, 700)] + rng.normal(size=(700, 64)) * 10.0 ** rng.integers(-6, 0, (700, 1))).astype(np.float32)
    vectors[50:60] = vectors[7]
    codes = [f"c{i}" for i in rng.integers(0, 3, 700)]
    got = similarity._near_in_block(0.4, 2)(*_sides(vectors, codes))
    pairs = {(int(s[1:]), int(d[1:])) for s, d in zip(got.column("source").to_pylist(), got.column("dst").to_pylist())}
    assert pairs == _brute(vectors, codes, 0.4, 2) and len(pairs) == got.num_rows > 1000


def test_the_margin_holds_for_many_pairs():
    rng = np.random.default_rng(3)
    for dims in (1, 4, 64, 1024):
        a, b = (unit(rng.normal(size=(400, dims))) for _ in range(2))
        off = np.abs((a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.float64) - a @ b.T)
        assert off.max() < similarity._single_error(dims)


def test_few_set_places_among_many_flags():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 8, 9, 4096, 5003):
        for share in (0.0, 0.001, 0.5, 1.0):
            flags = rng.random(size) < share
            assert similarity._places(flags).tolist() == np.flatnonzero(flags).tolist()


def test_products_of_some_pairs_equal_those_of_all():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    for n in (1, 20, 1000):
        row, place = rng.integers(0, 40, n), rng.integers(0, 30, n)
        assert np.allclose(similarity._products(a, b, row, place), (a @ b.T)[row, place], atol=1e-12)
