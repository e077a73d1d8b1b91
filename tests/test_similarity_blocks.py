"""Large blocks: copies of a row in the shuffle, and tiles inside a block."""

import numpy as np
import pyarrow as pa

from groundwork.operators import similarity
from tests.test_graph import _brute_edges


def test_copies_of_a_row_do_not_grow_with_the_rows():
    for rows in (100_000, 500_000, 1_500_000):
        block = similarity._block_rows(rows)
        assert -(-rows // block) <= similarity.MAX_BLOCKS and block <= similarity.MAX_BLOCK_ROWS
    assert similarity._block_rows(100) == similarity.BLOCK_ROWS
    assert similarity._block_rows(3_000_000) == similarity.MAX_BLOCK_ROWS


def test_tiles_of_a_block_equal_brute_force(monkeypatch):
    for name, size in (("_CHUNK", 7), ("_TILE", 11), ("_FIRST_TILE", 3), ("_SOURCES", 20)):
        monkeypatch.setattr(similarity, name, size)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 4)).astype(np.float32)
    vectors[20:30] = vectors[3]
    ids, codes = [f"t{i:03d}" for i in rng.permutation(90)], [f"c{i}" for i in rng.choice(3, size=90)]
    columns = [pa.array(ids), pa.array(codes), pa.array(vectors.tolist(), pa.list_(pa.float32()))]
    left = pa.table(columns, names=["ticket_id", "error_code", "embedding"])
    right = pa.table(columns, names=["target_id", "target_code", "target_embedding"])
    want = _brute_edges(list(zip(ids, codes, vectors.astype(np.float64))), 0.35, 2)
    got = similarity._near_in_block(0.35, 2)(left, right).to_pylist()
    assert {(r["source"], r["dst"]) for r in got} == want and len(got) == len(want)
    assert similarity._near_in_block(0.35, 2)(left, right.slice(0, 0)).num_rows == 0


def test_copies_inside_cells_do_not_grow_with_the_rows():
    rng = np.random.default_rng(7)
    for rows in (50_000, 500_000, 1_500_000):
        shares = rng.pareto(1.2, int(np.sqrt(rows) / 4)) + 0.1
        counts = (rows * shares / shares.sum()).astype(np.int64)
        whole = similarity._block_rows(rows)
        block = similarity._cell_block_rows(counts, counts, whole)
        copies = (counts * -(-counts // block)).sum() / counts.sum()
        assert block <= whole and (copies <= similarity.MEAN_BLOCKS or block == whole and copies <= similarity.MAX_BLOCKS)
    assert similarity._cell_block_rows(np.array([10, 0, 20]), np.array([10, 5]), 4000) == similarity.BLOCK_ROWS
