"""What a Python worker holds at once does not grow with the size of an Arrow batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from groundwork.operators import cells, grounding, nearest


def test_a_scan_meets_tickets_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    vectors, asked = rng.normal(size=(5000, 4)).astype(np.float32), nearest.unit(rng.normal(size=(3, 4)))
    ids = [f"t{i:05d}" for i in rng.permutation(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(vectors.tolist(), pa.list_(pa.float32()))], names=["ticket_id", "embedding"])
    seen, offer = [], nearest.Best.offer
    monkeypatch.setattr(nearest.Best, "offer", lambda self, ids, distances, which: (seen.append(distances.size), offer(self, ids, distances, which)))
    [found] = nearest._scan(["a", "b", "c"], asked, [({}, np.arange(3))], 10, iter([batch, batch.slice(0, 0)]))
    assert max(seen) <= 3 * 1024
    distances = 1.0 - asked @ nearest.unit(vectors.astype(np.float64)).T
    for q, name in enumerate("abc"):
        want = sorted(zip(nearest.six_place_steps(distances[q]), ids))[:10]
        assert [r["ticket_id"] for r in found.to_pylist() if r["question_id"] == name] == [i for _, i in want]


def test_questions_meet_cells_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    asked, centres = nearest.unit(rng.normal(size=(9, 4))), rng.normal(size=(5000, 4)).astype(np.float32)
    number, radius = rng.permutation(5000).astype(np.int32), rng.integers(0, 300_000, 5000)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(number), pa.array(centres.tolist(), pa.list_(pa.float32())), pa.array(number.astype(np.int64)), pa.array(radius)],
        names=["cell", "centre", "n", "radius"])
    steps = cells.angle_steps(asked @ nearest.unit(centres.astype(np.float64)).T)
    seen, angle_steps = [], cells.angle_steps
    monkeypatch.setattr(cells, "angle_steps", lambda cosines: (seen.append(cosines.size), angle_steps(cosines))[1])

    routes = [r for b in cells._routes(asked, 40, iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    reach = rng.integers(100_000, 400_000, 9)
    within = [r for b in cells._within(asked, reach, 500, iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert max(seen) <= 9 * 1024
    for q in range(9):
        first = sorted((r["steps"], r["cell"], r["n"]) for r in routes if r["question"] == q)[:40]
        assert first == sorted((int(s), int(c), int(c)) for s, c in zip(steps[q], number))[:40]
        found = {r["cell"] for r in within if np.unpackbits(np.frombuffer(r["bits"], np.uint8))[q]}
        assert found == set(number[steps[q] * 1000 - 500 * radius <= reach[q] * 1000].tolist())


def test_prompts_are_strings_a_few_at_a_time():
    system, prompt = pa.array(["s" * 100] * 4000), pa.array([f"{i} " + "p" * 5000 for i in range(4000)])
    tracemalloc.start()
    said = grounding._said(system, prompt, lambda pairs: [p.split(" ")[0] for _, p in pairs], 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert said.to_pylist() == [str(i) for i in range(4000)] and peak < 2_000_000
