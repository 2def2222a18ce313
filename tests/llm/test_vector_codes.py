"""Vector codes against plain Python, in all cases of the bounds."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tickweave.llm import vector_codes


def brute(rows, rounds=vector_codes.ROUNDS):
    own = [(i, [int(np.floor(4096 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not own:
        return []
    d = -(-max(len(r[1]) for r in own) // 8)
    parts = np.array([r[1] + [0] * (8 * d - len(r[1])) for r in own], object).reshape(len(own), 8, d)
    books = [[list(parts[e, p]) for e in range(min(16, len(own)))] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], entry)), e) for e, entry in enumerate(books[p])) for p in range(8)] for x in parts]

    for _ in range(rounds):
        best = assign()
        for p in range(8):
            for e in range(len(books[p])):
                mine = [parts[i, p] for i in range(len(own)) if best[i][p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    best, total = assign(), defaultdict(int)
    for r, b in zip(own, best):
        total[r[2]] += sum(x[0] for x in b)
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in b), sum(x[0] for x in b), total[r[2]], digest) for r, b in zip(own, best)]


def same(spark, rows, shape="vec_id long, embedding array<float>, label int, _label string"):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    found = vector_codes.codes(spark.createDataFrame([(*r, "x") for r in rows], shape).repartition(3))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)


def test_clusters_ties_and_dropped_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 24))
    rows = [(int(i), (centres[rng.integers(9)] + 0.1 * rng.normal(size=24)).tolist(), int(rng.integers(4)) if i % 5 else None) for i in rng.permutation(300)]
    rows += [(900 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[3][1], 2), (7, rows[4][1], 2), (None, rows[5][1], 3)]
    rows += [(1000, None, 1), (1001, [1.0] * 23 + [None], 1), (1002, [float("nan")] + [1.0] * 23, 1), (-5, [float("inf")] * 24, 1), (1003, [float("-inf")] * 24, None)]
    same(spark, rows)


def test_few_vectors_of_unequal_length(spark):
    same(spark, [(3, [0.5, -0.25, 1.0], 1), (1, [0.1] * 9, None), (2, [], None), (9, [0.0] * 17, 1)])


@pytest.mark.parametrize("rows", [[(1, [0.1] * 8, None)], [(1, [], 1), (2, [], 1)]])
def test_one_entry_and_empty_vectors(spark, rows):
    same(spark, rows)


def test_nothing_kept(spark):
    found = vector_codes.codes(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert found.collect() == []


def test_components_beyond_64_bits_say_so(spark):
    with pytest.raises(Exception, match="don't fit 64 bits"):
        vector_codes.codes(spark.createDataFrame([(i, [1e30] * 8, 1) for i in range(3)], "vec_id long, embedding array<float>, label int")).collect()


def test_bounds_spare_distances_and_lists_shrink():
    rng = np.random.default_rng(1)
    x = rng.integers(-3000, 3000, (4000, 6))
    part, books = np.repeat(np.arange(8), 500), rng.integers(-3000, 3000, (8, 16, 6))
    state = np.zeros(len(x), vector_codes.bound_dtype(4))
    vector_codes.search(x, part, books, 4, state)
    for step in range(12):
        new = books + rng.integers(-40, 40, books.shape) // (1 + step)
        move = np.sqrt(((new - books) ** 2).sum(-1)) * (1 + vector_codes.SLACK)
        place, books = vector_codes.advance(x, part, new, move, state), new
        dist = ((x[:, None, :] - books[part]) ** 2).sum(-1)
        assert (state["near"][:, 0] == dist.argmin(1)).all()
        if step > 3:
            assert (place == 0).mean() > 0.3
    listed = np.take_along_axis(np.sqrt(dist), state["near"].astype(int), 1)
    assert (state["low"][:, 1:] <= listed[:, 1:]).all() and (state["low"][:, 0] >= listed[:, 0]).all()
    assert vector_codes.shorter(np.array([90, 1000, 9, 1, 0, 0]), 4, 2) == 2
    assert vector_codes.shorter(np.array([10, 1000, 9, 1, 0, 0]), 4, 2) == 3
    assert vector_codes.shorter(np.array([10, 0, 9, 9, 9, 9]), 4, 2) == 4


def test_many_labels_are_joined_apart(spark, monkeypatch):
    rows = [(i, "00", i % 7, None if i % 3 == 0 else i % 50) for i in range(500)]
    coded = spark.createDataFrame(rows, "vec_id long, code string, error long, label int")
    want = defaultdict(int)
    for r in rows:
        want[r[3]] += r[2]
    monkeypatch.setattr(vector_codes, "HEAVY", 5)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 10)
    found = vector_codes.with_label_error(coded).collect()
    assert len(found) == 500 and all(r["label_error"] == want[r["label"]] for r in found)
