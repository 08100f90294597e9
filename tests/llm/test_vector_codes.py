"""Vector codes against a plain evaluation of all distances."""

import math
import random

import numpy as np
import pytest

from odflux.llm import vector_codes
from odflux.llm.vector_codes import Blocks, compress, curve_order, digest, hilbert, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, run int"


def plain(rows, parts, entries, rounds):
    """{row number: (code, error)} and codebooks, one distance at a time."""
    kept = [
        (k, i, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, *_) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max(len(v) for _, _, v in kept) // parts)
    cut = [(k, i, [(v + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)]) for k, i, v in kept]
    first = sorted(cut, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[r[2][p] for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, _, v in cut:
                members.setdefault(nearest(p, v[p])[1], []).append(v[p])
            books[p] = [
                [sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else books[p][e]
                for e in range(len(books[p]))
            ]
    out = {}
    for k, _, v in cut:
        best = [nearest(p, v[p]) for p in range(parts)]
        out[k] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    return out, books


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    out = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(300)]
    out += [(i, [0.5] * 8, 7) for i in range(300, 420)]  # one vector, many times
    out += [(5, [0.25] * 8, 1), (5, [0.25] * 8, 1), (None, [0.1] * 8, None), (None, [0.1] * 8, None)]
    out += [(900, None, 1), (901, [], 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1)]
    out += [(905, [1.0, -1.0, 0.5], 2), (906, [0.0] * 8, 2)]
    return [(*r, "clash", 3) for r in out]


@pytest.mark.parametrize("run", [vector_codes.RUN, 400])
def test_codes_equal_plain_evaluation(spark, monkeypatch, rows, run):
    monkeypatch.setattr(vector_codes, "RUN", run)
    coded, books = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts=4, entries=9)
    wanted, expected = plain(rows, 4, 9, 2)
    assert books.tolist() == expected
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=str)
    assert got == sorted(((rows[k][0], rows[k][2], *v) for k, v in wanted.items()), key=str)
    assert digest(books) == digest(np.array(expected))


def test_label_error_sums_equal_labels_and_nulls(spark, rows):
    coded, _ = compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=9)
    wanted = {}
    for r in coded.collect():
        wanted[r.label] = wanted.get(r.label, 0) + r.error
    got = with_label_error(coded).collect()
    assert len(got) == coded.count() and all(r.label_error == wanted[r.label] for r in got)
    assert None in wanted


def test_fewer_vectors_than_entries_and_none_at_all(spark, rows):
    coded, books = compress(spark.createDataFrame(rows[:3], SCHEMA), parts=4, entries=9)
    assert books.shape == (4, 3, 2) and {r.error for r in coded.collect()} == {0}
    coded, books = compress(spark.createDataFrame(rows, SCHEMA).limit(0))
    assert books is None and coded.collect() == [] and coded.columns == ["vec_id", "label", "code", "error"]
    coded, books = compress(spark.createDataFrame([(1, None, 1, "", 1)], SCHEMA))
    assert books is None and coded.collect() == []


def test_too_large_components_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        vector_codes.whole_numbers(pa.array([[1e30]]), 256)


def test_large_components_are_exact():
    x = np.random.default_rng(1).integers(-(1 << 27), 1 << 27, (100, 3))
    book = x[:7] + 1
    codes, found, _ = Blocks(x).assign(book)
    exact = ((x[:, None, :] - book) ** 2).sum(axis=2)
    assert (codes.ravel()[:100] == exact.argmin(axis=1)).all() and (found.ravel()[:100] == exact.min(axis=1)).all()


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_curve_visits_all_cells_by_single_steps(dims):
    cells = np.stack(np.meshgrid(*[np.arange(4)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hilbert(cells, 2)
    assert sorted(place) == list(range(4**dims))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_boxes_shorten_the_lists():
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 6, (4096, 4)) + rng.choice([-200, -60, 80, 190], (4096, 4))).astype(np.int64)
    book = x[:64]
    codes, found, evaluated = Blocks(x[curve_order(x)]).assign(book)
    assert evaluated < 0.5 * 4096 * 64
    exact = ((x[curve_order(x)][:, None, :] - book) ** 2).sum(axis=2)
    assert (codes.ravel() == exact.argmin(axis=1)).all()
