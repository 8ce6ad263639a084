import hashlib
import math
import random

import numpy as np
import pytest

from tallybook.llm import codes as C

ROWS = "vec_id long, embedding array<float>, label int, _row long, code string, _any_label int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, 1, "clash", 2) for i, v, label in rows], ROWS.replace("<float>", f"<{kind}>"))


def brute(rows, rounds=6, entries=16):
    """The definition with Python's whole numbers; vectors of one width that 8 divides."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(8)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(part(v, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), c, e, by_label[label], digest) for i, c, e, label in out)


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("width", [8, 24])
def test_against_plain_loops(spark, monkeypatch, width):
    monkeypatch.setattr(C, "BLOCK_ROWS", 32)
    rnd = random.Random(width)
    middle = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i * 3 % 701, [rnd.gauss(m, 0.1) for m in middle[i % 9]], rnd.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[5][1], 3) for i in range(150)]  # one very common vector
    rows += [(None, rows[7][1], None), (2, rows[8][1], 1), (2, rows[8][1], 1), (9, None, 1), (9, [None] * width, 1), (9, [float("nan")] * width, 1), (9, [float("-inf")] + [0.0] * (width - 1), 1)]
    assert got(C.vector_codes(frame(spark, rows).repartition(3))) == brute(rows)


def test_ties_go_to_the_lower_index(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 4)
    rows = [(i, [float(i % 3 - 1)] * 8, i % 2) for i in range(40)]
    assert got(C.vector_codes(frame(spark, rows))) == brute(rows)
    assert C.short_list(np.array([0]), np.array([0]), np.array([[1], [-1], [1], [5]])).tolist() == [0, 1, 2]


def test_shortlists_hold_every_nearest_entry_and_cut():
    rng = np.random.default_rng(3)
    cut = 0
    for _ in range(200):
        points, entries = rng.integers(-50, 50, (20, 3)) + rng.integers(-200, 200, 3), rng.integers(-200, 200, (16, 3))
        few = C.short_list(points.min(0), points.max(0), entries)
        best, distance = C.nearest(points, entries)
        again, same = C.nearest(points, entries[few])
        assert (few[again] == best).all() and (same == distance).all()
        cut += len(few) < 16
    assert cut > 150


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (1, 5)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        place = C.hilbert_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_odd_widths_and_empty(spark):
    rows = [(1, [0.5] * 10, 1), (2, [0.25] * 10, 1), (3, [1.0] * 4, 1), (4, [], 2)]
    out = {r.vec_id: r for r in C.vector_codes(frame(spark, rows)).collect()}
    assert len(out[1].code) == 16 and out[1].error == 0 and (out[3].code, out[3].error, out[3].label_error) == (None, None, 0) and out[4].label_error is None
    assert C.vector_codes(frame(spark, [])).count() == 0 and C.vector_codes(frame(spark, [(1, None, 2)])).count() == 0
    assert [r.code for r in C.vector_codes(frame(spark, [(1, [], 2)])).collect()] == ["00" * 8]
    assert C.vector_codes(frame(spark, rows[:2], "double")).count() == 2
    with pytest.raises(Exception, match="64 bits"):
        C.vector_codes(frame(spark, [(1, [1e6] * 8, 2)])).count()
