"""Vector codes against plain Python, the Hilbert curve, box bounds and odd rows."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from scorelake.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, _hot string, row int"


def codes_by_force(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract, word for word, in Python integers."""
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    width = len(rows[0][1]) // parts
    cells = [[[math.floor(scale * x) for x in v[p * width:(p + 1) * width]] for p in range(parts)] for _, v, _ in rows]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cells:
                own[nearest(p, c[p])[1]].append(c[p])
            for e, members in own.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cells]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(rows, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    long = lambda x: x if x < 2**63 else None
    wide = {lab for (_, _, lab), e in zip(rows, errors) if e >= 2**63}
    return [(i, "".join(f"{e:02x}" for _, e in f), long(err), None if lab in wide else long(by_label[lab]), digest) for (i, _, lab), f, err in zip(rows, found, errors)]


def single(x):
    return float(np.float32(x))


def table_of(r, n, dim=16, spread=1.0):
    rows = [(i, [single(r.gauss(0, spread)) for _ in range(dim)], r.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(n + i, list(rows[5][1]), 1) for i in range(n // 2)]  # one vector holds a third of all rows
    rows += [(None, list(rows[0][1]), None), (3, [0.0] * dim, 9), (3, [0.0] * dim, 9), (n * 2, None, 1), (n * 2 + 1, [float("nan")] + [0.0] * (dim - 1), 1),
             (n * 2 + 2, [float("-inf")] + [0.0] * (dim - 1), 2), (n * 2 + 3, [None] + [0.0] * (dim - 1), 2)]
    r.shuffle(rows)
    return rows


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA)
    key = lambda t: tuple("" if x is None else str(x) for x in t)
    return sorted(map(tuple, vc.code_rows(df, **options).collect()), key=key), key


@pytest.mark.parametrize("seed,n,spread,block_rows", [(1, 400, 1.0, 16), (2, 90, 1e5, 8), (3, 60, 1e20, 256), (4, 7, 0.01, 4)])
def test_codes_equal_brute_force(spark, seed, n, spread, block_rows):
    rows = table_of(random.Random(seed), n, spread=spread)
    found, key = got(spark, rows, block_rows=block_rows)
    assert found == sorted(codes_by_force(rows), key=key)


def test_one_outlier_changes_no_result(spark):
    r = random.Random(9)
    rows = table_of(r, 60) + [(5000, [single(3.0e38)] * 16, 7)]
    found, key = got(spark, rows, block_rows=8)
    assert found == sorted(codes_by_force(rows), key=key)


def test_odd_tables(spark):
    assert got(spark, [])[0] == []
    assert got(spark, [(1, None, 1), (2, [float("nan")] * 8, 2)])[0] == []
    assert [t[1:4] for t in got(spark, [(1, [], 1), (2, [], None)])[0]] == [("00" * 8, 0, 0)] * 2
    # The most frequent length counts, and parts may differ by one component.
    rows = [(i, [single(i * 0.5 + j) for j in range(10)], 0) for i in range(6)] + [(9, [1.0], 0)]
    assert len(got(spark, rows)[0]) == 6


def test_hilbert_neighbours_touch():
    for dim, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        keys = vc.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_shortlist_keeps_every_nearest_entry():
    r = random.Random(4)
    for _ in range(200):
        entries = [[r.randint(-9, 9) for _ in range(3)] for _ in range(6)]
        points = np.array([[r.randint(-6, 6) for _ in range(3)] for _ in range(5)])
        low, high = points.min(axis=0), points.max(axis=0)
        books = vc.Codebooks([entries])
        among = books.shortlist(0, low, high)
        assert among == vc.shortlist(low.tolist(), high.tolist(), entries)
        full, _ = books.nearest(0, points, list(range(6)))
        some, _ = books.nearest(0, points, among)
        assert full.tolist() == some.tolist()


def test_limbs_round_trip():
    values = [0, -1, 2**31, -(2**31) - 5, 2**150 + 7, -(2**150) - 7]
    assert vc.from_limbs(vc.to_limbs(values)) == values
