"""Cell suppression and attribute lists against plain Python, on many columns and with missing values."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import bitmaps, discern, release


def suppressed(rows, k):
    """Greedy over sets of differing columns: fewest new ones first, then the one whose first column comes first."""
    p, out = len(rows[0]), []
    for t in rows:
        gone = set()
        if len(rows) - 1 < k:
            gone = set(range(p))
        while len(rows) - 1 >= k:
            sets = [{c for c in range(p) if o[c] != t[c]} - gone for o in rows]
            if sum(not s for s in sets) > k:
                break
            rest = [s for s in sets if s]
            if not rest:
                break
            fewest = min(map(len, rest))
            gone |= max((s for s in rest if len(s) == fewest), key=lambda s: [c in s for c in range(p)])
        out.append(gone)
    return out


@pytest.mark.parametrize(("p", "n", "k"), [(30, 160, 3), (4, 300, 6), (70, 60, 2), (2, 3, 5)])
def test_suppression_matches_brute_force(spark, monkeypatch, p, n, k):
    monkeypatch.setattr(bitmaps, "BLOCK", 50)
    monkeypatch.setattr(bitmaps, "DENSE", 20)
    monkeypatch.setattr("sparkloom.operators.helpers.BATCH_BYTES", 20_000)
    rng = random.Random(p)
    base = [[rng.choice("abc") for _ in range(p)] for _ in range(5)]
    rows = [tuple(rng.choice([None, "a", "b", "x"]) if rng.random() < 0.12 else v for v in rng.choice(base)) for _ in range(n)]
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, " + ", ".join(f"{c} string" for c in cols)).repartition(3)
    got = {r.row: {int(c[1:]) for c in r.suppressed} for r in release.kambiguate(df, cols, k).collect()}
    assert got == dict(enumerate(suppressed(rows, k)))


def test_bitmaps_count_differing_columns():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (500, 9))
    x[:, 4] = rng.integers(0, 400, 500)
    n = rng.integers(1, 4, 500)
    closed = rng.random((40, 9)) < 0.3
    closed[0] = True
    cols = [pa.array([str(v) for v in c]) for c in x.T]
    block = bitmaps.Block(cols, n)
    asked = [c.slice(0, 40) for c in cols]
    asked[2] = pa.array(["none"] * 40)
    hits, least, mask = block.look(block.codes(asked), closed)
    for t in range(40):
        d = (x != x[t]) & ~closed[t]
        d[:, 2] = ~closed[t][2]
        count = d.sum(1)
        assert hits[t] == n[count == 0].sum() and least[t] == (count[count > 0].min() if (count > 0).any() else 0)
        if least[t]:
            assert mask[t].tolist() == max(r.tolist() for r in d[count == least[t]])


def lists(rows, tau):
    """rows: (values, label). Greedy attributes that tell a row from other classes; a null tells nothing."""
    p, out = len(rows[0][0]), {}
    tell = lambda a, b, c: a[c] is not None and b[c] is not None and a[c] != b[c]
    for v, y in rows:
        left = [o for o, z in rows if y is not None and z is not None and z != y]
        goal = len(left) - tau * sum(any(tell(v, o, c) for c in range(p)) for o in left)
        picked = []
        while len(left) > goal:
            gain = [sum(tell(v, o, c) for o in left) for c in range(p)]
            best = max(range(p), key=lambda c: (gain[c], -c))
            if not gain[best]:
                break
            picked.append(best)
            left = [o for o in left if not tell(v, o, best)]
        out[v, y] = picked
    return out


@pytest.mark.parametrize(("p", "tau", "missing"), [(5, 1.0, 0.0), (5, 0.7, 0.2), (12, 1.0, 0.1), (70, 1.0, 0.02), (5, 0.9, 0.0)])
def test_attribute_lists_match_brute_force(spark, p, tau, missing):
    rng = random.Random(p)
    rows = [(tuple(None if rng.random() < missing else rng.choice(["a", "b", "c|", "=d"][: 2 + c % 3]) for c in range(p)), rng.choice(["x", "y", "z", None])) for _ in range(70)]
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame([(*v, y) for v, y in rows], ", ".join(f"{c} string" for c in cols) + ", label string").repartition(3)
    got = {(tuple(r[c] for c in cols), r.label): [int(c[1:]) for c in r.needed] for r in discern.min_attributes_by_row(df, cols, "label", tau).collect()}
    assert got == lists(rows, tau)
