"""Hard negatives against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import negatives


def plain(rows, every=50, positives=5, count=3):
    """rows: (id, label, integer vector)."""
    ids, labels, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
    out = []
    for a in sorted({i for i in ids.tolist() if i % every == 0}):
        at = min(np.flatnonzero(ids == a), key=lambda x: (labels[x], v[x].tolist()))
        s = v @ v[at]
        order = np.lexsort((ids, -s))
        for p in [x for x in order if labels[x] == labels[at] and ids[x] != a][:positives]:
            hard = [x for x in order if labels[x] != labels[at] and 50 * s[p] <= 100 * s[x] <= 95 * s[p]][:count]
            out += [(a, int(ids[p]), n, int(ids[x]), int(s[p]), int(s[x])) for n, x in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "scale", "block", "batch"), [("float", 1.0, 8192, 16 << 20), ("double", 1.0, 100, 2000), ("double", 30_000.0, 200, 16 << 20), ("double", 200_000.0, 8192, 16 << 20)])
def test_negatives_match_brute_force(spark, monkeypatch, kind, scale, block, batch):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr("sparkloom.llm.common.BATCH_BYTES", batch)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 12)) * 0.6
    label = rng.integers(0, 4, 900)
    v = (centre[(label + rng.integers(0, 2, 900)) % 4] + rng.normal(size=(900, 12)) * 0.5) * scale
    v = v.astype(np.float32) if kind == "float" else v
    v[300:420] = v[100]
    v[500:520] = 0
    given = [(i, int(x), y.tolist()) for i, x, y in zip(range(900), label, v)]
    given += [given[50], given[50], given[77], (100, 3, given[3][2])]
    rows = [(i, x, np.floor(256 * np.array(y, np.float64)).astype(np.int64)) for i, x, y in given]
    odd = [(1000, None, [0.5] * 12), (1050, 1, None), (1100, 1, [None] * 12), (1150, 2, [float("inf")] * 12), (1200, 2, [float("nan")] * 12), (1250, 0, [1.0] * 3), (1300, 0, []), (None, 1, [0.1] * 12)]
    odd += [(1350, 1, [1e30] * 12)]
    df = spark.createDataFrame(given + odd, f"vec_id long, label int, embedding array<{kind}>").withColumns({"v": F.lit("clash"), "code": F.lit(1), "score": F.lit(1)})
    got = sorted(map(tuple, negatives.mine(df).collect()))
    assert got == plain(rows) and len(got) > 100


def test_negatives_of_few_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.5, 0.5])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in negatives.mine(df).collect()] == [(0, 1, 1, 2, 256 * 230 + 128 * 128, 256 * 128 + 128 * 128)]
    assert negatives.mine(df.limit(0)).count() == 0 and negatives.mine(df.filter("vec_id > 0")).count() == 0 and negatives.mine(df.filter("label = 1")).count() == 0


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (500, 9))
    x[:, 2] = 7
    edges = negatives.cell_edges(x[:60], x.min(0), x.max(0), 16)
    codes = negatives.quantise(x, edges)
    low, high = negatives.cell_ends(codes, edges)
    assert (low <= x).all() and (x <= high).all()
    lower, upper = negatives.Bounds(codes, edges, 9 * 90.0**2).of(x[:20])
    exact = x[:20] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all() and np.mean(upper - lower) < np.ptp(exact)
