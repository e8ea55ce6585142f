"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import resample
from tests.llm.test_llm_operators import ROWS, frame

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TARGET = [("w1 w2 w3 é w4 w5",), ("W7 w8-w9 日本",), (None,), ("",)]


def features(t, max_n=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, share=25, min_words=20, max_n=2, buckets=10000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, max_n)[1]) for texts in ([x for _, x in rows], [x for (x,) in target]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, x in rows:
        n, f = features(x, max_n)
        w = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {id(x): n for n, x in enumerate(fit[: len(fit) * share // 100], 1)}
    return [(*x, rank.get(id(x))) for x in out]


@pytest.mark.parametrize(("max_n", "block"), [(2, 4 << 20), (2, 300), (3, 500), (1, 500)])
def test_importance_matches_plain_python(spark, monkeypatch, max_n, block):
    monkeypatch.setattr(resample, "BLOCK_BYTES", block)
    docs = frame(spark, ROWS)
    target = spark.createDataFrame(TARGET, "text string")
    got = resample.importance(docs, target, share=40, max_n=max_n).collect()
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted(plain(ROWS, TARGET, 40, max_n=max_n), key=key)


def test_importance_of_empty_tables(spark):
    docs, target = frame(spark, ROWS), spark.createDataFrame(TARGET, "text string")
    assert resample.importance(docs.limit(0), target).count() == 0
    none = resample.importance(docs, target.limit(0))
    assert none.count() == len(ROWS) and none.filter("rank is not null").count() == sum(features(t)[0] >= 20 for _, t in ROWS) // 4
    assert resample.resample(docs, target).columns == docs.columns


def test_resampling_draws_near_the_target(spark):
    rows = [(i, " ".join([f"{'near' if i % 4 == 0 else 'far'}{(i + j) % 30}" for j in range(60)])) for i in range(400)]
    target = spark.createDataFrame([(" ".join(f"near{(i * 7 + j) % 30}" for j in range(60)),) for i in range(50)], "text string")
    kept = resample.resample(frame(spark, rows), target).select("doc_id").collect()
    assert len(kept) == 100 and sum(r.doc_id % 4 == 0 for r in kept) >= 95


def test_suffix_array_and_runs():
    rng = np.random.default_rng(1)
    seq = np.append(rng.integers(0, 4, 199), 0)  # a zero closes the last text
    for depth in (1, 2, 3, 5):
        order, lcp = resample.suffix_array(seq, depth)
        rows = [[*seq[i : i + depth].tolist(), *[0] * depth][:depth] for i in order]
        assert rows == sorted(rows) and sorted(order) == list(range(200))
        for k in range(1, 200):
            a, b, n = seq[order[k - 1] :].tolist(), seq[order[k] :].tolist(), 0
            while n < depth and n < min(len(a), len(b)) and a[n] == b[n] > 0:
                n += 1
            assert lcp[k] == n


def test_equal_rows_have_ranks_of_their_own(spark):
    rows = [(None, " ".join(f"w{j}" for j in range(25)))] * 300 + [(1, " ".join(f"v{j}" for j in range(25)))] * 100
    got = resample.importance(frame(spark, rows), spark.createDataFrame(TARGET, "text string")).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 101)) and len(got) == 400


def test_crc_of_joined_texts():
    rng = np.random.default_rng(2)
    a, b = ([rng.bytes(int(n)) for n in rng.integers(0, 70, 200)] for _ in range(2))
    moved = resample.crc_shifted(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([len(x) for x in b]))
    assert (moved ^ np.array([zlib.crc32(x) for x in b], np.uint32)).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]
