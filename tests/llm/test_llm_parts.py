"""Texts past one block, and the parts of the operators (EM, FTRL, BM25, dense spans) against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash

from sparkloom.llm import packing, pieces, pii, simhash, substring_dedup, toxicity, vec

WORD = re.compile("[^\x20\x09-\x0D]+")
CLOSED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    long = [" ".join(rng.choice(words) for _ in range(250_000)) for _ in range(2)]
    return [(1, f"{passage} {long[0]}"), (2, f"{long[1]} {passage} end"), (3, passage), (4, None), (5, "")]


@pytest.fixture(scope="module")
def long_docs(spark, long_rows):
    assert max(len(t or "") for _, t in long_rows) > vec.BLOCK_BYTES
    return spark.createDataFrame(long_rows, "doc_id long, text string").repartition(2).cache()


def test_long_texts_lose_their_repeated_words(long_docs, long_rows):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(long_docs).collect()}
    assert got == {1: (250_040, 0), 2: (250_041, 40), 3: (40, 40), 4: (0, 0), 5: (0, 0)}


def test_long_texts_have_exact_fingerprints(long_docs, long_rows):
    for r in simhash.fingerprints(long_docs).collect():
        w = WORD.findall(dict(long_rows)[r.doc_id] or "")
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(len(w) - 3)], np.uint64)
        want = sum(1 << b for b in range(64) if len(h) and 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
        assert r.fp % (1 << 64) == want


def test_long_texts_are_encoded_whole(long_docs, long_rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.codec(path).model
    for r in pieces.encode_digests(long_docs, path).collect():
        ids = [1, *model.encode(dict(long_rows)[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    args = (public_tokenizers.path("byte_bpe_50k.json"), 1, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = {}
    for r in packing.pack(long_docs, *args).collect():
        whole.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, t in long_rows:
        assert np.frombuffer(b"".join(x for _, x in sorted(whole[i])), "<u4").tolist() == [*bpe.encode(t or "", add_special_tokens=False).ids, 1]


def test_long_texts_are_scored_by_all_their_words(spark):
    rows = [(i, f"a{i % 7} b{i % 5} " + ("vile" if i % 2 else "kind")) for i in range(400)] + [(1000, "b1 " * 500_000 + "vile"), (1001, "b1 " * 500_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[1000] > 0.5 and got[1000] > got[1001]


def test_ftrl_matches_the_published_update():
    rng = random.Random(4)
    model, z, n = toxicity.Ftrl(100), {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else model.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(500):
        x, y = sorted(rng.sample(range(20), 4)), rng.randrange(2)
        model.learn(np.array(x), y)
        w = {i: weight(i) for i in [*x, bias]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    at = np.array([*range(20), bias])
    assert model.weights(at) == pytest.approx([weight(i) for i in at]) and 0 < np.count_nonzero(model.weights(at[:-1])) < 20


def test_neighbours_are_ranked_by_bm25(monkeypatch):
    monkeypatch.setattr(packing, "QUERY_TERMS", 100)  # ties at the end of a query would be open
    rng = random.Random(5)
    texts = [" ".join(rng.choice([f"t{i}" for i in range(60)]) for _ in range(rng.randrange(3, 30))) for _ in range(40)] + ["alone"]
    n, ws = len(texts), [t.split() for t in texts]
    held = {w: sum(w in x for x in ws) for x in ws for w in x}
    df = np.zeros(1 << packing.TERM_BITS, np.int64)
    hashes = packing._terms(list(held))[1]
    place = dict(zip(held, (hashes >> np.uint64(64 - packing.TERM_BITS)).tolist()))
    for w, c in held.items():
        df[place[w]] = max(df[place[w]], 3 * c)
    docs, words = 3 * n, 3 * sum(map(len, ws))
    index = packing.Index(texts, df, docs, words)

    def part(w, x):
        idf = math.log1p((docs - df[place[w]] + 0.5) / (df[place[w]] + 0.5))
        return idf * x.count(w) * (packing.K1 + 1) / (x.count(w) + packing.K1 * (1 - packing.B + packing.B * len(x) / (words / docs)))

    unused = np.array([rng.random() < 0.8 for _ in texts])
    for seed in range(n):
        query = sorted((w for w in set(ws[seed]) if held[w] > 1), key=lambda w: -part(w, ws[seed]))[: packing.QUERY_TERMS]
        score = [sum(part(w, x) for w in query if w in x) for x in ws]
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == {i for i in range(n) if unused[i] and score[i] > 0}, seed
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))


def test_em_finds_the_rates_of_the_labelers():
    prior, hit, false = 0.6, [0.95, 0.85, 0.75, 0.9, 0.65], [0.05, 0.15, 0.3, 0.1, 0.4]
    table = []
    for bits in range(32):
        v = [bits >> i & 1 for i in range(5)]
        p = prior * math.prod(h if x else 1 - h for x, h in zip(v, hit)) + (1 - prior) * math.prod(f if x else 1 - f for x, f in zip(v, false))
        table.append((v, p * 1e6))
    got = pii.estimate(table, 200)
    assert got[0] == pytest.approx(prior, abs=0.02) and got[1] == pytest.approx(hit, abs=0.02) and got[2] == pytest.approx(false, abs=0.02)
    w = pii._train(table, 200)
    assert all(x > 0 for x in w[1:]) and w[1] == max(w[1:])


def test_texts_full_of_addresses(spark):
    """Over several stretches, with overlaps of kinds; marks as a plain sweep sets them."""
    rng = random.Random(6)
    bits = ["u{0}@h{0}.com", "10.0.{1}.1", "é😀", "x@1.2.3.4.de", "no", "and", "é"]
    texts = [" ".join(rng.choice(bits).format(j, j % 256) for j in range(n)) for n in (3, 700, 2500)]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    for i, t, _ in rows:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(CLOSED.values()) for m in re.finditer(p, t))
        assert [tuple(x) for x in found[i].base] == want
        text, at = [], 0
        for s, k, e in sorted(tuple(x) for x in found[i].spans):
            if s >= at:
                text += [t[at:s], f"<{pii.KINDS[k]}>"]
            at = max(at, e)
        assert out[i].text == "".join([*text, t[at:]]) and out[i].n_chars == len(out[i].text)
