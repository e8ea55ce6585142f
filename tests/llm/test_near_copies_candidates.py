"""Near copies that only their fingerprints bring together."""

import random

import corpus_pipeline
import numpy as np

from sparkloom.llm import near_copies, simhash, vec


def test_copies_without_a_common_key_are_linked_by_their_fingerprints(spark):
    """Of sets of similarity 0.8 or little more, one pair in 1,500 or so shares no MinHash key; a text mostly of one repeated run keeps its fingerprint."""
    rng, pairs = random.Random(5), []
    for _ in range(12000):
        words = [f"w{rng.randrange(10**9)}" for _ in range(35)]
        pairs += [" ".join(["x"] * 60 + words), " ".join(["x"] * 60 + words[:-7])]
    buf, off = vec.text_buffer(near_copies.pa.array(pairs))
    bands = []
    for a, b in vec.blocks(off):
        bands.append(near_copies._bands(*near_copies._shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])))
    bands = np.concatenate(bands).reshape(len(pairs) // 2, 2, -1)
    apart = np.flatnonzero((bands[:, 0] != bands[:, 1]).all(axis=1))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    left, right = pairs[::2], pairs[1::2]
    found = [i for i in apart if simhash.fingerprint(left[i], 5) == simhash.fingerprint(right[i], 5) and len(grams(left[i]) & grams(right[i])) >= 0.8 * len(grams(left[i]) | grams(right[i]))]
    assert found
    docs = spark.createDataFrame([(0, left[found[0]]), (1, right[found[0]]), (2, " ".join(["x"] * 60 + ["other", "words"] * 9))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2]
