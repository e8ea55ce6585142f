"""Token ids of packing: those of the tokenizers file, for less time, however odd the text."""

import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import packing

ARGS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 1)


def _same(texts):
    model = Tokenizer.from_file(ARGS[0])
    assert [x.tolist() for x in packing.tokens(*ARGS)(texts)] == [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_blanks_and_signs_in_any_order():
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x0b", "\x1c", "\x85", "​", "a", "é", "漢", "١", "9", ".", "!", "'", "'s", "'LL", "'ll", "'re", "🙂", "́", "<|", "<|endoftext|>", "\x00"]
    _same(["", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 25))) for _ in range(3000))])


def test_a_million_blanks_in_a_row(spark):
    """tiktoken gives such a text up."""
    texts = [" " * 1_200_000 + "end", "a " * 10 + "\n" * 1_200_000]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ARGS[0], 1, *ARGS[1:3], with_ids=False).collect()
    model = Tokenizer.from_file(ARGS[0])
    want = {i: [*model.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert {r.doc_id: r.doc_tokens for r in out} == {i: len(x) for i, x in want.items()}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(map(len, want.values()))


def test_tokens_take_less_than_lists_of_ids_by_the_given_pattern():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()] * 4
    ours = packing.tokens(*ARGS)
    with open(ARGS[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    given = tiktoken.Encoding("given", pat_str=ARGS[2], mergeable_ranks=ranks, special_tokens={})

    def least(f):
        took = []
        for _ in range(5):
            begun = time.process_time()
            f(texts)
            took.append(time.process_time() - begun)
        return min(took)

    assert least(ours) < 0.85 * least(lambda ts: [np.array([*given.encode_ordinary(t), 1], np.uint32) for t in ts])
