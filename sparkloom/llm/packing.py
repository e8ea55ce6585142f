"""Lexical retrieval packing: documents into sequences of at most ``WIDTH`` tokens.

1. One pass over all texts counts, for ``2**TERM_BITS`` hashed words, the documents that hold them (the
   collection statistics of BM25), all words, and the bytes by signature.  A text's signature is ``LEVELS`` smallest
   hashes of its words under as many hash functions, which like texts tend to share, then a hash of all its words.
2. Signatures in order are cut into shards of about ``SHARD_BYTES`` by their cumulated bytes, so that more texts with
   one smallest hash are told apart by the next ones.  Only texts with the same words, and more of them than
   a shard holds, are dealt by id, and null ids and rows that repeat an id and text by their number.  Texts are
   shuffled to their shards once, sorted by id.
3. A task takes a shard: it tokenises, builds an inverted index and packs greedily.  The document
   that a sequence begins with is the seed.  BM25 with the seed's ``QUERY_TERMS`` weightiest words ranks
   the unused documents of the shard; they fill the window in that order.  The one that does not fit
   is cut, and its rest begins, and seeds, the next sequence.  Without a neighbour the next unused id follows.
   The last window of a shard is cut into powers of two, which need no padding.

Every id lies in exactly one piece.  Ids are those of the tokenizers library for ``tokenizer_path``, by the same
vocabulary in tiktoken when its ranks file is given.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import materialize, partitions
from sparkloom.operators.helpers import global_cumsum

WIDTH = 2048
SHARD_BYTES = 2 << 20
#: bytes of text whose words are hashed at a time: what that takes fits a core's cache
BLOCK_BYTES = 512 << 10
TERM_BITS = 18
#: smallest hashes in a signature, 16 bits of each
LEVELS = 8
SIGNATURE_BYTES = 2 * LEVELS + 8
_ODD = vec.mix(np.arange(1, LEVELS + 1, dtype=np.uint64), 77) | np.uint64(1)
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: how patterns of the GPT-2 family end
_BLANKS = r"|\s+(?!\S)|\s+"


def _grouped(pattern: str) -> str:
    """The same pattern with the alternatives before the look-ahead in a group, which runs without backtracking."""
    head = pattern.removesuffix(_BLANKS)
    return pattern if head == pattern else f"(?:{head}){_BLANKS}"


class Tokens:
    """Text -> ids; end_id closes each document.

    Texts are encoded whole: a table of words costs more than it saves where many words are new (265 CPU seconds a GB
    of text against 186).  A text that tiktoken gives up, as a million blanks in a row, goes to tokenizers.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None, pattern: str | None, end_id: int) -> None:
        self.path, self.end_id = tokenizer_path, end_id
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            model = tiktoken.Encoding("texts", pat_str=_grouped(pattern), mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
            self.encode = lambda t: model.encode_to_numpy(t, allowed_special="all")
        else:
            self.encode = self.by_tokenizers

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def by_tokenizers(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.encode(text)
        except ValueError:
            return self.by_tokenizers(text)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text, the end id last."""
        return [np.append(self._ids(t), np.uint32(self.end_id)) for t in texts]


@lru_cache(2)
def tokens(*args) -> Tokens:
    return Tokens(*args)


def _terms(text: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word hash) of every word."""
    buf, off = vec.text_buffer(pa.array(text, pa.string()))
    rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in vec.blocks(off, BLOCK_BYTES):
        part = buf[off[a] : off[b]]
        ws, we, first = vec.words(part, off[a : b + 1] - off[a])
        rows.append(a + vec.row_of_word(first))
        terms.append(vec.word_hashes(part, ws, we))
    return np.concatenate(rows), np.concatenate(terms)


@vec.lean
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, signature, n): 0 documents with a term, 1 bytes with a signature, 2 documents, 3 words."""
    df = np.zeros(1 << TERM_BITS, np.int64)
    docs = total = 0
    for batch in batches:
        buf, off = vec.text_buffer(batch.column(0))
        for a, b in vec.blocks(off, BLOCK_BYTES):
            part = buf[off[a] : off[b]]
            ws, we, first = vec.words(part, off[a : b + 1] - off[a])
            h = vec.word_hashes(part, ws, we)
            row = vec.row_of_word(first)
            # np.unique hashes before it sorts, at eight times the time
            both = np.sort(row << TERM_BITS | (h >> np.uint64(64 - TERM_BITS)).astype(np.int64))
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            df += np.bincount(both & ((1 << TERM_BITS) - 1), minlength=len(df))
            docs, total = docs + b - a, total + len(h)
            kind, key = np.ones(b - a, np.int32), np.zeros(b - a, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), _binary(_signature(h, first)), pa.array(np.diff(off[a : b + 1]) + 1)], ["kind", "key", "signature", "n"])
    a = np.flatnonzero(df)
    kind = np.repeat([0, 2, 3], [len(a), 1, 1])
    key, n = np.concatenate([a, [0, 0]]), np.concatenate([df[a], [docs, total]])
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(key.astype(np.int32)), pa.nulls(len(key), pa.binary()), pa.array(n)], ["kind", "key", "signature", "n"])


def _signature(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x SIGNATURE_BYTES: LEVELS smallest word hashes of each row, spread evenly over 16 bits, and the sum of all; 0 without words."""
    out = np.zeros((len(first) - 1, SIGNATURE_BYTES), np.uint8)
    full = np.diff(first) > 0
    if len(h):
        at = first[:-1][full]
        for i, odd in enumerate(_ODD):
            least = vec.mix(np.minimum.reduceat(h * odd, at), 78) >> np.uint64(48)
            out[full, 2 * i : 2 * i + 2] = least.astype(">u2").view(np.uint8).reshape(-1, 2)
        out[full, 2 * LEVELS :] = vec.mix(np.add.reduceat(h, at), 79).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _cuts(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first signature, first shard, number of shards) of runs of signatures, in order.

    A run has at most 2 * SHARD_BYTES; a signature over SHARD_BYTES is a run of its own, in parts if
    it is over twice that.  The driver gets a row per run.
    """
    heavy = F.col("n") > SHARD_BYTES
    runs = global_cumsum(sizes, [F.col("signature")], {"stop": F.col("n"), "heavies": heavy.cast("long")})
    cell = F.floor((F.col("stop") - F.col("n")) / SHARD_BYTES)
    runs = runs.groupBy(cell.alias("cell"), "heavies", heavy.alias("heavy")).agg(F.min("signature").alias("signature"), F.max("n").alias("n"))
    rows = sorted((bytes(r["signature"]), max(-(-r["n"] // (2 * SHARD_BYTES)), 1) if r["heavy"] else 1) for r in runs.collect())
    parts = np.array([n for _, n in rows], np.int64)
    return np.array([s for s, _ in rows], f"S{SIGNATURE_BYTES}"), np.cumsum(parts) - parts, parts


class Spread:
    """Hashes that deal the texts of one signature: of the id; for null ids and further copies of an (id, text) also of a number.

    Copies are numbered within a task and the task's number is hashed in, so copies in other tasks go elsewhere.  Equal
    rows are interchangeable, so a task that runs again in another order deals the same rows.
    """

    def __init__(self, task: int) -> None:
        self.task, self.met = task, {}

    def __call__(self, key: int | None, text: bytes) -> int:
        digest = xxhash.xxh3_128_digest(text)
        copy = self.met.get((key, digest), 0)
        self.met[key, digest] = copy + 1
        if key is not None and not copy:
            return int(vec.mix(np.array([key], np.int64).view(np.uint64))[0])
        return xxhash.xxh3_64_intdigest(f"{key}|{self.task}|{copy}|".encode() + digest)


def _deal(shared):
    """Adds the shard: the run that the signature lies in, and a part of it (Spread) if it has several."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, base, parts = shared.value
        spread = Spread(TaskContext.get().partitionId())
        for batch in batches:
            buf, off = vec.text_buffer(batch.column(1))
            at = np.zeros(batch.num_rows, np.int64)
            for a, b in vec.blocks(off, BLOCK_BYTES):
                part = buf[off[a] : off[b]]
                ws, we, first = vec.words(part, off[a : b + 1] - off[a])
                own = _signature(vec.word_hashes(part, ws, we), first).view(f"S{SIGNATURE_BYTES}").ravel()
                at[a:b] = np.searchsorted(begin, own, "right") - 1
            shard = base[at]
            for i in np.flatnonzero(parts[at] > 1).tolist():
                shard[i] += spread(batch.column(0)[i].as_py(), buf[off[i] : off[i + 1]].tobytes()) % int(parts[at[i]])
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1)], ["shard", "id", "text"])

    return run


class Index:
    """BM25 over the texts of a shard, with the collection's statistics."""

    def __init__(self, texts: list[str], df: np.ndarray, docs: int, words: int) -> None:
        row, h = _terms(texts)
        self.n = len(texts)
        # (term, row) in one number: 44 bits of the hash and 20 of the row
        bits = max(20, self.n.bit_length())
        low = np.uint64((1 << bits) - 1)
        both = np.sort((h & ~low) | row.astype(np.uint64))
        once = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        tf = np.diff(np.append(once, len(both)))
        both = both[once]
        self.row, held_hash = (both & low).astype(np.int64), both & ~low
        new = np.append(True, held_hash[1:] != held_hash[:-1]) if len(both) else np.zeros(0, bool)
        term = np.cumsum(new) - 1
        self.begin = np.append(np.flatnonzero(new), len(both))
        vocabulary, held = held_hash[new], np.diff(self.begin)
        seen = np.maximum(df[(vocabulary >> np.uint64(64 - TERM_BITS)).astype(np.int64)], held)
        idf = np.log1p((docs - seen + 0.5) / (seen + 0.5))
        length = np.bincount(row, minlength=self.n)
        norm = K1 * (1 - B + B * length / max(words / max(docs, 1), 1e-9))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.row])
        # a text's query: its weightiest terms that another text of the shard holds too
        useful = np.flatnonzero(held[term] > 1)
        # by row, then falling weight, then term
        top = self.weight.max(initial=0.0) * 1.001 + 1e-9
        order = useful[np.argsort(self.row[useful] - self.weight[useful] / top, kind="stable")]
        self.terms = term[order]
        self.first = np.searchsorted(self.row[order], np.arange(self.n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused rows with a positive score, best first, ties to the smaller row."""
        query = self.terms[self.first[seed] : min(self.first[seed + 1], self.first[seed] + QUERY_TERMS)]
        if not len(query):
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(self.begin[t], self.begin[t + 1]) for t in query])
        score = np.bincount(self.row[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(sizes: list[int], index: Index, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of all pieces."""
    unused, left = np.ones(len(sizes), bool), 0
    out, sequence, filled = [], 0, 0
    queue: list[int] = []
    seed = None

    def put(row: int, start: int) -> int | None:
        """Place ids from start on; returns the place where the window ended, or None if all went in."""
        nonlocal filled, sequence
        n = min(sizes[row] - start, width - filled)
        out.append((row, start, n, sequence, filled))
        filled += n
        if filled == width:
            sequence, filled = sequence + 1, 0
            return start + n if start + n < sizes[row] else None
        return None

    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            row = queue.pop()
        else:
            while left < len(sizes) and not unused[left]:
                left += 1
            if left == len(sizes):
                break
            row, seed = left, None
        unused[row] = False
        rest: int | None = 0
        while rest is not None:
            rest = put(row, rest)
        if filled and (seed is None or out[-1][4] == 0):
            # the window begins with this document: its neighbours come next
            seed = row
            queue = index.neighbours(row, unused)[::-1].tolist()
        elif not filled:
            seed, queue = None, []
    return _tail(out, sequence, filled)


def _tail(out: list, sequence: int, filled: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the last, partial window into sequences whose lengths are powers of two."""
    if not filled:
        return out
    cuts = [1 << b for b in reversed(range(filled.bit_length())) if filled >> b & 1]
    edges = [0, *np.cumsum(cuts).tolist()]
    done = [x for x in out if x[3] != sequence]
    for row, start, n, s, at in (x for x in out if x[3] == sequence):
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            a, b = max(at, lo), min(at + n, hi)
            if a < b:
                done.append((row, start + a - at, b - a, sequence + i, a - lo))
    return done


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(shared, args: tuple, with_ids: bool):
    def solve(shard: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        df, docs, words = shared.value
        found = tokens(*args)(texts)
        pieces = pack_shard([len(x) for x in found], Index(texts, df, docs, words))
        cut = [found[r][s : s + n].astype("<u4").tobytes() for r, s, n, _, _ in pieces]
        cols = [[ids[r] for r, *_ in pieces], [x[1] for x in pieces], [x[2] for x in pieces], [zlib.crc32(c) for c in cut], [len(found[x[0]]) for x in pieces], [(shard << 32) + x[3] for x in pieces], [x[4] for x in pieces]]
        arrays = [pa.array(c, pa.int64()) for c in cols]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(cut, pa.binary())] * with_ids, _NAMES + ["ids"] * with_ids)

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts = None, [], []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(of)) if len(of) else []):
                if of[a] != shard:
                    if ids:
                        yield solve(shard, ids, texts)
                        vec.give_back()
                    shard, ids, texts = int(of[a]), [], []
                ids += batch.column(1).slice(a, b - a).to_pylist()
                texts += [t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]
        if ids:
            yield solve(shard, ids, texts)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids (little-endian 32-bit)]: a row per piece.

    A null or empty text is the end id alone.  Null ids stay null and sort last; rows that share an id
    are documents of their own.  Ties go to the smaller id.  An empty table gives an empty result;
    extra columns are not read.  The files must exist on every machine.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    df = np.zeros(1 << TERM_BITS, np.int64)
    counts = materialize(src.select("text").mapInArrow(_statistics, "kind int, key int, signature binary, n long").groupBy("kind", "key", "signature").agg(F.sum("n").alias("n")))
    found = counts.filter("kind <> 1").select("kind", "key", "n").toArrow()
    kind, key, n = (found.column(c).to_numpy() for c in range(3))
    df[key[kind == 0]] = n[kind == 0]
    totals = [int(n[kind == k].sum()) for k in (2, 3)]
    shards = _cuts(counts.filter("kind = 1").select("signature", "n"))
    dealt = src.mapInArrow(_deal(spark.sparkContext.broadcast(shards)), "shard long, id long, text string")
    dealt = dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard", F.asc_nulls_last("id"), "text")
    schema = ", ".join(f"{x} long" for x in _NAMES) + ", ids binary" * with_ids
    return dealt.mapInArrow(_pack(spark.sparkContext.broadcast((df, *totals)), (tokenizer_path, ranks_path, pattern, end_id), with_ids), schema)
