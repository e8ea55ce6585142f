"""Near copies by shingles: groups of texts linked by a Jaccard similarity of at least ``LEAST``.

Words and their case are those of SimHash (``simhash``); a text's set holds its runs of ``SHINGLE`` words
(fewer words: the whole sequence), as 64-bit hashes.

1. Texts with the same words are one class.  Each class has its SimHash fingerprint (``simhash.fingerprint`` over
   the same shingles, repeats included); bit-sliced comparison links those at most 4 bits apart.
2. Most sets of similarity 0.8 are further apart than that, so a class also has ``BANDS`` keys of ``ROWS`` MinHashes each;
   sets of similarity s share one with chance 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.8, 0.99999 at 0.85.  The members
   of a key are linked to its smallest one.  The components of both are the candidates.  Only these texts are read again.  A component over ``PART_WORDS`` words is split into parts that meet in pairs.
3. In each pair of parts the sets themselves decide: a search over an inverted index reaches, from each text,
   those not yet reached that have the similarity.  Its links give the components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import materialize, small_or_shuffled
from sparkloom.llm.simhash import _LOWER, components, fingerprint, links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 6
PART_WORDS = 500_000
_FOLD = np.frombuffer(_LOWER, np.uint8)
_ODD = vec.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 10) | np.uint64(1)


def _shingles(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles, first of each row + total) of a block of texts, repeats included."""
    part = _FOLD[part]
    ws, we, first = vec.words(part, off)
    h = vec.word_hashes(part, ws, we)
    size = np.diff(first)
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    begin = np.append(0, np.cumsum(n))
    at = np.repeat(first[:-1] - begin[:-1], n) + np.arange(begin[-1])
    return vec.mix(vec.run_sums(h, at, at + np.repeat(np.minimum(size, SHINGLE), n)), 11), begin


def _bands(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """rows x BANDS keys; 0 without words."""
    out = np.zeros((len(begin) - 1, BANDS), np.uint64)
    full = np.diff(begin) > 0
    if len(hashes):
        at, mine = begin[:-1][full], out[full]
        for i, odd in enumerate(_ODD):
            mine[:, i // ROWS] = vec.mix(mine[:, i // ROWS] + vec.mix(np.minimum.reduceat(hashes * odd, at), 12), i)
        out[full] = mine
    return out


def digest(text: str | None) -> bytes:
    """Of the words: equal for texts that differ only in case and gaps."""
    return hashlib.md5(b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split()), usedforsecurity=False).digest()


@vec.lean
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = vec.text_buffer(batch.column(1))
        bands, size = [np.zeros((0, BANDS), np.uint64)], [np.zeros(0, np.int64)]
        for a, b in vec.blocks(off):
            hashes, begin = _shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            bands.append(_bands(hashes, begin))
            size.append(np.diff(begin))
        keys = np.concatenate(bands).view(np.int64).ravel()
        keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(BANDS)), pa.array(keys))
        marks = pa.array([digest(t.as_py()) for t in batch.column(1)], pa.binary())
        prints = pa.array([fingerprint(t.as_py(), SHINGLE) for t in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), marks, pa.array(np.concatenate(size)), keys, prints], ["doc_id", "mark", "n", "bands", "fp"])


@vec.lean
def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([digest(t.as_py()) for t in batch.column(0)], pa.binary()), batch.column(0)], ["mark", "text"])


def reach(sets: list[np.ndarray], least: float = LEAST) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets (sorted, distinct) whose Jaccard similarity is at least ``least``."""
    size = np.array([len(s) for s in sets], np.int64)
    row, value = np.repeat(np.arange(len(sets)), size), np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    held, stop = value[begin], np.append(begin[1:], len(value))
    open_, us, vs = np.ones(len(sets), bool), [], []
    for seed in range(len(sets)):
        queue = [seed] if open_[seed] else []
        open_[seed] = False
        while queue:
            x = queue.pop()
            if not open_.any():
                break
            at = np.searchsorted(held, sets[x])
            several = at[stop[at] - begin[at] > 1]
            if not len(several):
                continue
            both = np.bincount(np.concatenate([row[begin[i] : stop[i]] for i in several]), minlength=len(sets))
            new = np.flatnonzero(open_ & (both > 0) & (both >= least * (size + size[x] - both) - 1e-9))
            open_[new] = False
            queue += new.tolist()
            us += [x] * len(new)
            vs += new.tolist()
    return us, vs


@vec.lean
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of the links of each (root, lo, hi); rows are sorted by these."""

    def solve(nodes: list, texts: list) -> pa.RecordBatch:
        buf, off = vec.text_buffer(pa.array(texts, pa.string()))
        sets = []
        for a, b in vec.blocks(off):
            hashes, begin = _shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            sets += [np.unique(hashes[x:y]) for x, y in zip(begin, begin[1:])]
        node = np.array(nodes, np.int64)
        us, vs = reach(sets)
        u, v = node[np.array(us, np.int64)], node[np.array(vs, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    now, nodes, texts = None, [], []
    for batch in batches:
        for root, lo, hi, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (root, lo, hi) != now:
                if len(nodes) > 1:
                    yield solve(nodes, texts)
                now, nodes, texts = (root, lo, hi), [], []
            nodes.append(node)
            texts.append(text)
    if len(nodes) > 1:
        yield solve(nodes, texts)


def _linked(classes: DataFrame) -> DataFrame:
    """u > v: links between classes (node, n, bands, fp) that are candidates, by fingerprints or by keys; a text without words has none."""
    worded = classes.filter("n > 0")
    prints = materialize(worded.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("c")))
    several = prints.filter("c > 1").select("fp", "least")
    same = worded.select("node", "fp").join(small_or_shuffled(several, several.count()), "fp").filter("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    end = lambda fp, node: prints.select(F.col("fp").alias(fp), F.col("least").alias(node))
    near = links(prints.select("fp")).join(end("u", "a"), "u").join(end("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    keys = worded.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("node").alias("v"), F.count("*").alias("c")).filter("c > 1")
    met = keys.join(shared, ["band", "key"]).filter("node > v").select(F.col("node").alias("u"), "v")
    return same.unionByName(near).unionByName(met).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id of the group, itself included): a row per input row.

    Texts without words are copies of each other.  A row with a null id takes the smallest id of its
    group (null if there is none).  Repeated rows stay.  An empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(src.mapInArrow(_sketch, "doc_id long, mark binary, n long, bands array<long>, fp long"))
    classes = rows.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    found = materialize(components(_linked(classes)))
    member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "mark", "n"), "node")
    parts = member.groupBy("root").agg(F.ceil(F.sum("n") / PART_WORDS).cast("int").alias("parts"))
    member = materialize(member.join(parts, "root").select("root", "node", "mark", "parts"))
    texts = src.select("text").mapInArrow(_marked, "mark binary, text string").join(member, "mark")
    texts = texts.groupBy("root", "node", "parts").agg(F.first("text").alias("text"))
    texts = texts.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    texts = texts.select("root", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "text")
    links = texts.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node").mapInArrow(_verify, "u long, v long").distinct()
    root = components(links).withColumnRenamed("node", "of")
    classes = classes.join(root, classes["node"] == root["of"], "left").select("mark", F.coalesce("root", "node").alias("root"), "least")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "mark").join(classes.join(named, "root").select("mark", "component_id"), "mark").select("doc_id", "component_id")
