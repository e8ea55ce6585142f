"""SimHash near-dedup with bit-sliced comparison.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lowered; shingles are ``shingle`` words joined by one
space, repeats included (fewer words: the whole sequence).  A fingerprint bit is set if it is set in
over half of the shingles' XXH64 values (seed 42); a text without words has fingerprint zero.

Search.  Only distinct fingerprints are compared.  64 bits are cut in 6 blocks; two fingerprints at
most 4 bits apart agree in at least two of them, so the 15 pairs of blocks are exact bucket keys.  A
bucket over ``BUCKET`` members is split into parts, and each pair of parts is a bucket of its own.
A task takes many buckets at once: members lie 64 to a word, one word for each bit (bit planes), and
carry-save counters add up 64 distances by bitwise operations; every 8 planes the words whose lanes
all exceed the radius are abandoned.  Each bucket gives a spanning forest of its links, never all
pairs.  Components come from rounds of star contraction, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_steps, materialize, small_or_shuffled, steps_so_far

RADIUS = 4
#: (first bit, bits) of the six blocks
_BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: members of a bucket before it is split
BUCKET = 1024
#: edges of a node before they are dealt over several tasks
HOT = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    ws = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not ws:
        return 0
    norm = memoryview(b" ".join(ws))
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    start = np.cumsum(size) - size
    k = min(shingle, len(ws))
    ends = (start + size - 1)[k - 1 :]
    counts, n, digest = np.zeros(64, np.int64), len(ends), xxhash.xxh64_digest
    for at in range(0, n, 1 << 15):
        part = b"".join([digest(norm[a:b], 42) for a, b in zip(start[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist())])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def close_pairs(fps: np.ndarray, group: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers at most ``radius`` bits apart in one group.

    Rows are sorted by group.  A group with rows on the right is compared left against right; other
    groups within themselves, each pair once.
    """
    none = np.zeros(0, np.int64)
    if not len(fps):
        return none, none
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, len(group)))
    gid = np.repeat(np.arange(len(begin)), size)
    two = np.add.reduceat(right.astype(np.int64), begin) > 0
    cand = np.flatnonzero(right | ~two[gid])
    held = np.bincount(gid[cand], minlength=len(begin))  # candidates of a group
    nth = np.arange(len(cand)) - np.repeat(np.cumsum(held) - held, held)
    n_words = (held + 63) // 64
    first_word = np.cumsum(n_words) - n_words
    total = int(n_words.sum())
    lane_row = np.full(total * 64, -1, np.int64)
    lane_row[first_word[gid[cand]] * 64 + nth] = cand
    lanes = np.where(lane_row >= 0, fps[lane_row], np.uint64(0)).reshape(total, 64)
    pack = lambda bits: np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    empty = pack((lane_row < 0).reshape(total, 64))
    query = np.flatnonzero(~right | ~two[gid])
    q = np.repeat(query, n_words[gid[query]])
    w = np.arange(len(q)) - np.repeat(np.cumsum(n_words[gid[query]]) - n_words[gid[query]], n_words[gid[query]])
    own = q - begin[gid[q]] - 64 * w  # lanes up to the query's own place are no partners inside a group
    shut = np.where(own >= 63, _ALL, np.where(own < 0, np.uint64(0), (np.uint64(2) << np.clip(own, 0, 62).astype(np.uint64)) - np.uint64(1)))
    w = w + first_word[gid[q]]
    dead = empty[w] | np.where(two[gid[q]], np.uint64(0), shut)
    bits = (radius + 1).bit_length()
    count = [np.zeros(len(q), np.uint64) for _ in range(bits)]
    for b in range(64):
        if b % 8 == 0:
            live = dead != _ALL  # abandon words whose lanes all exceed the radius
            if not live.all():
                q, w, dead, count = q[live], w[live], dead[live], [c[live] for c in count]
            if not len(q):
                return none, none
        plane = pack(((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
        carry = plane[w] ^ np.where((fps[q] >> np.uint64(b)) & np.uint64(1), _ALL, np.uint64(0))
        full = _ALL
        for i in range(bits):
            count[i], carry = count[i] ^ carry, count[i] & carry
            full = full & (count[i] if (radius + 1) >> i & 1 else ~count[i])
        dead = dead | full
    live = dead != _ALL
    q, w, dead = q[live], w[live], dead[live]
    hit, lane = np.nonzero(np.unpackbits((~dead).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return q[hit], lane_row[w[hit] * 64 + lane]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _links(radius: int):
    def solve(fp: np.ndarray, group: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        a, b = close_pairs(fp.view(np.uint64), group, right, radius)
        label = forest(len(fp), a, b)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[at], fp[label[at]])), pa.array(np.minimum(fp[at], fp[label[at]]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            key, lo, hi, fp = (batch.column(c).to_numpy() for c in range(4))
            right = batch.column(4).to_numpy(zero_copy_only=False)
            rows = [key, lo, hi, fp, right]
            if held:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            group = np.cumsum(new)
            held = [x[last:] for x in rows]
            if last:
                yield solve(rows[3][:last], group[:last], rows[4][:last])
        if held:
            yield solve(held[3], np.zeros(len(held[3]), np.int64), held[4])

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u > v: a spanning forest, bucket by bucket, of the links between distinct fingerprints (column fp)."""
    if radius > 4:
        raise ValueError("six blocks find at most 4 differing bits")
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in _BLOCKS]
    keys = [F.lit(i << 24) + part[x] * 2048 + part[y] for i, (x, y) in enumerate(combinations(range(6), 2))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    # only buckets to be split need their size; there are few, or else the join shuffles
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts")))
    rows = rows.join(small_or_shuffled(large, large.count()), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", (F.col("mine") > F.col("other")).alias("right"))
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").mapInArrow(_links(radius), "u long, v long").distinct()


def _with_least(edges: DataFrame, key: str, least: DataFrame, how: str) -> DataFrame:
    """edges with m of least (node, m) where node is edges' key.

    A key with more than HOT edges, or more than a 10,000th of them all, is dealt over several tasks, which get a copy of its m each;
    there are at most 10,000 such keys, so they are known everywhere.
    """
    n = edges.count()
    most = max(HOT, n // 10_000)
    hot = F.broadcast(edges.groupBy(F.col(key).alias("h")).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = edges.join(hot, F.col(key) == F.col("h"), "left").select("u", "v", F.pmod(F.xxhash64("u", "v"), parts).cast("int").alias("part"))
    copies = least.join(hot, F.col("node") == F.col("h"), "left").select("node", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of"))
    return dealt.join(copies, (F.col(key) == F.col("node")) & (F.col("part") == F.col("of")), how).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of the edges u > v.

    A round points each edge at the least node that its smaller end knows, then links the smaller ends of
    a node to its least one.  A root's many edges are never brought together: they have nothing to look up.
    """
    spark = edges.sparkSession
    since = steps_so_far(spark)
    edges = materialize(edges)
    mark = None
    while True:
        until = steps_so_far(spark)
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
        least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = materialize(_with_least(edges, "v", least, "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        ends = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.max("v").alias("x"))
        # only nodes with several smaller ends have something to link
        small = _with_least(large, "u", ends.filter("x > m").select("node", "m"), "inner").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(ends.select(F.col("node").alias("u"), F.col("m").alias("v")).unionByName(small).distinct())
        drop_steps(spark, since, until)
        since = until
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included): a row per input row.

    Null and empty texts have fingerprint 0 and link like any other.  A row with a null id gets a
    fingerprint and takes the smallest id of its component (null if there is none).  Repeated rows
    stay.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), radius))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = 4) -> DataFrame:
    """Rows of documents, the one with the smallest doc_id of each component; all columns stay.

    Of repeated rows with that id one stays.  A component without any non-null id keeps all its rows.
    """
    return keep_least(docs, near_duplicates(docs, radius, shingle))


def keep_least(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of documents without those that groups (doc_id, component_id) give another smallest id; see keep_one."""
    found = materialize(groups.select("doc_id", "component_id"))
    gone = found.filter("doc_id is not null and doc_id <> component_id or doc_id is null and component_id is not null").select("doc_id").distinct()
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    again = found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id"]) if again else kept
