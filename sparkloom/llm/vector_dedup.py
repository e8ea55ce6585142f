"""Near copies among vectors of one label, by randomised-rotation binary codes.

Codes.  A vector of length 1 is rotated at random and its signs are kept, a bit for each dimension, with
its correction factor f, the inner product of the rotated vector and its signs over sqrt(d).  With a, the
product of another rotated vector and those signs over sqrt(d), a / f estimates the cosine without bias.

Bounds.  The other vector's angle to the signs is at most the vector's own, arccos f, more than the angle
between the two: this holds for certain.  The estimate's error is above ``SIGMAS / sqrt(d - 1)`` times
sqrt(1 - f^2) / f with a chance under 2 exp(-SIGMAS^2 / 2); that is the tighter bound in many dimensions.
Both are a least a for each coded vector, so a pair is decided by one comparison: below it no link is
possible; else the cosine is computed again from the given vectors, in doubles, and decides alone.

Pairs.  Equal vectors of a label are one class.  A class lies in the cell of its nearest centroid (of a
bounded sample; they only route) and visits the cells of higher number that its angle to their centroid
cannot exclude, given their radius.  Cells are split in parts of about ``PART`` classes; members of a part
stay in one task, those of the part's later parts and the visitors stream past.  A task gives link
counts for each class and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.ann import _kmeans, _vectors, usable
from sparkloom.llm.common import materialize, small_or_shuffled
from sparkloom.llm.simhash import components, forest

LEAST = 0.93
PART, CHUNK, SAMPLE, MOST_CELLS = 4096, 1024, 8192, 1024
SIGMAS = 8.0
#: what float sums may be off
_SLACK = 1e-4


def rotation(d: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal d x d matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles, times a power of two each so that no product overflows; their lengths)."""
    v = v.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
    return v, np.sqrt((v * v).sum(1))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs, correction factors) of vectors of length 1."""
    z = unit @ turn
    return np.packbits(z >= 0, axis=1), np.abs(z).sum(1) / math.sqrt(z.shape[1])


def least_products(factor: np.ndarray, d: int, least: float, sigmas: float = SIGMAS) -> np.ndarray:
    """Of each code, the product of another rotated vector with it below which their cosine is under ``least``."""
    f = np.clip(factor, 1e-9, 1.0)
    certain = np.cos(np.minimum(np.arccos(f) + math.acos(least), math.pi))
    likely = f * least - np.sqrt(1 - f * f) * sigmas / math.sqrt(max(d - 1, 1))
    return np.maximum(certain, likely) - _SLACK


class Part:
    """The members of one part; what has been linked so far."""

    def __init__(self, node: np.ndarray, weight: np.ndarray, v: np.ndarray, codes: np.ndarray, factor: np.ndarray, least: float) -> None:
        self.node, self.weight, self.least = node, weight, least
        self.v, self.size = scaled(v)
        d = v.shape[1]
        self.turn = rotation(d)
        self.z = ((self.v / self.size[:, None]) @ self.turn).astype(np.float32)
        self.signs = ((np.unpackbits(codes, axis=1, count=d) * np.float32(2) - np.float32(1)) / np.float32(math.sqrt(d))).astype(np.float32)
        self.floor = least_products(factor, d, least).astype(np.float32)[:, None]
        self.label, self.count = np.arange(len(node)), np.zeros(len(node), np.int64)
        self.exact = 0

    def _links(self, v: np.ndarray, size: np.ndarray, z: np.ndarray, from_row: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(member, other) of the pairs over the least cosine; with from_row, others are the members from there on, each pair once."""
        may = self.signs @ z.T >= self.floor
        if from_row is not None:
            may &= np.arange(len(self.node))[:, None] < from_row + np.arange(len(z))
        if np.count_nonzero(may) * 16 > may.size:
            self.exact += may.size
            return np.nonzero(may & (self.v @ v.T / (self.size[:, None] * size) >= self.least))
        i, j = np.nonzero(may)
        self.exact += len(i)
        ok = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 15):
            x, y = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            ok[a : a + (1 << 15)] = np.einsum("pd,pd->p", self.v[x], v[y]) / (self.size[x] * size[y]) >= self.least
        return i[ok], j[ok]

    def _join(self, i: np.ndarray, j: np.ndarray, others: int) -> np.ndarray:
        n = len(self.node)
        known = np.flatnonzero(self.label != np.arange(n))
        label = forest(n + others, np.concatenate([i, known]), np.concatenate([j, self.label[known]]))
        self.label = label[:n]
        return label[n:]

    def meet_itself(self) -> None:
        for a in range(0, len(self.node), CHUNK):
            of = slice(a, a + CHUNK)
            i, j = self._links(self.v[of], self.size[of], self.z[of], a)
            j = j + a
            self.count += np.bincount(i, self.weight[j], len(self.node)).astype(np.int64) + np.bincount(j, self.weight[i], len(self.node)).astype(np.int64)
            self._join(i, j, 0)

    def meet(self, node: np.ndarray, weight: np.ndarray, v: np.ndarray, *_: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Link counts and an edge for each of the given classes that has links."""
        v, size = scaled(v)
        i, j = self._links(v, size, ((v / size[:, None]) @ self.turn).astype(np.float32))
        self.count += np.bincount(i, weight[j], len(self.node)).astype(np.int64)
        count = np.bincount(j, self.weight[i], len(node)).astype(np.int64)
        label = self._join(i, j + len(self.node), len(node))
        at = np.flatnonzero(count)
        return [(node[at], self.node[label[at]], count[at])]

    def rows(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.flatnonzero(self.count)
        return [(self.node[at], self.node[self.label[at]], self.count[at])]


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds code and factor to (node, label, least, weight, v), whose vectors may differ in length."""
    for batch in batches:
        d = np.diff(batch.column(4).offsets.to_numpy())
        code, factor = [b""] * len(d), np.zeros(len(d))
        for n in np.unique(d):
            at = np.flatnonzero(d == n)
            v, size = scaled(_vectors(batch.column(4).take(pa.array(at)), len(at)))
            codes, factor[at] = encode(v / size[:, None], rotation(int(n)))
            for i, c in zip(at.tolist(), codes):
                code[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor)], [*batch.schema.names, "code", "factor"])


def _batch(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v, n = (np.concatenate(x) for x in zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])


def _link_rows(least: float):
    """(class, one it is linked with or itself, link count) from (area, part, late, node, weight, v, code, factor), sorted by part, members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for batch in batches:
            group, extra = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            streams = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (extra[1:] != extra[:-1]) | (streams[1:] != streams[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(group))):
                if (group[a], extra[a]) != key:
                    if part is None and held:
                        part = _made(held, least)
                    if part is not None:
                        yield _batch(part.rows())
                    key, held, part = (group[a], extra[a]), [], None
                rows = batch.slice(a, b - a)
                if not streams[a]:
                    held.append(rows)
                    continue
                if part is None and held:
                    part = _made(held, least)
                for at in range(0, rows.num_rows, CHUNK) if part is not None else ():
                    yield _batch(part.meet(*_columns(rows.slice(at, CHUNK))))
        if part is None and held:
            part = _made(held, least)
        if part is not None:
            yield _batch(part.rows())

    return run


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return rows.column(3).to_numpy(), rows.column(4).to_numpy(), _vectors(rows.column(5), rows.num_rows), codes, rows.column(7).to_numpy()


def _made(held: list[pa.RecordBatch], least: float) -> Part:
    cols = [_columns(x) for x in held]
    part = Part(*(np.concatenate(x) for x in zip(*cols)), least)
    part.meet_itself()
    return part


def _route_rows(shared, least: float):
    """(node, cell, angle to its centroid), or with radii (node, visited cells of higher number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                v, size = scaled(_vectors(part.column(1), part.num_rows))
                angle = np.arccos(np.clip((v / size[:, None]) @ centres.T, -1, 1))
                cell = angle.argmin(1)
                if radii is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell.astype(np.int32)), pa.array(angle.min(1))], ["node", "cell", "angle"])
                else:
                    visits = (angle <= radii + math.acos(least) + _SLACK) & (np.arange(len(centres)) > cell[:, None])
                    row, to = np.nonzero(visits)
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(to.astype(np.int32))], ["node", "cell"])

    return run


def _cells(classes: DataFrame, d: int, most: int, least: float) -> DataFrame:
    """node, cell, streams: where a class stays, and where it only visits."""
    spark = classes.sparkSession
    cells = min(most // PART + 1, MOST_CELLS)
    stays = classes.select("node", F.lit(0).alias("cell"), F.lit(False).alias("streams"))
    if cells == 1:
        return stays
    sample = np.array([r[0] for r in classes.filter(F.size("v") == d).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").collect()], np.float64)
    unit = scaled(sample)[0]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centres = _kmeans(unit, min(cells, len(unit)), np.random.default_rng(3))
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.where(size > 1e-12, centres / np.maximum(size, 1e-12), unit[0])
    of = classes.filter(F.size("v") == d).select("node", "v")
    found = materialize(of.mapInArrow(_route_rows(spark.sparkContext.broadcast((centres, None)), least), "node long, cell int, angle double"))
    radii = np.full(len(centres), -10.0)
    for r in found.groupBy("cell").agg(F.max("angle").alias("r")).collect():
        radii[r["cell"]] = r["r"]
    visits = of.mapInArrow(_route_rows(spark.sparkContext.broadcast((centres, radii)), least), "node long, cell int")
    return stays.join(classes.filter(F.size("v") != d).select("node"), "node", "left_semi").unionByName(found.select("node", "cell", F.lit(False).alias("streams"))).unionByName(visits.withColumn("streams", F.lit(True)))


def links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """u, v, n: of each class (node, label, weight, v, code, factor) its links, as weights of those it is linked with, task by task, and one of them or itself."""
    groups = classes.groupBy("label", F.size("v").alias("d")).count()
    sizes = groups.groupBy("d").agg(F.sum("count").alias("all"), F.max("count").alias("most")).orderBy(F.desc("all"), "d").first()
    if sizes is None:
        return classes.sparkSession.createDataFrame([], "u long, v long, n long")
    placed = classes.select("node", "label", "weight", "v", "code", "factor").join(_cells(classes, sizes["d"], sizes["most"], least), "node")
    placed = placed.withColumn("d", F.size("v"))
    parts = placed.filter(~F.col("streams")).groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    parts = materialize(parts.withColumn("area", F.monotonically_increasing_id()))
    placed = placed.join(small_or_shuffled(parts, parts.count(), 64), ["label", "d", "cell"])
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    # a member stays in its own part and streams past the earlier ones, a visitor past all
    last = F.when(F.col("streams"), F.col("parts") - 1).otherwise(mine)
    roles = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("part"), (F.col("streams") | (i < mine)).alias("late")))
    work = placed.withColumn("role", F.explode(roles)).select("area", "role.part", F.col("role.late").alias("late"), "node", "weight", "v", "code", "factor")
    met = work.repartition("area", "part").sortWithinPartitions("area", "part", "late", "node")
    return met.mapInArrow(_link_rows(least), "u long, v long, n long")


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable, itself included), kept: one row per input row.

    Rows link if their labels are equal and not null and their cosine is at least ``least``.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths.  Repeated rows are rows of their own and link.  A row with a null id links like any other;
    it takes the smallest id of its component and is kept only if there is none.  An empty table gives an
    empty result.  Other columns are not read.
    """
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    takes_part = F.col("label").isNotNull() & usable(F.col("v"))
    src = rows.filter(takes_part)
    classes = src.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "label", "least", "weight", "v")
    classes = materialize(classes.mapInArrow(_code_rows, f"node long, label string, least long, weight long, v array<{kind}>, code binary, factor double"))
    found = materialize(links(classes, least))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    edges = found.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    linked = classes.select("node", "least", "weight").join(counts, "node", "left").join(components(edges), "node", "left")
    linked = materialize(linked.select("node", "least", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(named, "root").select("node", "n_links", "component_id").join(classes.select("node", "label", "v"), "node").drop("node")
    joined = src.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.coalesce(takes_part, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
