"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ``ORDER``, with every context and symbol that its
training rows hold; places before a text's first byte count as a symbol of their own in contexts.  Frozen
counts become probabilities by method C with exclusion: a symbol seen n_s times after a context has
n_s / (n + q), q distinct symbols; the escape's q / (n + q) goes to the shorter context's distribution
over the symbols not seen; below order 0 all bytes are alike.  The code length of a text is the exact sum of
-log2 p of each byte after its longest context.

A tree is kept sparsely: for each order the sorted keys (context, symbol) with their costs, and the sorted contexts with
the cost of their escape.  A block of texts is scored by its distinct runs of ``ORDER`` + 1 bytes, each looked up once for each language.

Training takes at most ``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` of each language (in expectation; chosen by a hash of row and
text, whole texts).  That bounds the trees, whatever the corpus: no context of those rows is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import materialize, small_or_shuffled

ORDER = 4
TRAIN_ROWS, TRAIN_BYTES = 2000, 16 << 20
#: languages of one model; more than that is no language column
LANGUAGES = 1000
UNDETERMINED = "und"
#: bits of a symbol in a key, and the symbol before a text's first byte
_BITS, _START = 9, 256


def grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A key for each byte: the byte in the lowest bits, above it the ``ORDER`` before it, the nearest lowest."""
    since = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    key = buf.astype(np.int64)
    for d in range(1, ORDER + 1):
        prev = np.full(len(buf), _START, np.int64)
        prev[d:] = buf[:-d]
        prev[since < d] = _START
        key |= prev << (_BITS * d)
    return key


@vec.lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of (lang, text), block by block."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        of, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
        buf, off = vec.text_buffer(batch.column(1))
        for lo, hi in vec.blocks(off):
            key = grams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            key |= np.repeat(of[lo:hi], np.diff(off[lo : hi + 1])) << (_BITS * (ORDER + 1))
            key, n = np.unique(key, return_counts=True)
            lang = names.take(pa.array(key >> (_BITS * (ORDER + 1))))
            yield pa.RecordBatch.from_arrays([lang, pa.array(key & ((1 << (_BITS * (ORDER + 1))) - 1)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of keys in a sorted table."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


class Tree:
    """Frozen statistics of one language: for each order sorted keys and costs, sorted contexts and escape costs, in bits."""

    def __init__(self, key: np.ndarray, n: np.ndarray) -> None:
        """key: distinct grams, n: how often each was seen."""
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        below: np.ndarray | None = None
        for k in range(ORDER + 1):
            entry, to = np.unique(key & ((1 << (_BITS * (k + 1))) - 1), return_inverse=True)
            count = np.bincount(to, n, len(entry))
            ctx, of = np.unique(entry >> _BITS, return_inverse=True)
            total, kinds = np.bincount(of, count, len(ctx)), np.bincount(of, minlength=len(ctx))
            # what the shorter context leaves for the symbols not seen here
            low = np.full(len(entry), 1 / 256) if below is None else below[_find(self.seen[-1][0], entry & ((1 << (_BITS * k)) - 1))[0]]
            rest = 1 - np.bincount(of, low, len(ctx))
            whole = total + np.where(kinds < 256, kinds, 0)
            p = count / whole[of]
            self.seen.append((entry, -np.log2(p).astype(np.float32)))
            self.escape.append((ctx, -np.log2(np.where(kinds < 256, kinds / whole / np.maximum(rest, 1e-12), 1)).astype(np.float32)))
            below = p

    def costs(self, key: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the others."""
        out, open_ = np.zeros(len(key), np.float32), np.arange(len(key))
        for k in range(ORDER, -1, -1):
            mine = key[open_] & ((1 << (_BITS * (k + 1))) - 1)
            at, hit = _find(self.seen[k][0], mine)
            out[open_[hit]] += self.seen[k][1][at[hit]]
            open_, mine = open_[~hit], mine[~hit]
            at, known = _find(self.escape[k][0], mine >> _BITS)
            out[open_[known]] += self.escape[k][1][at[known]]
        out[open_] += 8
        return out


class Model:
    def __init__(self, trees: dict[str, Tree]) -> None:
        self.langs, self.trees = sorted(trees), [trees[x] for x in sorted(trees)]

    def bits(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each row (rows x languages)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        full = np.diff(off) > 0
        if full.any():
            met = pa.array(grams(buf, off)).dictionary_encode()
            key, at = met.dictionary.to_numpy(), met.indices.to_numpy()
            for j, tree in enumerate(self.trees):
                out[full, j] = np.add.reduceat(tree.costs(key)[at], off[:-1][full], dtype=np.float64)
        return out


def _grow(rows: pd.DataFrame) -> pd.DataFrame:
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(key)
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "keys": [key[order].tobytes()], "counts": [n[order].tobytes()]})


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", rows: int = TRAIN_ROWS, key: str | None = None) -> Model | None:
    """A model from rows with language and text; None if there are none.

    key: a column that tells rows with one text apart in the choice of training rows.
    """
    src = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.col(key).cast("string") if key else F.lit("")).alias("key")).filter("lang is not null and text is not null")
    sizes = materialize(src.groupBy("lang").agg(F.least(rows / F.count("*"), TRAIN_BYTES / F.greatest(F.sum(F.octet_length("text")), F.lit(1))).alias("share")))
    kinds = sizes.count()
    if kinds > LANGUAGES:
        raise ValueError(f"{kinds} different values of {lang_col}: no language column")
    u = F.pmod(F.xxhash64("text", "key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = src.join(small_or_shuffled(sizes, kinds, 64), "lang").filter(u < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    grown = counts.groupBy("lang").applyInPandas(_grow, "lang string, keys binary, counts binary").collect()
    trees = {r["lang"]: Tree(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)) for r in grown}
    return Model(trees) if trees else None


def _score(shared):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            spoken = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            buf, off = vec.text_buffer(batch.column(1))
            pred, score = [], []
            for a, b in vec.blocks(off):
                bits = model.bits(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                for i in range(b - a):
                    ok = spoken[a + i]
                    pred.append(model.langs[best[i]] if ok else UNDETERMINED)
                    score.append(float(1 / odds[i]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per input row.

    The model learns from rows that are not held out and have an id, a language and a text.  A text that is null
    or has no letter is ``und`` with score 0, and so is every text when nothing can be learned.  Score
    is the share of the best language's probability among all languages; ties go to the name that
    sorts first.  Repeated rows and extra columns change nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("spoken"), held_out(F.col(id_col)).alias("held_out"))
    model = train(docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), lang_col, text_col, key=id_col)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of docs with a language predicted at ``least`` or more; all columns stay, lang too."""
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), key="doc_id")
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = vec.text_buffer(batch.column(batch.schema.get_field_index("text")))
            fine = np.zeros(batch.num_rows, bool)
            for a, b in vec.blocks(off):
                bits = shared.value.bits(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                fine[a:b] = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1) >= least
            yield batch.filter(pa.array(fine))

    return docs.filter(F.col("text").rlike("\\p{L}")).mapInArrow(run, docs.schema)
