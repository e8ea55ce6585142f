"""Substring dedup with suffix automata over reference shards.

A window is ``min_words`` consecutive words; a word goes if a window that covers it also starts in
a document with a smaller id.  Windows are judged on the input.

1. Anchors.  In each window the run of ``_ANCHOR`` words with the smallest hash is its anchor: equal
   windows have equal anchors, and neighbouring windows mostly share one, so about a fifth of the
   places is shuffled, once.  All places of an anchor that two documents have get one id, its
   *owner*: the smallest that the sorted stream of its places begins with.  Anchors that ``HEAVY``
   documents of every ``PROBE``-th one (by hash) have are found beforehand; they get their owner from
   that list, are spread over all tasks and never meet in one.  The list only spreads work; results
   don't hang on it.  Rows with one id and text are taken once.
2. Segments.  Runs of windows whose anchors have one owner are cut out as texts.  All occurrences of
   a window have the same anchor, hence the same owner: they meet in one reference shard.
3. Reference shards.  Distinct segment texts (a text carries its smallest id) are grouped by owner
   into shards of bounded size.  A task builds a suffix automaton of its shard, each state carrying
   the smallest id that contains its strings, and streams the shard's texts through it: matching
   statistics give at each word the longest match, and the state of its last ``min_words`` words
   tells the first document.  Texts of a shard over the bound (a common passage in many settings) are
   cut finer: by the anchors of ``_FINER`` words inside, a few windows a piece.  Equal windows have equal
   finer anchors too, so they meet once more, in one of many shards.  Should one finer anchor still be over the
   bound, its shard is split in p parts and its texts in p slices, and each slice meets each part.
4. Maximal spans whose first document is smaller than the reader's own are removed.

Shards go to the tasks that need them instead of to all executors, so nothing that grows with the
corpus is broadcast.  Hashes choose candidates only; real words decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.common import LAST_ID, materialize, partitions, small_or_shuffled

MIN_WORDS = 13
#: words of an anchor, and of one that cuts the texts of a shard over the bound
_ANCHOR, _FINER = 5, 9
#: words of distinct reference text in a shard, about, and at most before it is split
SHARD_WORDS, SPLIT_WORDS = 100_000, 400_000
_NONE, _OPEN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: an anchor is heavy if it is found in HEAVY of the documents whose hash PROBE divides
HEAVY, PROBE = 8, 64


class SuffixAutomaton:
    """Of several word sequences; each state knows the smallest id among the texts that hold it."""

    def __init__(self) -> None:
        self.link, self.length, self.next, self.first = [-1], [0], [{}], [_NONE]

    def _state(self, length: int, link: int, edges: dict, first: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, q: int, sym: int) -> int:
        """A copy of q for the strings no longer than those through p."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), _NONE)
        self.link[q] = new
        while p >= 0 and self.next[p].get(sym) == q:
            self.next[p][sym] = new
            p = self.link[p]
        return new

    def add(self, text: list[int], owner: int) -> None:
        link, length, nxt, first = self.link, self.length, self.next, self.first
        last = 0
        for sym in text:
            q = nxt[last].get(sym)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, sym)
                if owner < first[last]:
                    first[last] = owner
                continue
            p, last = last, self._state(length[last] + 1, 0, {}, owner)
            while p >= 0 and sym not in nxt[p]:
                nxt[p][sym] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][sym]
                link[last] = q if length[q] == length[p] + 1 else self._split(p, q, sym)

    def close(self, least: int) -> None:
        """Carry ids down the suffix links; find of each state the one that holds its last ``least`` words."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        link, first, length = self.link, self.first, self.length
        for v in reversed(order):
            u = link[v]
            if u >= 0 and first[v] < first[u]:
                first[u] = first[v]
        self.least = least
        self.tail_first = tail = [_NONE] * len(link)
        for v in order:
            if length[v] >= least:
                tail[v] = first[v] if length[link[v]] < least else tail[link[v]]

    def first_ids(self, text: list[int]) -> list[int]:
        """For each end of a match of ``least`` words or more, the smallest id with the last ``least`` words."""
        link, length, nxt, tail, least = self.link, self.length, self.next, self.tail_first, self.least
        state, size, out = 0, 0, []
        for sym in text:
            to = nxt[state].get(sym)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(sym)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(tail[state] if size >= least else _NONE)
        return out


def _anchors(buf: np.ndarray, off: np.ndarray, n: int, size: int = _ANCHOR):
    """Of a block: word starts, ends, first words, rows of windows, starts of windows, anchor places, gram hashes."""
    ws, we, first = vec.words(buf, off)
    row = vec.row_of_word(first)
    if len(ws) < n:
        none = np.zeros(0, np.int64)
        return ws, we, first, none, none, none, np.zeros(0, np.uint64)
    k = min(size, n)
    gram = vec.gram_hashes(vec.word_hashes(buf, ws, we), k)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    place = at + sliding_window_view(gram, n - k + 1).argmin(1)[at]
    return ws, we, first, row[at], at, place, gram


def _anchor_rows(n: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, off = vec.text_buffer(batch.column(2))
            for a, b in vec.blocks(off):
                _, _, first, row, _, place, gram = _anchors(buf[off[a] : off[b]], off[a : b + 1] - off[a], n)
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                row, place = row[new], place[new]
                yield pa.RecordBatch.from_arrays([pa.array(gram[place].view(np.int64)), pa.array(ids[a + row]), pa.array(th[a + row]), pa.array((place - first[row]).astype(np.int32))], ["anchor", "id", "th", "pos"])

    return run


@vec.lean
def _owned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, pos, owner) of shared anchors, from (anchor, id, th, pos, owner or _OPEN) sorted by anchor and id.

    A group's first id is its owner.  Between batches it keeps that id once a second one was seen, or
    else the group's rows so far, which are of one document.
    """
    names = ["id", "th", "pos", "owner"]
    known: tuple[int, int] | None = None
    held: list[np.ndarray] | None = None
    out = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            held = None
        anchor, ids, th, pos, owner = rows
        if not len(anchor):
            continue
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(begin, len(anchor)))
        first, last = ids[begin].copy(), ids[begin + size - 1]
        shared = first != last
        if known is not None and known[0] == anchor[0]:
            first[0], shared[0] = known[1], True
        known = (int(anchor[-1]), int(first[-1])) if shared[-1] else None
        ready = np.repeat(shared, size)
        got = np.where(owner != _OPEN, owner, np.repeat(first, size))
        ready |= owner != _OPEN
        if known is None and owner[-1] == _OPEN:
            held = [c[begin[-1] :] for c in rows]
            ready[begin[-1] :] = False
        yield out([ids[ready], th[ready], pos[ready], got[ready]])


def _segment_rows(n: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            buf, off = vec.text_buffer(batch.column(2))
            hits = batch.column(3)
            ends, flat = hits.offsets.to_numpy(), hits.values
            pos, owner = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for a, b in vec.blocks(off):
                part = buf[off[a] : off[b]]
                ws, we, first, row, at, place, _ = _anchors(part, off[a : b + 1] - off[a], n)
                mine = slice(ends[a] , ends[b])
                own = np.full(int(first[-1]) + 1, _NONE, np.int64)
                own[np.repeat(first[:-1], np.diff(ends[a : b + 1])) + pos[mine]] = owner[mine]
                got = own[place]
                cut = np.ones(len(at), bool)
                cut[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
                lo = np.flatnonzero(cut)
                hi = np.append(lo[1:], len(at)) - 1
                keep = got[lo] != _NONE if len(lo) else np.zeros(0, bool)
                lo, hi = lo[keep], hi[keep]
                raw = part.tobytes()
                begin, end = ws[at[lo]].tolist(), we[at[hi] + n - 1].tolist()
                texts = [b" ".join(raw[x:y].split()).decode("utf-8", "replace") for x, y in zip(begin, end)]
                r = row[lo]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + r]), pa.array(th[a + r]), pa.array(got[lo]), pa.array((at[lo] - first[r]).astype(np.int32)), pa.array((hi - lo + n).astype(np.int32)), pa.array(texts, pa.string())], ["id", "th", "owner", "start", "n", "segment"])

    return run


def _finer_rows(n: int):
    """Pieces of (owner, t1, t2, first_id, segment): runs of its windows with one finer anchor, which is the piece's owner."""

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [batch.column(c).to_numpy() for c in range(4)]
            buf, off = vec.text_buffer(batch.column(4))
            for a, b in vec.blocks(off):
                part = buf[off[a] : off[b]]
                ws, we, first, row, at, place, gram = _anchors(part, off[a : b + 1] - off[a], n, _FINER)
                if not len(at):
                    continue
                anchor = gram[place]
                lo = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
                hi = np.append(lo[1:], len(at)) - 1
                raw, r = part.tobytes(), row[lo]
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ws[at[lo]].tolist(), we[at[hi] + n - 1].tolist())]
                cols = [*(c[a + r] for c in of), anchor[lo].view(np.int64), (at[lo] - first[r]).astype(np.int32), (hi - lo + n).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(texts, pa.string())], ["of", "of1", "of2", "id", "owner", "start", "n", "segment"])

    return run


def _match_shard(n: int):
    """One shard (or part and slice of one): build the automaton, stream the texts, give runs of first ids."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, int] = {}
        seqs = [[ids.setdefault(w, len(ids)) for w in t.split(" ")] for t in rows["segment"]]
        sam = SuffixAutomaton()
        for seq, owner, b in zip(seqs, rows["first_id"].tolist(), rows["builds"].tolist()):
            if b:
                sam.add(seq, owner)
        sam.close(n)
        at, lows, highs, firsts = [], [], [], []
        for i, (seq, s) in enumerate(zip(seqs, rows["streams"].tolist())):
            if not s:
                continue
            got = np.array(sam.first_ids(seq)[n - 1 :], np.int64)
            lo = np.flatnonzero(np.append(True, got[1:] != got[:-1]))
            hi = np.append(lo[1:], len(got)) - 1
            for x, y in zip(lo[got[lo] != _NONE].tolist(), hi[got[lo] != _NONE].tolist()):
                at.append(i)
                lows.append(x)
                highs.append(y)
                firsts.append(int(got[x]))
        src = rows.iloc[at]
        return pd.DataFrame({"owner": src["owner"].to_numpy(), "t1": src["t1"].to_numpy(), "t2": src["t2"].to_numpy(), "lo": np.array(lows, np.int32), "hi": np.array(highs, np.int32), "first_id": np.array(firsts, np.int64)})

    return run


def _cut(n_schema_cols: int):
    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, gone = [], [], []
            spans = batch.column(2)
            for text, ranges in zip(batch.column(1).to_pylist(), spans.to_pylist()):
                ws = (text or "").encode("utf-8", "replace").split()
                total.append(len(ws))
                if ranges:
                    out, to = [], 0
                    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                        out += ws[to:lo]
                        to = max(to, hi)
                    ws = out + ws[to:]
                gone.append(total[-1] - len(ws))
                kept.append(b" ".join(ws).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), spans], ["doc_id", "kept", "n_words", "n_removed", "spans"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th, text, each key (id, th) once. th tells texts of one id apart; 0 where no id comes twice, as it costs bytes."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(text_col).alias("text"))
    twice = src.groupBy("id").count().filter("count > 1").limit(1).count()
    if not twice:
        return src.select("id", F.lit(0).cast("long").alias("th"), "text")
    return materialize(src.groupBy("id", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text")))


def _heavy(src: DataFrame, n: int) -> DataFrame:
    """(anchor, owner) of the heavy anchors; an owner is any document that has the anchor."""
    probe = src.filter(F.pmod(F.xxhash64("id", "th"), F.lit(PROBE)) == 0)
    once = probe.mapInArrow(_anchor_rows(n), "anchor long, id long, th long, pos int").select("anchor", "id").distinct()
    return once.groupBy("anchor").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter(F.col("n") >= HEAVY).select("anchor", "owner")


def _marked(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"t1": F.xxhash64("segment"), "t2": F.xxhash64("segment", F.lit(1))})


def _shards(segments: DataFrame) -> DataFrame:
    """Distinct texts (owner, t1, t2) with first_id, segment, n, their shard and its parts: 1 unless it is over the bound."""
    texts = segments.groupBy("owner", "t1", "t2").agg(F.min("id").alias("first_id"), F.first("segment").alias("segment"), F.first("n").alias("n"))
    total = segments.agg(F.sum("n")).first()[0] or 0
    shards = int(total // SHARD_WORDS) + 1
    texts = materialize(texts.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int")))
    sizes = texts.groupBy("shard").agg(F.greatest(F.ceil(F.sum(F.col("n").cast("long")) / SPLIT_WORDS), F.lit(1)).cast("int").alias("parts"))
    return texts.join(small_or_shuffled(sizes, shards), "shard")


def _runs(sized: DataFrame, min_words: int) -> DataFrame:
    """(owner, t1, t2, lo, hi, first_id): runs of windows of each text with the smallest id that has them."""
    mine, every = F.pmod("t1", F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    role = lambda part, slice, builds, streams: F.struct(part.alias("part"), slice.alias("slice"), F.lit(builds).alias("builds"), F.lit(streams).alias("streams"))
    roles = F.when(F.col("parts") == 1, F.array(role(F.lit(0), F.lit(0), True, True))).otherwise(
        F.concat(F.transform(every, lambda i: role(mine, i, True, False)), F.transform(every, lambda i: role(i, mine, False, True)))
    )
    work = sized.withColumn("role", F.explode(roles)).select("shard", "role.*", "owner", "t1", "t2", "first_id", "segment")
    return work.groupBy("shard", "part", "slice").applyInPandas(_match_shard(min_words), "owner long, t1 long, t2 long, lo int, hi int, first_id long")


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans array<struct<lo,hi>>) of the documents that lose words; hi is exclusive."""
    src = _keyed(docs, id_col, text_col)
    heavy = materialize(_heavy(src, min_words))
    anchors = src.mapInArrow(_anchor_rows(min_words), "anchor long, id long, th long, pos int")
    anchors = anchors.join(small_or_shuffled(heavy, heavy.count()), "anchor", "left").select("anchor", "id", "th", "pos", F.coalesce("owner", F.lit(int(_OPEN))).alias("owner"))
    spread = F.when(F.col("owner") != int(_OPEN), F.pmod("id", F.lit(4096))).otherwise(F.lit(0))
    met = anchors.repartition(partitions(docs.sparkSession), "anchor", spread).sortWithinPartitions("anchor", "id")
    hits = met.mapInArrow(_owned_rows, "id long, th long, pos int, owner long").groupBy("id", "th").agg(F.collect_list(F.struct("pos", "owner")).alias("hits"))
    segments = materialize(src.join(hits, ["id", "th"]).select("id", "th", "text", "hits").mapInArrow(_segment_rows(min_words), "id long, th long, owner long, start int, n int, segment string").transform(_marked))

    sized = _shards(segments)
    runs = _runs(sized.filter("parts = 1"), min_words)
    over = sized.filter("parts > 1")
    if over.limit(1).count():
        names = "of long, of1 long, of2 long, id long, owner long, start int, n int, segment string"
        finer = materialize(_marked(over.select("owner", "t1", "t2", "first_id", "segment").mapInArrow(_finer_rows(min_words), names)))
        found = finer.select("of", "of1", "of2", "start", "owner", "t1", "t2").join(_runs(_shards(finer), min_words), ["owner", "t1", "t2"])
        runs = runs.unionByName(found.select(F.col("of").alias("owner"), F.col("of1").alias("t1"), F.col("of2").alias("t2"), (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"), "first_id"))
    return (
        segments.select("id", "th", "start", "owner", "t1", "t2")
        .join(runs, ["owner", "t1", "t2"])
        .filter("first_id < id")
        .groupBy("id", "th")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + min_words).alias("hi"))).alias("spans"))
    )


def remove_repeated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (remaining words joined by one space), n_words, n_removed, spans: one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and an empty ``kept``.  A
    null id counts as larger than all others.  Rows that share an id never shorten each other; equal
    rows get equal results.  Texts under ``min_words`` words stay as they are.  An empty table gives
    an empty result.  Other columns are not read.
    """
    spans = materialize(removed_spans(docs, min_words, id_col, text_col))
    rows, pieces = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"))
    if spans.filter("th <> 0").limit(1).count():
        src = src.withColumn("th", F.xxhash64("text"))
    else:
        src = src.withColumn("th", F.lit(0).cast("long"))
    joined = src.join(small_or_shuffled(spans, rows, 32 + 16 * (pieces or 0) / max(rows, 1)), ["id", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(3), "doc_id long, kept string, n_words long, n_removed long, spans array<struct<lo int, hi int>>")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the gap after each; the rest stays as it is."""
    data = text.encode("utf-8", "replace")
    begin = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, to = [], 0
    for lo, hi in sorted(spans):
        if begin[hi] > to:
            out.append(data[to : max(begin[lo], to)])
            to = begin[hi]
    return b"".join([*out, data[to:]]).decode("utf-8", "replace")


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of documents with repeated spans cut out of text and n_chars set anew for those; all columns stay.

    Texts that lose nothing stay as they are.  A text that loses all words becomes empty, its row stays.
    """
    spans = materialize(removed_spans(docs, min_words))
    rows, pieces = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    th = F.xxhash64("text") if spans.filter("th <> 0").limit(1).count() else F.lit(0).cast("long")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "__th": th})
    side = small_or_shuffled(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), rows, 32 + 16 * (pieces or 0) / max(rows, 1))
    joined = keyed.join(side, ["__id", "__th"], "left").select(*docs.columns, "__spans")
    n_chars = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None

    @vec.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, names = batch.columns[:-1], batch.schema.names[:-1]
            found = batch.column(len(names)).to_pylist()
            at = names.index("text")
            if any(found):
                text = [t if not s else _cut_out(t, [(x["lo"], x["hi"]) for x in s]) for t, s in zip(cols[at].to_pylist(), found)]
                cols[at] = pa.array(text, cols[at].type)
                if n_chars is not None:
                    i = names.index("n_chars")
                    cols[i] = pa.array([len(t) if s else n for t, s, n in zip(text, found, cols[i].to_pylist())], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)
