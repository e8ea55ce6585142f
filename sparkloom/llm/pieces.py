"""SentencePiece encoding and decoding over distinct marked words.

The normaliser writes a marker for each space and one before the text.  When no piece of the model
has a marker after another character, no merge crosses from a word into the next marker, so a text's
ids are those of its marked words (a run of markers and what follows to the next run) one after the
other.  Each distinct marked word of a worker's blocks is segmented once, in a bounded table; ids and
decoded strings are joined back by position.  This needs no shuffle: a table over the whole corpus
would have to move every occurrence of every word.

Models that do not meet the conditions (checked on the model itself) are encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.chunks import ChunkTable

_MARK = "▁"
_PARTS = re.compile(f"[ {_MARK}]*[^ {_MARK}]+|[ {_MARK}]+$")
#: a place where splitting at single spaces is not the same as cutting before each run of markers
_RUNS = re.compile(f"^[ {_MARK}]|[ {_MARK}]{{2}}|{_MARK}|[ {_MARK}]$")
#: texts whose splitting is tested on first use; their pieces cover what a normaliser might change
_PROBES = ["a", "  a  b ", " x", "a\tb\nc", "  äß ﬁ Ａ", "　 é ​ z", "<s> </s> <0x41>", "x" * 90 + " y", "  a\r\n b"]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = self.model.bos_id(), self.model.eos_id()
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.local = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self.table = ChunkTable(self._encode, self._decode)
        self.local = self.local and all(self._same(t) for t in _PROBES)

    def _same(self, text: str) -> bool:
        ids = self.model.encode(text)
        found, _, back = self._by_chunks([text])
        return found.tolist() == ids and back[0] == self.model.decode(ids)

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        # the library puts the first marker back before a text, but not before an empty one
        found = self.model.encode(chunks, num_threads=1)
        return [ids if c else [self.model.piece_to_id(_MARK)] for c, ids in zip(chunks, found)]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Marked words without their first marker."""
        if not text:
            return []
        if _RUNS.search(text):
            return [c[1:].replace(_MARK, " ") for c in _PARTS.findall(" " + text)]
        return text.split(" ")

    def _decode(self, chunks: list[str], ids: list[list[int]]) -> list[str]:
        """Decoded chunks, without the marker that the library drops before a text."""
        return self.model.decode(ids, num_threads=1)

    def _by_chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        rows = [self._cut(t) for t in texts]
        ids, size, number = self.table.join(rows)
        notes, at, back = self.table.notes, 0, []
        number = number.tolist()
        for r in rows:
            back.append(" ".join([notes[n] for n in number[at : at + len(r)]]))
            at += len(r)
        return ids, size, back

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, ids in each text, decoded texts), without begin and end ids."""
        if self.local:
            return self._by_chunks(texts)
        ids = self.model.encode(texts, num_threads=1)
        return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64), [self.model.decode(x) for x in ids]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _run(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            _, off = vec.text_buffer(batch.column(1))
            for a, b in vec.blocks(off):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, size, back = model.encode_block(texts)
                rows, at = [], 0
                for n in size.tolist():
                    rows.append(np.concatenate([[model.bos], ids[at : at + n], [model.eos]]).astype("<u4"))
                    at += n
                cols = [batch.column(0).slice(a, b - a)]
                if keep:
                    cols += [pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array(back, pa.string())]
                else:
                    cols += [pa.array(size + 2), pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"] if keep else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> (with begin and end ids), decoded (what decode(ids) gives): a row per input row.

    A null text is an empty one: begin and end ids only.  Null ids, repeated rows and extra columns
    change nothing.  An empty table gives an empty result.  ``model_path`` must exist on every machine.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(model_path, True), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with counts and SHA-256 digests in place of the ids and texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
