"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes of a text sets chunk borders by content alone, so passages that documents share fall into
the same chunks whatever precedes them. A worker encodes each distinct chunk once and keeps its ids. The chunks of a
document are then joined: around every border the text from the last certain border on the left to the first on the
right is encoded anew, and the new ids replace the old ones between the token borders that both have there; a chunk
without any is encoded anew with its neighbours, up to the whole document. The ids equal those of encoding the whole text,
for every text.

A border is certain between a letter of any common script and a blank or sign behind it: no pre-token holds both, whatever
stands further off, so every encoding of a text around it has a token border there.

Defined results: a null text has null ids; the empty text has none. Strings of special tokens are ordinary text. Very long
texts are encoded whole, in time that grows with their length. Rows that repeat are encoded alike, so ties don't matter.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices
from .tokencount import VOCABULARY, encoding

MASK_BITS = 10  # chunks of about 1 KB
LEAST = 256
CACHE_BYTES = 48 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
# letters of old standing in the common scripts, of whose kind no two Unicode versions differ, and signs that are neither letters nor numbers
_LETTER = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01ba\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u0e01-\u0e30\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
_SIGN = r"[\s!-/:-@\[-`{-~\u00ab\u00bb\u00bf\u2010-\u2027\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a\uff1b\uff1f]"
_FIRST = re.compile(f"{_LETTER}(?={_SIGN})")
_LAST = re.compile(f"(?s).*{_LETTER}(?={_SIGN})")


def borders(data: bytes, bits: int = MASK_BITS, least: int = LEAST) -> list[int]:
    """Ends of the chunks of ``data``: where the gear hash of the last 16 bytes is 0 in its top bits, at least ``least`` apart, never inside a UTF-8 sequence."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    hit = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    out, last = [], 0
    for e in hit.tolist():
        while e < n and data[e] & 0xC0 == 0x80:
            e += 1
        if e - last >= least and n - e >= 1:
            out.append(e)
            last = e
    out.append(n)
    return out


class Chunks:
    """Chunk -> (ids, ends of the tokens in bytes, first and last certain border), each encoded once while it is held."""

    def __init__(self, vocabulary: str, limit: int = CACHE_BYTES):
        self.enc, self.limit = encoding(vocabulary), limit
        most = max(self.enc._mergeable_ranks.values()) + 1
        self.width = np.zeros(most, np.int32)
        for b, i in self.enc._mergeable_ranks.items():
            self.width[i] = len(b)
        self.held: dict[bytes, tuple] = {}
        self.size = self.encoded = self.reused = 0

    def ids(self, text: bytes) -> np.ndarray:
        return np.array(self.enc.encode_ordinary(text.decode("utf-8")), np.int32)

    def get(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
        found = self.held.get(chunk)
        if found is None:
            text = chunk.decode("utf-8")
            ids = np.array(self.enc.encode_ordinary(text), np.int32)
            at = np.cumsum(self.width[ids])
            first, last = _FIRST.search(text), _LAST.match(text)
            ends = [-1 if m is None else int(np.searchsorted(at, len(text[: m.end()].encode("utf-8")))) for m in (first, last)]
            found = (ids, at, *ends)
            self.encoded += 1
            if self.size > self.limit:
                self.held.clear()
                self.size = 0
            self.held[chunk] = found
            self.size += len(chunk) + 12 * len(ids) + 400
        else:
            self.reused += 1
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, from those of its chunks."""
        data = text.encode("utf-8")
        ends = borders(data)
        if len(ends) < 2:
            return self.get(data)[0] if data else np.zeros(0, np.int32)
        out: list[np.ndarray] = []
        pending: list[bytes] = []  # text behind the last certain border, not joined yet
        start = 0
        for k, e in enumerate(ends):
            chunk = data[start:e]
            ids, at, i, j = self.get(chunk)
            start = e
            # tokens i and j end at the chunk's first and last certain border
            if k == 0:
                if j < 0:
                    pending = [chunk]
                else:
                    out.append(ids[: j + 1])
                    pending = [chunk[at[j] :]]
            elif i < 0:
                pending.append(chunk)
            else:
                pending.append(chunk[: at[i]])
                out.append(self.ids(b"".join(pending)))
                if k == len(ends) - 1:
                    out.append(ids[i + 1 :])
                    return np.concatenate(out)
                out.append(ids[i + 1 : j + 1])
                pending = [chunk[at[j] :]]
        out.append(self.ids(b"".join(pending)))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8")


_CHUNKS: dict[str, Chunks] = {}


def chunks(vocabulary: str) -> Chunks:
    """The worker's table of chunks; it outlives a task, and what it holds is bounded."""
    if vocabulary not in _CHUNKS:
        _CHUNKS[vocabulary] = Chunks(vocabulary)
    return _CHUNKS[vocabulary]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("exact", pa.bool_())])


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    size = np.array([0, *(0 if r is None else len(r) for r in rows)])
    flat = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
    mask = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(flat), mask=mask)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact) for every row; ``exact`` tells that decoding the ids gave the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunks(vocabulary)
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                texts = b.column(1).to_pylist()
                ids = [None if t is None else table.encode(t) for t in texts]
                same = [None if t is None else table.decode(i) == t for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([None if i is None else len(i) for i in ids], pa.int64()), _lists(ids), pa.array(same, pa.bool_())], schema=OUT
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, exact boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) from token ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            texts = [None if i is None else enc.decode_bytes(i).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
