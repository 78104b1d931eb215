"""Tokens, hashes and Arrow helpers of the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash

WORD = re.compile(r"\w+")
PIECE = re.compile(r"\w+|[^\w\s]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class HashCache(dict):
    """word -> 64-bit hash; emptied when it holds ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def hashed_tokens(texts: list[str | None], cache: HashCache, pattern: re.Pattern = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased tokens of all texts in one array, and the len(texts)+1 offsets of the texts in it."""
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    get = cache.__getitem__
    for i, t in enumerate(texts):
        if t:
            words = pattern.findall(t.lower())
            parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
            offsets[i + 1] = len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(offsets)


def slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows with about ``chars`` bytes of ``column`` each, so that working memory doesn't follow the longest rows."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def record_batch(schema: pa.Schema, columns: list[Any]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, f in zip(columns, schema)], schema=schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by URI or plain path."""
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)
