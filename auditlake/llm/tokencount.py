"""Token counts without token ids.

A map over the documents splits texts into pre-tokens and inverts each run of rows: one row for every distinct pre-token of
a run, with the documents that hold it and how often. These rows meet by pre-token, sorted; so each distinct pre-token is
encoded once, only the number of its pieces is kept, and the products are summed per document. Partial sums, not token
ids, travel on to the final sum. The ids of a run's documents travel with its postings, so the table is read once and its
order doesn't matter. Postings of pre-tokens that many documents of a run hold are spread over tasks by a salt of the run,
and their pieces are counted once for each salt; nothing that grows with the corpus meets in one task.

Defined results: a null text has a null count, a text without pre-tokens 0. A very long text is a run of its own, counted
whole. Rows that repeat an id, or repeat in full, are counted one by one, so there are no ties. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The usual pre-token pattern of byte-level vocabularies: contractions, letters, numbers, other signs, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FLUSH = 2_000_000  # partial sums that a task holds
HOT, SALTS = 512, 1 << 16  # documents of a run from which on a pre-token's postings are salted, and the salts there are


def encoding(vocabulary: str):
    """The tiktoken encoding of a vocabulary file, built once per worker."""
    import tiktoken

    if vocabulary not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(vocabulary).read_bytes().splitlines() if x)}
        _ENCODINGS[vocabulary] = tiktoken.Encoding(Path(vocabulary).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


_ENCODINGS: dict = {}


def splitter():
    import regex

    return regex.compile(PATTERN).findall


KINDS = "pretoken string, base long, salt int, docs binary, times binary"
POSTINGS = pa.schema([("pretoken", pa.string()), ("base", pa.int64()), ("salt", pa.int32()), ("docs", pa.binary()), ("times", pa.binary())])
SUMS = pa.schema([("base", pa.int64()), ("tokens", pa.binary()), ("ids", pa.binary()), ("states", pa.binary())])
_SUMS = "base long, tokens binary, ids binary, states binary"
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_MOST = np.iinfo(np.uint16).max


def _binary(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of ``flat`` as one binary array, without a copy for each."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * flat.itemsize).astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array's runs in one array, and the length of each run."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind)[ends[0] // 2 : ends[-1] // 2], np.diff(ends) // 2


def _invert(texts: list[str | None], base: int, split, hot: int = HOT) -> pa.RecordBatch | None:
    """The postings of one run: its pre-tokens, and for each the documents (by their place behind ``base``) and frequencies. Those in at least ``hot`` documents are salted by the run."""
    number: dict[str, int] = {}
    codes, docs, times = [], [], []
    for d, t in enumerate(texts):
        if t:
            c = Counter(split(t))
            codes.append(np.fromiter([number.setdefault(p, len(number)) for p in c], np.int64, len(c)))
            times.append(np.fromiter(c.values(), np.int64, len(c)))
            docs.append(np.full(len(c), d, np.uint16))
    if not number:
        return None
    code, doc, n = np.concatenate(codes), np.concatenate(docs), np.concatenate(times)
    while (n > _MOST).any():  # what two bytes can't hold goes into further postings of the same document
        high = np.flatnonzero(n > _MOST)
        code, doc, n = np.concatenate([code, code[high]]), np.concatenate([doc, doc[high]]), np.concatenate([n, n[high] - _MOST])
        n[high] = _MOST
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(number) + 1))
    salt = np.where(np.diff(cuts) >= hot, 1 + (base * 2654435761 >> 7) % SALTS, 0).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(number)), pa.array(np.full(len(number), base)), pa.array(salt), _binary(doc[order], cuts), _binary(n[order].astype(np.uint16), cuts)], schema=POSTINGS
    )


def _runs(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """(ids, texts) of runs of rows, of about ``chars`` characters and at most 60,000 rows."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and (size > chars or len(texts) >= 60_000):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t or "")
    if texts:
        yield ids, texts


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", run_chars: int = 16 << 20, hot: int = HOT) -> DataFrame:
    """(doc_id, n_tokens) for every row."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, base = splitter(), TaskContext.get().partitionId() << 32
        for ids, texts in _runs(batches, run_chars):
            out = _invert(texts, base, split, hot)
            if out is not None:
                yield out
            # the run's own row, with neither pre-token nor place among the sorted ones: ids, and which of these and of the texts are null
            states = np.array([(i is None) + 2 * (t is None) for i, t in zip(ids, texts)], np.uint8)
            own = [[None], [base], [0], [np.array([i or 0 for i in ids], np.int64).tobytes()], [states.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(own, POSTINGS)], schema=POSTINGS)
            base += 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        sums: dict[int, np.ndarray] = {}
        held, last, pieces = 0, None, 0
        for b in batches:
            tokens = b.column(0).to_pylist()
            own = [k for k, p in enumerate(tokens) if p is None]
            if own:
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(own)), pa.nulls(len(own), pa.binary()), b.column(3).take(pa.array(own)), b.column(4).take(pa.array(own))], schema=SUMS)
                b = b.filter(b.column(0).is_valid())
                tokens = b.column(0).to_pylist()
            if not tokens:
                continue
            n = np.empty(len(tokens), np.int64)
            for k, p in enumerate(tokens):  # equal ones follow each other
                if p != last:
                    last, pieces = p, len(encode(p))
                n[k] = pieces
            doc, size = _flat(b.column(3), np.uint16)
            weight = _flat(b.column(4), np.uint16)[0] * np.repeat(n, size)
            bases, which = np.unique(b.column(1).to_numpy(), return_inverse=True)
            which = np.repeat(which, size)
            order = np.argsort(which, kind="stable")
            doc, weight = doc[order], weight[order]
            cuts = np.searchsorted(which[order], np.arange(len(bases) + 1)).tolist()
            for base, i, j in zip(bases.tolist(), cuts, cuts[1:]):
                add = np.bincount(doc[i:j], weight[i:j]).astype(np.int64)
                total = sums.get(base)
                if total is None:
                    sums[base] = add
                    held += len(add)
                elif len(total) < len(add):
                    add[: len(total)] += total
                    sums[base] = add
                    held += len(add) - len(total)
                else:
                    total[: len(add)] += add
            if held > FLUSH:
                yield _sums(sums)
                sums, held = {}, 0
        if sums:
            yield _sums(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, ids, states = None, np.zeros(0, np.int64), None, None

        def out() -> pa.RecordBatch:
            n = np.zeros(len(ids), np.int64)
            n[: len(kept)] = kept
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=(states & 1).astype(bool)), pa.array(n, mask=(states & 2).astype(bool))], schema=COUNTS)

        for b in batches:
            for base, vec, own, state in zip(*(c.to_pylist() for c in b.columns)):
                if base != now:
                    if now is not None:
                        yield out()
                    now, kept = base, np.zeros(0, np.int64)
                if own is not None:
                    ids, states = np.frombuffer(own, np.int64), np.frombuffer(state, np.uint8)
                    continue
                v = np.frombuffer(vec, np.int64)
                if len(v) > len(kept):
                    kept = np.concatenate([kept, np.zeros(len(v) - len(kept), np.int64)])
                kept[: len(v)] += v
        if now is not None:
            yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    postings = slim.mapInArrow(invert, KINDS)
    # a run's own row goes by its number
    placed = postings.repartition("pretoken", "salt", F.when(F.col("pretoken").isNull(), F.col("base"))).sortWithinPartitions("pretoken")
    return placed.mapInArrow(count, _SUMS).repartition("base").sortWithinPartitions("base").mapInArrow(total, "doc_id long, n_tokens long")


def _sums(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    none = pa.nulls(len(sums), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary()), none, none], schema=SUMS)
