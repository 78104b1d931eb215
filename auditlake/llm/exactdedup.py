"""Exact dedup with Patricia tries.

Copies within an Arrow batch are merged before anything is shuffled, so of a text that a third of all rows have, only one
row for each batch travels. Documents are partitioned by length and content hash, so equal texts meet in one task. Each
task inserts the full byte strings into a compressed radix trie whose terminal nodes hold the smallest identifier: no
decision rests on a hash. Rows come to it in the order of their smallest identifiers, so they are given out with their
owner as they come, and nothing but the trie is held. When a trie outgrows its limit, the largest subtrees are spilled to
the shared folder and finished one after the other.

Defined results: a null text equals nothing, so its row owns itself. The empty text is a text like any other. A null
doc_id loses to any other; a group of nulls only has a null owner. Rows that repeat in full are copies of each other; of
copies that tie in doc_id, the one whose other columns are smallest is kept. A very long text is compared whole; one that
is larger than the limit is held all the same. Other columns of any name are carried (:func:`drop_copies`) or ignored (:func:`owners`). An empty table gives none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, temporary
from .common import filesystem

NODE_BYTES = 300  # what a node of the trie takes besides its label


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of ``a`` and ``b[at:]``, by bisection with memory comparisons."""
    low, high = 0, min(len(a), len(b) - at)
    if b.startswith(a[:high], at):
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


class _Node:
    __slots__ = ("label", "children", "held", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.held, self.spilled = label, {}, None, None


class PatriciaTrie:
    """Compressed radix trie over byte strings. ``merge(held, new)`` joins what a terminal node holds (``held`` is None at first); ``settle(held, new)`` is told of every value that reached its terminal; ``weigh(held)`` is what a held value takes."""

    def __init__(self, merge: Callable[[Any, Any], Any], limit: int = 96 << 20, folder: str | None = None, settle: Callable[[Any, Any], None] | None = None, weigh: Callable[[Any], int] = lambda held: 64):
        self.merge, self.limit, self.folder, self.settle, self.weigh = merge, limit, folder, settle, weigh
        self.root, self.size, self.spills = _Node(b""), 0, 0

    def _hold(self, node: _Node, value: Any) -> None:
        before = 0 if node.held is None else self.weigh(node.held)
        node.held = self.merge(node.held, value)
        self.size += self.weigh(node.held) - before
        if self.settle:
            self.settle(node.held, value)

    def insert(self, key: bytes, value: Any) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                node.spilled[1].append((key[at:], value))
                node.spilled[2] += len(key) - at + self.weigh(value)
                self.size += len(key) - at + self.weigh(value)
                if node.spilled[2] > self.limit // 8:
                    self._flush(node)
                break
            if at == len(key):
                self._hold(node, value)
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.size += len(child.label) + NODE_BYTES
                self._hold(child, value)
                break
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            n = _common(child.label, key, at)
            middle = _Node(child.label[:n])
            child.label = child.label[n:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            self.size += NODE_BYTES
            node, at = middle, at + n
        if self.folder and self.size > self.limit:
            self._spill()

    def _flush(self, node: _Node) -> None:
        """Writes what waits for a spilled subtree to one more file."""
        if node.spilled[1]:
            fs, base = filesystem(self.folder)
            fs.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}"
            with fs.open_output_stream(path) as f:
                f.write(pickle.dumps(node.spilled[1], 5))
            self.size -= node.spilled[2]
            node.spilled[0].append(path)
            node.spilled[1], node.spilled[2] = [], 0

    @staticmethod
    def _entries(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, Any]]:
        stack = [(node, prefix)]
        while stack:
            x, at = stack.pop()
            if x.held is not None:
                yield at, x.held
            stack.extend((c, at + c.label) for c in x.children.values())

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + NODE_BYTES + (0 if x.held is None else self.weigh(x.held)) + (x.spilled[2] if x.spilled else 0)
            stack.extend(x.children.values())
        return total

    def _spill(self) -> None:
        """Moves the largest subtrees below the first branching out, until half the limit is free."""
        top = self.root
        while len(top.children) == 1 and top.held is None and next(iter(top.children.values())).spilled is None:
            top = next(iter(top.children.values()))
        left = sorted(((self._weight(c), c) for c in top.children.values() if c.spilled is None), key=lambda x: -x[0])
        for weight, c in left:
            if self.size <= self.limit // 2:
                break
            self.size -= weight - NODE_BYTES - 1
            c.spilled = [[], list(self._entries(c, c.label[1:])), 0]  # all but the byte that leads there
            c.label, c.children, c.held = c.label[:1], {}, None
            self._flush(c)
            self.spills += 1
        for c in top.children.values():
            if c.spilled is not None:
                self._flush(c)
        if self.size > self.limit:  # a text, or what one terminal holds, that is larger than the limit: it has to be kept
            self.limit = 2 * self.size

    def items(self) -> Iterator[tuple[bytes, Any]]:
        """Every key with what it holds; spilled subtrees last, one at a time."""
        later, stack = [], [(self.root, b"")]
        while stack:
            x, at = stack.pop()
            if x.spilled is not None:
                self._flush(x)
                later.append((x.spilled[0], at))
                continue
            if x.held is not None:
                yield at, x.held
            stack.extend((c, at + c.label) for c in x.children.values())
        self.root, self.size = _Node(b""), 0
        for files, prefix in later:
            sub = PatriciaTrie(self.merge, self.limit, self.folder, self.settle, self.weigh)
            fs, _ = filesystem(self.folder)
            for path in files:
                with fs.open_input_stream(path) as f:
                    for key, value in pickle.loads(f.read()):
                        sub.insert(key, value)
                fs.delete_file(path)
            for key, value in sub.items():
                yield prefix + key, value


def _by_content(docs: DataFrame, text: Column, doc_id: Column) -> DataFrame:
    """Rows with equal texts in one partition; null texts, which equal nothing, are spread by id."""
    spread = F.when(text.isNull(), F.xxhash64(doc_id)).otherwise(F.lit(0))
    return docs.repartition(F.length(text), F.xxhash64(text), spread)


OWNERS = pa.schema([("doc_id", pa.int64()), ("owner_id", pa.int64())])
MERGED = pa.schema([("least", pa.int64()), ("ids", pa.list_(pa.int64())), ("text", pa.string())])


def _first(held: tuple | None, new: tuple) -> tuple:
    """Owners come in order: the first one stays, without the ids it came with."""
    return (new[0], None) if held is None else held


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct text of a batch, with all ids; null texts, which equal nothing, in one row of their own."""
    for b in batches:
        by: dict[str | None, list] = {}
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            by.setdefault(t, []).append(i)
        least = [min((i for i in ids if i is not None), default=None) for ids in by.values()]
        yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), pa.array(list(by.values()), pa.list_(pa.int64())), pa.array(list(by), pa.string())], schema=MERGED)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 96 << 20) -> DataFrame:
    """(doc_id, owner_id) for every row: the owner is the smallest doc_id with the very same text."""
    folder = temporary(f"{shared_dir(docs.sparkSession)}/patricia-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        own: list[int | None] = []

        def settle(held: tuple, new: tuple) -> None:
            if new[1]:
                ids.extend(new[1])
                own.extend([held[0]] * len(new[1]))

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.int64())], schema=OWNERS)
            ids.clear()
            own.clear()
            return b

        trie = PatriciaTrie(_first, limit, folder, settle, lambda held: 64 + 40 * len(held[1] or ()))
        for batch in batches:
            for least, some, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if text is None:
                    ids.extend(some)
                    own.extend(some)
                else:
                    trie.insert(text, (least, some))
            yield out()
        for _ in trie.items():
            if len(ids) > 50_000:
                yield out()
        yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    merged = slim.mapInArrow(_merged, "least long, ids array<long>, text string")
    placed = _by_content(merged, F.col("text"), F.col("least")).sortWithinPartitions(F.length("text"), F.xxhash64("text"), F.col("least").asc_nulls_last())
    return placed.mapInArrow(run, "doc_id long, owner_id long")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 96 << 20) -> DataFrame:
    """The rows of ``docs`` with each text once, in the row with the smallest id (then the smallest other columns); all rows with a null text stay."""
    folder = temporary(f"{shared_dir(docs.sparkSession)}/patricia-{uuid.uuid4().hex}")
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def rank(row: tuple) -> tuple:
        return row[at_id] is None, row[at_id] or 0, repr(row)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best row of each text of a batch."""
        for b in batches:
            by: dict[str, list[int]] = {}
            keep = []
            for k, t in enumerate(b.column(at_text).to_pylist()):
                if t is None:
                    keep.append(k)
                else:
                    by.setdefault(t, []).append(k)
            for some in by.values():
                if len(some) > 1:
                    few = b.take(pa.array(some))
                    rows = list(zip(*(c.to_pylist() if k != at_text else [None] * len(some) for k, c in enumerate(few.columns))))
                    some = [some[min(range(len(some)), key=lambda k: rank(rows[k]))]]
                keep += some
            yield b if len(keep) == len(b) else b.take(pa.array(sorted(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def better(held: tuple | None, new: tuple) -> tuple:
            return new if held is None or new[0] < held[0] else held

        trie, schema = PatriciaTrie(better, limit, folder, weigh=lambda held: 400 + 2 * len(held[0][2])), None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() if k != at_text else [None] * len(batch) for k, c in enumerate(batch.columns)]
            texts = batch.column(at_text)
            if texts.null_count:
                yield batch.filter(texts.is_null())
            for row, t in zip(zip(*columns), texts.cast(pa.binary()).to_pylist()):
                if t is not None:
                    trie.insert(t, (rank(row), row))
        rows, size = [], 0
        for key, (_, row) in trie.items():
            rows.append((*row[:at_text], key.decode("utf-8"), *row[at_text + 1 :]))
            size += len(key)
            if size > 4 << 20 or len(rows) >= 5_000:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)

    return _by_content(docs.mapInArrow(once, docs.schema), F.col(text_col), F.col(id_col)).mapInArrow(run, docs.schema)
