"""Language-model scores from a hashed maximum-entropy model.

A word's probability is the product of its classes': every distinct word of the corpus has a path through a tree of
classes with ``FAN`` children each, short for frequent words, and each step of the path is a softmax over the summed
weights of the context's features: the class itself (a bias), the last word, and in the first ``SHALLOW`` steps, which
weigh most, the last two words and the last but one (a skip). A feature at a class is hashed to a row of ``FAN`` weights.

What the model holds grows with the corpus: all its distinct words have paths of their own, and there is a row of weights
for every ``SHARE`` words or so. Neither passes the driver, which sees a histogram of counts and names of files: the
words' codes are sorted segments in the shared folder, mapped by workers; the weights are spans in the shared folder.

1. Texts are tokenised once; the distinct words of each run of documents, and their places in these, are written.
2. Words are counted. A path's length follows from the count (a scaled Shannon code, found from the histogram), the path
   from the rank among the words of this length.
3. Training passes over all runs once, in ``ROUNDS`` rounds by the hash of the run. In a round, tasks run gradient descent
   over their runs from the weights so far, with a rate that falls by row as its gradients add up, and send on the rows
   that changed after every ``BLOCK`` words or so (or eight for each row of weights, if that is more). Changes of a span meet in two steps, within groups of tasks and then
   over the groups. Those of rows that little was learnt of are added; the more was learnt, the more it is an average.
   A task holds one table, the one that it changes.
4. Scoring is one narrow pass in numpy batches, which gathers the sparse rows that occur.

Defined results: a text that is null or has no words has 0 words and null scores. A very long text is one run, scored whole.
Rows that repeat are scored alike (ties don't matter) and count in training as often as they occur. Other columns are
ignored. An empty table gives an empty result. A task that is run again writes files of its own, of which only those of
the run that counts are read.
"""

from __future__ import annotations

import functools
import io
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, shared_dir, temporary
from .common import HashCache, filesystem, hashed_tokens, mix, slices

FAN = 16
BITS = 4  # of a step
FEATURES = 4
SHARE = 4  # distinct words for each row of weights
SPAN = 512  # rows of weights that travel together
SENT = 64  # spans of a batch of changes, 1.2 MB
SHALLOW = 2  # steps of a path at which the longer contexts count, too
ROUNDS = 2
BLOCK = 4_000_000
RUN_CHARS = 512 << 10  # of text in a run; its parts so stay below what the JVM takes for huge objects
BATCH = 4096  # steps in one update
RATE = 0.4
SUMMED = 16.0  # summed squares of gradients up to which changes of different blocks are added rather than averaged
DEEPEST = 15  # steps of a path; two words of equal hash are one
_K = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ONES = np.ones(FAN, np.float32)
_ROW = np.dtype((np.void, 4 * FAN))
_START = np.uint64(0x2545F4914F6CDD1D)


def _put(folder: str, array: np.ndarray) -> str:
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    name, held = f"{uuid.uuid4().hex}.npy", io.BytesIO()
    np.save(held, array)
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(held.getvalue())
    return name


def _get(folder: str, name: str) -> np.ndarray:
    fs, base = filesystem(folder)
    if fs.type_name == "local":
        return np.load(f"{base}/{name}", mmap_mode="r")
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.load(io.BytesIO(f.read()))


# --- words and their paths

def lengths(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Path lengths for bins of ``words`` words that occur about ``counts`` times each, such that all paths fit into the tree, with one of the longest left over."""
    total = float((counts * words).sum())
    bits = np.log2(total / counts) / BITS

    def at(shift: float) -> np.ndarray:
        return np.clip(np.ceil(bits - shift - 1e-12), 1, DEEPEST)

    def room(n: np.ndarray) -> bool:
        return float((words * 2.0 ** (-BITS * n)).sum()) + 2.0 ** (-BITS * max(n.max(), 1)) <= 1 + 1e-12

    low, high = -2.0, 2.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if room(at(mid)) else (low, mid)
    return at(low).astype(np.int64)


@dataclass
class Vocabulary:
    """word hash -> (code, length). Codes of one length follow each other, after those of the shorter ones."""

    folder: str
    segments: tuple[tuple[int, str], ...]  # first word, file
    start: np.ndarray  # [segments, DEEPEST + 1] code of each segment's first word of a length
    unknown: tuple[int, int]  # the path that no word has

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = words.view(np.int64)
        code, length = np.full(len(words), self.unknown[0], np.uint64), np.full(len(words), self.unknown[1], np.int64)
        if not len(self.segments):
            return code, length
        which = np.searchsorted(np.array([s[0] for s in self.segments]), words, "right") - 1
        for s in np.unique(which[which >= 0]).tolist():
            known = _segment(self.folder, self.segments[s][1])
            mine = np.flatnonzero(which == s)
            at = np.minimum(np.searchsorted(known[0], words[mine]), known.shape[1] - 1)
            mine, at = mine[known[0][at] == words[mine]], at[known[0][at] == words[mine]]
            packed = known[1][at]
            length[mine] = packed & 15
            code[mine] = self.start[s][packed & 15] + (packed >> 4).astype(np.uint64)
        return code, length


_segment = functools.lru_cache(maxsize=256)(_get)


def vocabulary(counted: DataFrame, folder: str) -> tuple[Vocabulary, int]:
    """Paths for all words of ``counted`` (word, n), and how many words there are."""
    fine = F.floor(F.log2("n") * 8).cast("int")
    bins = counted.groupBy(fine.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy("bin").collect()
    names = [r["bin"] for r in bins]
    words = np.array([r["words"] for r in bins], np.float64)
    size = lengths(np.array([r["n"] for r in bins]) / np.maximum(words, 1), words) if bins else np.zeros(0, np.int64)
    length_of = np.zeros(max(names, default=0) + 1, np.int64)
    length_of[names] = size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
        rows = []
        if held:
            word, length = np.concatenate([w for w, _ in held]), length_of[np.concatenate([k for _, k in held])]
            order = np.argsort(word, kind="stable")
            word, length = word[order], length[order]
            rank, per = np.zeros(len(word), np.int64), np.zeros(DEEPEST + 1, np.int64)
            for n in np.unique(length).tolist():
                these = length == n
                per[n] = these.sum()
                rank[these] = np.arange(per[n])
            rows = [(int(word[0]), _put(folder, np.stack([word, rank << 4 | length])), per.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["first", "file", "per"])

    ranged = counted.select("word", fine.alias("bin")).repartitionByRange("word")
    got = sorted((r["first"], r["file"], r["per"]) for r in ranged.mapInArrow(write, "first long, file string, per array<long>").collect())
    per = np.array([r[2] for r in got], np.int64).reshape(-1, DEEPEST + 1)
    start = np.zeros(per.shape, np.uint64)
    code, deepest = 0, max(1, int(size.max()) if len(size) else 1)
    for n in range(1, deepest + 1):
        code <<= BITS
        start[:, n] = (code + np.cumsum(per[:, n]) - per[:, n]).astype(np.uint64)
        code += int(per[:, n].sum())
    return Vocabulary(folder, tuple((a, b) for a, b, _ in got), start, (code, deepest)), int(per.sum())


# --- the model

def _lined(rows: int) -> np.ndarray:
    """[rows, FAN] zeros, of which each row is one line of the processor's cache."""
    raw = np.zeros(rows * FAN + 16, np.float32)
    first = -raw.ctypes.data % 64 // 4
    return raw[first : first + rows * FAN].reshape(rows, FAN)


@dataclass
class Weights:
    table: np.ndarray  # [rows, FAN]
    squares: np.ndarray  # [rows] sums of the squared gradients so far

    @staticmethod
    def zero(bits: int) -> Weights:
        return Weights(_lined(1 << bits), np.zeros(1 << bits, np.float32))

    def copy(self) -> Weights:
        table = _lined(len(self.table))
        table[:] = self.table
        return Weights(table, self.squares.copy())

    def span(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.table[k * SPAN : (k + 1) * SPAN], self.squares[k * SPAN : (k + 1) * SPAN]

    @property
    def shift(self) -> np.uint64:
        return np.uint64(65 - len(self.squares).bit_length())


def contexts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[FEATURES, words] hashes of what stands before each word; before a text's first word stands a sign of its own."""
    n = len(flat)
    ahead = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    one, two = np.full(n, _START), np.full(n, _START)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    one[ahead < 1] = two[ahead < 2] = _START
    h = np.empty((FEATURES, n), np.uint64)
    h[0] = _K[3]
    h[1] = mix(one * _K[0] + _K[1])
    h[2] = mix(h[1] + two * _K[2])
    h[3] = mix(two * _K[2] + _K[3])
    return h


def steps(ctx: np.ndarray, code: np.ndarray, length: np.ndarray, shift: np.uint64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, rows of weights [features, steps], children taken) over the paths of all words: of the first ``SHALLOW`` steps with all features, and of the others with the first two."""
    out = []
    for first, features in ((0, FEATURES), (SHALLOW, 2)):
        size = np.clip(length - first, 0, SHALLOW if not first else None)
        total = int(size.sum())
        word = np.repeat(np.arange(len(length)), size)
        depth = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + first
        down = ((length[word] - depth) * BITS).astype(np.uint64)
        left = code[word]
        node = ((left >> down) + (depth.astype(np.uint64) << np.uint64(60))) * _K[1]
        node ^= node >> np.uint64(29)
        child = ((left >> (down - np.uint64(BITS))) & np.uint64(FAN - 1)).astype(np.intp)
        out.append((word, (((ctx[:features, word] + node) * _K[0]) >> shift).astype(np.intp), child))
    return out


def _softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = table.take(rows[0], axis=0, mode="clip")
    more = np.empty_like(z)
    for r in rows[1:]:
        z += table.take(r, axis=0, out=more, mode="clip")
    if len(z) and z.max() > 60:  # a row's weights sum to 0, so there is no underflow to mind
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (z @ _ONES))[:, None]
    return z


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``rows`` [features, examples]: the distinct ones, which of these each is, and for all in order of their row, the example of each and where every distinct one's begin (with the end)."""
    n = rows.shape[1]
    order = np.sort((rows.ravel().astype(np.uint64) << np.uint64(32)) | np.arange(rows.size, dtype=np.uint64))
    place, row = (order & np.uint64(0xFFFFFFFF)).astype(np.intp), (order >> np.uint64(32)).astype(np.intp)
    new = np.concatenate(([True], row[1:] != row[:-1]))
    which = np.empty(rows.size, np.intp)
    which[place] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return row[first], which.reshape(rows.shape), place % n, np.append(first, len(row))


def _write(table: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """``table[row] = values``, whole rows at a time."""
    table.view(_ROW).reshape(-1)[row] = values.view(_ROW).reshape(-1)


def _summed(g: np.ndarray, rows: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sum of the gradients of each: of rows with many examples by runs, of the others in as many rounds as they have examples. ``found`` is what :func:`_distinct` gives."""
    row, _, example, edges = _distinct(rows) if found is None else found
    first, count = edges[:-1], np.diff(edges)
    total = g.take(example[first], axis=0, mode="clip")
    many, few, k = np.flatnonzero(count > 8), np.flatnonzero((count > 1) & (count <= 8)), 1
    while len(few):
        some = total.take(few, axis=0, mode="clip")
        some += g.take(example[first[few] + k], axis=0, mode="clip")
        _write(total, few, some)
        k += 1
        few = few[count[few] > k]
    if len(many):
        size = count[many]
        at = np.cumsum(size) - size
        total[many] = np.add.reduceat(g.take(example[np.repeat(first[many] - at, size) + np.arange(size.sum())], axis=0, mode="clip"), at, axis=0)
    return row, total


def update(w: Weights, rows: np.ndarray, child: np.ndarray, rate: float = RATE) -> None:
    """One gradient step on a batch: a row moves against the sum of its examples' gradients, over the root of its summed squares.

    The table, which doesn't fit into the processor's cache, is read and written once for each distinct row, in order.
    """
    found = _distinct(rows)
    row = found[0]
    now = w.table.take(row, axis=0, mode="clip")
    g = _softmax(now, found[1])
    g.reshape(-1)[np.arange(0, g.size, FAN) + child] -= 1
    total = _summed(g, rows, found)[1]
    squares = w.squares.take(row, mode="clip")
    squares += np.einsum("ij,ij->i", total, total)
    w.squares[row] = squares
    total *= (np.float32(rate) / np.sqrt(squares + np.float32(1e-6)))[:, None]
    now -= total
    _write(w.table, row, now)


def descend(w: Weights, flat: np.ndarray, at: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
    ctx, piece = contexts(flat, at), 1 << 15
    for a in range(0, len(flat), piece):
        for _, rows, child in steps(ctx[:, a : a + piece], code[a : a + piece], length[a : a + piece], w.shift):
            for b in range(0, len(child), BATCH):
                update(w, rows[:, b : b + BATCH], child[b : b + BATCH])


def log_probabilities(w: Weights, flat: np.ndarray, at: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Natural log-probability of every word."""
    ctx, piece, out = contexts(flat, at), 1 << 15, np.zeros(len(flat))
    for a in range(0, len(flat), piece):
        for word, rows, child in steps(ctx[:, a : a + piece], code[a : a + piece], length[a : a + piece], w.shift):
            lp = np.empty(len(child))
            for b in range(0, len(child), BATCH):
                c = child[b : b + BATCH]
                lp[b : b + BATCH] = np.log(np.maximum(_softmax(w.table, rows[:, b : b + BATCH])[np.arange(len(c)), c], 1e-30))
            out[a : a + piece] += np.bincount(word, lp, minlength=len(out[a : a + piece]))
    return out


# --- tables

RUNS = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
_RUNS = "run long, ids array<long>, sizes binary, words binary, counts binary, places binary"


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents: ids, words of each, distinct words with their counts, and the place of every word among these (two bytes where that is enough)."""
    from pyspark import TaskContext

    cache, run = HashCache(), TaskContext.get().partitionId() << 32
    for whole in batches:
        for b in slices(whole, "text", RUN_CHARS):
            flat, at = hashed_tokens(b.column(1).to_pylist(), cache)
            place, words = pd.factorize(flat)
            place = place.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
            values = [np.diff(at), np.asarray(words, np.uint64), np.bincount(place, minlength=len(words)).astype(np.uint32), place]
            ids = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([run]), ids, *(pa.array([v.tobytes()], pa.binary()) for v in values)], schema=RUNS)
            run += 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for words, counts in zip(b.column(0), b.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_py(), np.int64)), pa.array(np.frombuffer(counts.as_py(), np.uint32).astype(np.int64))], names=["word", "n"])


def _opened(names: Vocabulary, sizes: bytes, words: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(flat, at, code, length) of a run."""
    distinct = np.frombuffer(words, np.uint64)
    place = np.frombuffer(places, np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
    code, length = names.of(distinct)
    return distinct[place], np.concatenate(([0], np.cumsum(np.frombuffer(sizes, np.int64)))), code[place], length[place]


@dataclass(frozen=True)
class Stored:
    """Weights as spans in the shared folder; spans that aren't there are zero."""

    folder: str
    bits: int
    spans: tuple[tuple[int, str], ...] = ()

    @functools.cached_property
    def files(self) -> dict[int, str]:
        return dict(self.spans)

    def span(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.files:
            size = min(SPAN, 1 << self.bits)
            return np.zeros((size, FAN), np.float32), np.zeros(size, np.float32)
        some = _get(self.folder, self.files[k])
        return some[:, :FAN], some[:, FAN]

    def load(self) -> Weights:
        w = Weights.zero(self.bits)
        for k, _ in self.spans:
            w.table[k * SPAN : (k + 1) * SPAN], w.squares[k * SPAN : (k + 1) * SPAN] = self.span(k)
        return w


_HELD: dict[Stored, Weights] = {}


def _loaded(stored: Stored) -> Weights:
    """The weights, kept for the worker's next task; others that it kept go before these are read."""
    if stored not in _HELD:
        _HELD.clear()
        _HELD[stored] = stored.load()
    return _HELD[stored]


MOVES = pa.schema([("part", pa.int32()), ("origin", pa.int64()), ("rows", pa.binary()), ("moves", pa.binary()), ("squares", pa.binary())])
SUMS = pa.schema([("part", pa.int32()), ("origin_group", pa.int64()), ("moves", pa.binary()), ("squares", pa.binary())])


def _moves(base: Weights | Stored, now: Weights, origin: int) -> Iterator[pa.RecordBatch]:
    """The changed rows of each span, ``SENT`` spans at a time."""
    spans = -(-len(now.squares) // SPAN)
    for a in range(0, spans, SENT):
        out = []
        for k in range(a, min(a + SENT, spans)):
            (table, squares), (was, had) = now.span(k), base.span(k)
            gained = squares - had
            rows = np.flatnonzero(gained)
            if len(rows):
                moved = (table[rows] - was[rows]).astype(np.float16)
                out.append((k, origin, rows.astype(np.uint16).tobytes(), moved.tobytes(), gained[rows].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(MOVES)], schema=MOVES)


def _learned(batches: Iterator[pa.RecordBatch], names: Vocabulary, stored: Stored, block: int, origin: int) -> Iterator[pa.RecordBatch]:
    """What ``stored`` is changed by over the runs of a task. One table is held: what it was is read again, by span, when changes are sent."""
    _HELD.clear()
    now, seen = None, 0
    for b in batches:
        for sizes, words, places in zip(b.column(0), b.column(1), b.column(2)):
            flat, at, code, length = _opened(names, sizes.as_py(), words.as_py(), places.as_py())
            if len(flat):
                now = stored.load() if now is None else now
                descend(now, flat, at, code, length)
                seen += len(flat)
                if seen >= 2 * block:
                    yield from _moves(stored, now, origin)
                    now, seen, origin = None, 0, origin + 1
    if seen:
        yield from _moves(stored, now, origin)


def _weighted(moves: np.ndarray, gained: np.ndarray) -> np.ndarray:
    return moves * (gained + np.float32(SUMMED))[:, None]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weighted changes within each (part, group), whose rows come one after the other."""
    now, total, gained = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, total.tobytes(), gained.tobytes()), SUMS)], schema=SUMS)

    for b in batches:
        for part, group, rows, moves, squares in zip(*(c.to_pylist() for c in b.columns)):
            if (part, group) != now:
                if now is not None:
                    yield out()
                now, total, gained = (part, group), np.zeros((SPAN, FAN), np.float32), np.zeros(SPAN, np.float32)
            r, s = np.frombuffer(rows, np.uint16), np.frombuffer(squares, np.float32)
            total[r] += _weighted(np.frombuffer(moves, np.float16).reshape(-1, FAN).astype(np.float32), s)
            gained[r] += s
    if now is not None:
        yield out()


def _mixed(stored: Stored):
    spans = dict(stored.spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            size = min(SPAN, 1 << stored.bits)
            new = np.array(_get(stored.folder, spans[now])) if now in spans else np.zeros((size, FAN + 1), np.float32)
            new[:, :FAN] += (total / (gained + np.float32(SUMMED))[:, None])[:size]
            new[:, FAN] += gained[:size]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_put(stored.folder, new)])], names=["part", "file"])

        now, total, gained = None, None, None
        for b in batches:
            for part, moves, squares in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if now is not None:
                        yield out()
                    now, total, gained = part, np.zeros((SPAN, FAN), np.float32), np.zeros(SPAN, np.float32)
                total += np.frombuffer(moves, np.float32).reshape(SPAN, FAN)
                gained += np.frombuffer(squares, np.float32)
        if now is not None:
            yield out()

    return run


def train(runs: DataFrame, names: Vocabulary, stored: Stored, rounds: int = ROUNDS, block: int = BLOCK) -> Stored:
    """``runs`` are tokenised documents. A task takes about ``block`` words, and more of a large model, so that what is sent on grows with the corpus and no faster."""
    block = max(block, 8 << stored.bits)
    bytes_of = F.when(F.octet_length("words") > 8 << 16, 4).otherwise(2)  # of a place
    words = runs.agg(F.coalesce(F.sum(F.octet_length("places") / bytes_of), F.lit(0)).alias("n")).first()["n"]
    tasks = max(1, math.ceil(words / rounds / block))
    parts = runs.coalesce(tasks)
    for r in range(rounds):
        def learn(batches: Iterator[pa.RecordBatch], stored: Stored = stored) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            yield from _learned(batches, names, stored, block, TaskContext.get().partitionId() << 32)

        mine = parts.where(F.pmod(F.xxhash64("run"), F.lit(rounds)) == r).select("sizes", "words", "places")
        moves = mine.mapInArrow(learn, "part int, origin long, rows binary, moves binary, squares binary")
        # first within groups of about as many tasks as there are groups, so that no task reads what grows with all the corpus
        groups = max(1, math.isqrt(tasks))
        grouped = moves.withColumn("origin_group", F.pmod(F.xxhash64("origin"), F.lit(groups))).repartition("part", "origin_group").sortWithinPartitions("part", "origin_group", "origin")
        summed = grouped.select("part", "origin_group", "rows", "moves", "squares").mapInArrow(_added, "part int, origin_group long, moves binary, squares binary")
        ordered = summed.repartition("part").sortWithinPartitions("part", "origin_group").select("part", "moves", "squares")
        got = ordered.mapInArrow(_mixed(stored), "part int, file string").collect()
        stored = Stored(stored.folder, stored.bits, tuple(sorted((dict(stored.spans) | {x["part"]: x["file"] for x in got}).items())))
    return stored


SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """The tokenised runs of all rows, written to the shared folder, and the folder."""
    spark: SparkSession = docs.sparkSession
    folder = temporary(f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenised, _RUNS)
    rows.write.option("parquet.page.size.row.check.min", 1).parquet(f"{folder}/runs")  # else a page is some 100 runs, which the JVM holds several times
    return spark.read.schema(_RUNS).parquet(f"{folder}/runs"), folder


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) for every row, under a model trained on all of them."""
    runs, folder = prepared(docs, id_col, text_col)
    counted = f"{folder}/counts"
    runs.select("words", "counts").mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(counted)
    names, words = vocabulary(docs.sparkSession.read.parquet(counted), f"{folder}/names")
    discard(docs.sparkSession, counted)
    bits = max(12, round(math.log2(max(1, words / SHARE))))
    stored = train(runs, names, Stored(f"{folder}/weights", bits), rounds, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _loaded(stored)
        for b in batches:
            for ids, sizes, words, places in zip(*b.columns):
                flat, at, code, length = _opened(names, sizes.as_py(), words.as_py(), places.as_py())
                total = np.concatenate(([0.0], np.cumsum(log_probabilities(w, flat, at, code, length))))
                n, lp = np.diff(at), total[at[1:]] - total[at[:-1]]
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(n), pa.array(np.round(lp, 4), mask=none), pa.array(np.round(np.exp(np.minimum(-lp / np.maximum(n, 1), 700)), 4), mask=none)], schema=SCORES
                )

    return runs.select("ids", "sizes", "words", "places").mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")
