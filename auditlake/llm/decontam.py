"""Benchmark decontamination by CGK embedding and bit sampling.

Texts are sequences of lower-cased words. A window of a document matches a benchmark item of n words if its n words lie
within ``floor(ratio * n)`` word edits of the item (a window that the document's end cuts short is filled up with words
that match nothing). Search for matches:

1. The CGK random walk reads a window word by word; at step j it puts the word at the pointer out and moves on if bit j
   of the word's random bits says so. Windows at a small edit distance so get outputs at a small Hamming distance.
2. Bit sampling: a repetition has its own random bits and keeps ``SAMPLES`` places of the output as key. Every position
   of every document is a window; all repetitions look all windows up among the items' keys. A walk ends as soon as the
   places sampled so far are those of no item, which loses nothing. Each length class repeats until ``TRIALS`` copies of
   its items, with as many random edits as allowed, are found at the rate ``recall``, and ``REPETITIONS`` times at least.
3. Before that, a window is left out only where no match is possible: each of its words that no item has costs an edit,
   and an edit changes two of its word pairs at most, so more strange words than edits, or pairs than twice that, rule
   a match out.
4. What the lookups find is verified exactly, by banded edit distance.

Walks that parted seldom meet again in a long text, so items of more than ``PIECE`` words are looked for by pieces, one of
which has no more than its share of the edits, however these lie. What a piece finds is aligned with the whole item at any
start in reach, and the windows that this leaves are verified like the others.

Items are taken in length classes, in which lengths differ by at most a quarter, so that windows are of the items' size.
The benchmark is broadcast in blocks of at most ``BLOCK_CHARS``; a larger one makes more passes, not larger broadcasts.

Defined results: null texts, texts and items without words match nothing; items with a null id are left out; items that
repeat in full count once. Rows that repeat give their pairs again. Very long texts are searched whole, window by window;
of windows that tie in edits, the first is given. Other columns are ignored (:func:`leaks`) or carried
(:func:`drop_leaks`). An empty table or benchmark gives no pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, HashCache, hashed_tokens, mix, slices

RATIO = 0.2
REPETITIONS = 40
SAMPLES = 4
RECALL, TRIALS = 0.95, 400
PIECE = 60  # words that are walked in one go at most
BLOCK_CHARS = 32 << 20
HELD = 1 << 20  # walks that are held at a time
_PAD = np.uint64(0)
_K = np.uint64(0x9E3779B97F4A7C15)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of the rows of a and b, both [rows, n]; beyond ``most`` just some larger number."""
    rows, n = a.shape
    far = np.int32(most + 1)
    width = 2 * most + 1
    offset = np.arange(width, dtype=np.int32)
    # cell d of row i stands for column i + d - most
    now = np.where(offset >= most, offset - most, far)[None, :].repeat(rows, 0).astype(np.int32)
    padded = np.full((rows, n + 2 * most), _PAD, np.uint64)
    padded[:, most : most + n] = b
    for i in range(1, n + 1):
        column = i + offset - most
        same = padded[:, i - 1 : i - 1 + width] == a[:, i - 1 : i]
        step = now + np.where(same, 0, 1)
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        step[:, (column < 0) | (column > n)] = far + n
        if 0 <= most - i < width:
            step[:, most - i] = i
        step = np.minimum.accumulate(step - offset, axis=1) + offset
        now = step.astype(np.int32)
    return now[:, most]


def starts(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """For rows a [rows, n] and b [rows, n + 4 most], edits between a and the best run of b that starts at each of its first 4 most + 1 places; beyond ``most`` just some larger number."""
    n, width = a.shape[1], 4 * most + 1
    offset = np.arange(width, dtype=np.int32)
    now = np.zeros((len(a), width), np.int32)  # from the end, at which a run may end anywhere
    for i in range(n - 1, -1, -1):
        step = now + (b[:, i : i + width] != a[:, i : i + 1])
        step[:, 1:] = np.minimum(step[:, 1:], now[:, :-1] + 1)
        now = (np.minimum.accumulate((step + offset)[:, ::-1], axis=1)[:, ::-1] - offset).astype(np.int32)
    return now


def edited(rng: np.random.Generator, words: np.ndarray, times: int, swaps: bool) -> np.ndarray:
    """The words after as many random edits (substitutions only, or all kinds), with words that match nothing in and behind them."""
    out = words.tolist()
    for p in rng.random(times).tolist() if not swaps else (rng.permutation(len(out))[:times] / max(1, len(out))).tolist():
        at, kind = int(p * len(out) + 1e-9), 0 if swaps else int(rng.integers(3))
        out[at : at + (kind < 2)] = rng.integers(1, 1 << 62, int(kind != 1)).tolist()
    return np.array(out + rng.integers(1, 1 << 62, len(words)).tolist(), np.uint64)[: len(words)]


def classes(lengths: list[int]) -> list[tuple[int, int]]:
    """Ranges (least, most) that hold all lengths, with at most a quarter from least to most."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(lengths)):
        if not out or n > out[-1][0] * 1.25:
            out.append((n, n))
        out[-1] = (out[-1][0], n)
    return out


class Walks:
    """All repetitions for one length class, walked together: the sampled steps, the keys that items have at each of them, and the items by their whole keys."""

    def __init__(self, least: int, repetitions: int, samples: int, seed: int, flat: np.ndarray, start: np.ndarray, end: np.ndarray, ratio: float, recall: float = RECALL):
        while True:
            self._draw(least, repetitions, samples, seed)
            if self.recall(flat, start, end, ratio, seed) >= recall:
                break
            repetitions += 1 + repetitions // 4
        self.known = np.zeros(0, np.uint64)
        seen: list[np.ndarray] = []
        item, key = self._run(flat, start, end, seen)
        self.known = np.unique(np.concatenate(seen))
        order = np.argsort(key, kind="stable")
        self.keys, self.order = key[order], item[order]

    def _draw(self, least: int, repetitions: int, samples: int, seed: int) -> None:
        steps = 2 * least
        self.sampled = np.zeros((repetitions, steps), bool)
        seeds = np.empty(repetitions, np.uint64)
        for r in range(repetitions):
            rng = np.random.default_rng([seed * 1000 + r, least])
            seeds[r] = rng.integers(1, 1 << 62)
            self.sampled[r, rng.choice(steps, min(samples, steps), replace=False)] = True
        self.last = steps - 1 - np.argmax(self.sampled[:, ::-1], axis=1)
        self.seeds = mix(seeds)
        self.odd = mix(np.arange(1, steps + 1, dtype=np.uint64)) | np.uint64(1)  # each step draws its bit by a multiplier of its own

    def recall(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, ratio: float, seed: int, trials: int = TRIALS) -> float:
        """The share of edited items, at the limit of ``ratio``, that have a key of their item; the lower one of substitutions and of all kinds of edits."""
        rng = np.random.default_rng([seed, 77])
        which = rng.integers(len(start), size=trials)
        texts = [flat[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())]
        changed = [edited(rng, t, int(ratio * len(t) + 1e-9), k % 2 == 0) for k, t in enumerate(texts)]
        at = np.cumsum([0] + [len(t) for t in texts])
        found = []
        for some in (texts, changed):
            left, key = self._run(np.concatenate(some), at[:-1], at[1:], [])
            found.append(mix(left.astype(np.uint64)) ^ key)
        hit = np.zeros(trials, bool)
        hit[left[np.isin(found[1], found[0])]] = True
        return float(min(hit[::2].mean(), hit[1::2].mean()))

    def _run(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, seen: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(window, key) of the walks that come through to their last sample; with ``seen``, all do, and their keys are noted."""
        reps = len(self.last)
        rep, left = np.repeat(np.arange(reps), len(start)), np.tile(np.arange(len(start)), reps)
        ptr, stop, bits = start[left].astype(np.int64), end[left], self.seeds[rep]
        key, alive, dead = bits.copy(), np.ones(len(rep), bool), 0
        top, done = len(flat) - 1, []
        for j in range(self.sampled.shape[1]):
            if dead > len(rep) // 5:  # the others walk on until it pays to leave them out
                rep, left, ptr, stop, bits, key = (x[alive] for x in (rep, left, ptr, stop, bits, key))
                alive, dead = np.ones(len(rep), bool), 0
            if not len(rep):
                break
            word = np.where(ptr < stop, flat[np.minimum(ptr, top)], _PAD)
            now = np.flatnonzero(self.sampled[rep, j] & alive)
            if len(now):
                k = mix(key[now] * _K ^ word[now])
                key[now] = k
                if seen is None:
                    at = np.minimum(np.searchsorted(self.known, k), len(self.known) - 1)
                    lost = self.known[at] != k
                    alive[now[lost]] = False
                    dead += int(lost.sum())
                    now = now[~lost]
                else:
                    seen.append(k)
                ends = now[self.last[rep[now]] == j]
                if len(ends):
                    done.append((left[ends], key[ends]))
                    alive[ends] = False
                    dead += len(ends)
            ptr += (((word ^ bits) * self.odd[j]) >> np.uint64(63)).astype(np.int64)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def find(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all equal keys, some of them more than once; the windows go through in runs that bound what is held."""
        windows, items = [], []
        run = max(1, HELD // len(self.last))
        for i in range(0, len(start), run):
            left, key = self._run(flat, start[i : i + run], end[i : i + run])
            a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            times = b - a
            which = np.repeat(a - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
            windows.append(np.repeat(left + i, times))
            items.append(self.order[which])
        return np.concatenate(windows), np.concatenate(items)


class Items:
    """The search structures of one block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], ratio: float, repetitions: int, samples: int, seed: int = 5, recall: float = RECALL):
        cache = HashCache()
        self.flat, at = hashed_tokens([t for _, t in items], cache)
        length = np.diff(at)
        has = np.flatnonzero(length)
        self.ids = np.array([i for i, _ in items], np.int64)[has]
        self.start, self.length = at[:-1][has], length[has]
        self.most = np.floor(ratio * self.length + 1e-9).astype(np.int64)
        # words and word pairs that items have; what falls on one of their places by chance only prunes less
        self.shift = np.uint64(64 - min(26, max(16, (64 * max(1, len(self.flat))).bit_length())))
        self.words, self.pairs = (np.zeros(1 << (64 - int(self.shift)), bool) for _ in range(2))
        self.words[self.flat >> self.shift] = True
        self.pairs[self._pairs(self.flat) >> self.shift] = True
        self.classes = []  # (least words, most edits, items, first word of each in its item, whether they are whole, walks)
        count = -(-self.length // PIECE)
        owner = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first, behind = k * self.length[owner] // count[owner], (k + 1) * self.length[owner] // count[owner]
        size, whole = behind - first, count[owner] == 1
        for kind in (True, False):
            for least, longest in classes(size[whole == kind].tolist()):
                mine = np.flatnonzero((size >= least) & (size <= longest) & (whole == kind))
                begin = self.start[owner[mine]] + first[mine]
                walks = Walks(least, repetitions, samples, seed, self.flat, begin, begin + size[mine], ratio, recall)
                self.classes.append((least, int(np.floor(ratio * size[mine].max() + 1e-9)), owner[mine], first[mine], kind, walks))

    @staticmethod
    def _pairs(flat: np.ndarray) -> np.ndarray:
        return (flat[:-1] * _K ^ flat[1:]) * _K

    def find(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word of the window, edits) of every matching pair found, with the best window of each."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not len(flat) or not len(self.ids):
            return none
        n = len(flat)
        end_of = np.repeat(at[1:], np.diff(at))
        strange = np.concatenate(([0], np.cumsum(~self.words[flat >> self.shift], dtype=np.int32)))
        odd = np.concatenate(([0], np.cumsum(~self.pairs[self._pairs(flat) >> self.shift], dtype=np.int32)))  # odd[k]: among the pairs that end before word k + 1
        place = np.arange(n)
        windows, items = [], []
        loose: list[np.ndarray] = []  # (item, place of its first word if nothing were inserted or left out before the piece)
        for least, most, mine, first, whole, walks in self.classes:
            if not whole:  # a piece that lost words has as many of what follows in its window
                most *= 2
            # full windows first, by whole-array arithmetic, and those that a text's end cuts short
            few = odd[min(least, n) - 1 :][: max(0, n - least + 1)] - odd[: max(0, n - least + 1)] <= 2 * most
            start = np.flatnonzero(few)
            start = np.union1d(start, np.flatnonzero(end_of - place < least))
            stop = np.minimum(start + least, end_of[start])
            start = start[(strange[stop] - strange[start] + (start + least - stop) <= most) & (odd[stop - 1] - odd[start] <= 2 * most)]
            if not len(start):
                continue
            window, item = walks.find(flat, start, end_of[start])
            if not whole:
                loose.append(np.stack([mine[item], start[window] - first[item], start[window]], axis=1))
                continue
            pairs = np.unique(start[window] * len(self.ids) + mine[item])
            windows.append(pairs // len(self.ids))
            items.append(pairs % len(self.ids))
        if loose:
            window, item = self._whole(np.concatenate(loose), flat, at)
            windows.append(window)
            items.append(item)
        if not windows:
            return none
        window, item = np.concatenate(windows), np.concatenate(items)
        distance = self._edits(window, item, flat, end_of)
        good = distance <= self.most[item]
        window, item, distance = window[good], item[good], distance[good]
        text = np.searchsorted(at, window, "right") - 1
        order = np.lexsort((window, distance, item, text))
        text, item, window, distance = text[order], item[order], window[order], distance[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        text, item, window, distance = text[first], item[first], window[first], distance[first]
        return text, self.ids[item], window - at[text], distance

    def _edits(self, window: np.ndarray, item: np.ndarray, flat: np.ndarray, end_of: np.ndarray) -> np.ndarray:
        n = len(flat)
        distance = np.full(len(window), 1 << 30, np.int64)
        for size in np.unique(self.length[item]):
            these = np.flatnonzero(self.length[item] == size)
            most = int(self.most[item[these[0]]])
            run = max(1, min(4096, (1 << 24) // int(size)))
            for c in range(0, len(these), run):
                some = these[c : c + run]
                grid = window[some][:, None] + np.arange(size)
                a = np.where(grid < end_of[window[some]][:, None], flat[np.minimum(grid, n - 1)], np.uint64(1))
                b = self.flat[self.start[item[some]][:, None] + np.arange(size)]
                distance[some] = edits(a, b, most)
        return distance

    def _whole(self, found: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of the windows about the places at which pieces were found that may be the best of their text for their item."""
        text = np.searchsorted(at, found[:, 2], "right") - 1
        found = np.unique(np.stack([found[:, 0], text, found[:, 1]], axis=1), axis=0)
        item, text, place = found.T
        rows = []
        for i in np.unique(item).tolist():
            size, most = int(self.length[i]), int(self.most[i])
            mine = np.flatnonzero(item == i)
            # one place stands for those close behind it, as its starts reach as far again
            same = np.concatenate(([False], (text[mine][1:] == text[mine][:-1]) & (place[mine][1:] // (most + 1) == place[mine][:-1] // (most + 1))))
            mine = mine[~same]
            a = self.flat[self.start[i] : self.start[i] + size][None, :]
            run = max(1, (1 << 22) // (size + 4 * most))
            for c in range(0, len(mine), run):
                some = mine[c : c + run]
                grid = place[some][:, None] - 2 * most + np.arange(size + 4 * most)
                low, high = at[text[some]][:, None], at[text[some] + 1][:, None]
                b = np.where((grid >= low) & (grid < high), flat[np.clip(grid, 0, len(flat) - 1)], np.uint64(1))
                least = starts(a.repeat(len(some), 0), b, most)
                grid = grid[:, : least.shape[1]]
                r, d = np.nonzero((least <= most) & (grid >= low) & (grid < high))
                rows.append(np.stack([np.full(len(r), i), text[some][r], grid[r, d], least[r, d]], axis=1))
        rows = np.unique(np.concatenate(rows), axis=0)
        if not len(rows):
            return rows[:, 2], rows[:, 0]
        # no window has fewer edits than the run that starts with it: those with the fewest come first, and then what may still be as good
        end_of = np.repeat(at[1:], np.diff(at))
        _, pair = np.unique(rows[:, :2], axis=0, return_inverse=True)
        pair = pair.ravel()
        fewest = np.full(pair.max() + 1, 1 << 30)
        np.minimum.at(fewest, pair, rows[:, 3])
        best = np.full(len(fewest), 1 << 30)
        first = rows[:, 3] == fewest[pair]
        np.minimum.at(best, pair[first], self._edits(rows[first, 2], rows[first, 0], flat, end_of))
        rows = rows[rows[:, 3] <= best[pair]]
        return rows[:, 2], rows[:, 0]


@functools.lru_cache(maxsize=2)
def _items(sent: Broadcast, ratio: float, repetitions: int, samples: int, recall: float) -> Items:
    return Items(sent.value, ratio, repetitions, samples, recall=recall)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``most`` characters, read one partition at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t")
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r["t"]) > most:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    if held:
        yield held


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int64())])


def leaks(
    docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, repetitions: int = REPETITIONS, samples: int = SAMPLES, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, first_word, edits) for every document and item that match, with the best window found."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, first_word long, edits long")
    for n, block in enumerate(blocks(benchmark, item_col, "text", block_chars)):
        found = slim.mapInArrow(_search(spark.sparkContext.broadcast(block), ratio, repetitions, samples, recall), "doc_id long, item_id long, first_word long, edits long")
        out = out.unionByName(found) if n else found
    return out


def _search(sent: Broadcast, ratio: float, repetitions: int, samples: int, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cache = _items(sent, ratio, repetitions, samples, recall), HashCache()
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                text, item, window, distance = items.find(*hashed_tokens(b.column(1).to_pylist(), cache, WORD))
                if len(text):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(item), pa.array(window), pa.array(distance)], schema=LEAKS)

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, repetitions: int = REPETITIONS, samples: int = SAMPLES, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns as they were, in one narrow pass for each block of items."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, "text", block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            items, cache = _items(sent, ratio, repetitions, samples, recall), HashCache()
            for whole in batches:
                for b in slices(whole, text_col, 4 << 20):
                    keep = np.ones(len(b), bool)
                    keep[items.find(*hashed_tokens(b.column(at).to_pylist(), cache, WORD))[0]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
