"""SimHash near-dedup by bit-sliced comparison.

A document's sketch has 256 bits: the signs of the summed random signs of its word bigrams. Documents meet in buckets by
the minima of their hashed word 4-grams (one bucket for each of ``BANDS`` minima), as near copies share most of these and
other documents hardly any. In a task, the sketches of its buckets are stored vertically, one plane of 64-bit words per
bit of the sketch; a plane shifted by s lanes against itself compares every document with the one s places on, in all
buckets at once. Carry-save adders update 64 distances with each word, and a block of lanes is abandoned as soon as all
that count exceed the radius. Documents within the radius are linked, and links joined to groups by alternating stars.

A bucket of more than ``HEAVY`` sketches (a passage that many share) is cut into blocks, and every two of these meet in a
bucket of their own: all of its pairs are compared still, spread over tasks, so the result doesn't depend on ``HEAVY``.
The work of such a bucket grows with the square of its distinct sketches. There is no cap on partners or candidates.

Defined results: a text that is null or has no words has no sketch and stays on its own; so does a row with a null
doc_id (its group_id is null). Rows that share a doc_id are one document. Repeated texts have distance 0 and share a
group, whose smallest doc_id is kept, so ties can't arise. ``n_links`` counts the links by which a document was joined to
others or to the document with an equal sketch; links that join what is joined already aren't looked for. A very long text
is sketched whole, like any other. Other columns are ignored (:func:`groups`) or carried (:func:`one_per_group`). An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import checkpointed
from .common import HashCache, hashed_tokens, mix, slices

BITS = 256
RADIUS = 62
BANDS = 8
GRAM = 4
HEAVY = 4_000  # rows of a bucket that are compared in one task
BROADCAST_ROWS = 1 << 16  # crowded buckets that are broadcast; of more, the join is left to the optimiser
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_ODD = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | np.uint64(1)
SKETCH = pa.schema([("doc_id", pa.int64()), ("sketch", pa.binary()), ("minima", pa.list_(pa.int64()))])


def _grams(flat: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text (of all its words, where there are fewer) and the first place of each text."""
    length = np.diff(at)
    total = len(flat)
    mixed = np.zeros(total, np.uint64)
    left = np.repeat(at[1:], length) - np.arange(total)  # words from here to the text's end
    for k in range(n):
        some = flat[k:] * _C[k]
        mixed[: total - k] += np.where(left[: total - k] > k, some, np.uint64(0))
    count = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    start = np.concatenate(([0], np.cumsum(count)))
    keep = np.arange(start[-1]) - np.repeat(start[:-1], count) + np.repeat(at[:-1], count)
    return mix(mixed[keep]), start


def sketches(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[texts, 32] bytes of SimHash over bigrams; every text needs a word."""
    two, start = _grams(flat, at, 2)
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(start[:-1].tolist(), start[1:].tolist())])  # runs of at most 255, whose sums fit in bytes
    ends = np.append(cuts[1:], len(two))
    sums = np.empty((len(cuts), BITS), np.uint8)
    for i in range(0, len(cuts), 192):
        a, b = int(cuts[i]), int(ends[min(i + 192, len(cuts)) - 1])
        words = np.stack([mix(two[a:b] + c) for c in _C], axis=1)
        lanes = np.unpackbits(words.view(np.uint8), axis=1).view(np.uint64)
        sums[i : i + 192] = np.add.reduceat(lanes, cuts[i : i + 192] - a, axis=0).view(np.uint8)
    first = np.searchsorted(cuts, start[:-1])
    ones = np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > np.diff(start)[:, None], axis=1)


def minima(flat: np.ndarray, at: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[texts, bands] smallest hashes of the 4-grams."""
    grams, start = _grams(flat, at, GRAM)
    return np.stack([mix(np.minimum.reduceat(grams * _ODD[k], start[:-1])).view(np.int64) for k in range(bands)], axis=1)


def planes(sk: np.ndarray) -> np.ndarray:
    """The sketches as bit planes: [BITS, words], lane k of word w being document 64 w + k."""
    n = len(sk)
    bits = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(sk, axis=1).T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter (least bit first) exceeds ``radius``."""
    more = np.zeros_like(counter[0])
    equal = ~more
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            more |= equal & counter[k]
            equal = equal & ~counter[k]
    return more


def near(p: np.ndarray, shifts: np.ndarray, first: int, words: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """[shifts, words]: the lanes of ``words`` words from ``first`` on that are wanted and within ``radius`` of the document as many lanes on as each shift says."""
    shape = wanted.shape
    ones, twos, fours = (np.zeros(shape, np.uint64) for _ in range(3))
    upper = [np.zeros(shape, np.uint64) for _ in range(6)]
    bits, back = (shifts & 63).astype(np.uint64)[:, None], (64 - (shifts & 63)).astype(np.uint64)[:, None]  # a shift by 64 gives 0
    at = first + (shifts >> 6)[:, None] + np.arange(words)
    low = int(first + (shifts[0] >> 6))

    def csa(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ x
        return u ^ y, (a & x) | (u & y)

    for j in range(0, BITS, 8):
        some = p[j : j + 8]
        if len(shifts) == 1:
            other = (some[:, None, low : low + words] >> bits) | (some[:, None, low + 1 : low + 1 + words] << back)
        else:
            other = (some.take(at, axis=1) >> bits) | (some.take(at + 1, axis=1) << back)
        x = some[:, None, first : first + words] ^ other
        ones, t1 = csa(ones, x[0], x[1])
        ones, t2 = csa(ones, x[2], x[3])
        twos, f1 = csa(twos, t1, t2)
        ones, t1 = csa(ones, x[4], x[5])
        ones, t2 = csa(ones, x[6], x[7])
        twos, f2 = csa(twos, t1, t2)
        fours, carry = csa(fours, f1, f2)
        for k in range(6):
            upper[k], carry = upper[k] ^ carry, upper[k] & carry
        if j % 32 == 24 and j > radius and not (wanted & ~_above([ones, twos, fours, *upper], radius)).any():
            return np.zeros(shape, np.uint64)
    return wanted & ~_above([ones, twos, fours, *upper], radius)


def _lanes(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def links(bucket: np.ndarray, sk: np.ndarray, radius: int = RADIUS, block: int = 512) -> np.ndarray:
    """[links, 2] indices, which join the rows of equal ``bucket`` (sorted) that lie within ``radius`` of each other, directly or by way of others.

    A bucket is left as soon as all its rows are joined; further comparisons couldn't change the groups.
    """
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(starts, len(bucket)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    root = np.arange(len(bucket))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    open_parts = sizes - 1  # joins that a bucket still lacks
    shift = 1
    while len(starts):
        order = np.argsort(-sizes, kind="stable")
        starts, sizes, open_parts = starts[order], sizes[order], open_parts[order]
        lanes = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist())])
        which = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(lanes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        p = planes(sk[lanes])
        reach = min(int(sizes[0]), max(shift + 1, 2 * shift))  # shifts before the joined buckets are left out
        p = np.pad(p, ((0, 0), (0, reach // 64 + 3)))
        s = shift
        while s < reach and (used := int(sizes[sizes > s].sum())):
            words = -(-used // 64)
            some = np.arange(s, min(reach, s + max(1, min(64, 2048 // words))))  # narrow ones are taken together
            s += len(some)
            flags = np.zeros((len(some), words * 64), np.uint8)
            flags[:, :used] = (place[:used] + some[:, None] < sizes[which[:used]]) & (open_parts[which[:used]] > 0)
            wanted = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)
            for a in range(0, words, block):
                n = min(block, words - a)
                if wanted[:, a : a + n].any():
                    found = near(p, some, a, n, wanted[:, a : a + n], radius)
                    for r in np.flatnonzero(found.any(axis=1)).tolist():
                        for k in (_lanes(found[r]) + 64 * a).tolist():
                            x, y = find(lanes[k]), find(lanes[k + int(some[r])])
                            if x != y:
                                root[max(x, y)] = min(x, y)
                                open_parts[which[k]] -= 1
        shift = reach
        rest = (sizes > shift) & (open_parts > 0)
        starts, sizes, open_parts = starts[rest], sizes[rest], open_parts[rest]
    top = np.array([find(i) for i in np.flatnonzero(root != np.arange(len(root)))], np.int64)
    return np.stack([np.flatnonzero(root != np.arange(len(root))), top], axis=1) if len(top) else np.zeros((0, 2), np.int64)


def _sketched(docs: DataFrame, id_col: str, text_col: str, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache()
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                flat, at = hashed_tokens(b.column(1).to_pylist(), cache)
                has = np.flatnonzero(np.diff(at))
                if len(has):
                    at = np.append(at[has], at[-1])
                    low = minima(flat, at, bands)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(has)),
                            pa.array([s.tobytes() for s in sketches(flat, at)], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(low.ravel())),
                        ],
                        schema=SKETCH,
                    )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    return slim.mapInArrow(run, "doc_id long, sketch binary, minima array<long>")


def _linked(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows (bucket, doc, sketch) that lie together and in order of bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: np.ndarray, doc: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
            pairs = links(bucket, sk, radius)
            return pa.RecordBatch.from_arrays([pa.array(doc[pairs[:, 0]]), pa.array(doc[pairs[:, 1]])], names=["a", "b"])

        held: list[tuple] = []
        rows = 0
        for b in batches:
            if not len(b):
                continue
            sk = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), sk))
            rows += len(b)
            if rows >= 100_000 and held[-1][0][-1] != held[0][0][0]:
                bucket, doc, sk = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield out(bucket[:cut], doc[:cut], sk[:cut])
                held, rows = [(bucket[cut:], doc[cut:], sk[cut:])], len(bucket) - cut
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return buckets.mapInArrow(run, "a long, b long")


def _spread(rows: DataFrame, heavy: int) -> DataFrame:
    """``rows`` (bucket, rep, sketch) with every bucket of more than ``heavy`` rows cut into blocks, and in place of it a bucket for each two of these."""
    crowded = checkpointed(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select("bucket", F.ceil(F.col("n") / heavy).cast("int").alias("g")))
    many = crowded.count()
    if not many:
        return rows
    marked = rows.join(F.broadcast(crowded) if many <= BROADCAST_ROWS else crowded, "bucket", "left").withColumn("k", F.pmod(F.xxhash64("rep", "bucket"), "g").cast("int"))
    pairs = marked.where("g IS NOT NULL").select("bucket", "rep", "sketch", "k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("j")).where("k <> j")
    return marked.where("g IS NULL").select("bucket", "rep", "sketch").unionByName(pairs.select(F.xxhash64("bucket", F.least("k", "j"), F.greatest("k", "j")).alias("bucket"), "rep", "sketch"))


def groups(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, n_links, kept) for every row: the smallest doc_id of its group of near copies, how many links join it to others, and whether it is that one."""
    known = checkpointed(_sketched(docs, id_col, text_col, bands))
    reps = known.groupBy("sketch", "minima").agg(F.min("doc_id").alias("rep"))
    rows = reps.select("rep", "sketch", F.posexplode("minima").alias("band", "low")).select(F.xxhash64("band", "low").alias("bucket"), "rep", "sketch")
    buckets = _spread(rows, heavy).repartition("bucket").sortWithinPartitions("bucket", "rep")
    # rows of one document in different sketches, and links between documents
    same = known.join(reps, ["sketch", "minima"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = checkpointed(_linked(buckets, radius).unionByName(same).where("a <> b").distinct())
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    roots = components(edges).join(degree, "node")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    joined = ids.join(roots, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("group_id"))
    )


def one_per_group(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies of a document with a smaller id; all columns as they were."""
    gone = groups(docs, radius, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
