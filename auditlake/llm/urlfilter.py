"""URL filters on a sorted digest array.

The strings of a block list (canonical URLs and hosts) are sorted by their 64-bit xxhash and written, one segment per
partition of a range partitioning, to the folder that all executors share: the digests as a plain array, the offsets, and
the full strings. Workers memory-map the segments, look all keys of a batch up by vectorised binary search, and confirm
every hit against the stored string, so that colliding digests decide nothing. A list of any size costs a worker no more
memory than the pages it touches.

A URL is canonical without scheme, user, port, fragment, ``www.`` or ``m.`` in front, query order and trailing slash, its
host in lower case. A host entry also blocks the hosts below it.

Defined results: a null URL is null in all columns and not blocked; an empty one, or one without a host, matches only an
equal entry. An IPv6 host is kept with its brackets. Very long URLs are looked up whole. Rows that repeat are looked up
alike, and a page listed by host and by URL counts as listed by host, so there are no ties; null and repeated entries of the list count once or not at all. Other
columns are ignored (:func:`look_up`) or carried (:func:`drop_listed`). Empty tables and an empty list give none blocked.
"""

from __future__ import annotations

import functools
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, temporary
from .common import filesystem

_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?")
_FRONT = re.compile(r"^(?:www\d?|m)\.(?=[^.]+\.)")


def canonical(url: str) -> tuple[str, str]:
    """(canonical URL, host) of a URL."""
    m = _URL.match(url.strip())
    if not m:
        return url.strip(), ""
    host = _FRONT.sub("", m[1].lower().rstrip("."))
    path, query = m[2].rstrip("/"), m[3]
    return host + path + ("?" + "&".join(sorted(query.split("&"))) if query else ""), host


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class Segment:
    """One sorted run of digests with the strings, memory-mapped where the folder is a local path."""

    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        path = f"{base}/{name}"
        if fs.type_name == "local":
            self.keys, self.at = np.load(path + ".keys", mmap_mode="r"), np.load(path + ".at", mmap_mode="r")
            self.text = np.memmap(path + ".text", np.uint8, "r")
        else:
            def read(end: str) -> bytes:
                with fs.open_input_file(path + end) as f:
                    return f.read()

            self.keys, self.at = np.load(io.BytesIO(read(".keys"))), np.load(io.BytesIO(read(".at")))
            self.text = np.frombuffer(read(".text"), np.uint8)

    def holds(self, digests: np.ndarray, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(digests), bool)
        low = np.searchsorted(self.keys, digests, "left")
        for i in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == digests).tolist():
            k = int(low[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:
                if self.text[self.at[k] : self.at[k + 1]].tobytes() == keys[i]:
                    out[i] = True
                    break
                k += 1
        return out


class Listed:
    """The whole list: segments with the first and last digest of each."""

    def __init__(self, folder: str, segments: list[tuple[int, int, str]]):
        self.folder, self.segments, self.open = folder, sorted(segments), {}
        self.first = np.array([s[0] for s in self.segments], np.uint64)

    def holds(self, keys: list[str | None]) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        some = [i for i, k in enumerate(keys) if k is not None]
        if not some or not self.segments:
            return out
        raw = [keys[i].encode("utf-8", "surrogatepass") for i in some]
        digests = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        which = np.searchsorted(self.first, digests, "right") - 1
        for s in np.unique(which[which >= 0]).tolist():
            if s not in self.open:
                self.open[s] = Segment(self.folder, self.segments[s][2])
            these = np.flatnonzero(which == s)
            found = self.open[s].holds(digests[these], [raw[i] for i in these])
            out[np.array(some)[these[found]]] = True
        return out


@functools.lru_cache(maxsize=4)
def _listed(folder: str, segments: tuple) -> Listed:
    return Listed(folder, list(segments))


def build(entries: DataFrame, column: str, name: str) -> tuple[str, tuple[tuple[int, int, str], ...]]:
    """Writes the digest array of the distinct entries; (folder, segments). A task that runs again writes other files, of which only those of the run that counts are named."""
    folder = temporary(f"{shared_dir(entries.sparkSession)}/digests-{name}-{uuid.uuid4().hex}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_pylist())]
        out = []
        if rows:
            rows.sort()
            fs, base = filesystem(folder)
            fs.create_dir(base, recursive=True)
            path = uuid.uuid4().hex
            raw = [t.encode("utf-8", "surrogatepass") for _, t in rows]

            def put(end: str, data: bytes) -> None:
                with fs.open_output_stream(f"{base}/{path}{end}") as f:
                    f.write(data)

            for end, array in ((".keys", np.array([d for d, _ in rows], np.uint64)), (".at", np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))):
                held = io.BytesIO()
                np.save(held, array)
                put(end, held.getvalue())
            put(".text", b"".join(raw) + b"\0")  # never empty, so that it can be mapped
            out = [(rows[0][0] - (1 << 64) * (rows[0][0] >> 63), rows[-1][0] - (1 << 64) * (rows[-1][0] >> 63), path)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["first", "last", "path"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.array([digest(t) for t in b.column(0).to_pylist()], np.uint64)
            # the high bit is turned for the range partitioning, which knows signed numbers only
            yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array((d ^ np.uint64(1 << 63)).view(np.int64)), b.column(0)], names=["digest", "place", "entry"])

    hashed = entries.select(F.col(column).alias("entry")).where("entry IS NOT NULL").distinct().mapInArrow(digests, "digest long, place long, entry string")
    found = hashed.repartitionByRange("place").select("digest", "entry").mapInArrow(write, "first long, last long, path string").collect()
    return folder, tuple(sorted((r["first"] % (1 << 64), r["last"] % (1 << 64), r["path"]) for r in found))


def _verdicts(urls: list[str | None], lists: Listed) -> tuple[list, list, list]:
    parts = [(None, None) if u is None else canonical(u) for u in urls]
    by_url = lists.holds([k for k, _ in parts])
    probes, owner = [], []
    for i, (_, host) in enumerate(parts):
        labels = host.split(".") if host else []
        for k in range(max(0, len(labels) - 1)):  # a top-level domain alone is no entry
            probes.append("host:" + ".".join(labels[k:]))
            owner.append(i)
    by_host = np.zeros(len(urls), bool)
    by_host[np.array(owner, np.int64)[lists.holds(probes)]] = True
    return [k for k, _ in parts], [h for _, h in parts], [None if u is None else "host" if h else "url" if x else "none" for u, h, x in zip(urls, by_host, by_url)]


LOOKED = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("host", pa.string()), ("verdict", pa.string())])


def look_up(pages: DataFrame, entries: DataFrame, column: str = "entry", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url_key, host, verdict) for every row: listed by ``host``, by ``url`` or by ``none``. Entries are canonical URLs, or hosts with ``host:`` in front."""
    folder, segments = build(entries, column, "urls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _listed(folder, segments)
        for b in batches:
            key, host, verdict = _verdicts(b.column(1).to_pylist(), lists)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.string()), pa.array(host, pa.string()), pa.array(verdict, pa.string())], schema=LOOKED)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id long, url_key string, host string, verdict string")


def drop_listed(pages: DataFrame, entries: DataFrame, column: str = "entry", url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` that no entry blocks, all columns as they were."""
    folder, segments = build(entries, column, "urls")
    at = pages.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _listed(folder, segments)
        for b in batches:
            verdict = _verdicts(b.column(at).to_pylist(), lists)[2]
            yield b.filter(pa.array([v in (None, "none") for v in verdict]))

    return pages.mapInArrow(run, pages.schema)


def overused(pages: DataFrame, share: float = 0.05, url_col: str = "url") -> DataFrame:
    """A block list (entry) from the crawl itself: hosts with more than ``share`` of all pages, and canonical URLs that more than one page has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [canonical(u) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.string()), pa.array([h for _, h in both], pa.string())], names=["key", "host"])

    split = pages.select(url_col).where(F.col(url_col).isNotNull()).mapInArrow(run, "key string, host string")
    total = pages.where(F.col(url_col).isNotNull()).count()
    hosts = split.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share * total)
    urls = split.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return hosts.select(F.concat(F.lit("host:"), "host").alias("entry")).unionByName(urls.select(F.col("key").alias("entry")))
