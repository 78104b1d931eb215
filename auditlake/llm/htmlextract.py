"""HTML extraction by wrapper induction.

Pages of a host are grouped by layout: the set of sectioning elements that a page uses and the words of its body's class
that have no digits. A layout of fewer than ``LEAST`` pages goes with the host's most frequent one (or, where none has as
many, all the host's pages go together). Each group's pages are aligned with its reference page (the smallest page_id of
the layout) by simple tree matching of their DOM trees: the largest order-preserving match of elements of equal name,
parents before children; of matches of one size, the one with most equal subtrees, then with most equal classes and ids.
A text node of the reference counts as constant, and so as template, if at least two and ``COVERED`` of the layout's pages
have it and at least ``SAME`` of these with the same text. A page's content is the text of its varying slots: what is
aligned with no constant node, or differs from it. Scripts, styles, comments and the head have no content; nor have slots
within nav, footer, aside and form elements, which HTML itself sets apart from the content.

Two narrow passes over the pages where the references take at most ``BROADCAST_BYTES`` together, as these are broadcast;
beyond that, a shuffle join by host and layout, whose hot keys adaptive execution splits.

Defined results: a null html has null content; an empty one has empty content. A page whose url is null or has no host
has no peers, so all its text is content, as for a host's only page. Rows that repeat count as pages; of rows that tie in
page_id, the one with the smallest html is the reference, and a null page_id comes last. Very long pages are parsed whole,
in time that grows with their length, at any depth; lists of children are aligned whole, in time that grows with the
product of their lengths up to ``CELLS`` pairs. Beyond these they are cut first, at subtrees that both lists have once and
in the same order, and what is still longer at even parts: every child is still aligned, but the match may not be the
largest. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

SAME, COVERED, LEAST = 0.9, 0.5, 3
CELLS = 1 << 26
BROADCAST_BYTES = 32 << 20
_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_STOP = re.compile(r"""=\s*(["'])|>""")
_CLASS = re.compile(r"""(?<![\w-])(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_APART = frozenset(("head", "nav", "footer", "aside", "form"))
_SPACE = re.compile(r"\s+")
_NODE = 1 << 40  # what a matched node counts, beside equal subtrees and classes
_SUBTREE = 1 << 20


def _marks(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(first, behind, name or None, whether it closes, attributes) of all markup, in one pass: whatever isn't closed runs to the end or is text."""
    at, end = 0, len(source)
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            stop = end if stop < 0 else stop + 3
            yield at, stop, None, False, ""
            at = stop
            continue
        closes = source.startswith("/", at + 1)
        m = _NAME.match(source, at + 1 + closes)
        if m is None:
            if source[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            stop = source.find(">", at + 1)
            if stop < 0:
                return
            yield at, stop + 1, None, False, ""
            at = stop + 1
            continue
        i = m.end()
        while True:
            found = _STOP.search(source, i)
            if found is None:
                return
            if found[1] is None:
                break
            quote = source.find(found[1], found.end())
            i = found.end() if quote < 0 else quote + 1
        name, stop = m[0].lower(), found.end()
        if name in _RAW and not closes:
            last = _RAW[name].search(source, stop)
            stop = end if last is None else last.end()
            name = None
        yield at, stop, name, closes, source[m.end() : found.start()] if name else ""
        at = stop


class Tree:
    """A DOM in arrays: symbol, children and (for text nodes) text of each node; ``shape`` numbers subtrees that are equal but for their texts and attributes, ``whole`` is equal for equal ones and ``key`` for equal names, classes and ids."""

    __slots__ = ("symbol", "children", "text", "apart", "shape", "whole", "key")

    def __init__(self, source: str, symbols: dict[str, int], shapes: dict[tuple, int], sizes: list[int]):
        self.symbol, self.children, self.text, self.apart, self.key = [0], [[]], [None], [False], [0]
        open_: list[tuple[str, int]] = [("", 0)]
        opened: Counter[str] = Counter()
        at = 0
        for first, behind, name, closes, attributes in _marks(source):
            if first > at:
                self._text(source[at:first], open_[-1][1])
            at = behind
            if name is None:
                continue
            if closes:
                if opened[name]:
                    while True:
                        last = open_.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
                continue
            ends = _CLOSES.get(name)
            if (ends and open_[-1][0] in ends) or (name in _BLOCK and open_[-1][0] == "p"):
                opened[open_.pop()[0]] -= 1
            parent, node = open_[-1][1], len(self.symbol)
            self.symbol.append(symbols.setdefault(name, len(symbols) + 2))
            self.key.append(hash((name, *_CLASS.findall(attributes))) if attributes else hash(name))
            self.children.append([])
            self.text.append(None)
            self.apart.append(self.apart[parent] or name in _APART)
            self.children[parent].append(node)
            if name not in _VOID and not attributes.endswith("/"):
                open_.append((name, node))
                opened[name] += 1
        if at < len(source):
            self._text(source[at:], open_[-1][1])
        self.shape, self.whole = [0] * len(self.symbol), [0] * len(self.symbol)
        for node in range(len(self.symbol) - 1, -1, -1):  # children come after their parents
            below = self.children[node]
            key = (self.symbol[node], *[self.shape[c] for c in below])
            known = shapes.get(key)
            if known is None:
                known = shapes[key] = len(shapes)
                sizes.append(1 + sum([sizes[self.shape[c]] for c in below]))
            self.shape[node] = known
            self.whole[node] = hash((self.symbol[node], self.text[node], *[self.whole[c] for c in below]))

    def _text(self, raw: str, parent: int) -> None:
        text = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw).strip()
        if text:
            self.children[parent].append(len(self.symbol))
            self.symbol.append(1)
            self.key.append(0)
            self.children.append([])
            self.text.append(text)
            self.apart.append(self.apart[parent])


def _grid(pair: np.ndarray) -> np.ndarray:
    """Best[i][j]: the most that the first i rows and j columns give, for scores of row and column."""
    best = np.zeros((pair.shape[0] + 1, pair.shape[1] + 1), np.int64)
    for i in range(pair.shape[0]):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + pair[i]))
    return best


def _increasing(ys: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, at, before = [], [], []
    for k, y in enumerate(ys):
        p = bisect.bisect_left(tails, y)
        if p == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[p], at[p] = y, k
        before.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


class Matcher:
    """Simple tree matching; sizes of matches are kept by pair of shapes, as they depend on nothing else."""

    def __init__(self, most: int = 200_000, cells: int = CELLS):
        self.symbols: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.keys: list[tuple] = []
        self.scores: dict[tuple[int, int], int] = {}
        self.most, self.cells = most, cells

    def full(self) -> bool:
        return len(self.scores) > self.most or len(self.shapes) > self.most

    def parse(self, source: str) -> Tree:
        tree = Tree(source, self.symbols, self.shapes, self.sizes)
        if len(self.keys) < len(self.shapes):
            self.keys.extend(list(self.shapes)[len(self.keys) :])
        return tree

    def score(self, a: int, b: int) -> int:
        """The most nodes that two subtrees of these shapes have in common."""
        if a == b:
            return self.sizes[a]
        x, y = self.keys[a], self.keys[b]
        if x[0] != y[0]:
            return 0
        found = self.scores.get((a, b))
        if found is None:
            found, x, y = 1, x[1:], y[1:]
            k = 0
            while k < len(x) and k < len(y) and x[k] == y[k]:  # equal subtrees at either end belong to a largest match
                found += self.sizes[x[k]]
                k += 1
            i, j = len(x), len(y)
            while i > k and j > k and x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                found += self.sizes[x[i]]
            x, y = x[k:i], y[k:j]
            if len(x) * len(y) > self.cells:
                x, y = Counter(x), Counter(y)
                for shape in x:
                    found += min(x[shape], y[shape]) * self.sizes[shape]
            elif x and y:
                found += self._most(x, y)
            self.scores[a, b] = found
        return found

    def _most(self, x: tuple, y: tuple) -> int:
        if len(x) * len(y) > 2500:
            best = np.zeros(len(y) + 1, np.int64)
            pair = self._pairs(x, y)
            for i in range(len(x)):
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + pair(i)))
            return int(best[-1])
        last = [0] * (len(y) + 1)
        for a in x:
            now, left = [0], 0
            for j, b in enumerate(y):
                s = last[j] + self.score(a, b)
                if last[j + 1] > s:
                    s = last[j + 1]
                if left > s:
                    s = left
                now.append(s)
                left = s
            last = now
        return last[-1]

    def _pairs(self, x: tuple, y: tuple):
        """Row i of the scores of all pairs, from those of the distinct shapes."""
        ux, ix = np.unique(np.array(x), return_inverse=True)
        uy, iy = np.unique(np.array(y), return_inverse=True)
        some = np.array([[self.score(a, b) for b in uy.tolist()] for a in ux.tolist()], np.int64)
        return lambda i: some[ix[i]][iy]

    def _table(self, a: Tree, b: Tree, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """The pairs of a best match of two lists of children."""
        out = []
        k = 0
        while k < len(xs) and k < len(ys) and a.whole[xs[k]] == b.whole[ys[k]]:
            k += 1
        i, j = len(xs), len(ys)
        while i > k and j > k and a.whole[xs[i - 1]] == b.whole[ys[j - 1]]:
            i, j = i - 1, j - 1
        out += zip(xs[:k], ys[:k])
        out += zip(xs[i:], ys[j:])
        xs, ys = xs[k:i], ys[k:j]
        if not xs or not ys:
            return out
        if len(xs) * len(ys) > self.cells:
            for p, q in self._cut(a, b, xs, ys):
                out += self._table(a, b, p, q)
            return out
        sx, sy = [a.shape[c] for c in xs], [b.shape[c] for c in ys]
        if len(xs) * len(ys) > 2500:
            row = self._pairs(tuple(sx), tuple(sy))
            wy, ky = np.array([b.whole[c] for c in ys]), np.array([b.key[c] for c in ys])
            pair = np.empty((len(xs), len(ys)), np.int64)
            for i, c in enumerate(xs):
                s = row(i)
                pair[i] = np.where(s > 0, s * _NODE + (wy == a.whole[c]) * _SUBTREE + (ky == a.key[c]), 0)
        else:
            pair = []
            for c, s in zip(xs, sx):
                line = []
                for d, t in zip(ys, sy):
                    n = self.score(s, t)
                    line.append(n * _NODE + (a.whole[c] == b.whole[d]) * _SUBTREE + (a.key[c] == b.key[d]) if n else 0)
                pair.append(line)
        best = _grid(pair) if isinstance(pair, np.ndarray) else self._small(pair)
        i, j = len(xs), len(ys)
        while i and j:
            s = pair[i - 1][j - 1]
            if s and best[i][j] == best[i - 1][j - 1] + s:
                out.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    @staticmethod
    def _small(pair: list[list[int]]) -> list[list[int]]:
        best = [[0] * (len(pair[0]) + 1)]
        for line in pair:
            last, now, left = best[-1], [0], 0
            for j, s in enumerate(line):
                s += last[j]
                if last[j + 1] > s:
                    s = last[j + 1]
                if left > s:
                    s = left
                now.append(s)
                left = s
            best.append(now)
        return best

    @staticmethod
    def _cut(a: Tree, b: Tree, xs: list[int], ys: list[int]) -> list[tuple[list[int], list[int]]]:
        """Two long lists in parts that follow each other: at the subtrees that both have once, else in the middle."""
        wx, wy = [a.whole[c] for c in xs], [b.whole[c] for c in ys]
        nx, ny, at = Counter(wx), Counter(wy), {w: j for j, w in enumerate(wy)}
        once = [(i, at[w]) for i, w in enumerate(wx) if nx[w] == 1 and ny[w] == 1]
        cuts = [once[k] for k in _increasing([j for _, j in once])] or [(len(xs) // 2, len(ys) // 2)]
        edges = [(0, 0), *[c for c in cuts if c != (0, 0)], (len(xs), len(ys))]
        return [(xs[i:k], ys[j:m]) for (i, j), (k, m) in zip(edges, edges[1:])]

    def align(self, a: Tree, b: Tree) -> dict[int, int]:
        """Node of b -> node of a, for the text nodes that the best match pairs."""
        if sys.getrecursionlimit() < 1_000_000:
            sys.setrecursionlimit(1_000_000)  # trees may be deep, and scores call each other from Python only
        out: dict[int, int] = {}
        stack = [(0, 0)]
        while stack:
            p, q = stack.pop()
            if a.symbol[p] == 1:
                out[q] = p
            elif a.shape[p] == b.shape[q]:
                stack.extend(zip(a.children[p], b.children[q]))
            else:
                stack.extend(self._table(a, b, a.children[p], b.children[q]))
        return out


class _Host:
    """The matcher and the parsed references of the hosts at hand; dropped when the matcher is full."""

    def __init__(self):
        self.matcher, self.references = Matcher(), {}

    def align(self, group: tuple, reference: str, source: str) -> tuple[Tree, Tree, dict[int, int]]:
        if self.matcher.full() or len(self.references) > 256:
            self.__init__()
        kept = self.references.get(group)
        if kept is None:
            kept = self.references[group] = self.matcher.parse(reference)
        page = self.matcher.parse(source)
        return kept, page, self.matcher.align(kept, page)


VOTES = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("slot", pa.int32()), ("aligned", pa.int64()), ("same", pa.int64())])
OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("content", pa.string()), ("template_nodes", pa.int32()), ("content_nodes", pa.int32())])
_OUT = "page_id long, host string, content string, template_nodes int, content_nodes int"


def _vote(rows: Iterator[tuple[str, int, str, str]]) -> Iterator[pa.RecordBatch]:
    """(host, layout, slot, pages aligned, pages with the same text) from (host, layout, html, reference); the slot -1 counts the pages."""
    state, aligned, same = _Host(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        values = [[k[0] for k in aligned], [k[1] for k in aligned], [k[2] for k in aligned], list(aligned.values()), [same[k] for k in aligned]]
        out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, VOTES)], schema=VOTES)
        aligned.clear()
        same.clear()
        return out

    for host, layout, source, reference in rows:
        a, page, pairs = state.align((host, layout), reference, source)
        aligned[host, layout, -1] += 1
        for q, p in pairs.items():
            aligned[host, layout, p] += 1
            if a.text[p] == page.text[q]:
                same[host, layout, p] += 1
        if len(aligned) > 200_000:
            yield flush()
    yield flush()


def content(matcher_of: _Host, group: tuple, source: str, reference: str | None, slots: list[int] | None) -> tuple[str, int, int]:
    """(content, template nodes, content nodes) of a page."""
    a, page, pairs = matcher_of.align(group, reference, source) if slots else (None, matcher_of.matcher.parse(source), {})
    constant, out, template = frozenset(slots or ()), [], 0
    for node, text in enumerate(page.text):
        if text is not None:
            p = pairs.get(node)
            if p in constant and a.text[p] == text:
                template += 1
            elif not page.apart[node]:
                out.append(text)
    return "\n".join(out), template, len(out)


def _extract(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """From (page_id, host, layout, html, reference, slots)."""
    state, held, size = _Host(), [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(OUT)], schema=OUT)

    for page_id, host, layout, source, reference, slots in rows:
        if state.matcher.full():
            state = _Host()
        held.append((page_id, host, *((None, None, None) if source is None else content(state, (host, layout), source, reference, slots))))
        size += len(source or "")
        if size > 4 << 20 or len(held) >= 2000:
            yield out()
            held, size = [], 0
    yield out()


def _layout(source: Column) -> Column:
    """The sectioning elements of a page and the words of its body's class without digits, as a hash."""
    used = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(r"<(?i:(article|aside|footer|form|header|main|nav|section))[\s>]"), F.lit(1)), F.lower)))
    body = F.regexp_extract(F.regexp_extract(source, r"(?i)<body\s([^>]*)>", 1), r"""(?i)(?:^|\s)class\s*=\s*["']?([^"'>]*)""", 1)
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(body), r"\s+"), lambda w: ~w.rlike(r"\d"))))
    return F.xxhash64(F.concat_ws(" ", used), F.concat_ws(" ", words))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, content, template_nodes, content_nodes) for every row."""
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1))
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.when(host != "", host).alias("host"), F.col(html_col).alias("html"))
    slim = slim.withColumn("own", F.when(F.col("host").isNotNull() & F.col("html").isNotNull(), _layout(F.col("html"))))
    least = (
        slim.where("own IS NOT NULL").groupBy("host", "own")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "html")).alias("least"), F.count(F.lit(1)).alias("n"))
    )
    # a layout of its own, or the host's most frequent one, or (0, which no layout is meant by) all pages of the host
    least = checkpointed(least)  # read several times, and no larger than the references and layouts there are
    by_host = least.groupBy("host").agg(F.max(F.struct("n", F.col("own").alias("layout"))).alias("most"), F.sum("n").alias("all"))
    ranked = least.join(by_host, "host")
    few = F.col("most.n") < LEAST
    grouped = ranked.where("all > 1").select(
        "host", "own", "n", F.when(few, F.lit(0).cast("long")).when(F.col("n") >= LEAST, F.col("own")).otherwise(F.col("most.layout")).alias("layout"), "least", few.alias("few")
    )
    grouped = grouped.withColumn("votes", F.col("few") | (F.col("n") >= LEAST))
    reference = grouped.where("votes").groupBy("host", "layout").agg(F.min("least").alias("least")).select("host", "layout", F.col("least.html").alias("reference"))
    groups = grouped.select("host", "own", "layout", "votes")
    size = reference.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0)).alias("n")).first()["n"] + 100 * groups.count()
    if size <= broadcast_bytes:
        return _narrow(slim, groups, reference)
    named = slim.join(groups.hint("merge"), ["host", "own"], "left")
    voting = named.where("votes").join(reference.hint("merge"), ["host", "layout"]).select("host", "layout", "html", "reference")
    votes = voting.mapInArrow(lambda batches: _vote(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), "host string, layout long, slot int, aligned long, same long")
    template = reference.join(_constant(votes), ["host", "layout"])
    return (
        named.join(template.hint("merge"), ["host", "layout"], "left").select("page_id", "host", "layout", "html", "reference", "slots")
        .mapInArrow(lambda batches: _extract(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), _OUT)
    )


def _constant(votes: DataFrame) -> DataFrame:
    """(host, layout, slots): the constant slots of each group."""
    summed = votes.groupBy("host", "layout", "slot").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    # as many as the reference has text nodes
    every = summed.groupBy("host", "layout").agg(F.collect_list(F.struct("slot", "aligned", "same")).alias("v"), F.max(F.when(F.col("slot") == -1, F.col("aligned"))).alias("pages"))
    often = F.filter("v", lambda v: (v["slot"] >= 0) & (v["aligned"] > 1) & (v["aligned"] >= COVERED * F.col("pages")) & (v["same"] >= SAME * v["aligned"]))
    return every.select("host", "layout", F.sort_array(F.transform(often, lambda v: v["slot"])).alias("slots")).where(F.size("slots") > 0)


def _narrow(slim: DataFrame, groups: DataFrame, reference: DataFrame) -> DataFrame:
    """Both passes with groups and references in a broadcast table, whose size was checked."""
    sc = slim.sparkSession.sparkContext
    of = {(r["host"], r["own"]): (r["layout"], r["votes"]) for r in groups.collect()}
    html = {(r["host"], r["layout"]): r["reference"] for r in reference.collect()}
    sent = sc.broadcast((of, html))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, html = sent.value

        def rows() -> Iterator[tuple[str, int, str, str]]:
            for b in batches:
                for host, own, source in zip(*(c.to_pylist() for c in b.columns)):
                    layout, votes = of.get((host, own), (None, False))
                    if votes:
                        yield host, layout, source, html[host, layout]

        return _vote(rows())

    voting = slim.where("own IS NOT NULL").select("host", "own", "html")
    slots = {(r["host"], r["layout"]): r["slots"] for r in _constant(voting.mapInArrow(vote, "host string, layout long, slot int, aligned long, same long")).collect()}
    found = sc.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of, html), slots = sent.value, found.value

        def rows() -> Iterator[tuple]:
            for b in batches:
                for page_id, host, own, source in zip(*(c.to_pylist() for c in b.columns)):
                    layout = of.get((host, own), (None, False))[0]
                    yield page_id, host, layout, source, html.get((host, layout)), slots.get((host, layout))

        return _extract(rows())

    return slim.select("page_id", "host", "own", "html").mapInArrow(run, _OUT)
