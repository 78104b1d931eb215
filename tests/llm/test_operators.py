import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bpe, common, decontam, exactdedup, htmlextract, lm, quality, sharding, simhash, tokencount, urlfilter

from .conftest import CLASHES, WORDS


def empty(d):
    return d.limit(0)


def plain(d):
    return sorted((tuple(r) for r in d.collect()), key=repr)


# --- 7, exact dedup

def test_trie_with_and_without_spills(tmp_path):
    r = random.Random(1)
    keys = ["".join(r.choice("ab") for _ in range(r.randrange(40))).encode() for _ in range(3000)] + [b"", b"a" * 5000, b"a" * 4999 + b"b"]
    want = defaultdict(list)
    for n, k in enumerate(keys):
        want[k].append(n)
    for limit, folder in ((1 << 30, None), (60_000, str(tmp_path / "s"))):
        t = exactdedup.PatriciaTrie(lambda a, b: b if a is None else a + b, limit, folder)
        for n, k in enumerate(keys):
            t.insert(k, [n])
        assert t.spills > 0 or folder is None
        got = list(t.items())
        assert len(got) == len(want) and {k: sorted(v) for k, v in got} == want
    assert not list((tmp_path / "s").iterdir())


@pytest.mark.parametrize("limit", [96 << 20, 200_000])
def test_owners(hostile, limit):
    want = []
    rows = [(r["doc_id"], r["text"]) for r in hostile.collect()]
    for i, t in rows:
        same = [j for j, u in rows if t is not None and u == t and j is not None]
        want.append((i, i if t is None else min(same, default=None)))
    assert plain(exactdedup.owners(hostile, limit=limit)) == sorted(want, key=repr)
    assert exactdedup.owners(empty(hostile)).count() == 0


def test_what_many_copies_hold_stays_small(tmp_path):
    told, texts = [], [b"a" * 3000, b"b" * 3000, b"ab" * 1500]
    t = exactdedup.PatriciaTrie(exactdedup._first, 12_000, str(tmp_path / "s"), lambda held, new: told.append((held[0], new[1])), lambda held: 64 + 40 * len(held[1] or ()))
    for k in range(20_000):
        t.insert(texts[k % 3], (k, [k]))
        assert t.size <= 12_000 or k < 3
    for k in range(200):
        t.insert(b"b%d" % k * 100, (k, [-k - 1]))
    assert len(list(t.items())) == 203 and t.spills > 0
    assert sorted(x for _, ids in told if ids for x in ids) == sorted([*range(20_000), *(-k - 1 for k in range(200))])
    assert all(o == ids[0] % 3 for o, ids in told if ids and ids[0] >= 0) and not list((tmp_path / "s").iterdir())


def test_a_text_that_most_rows_have_is_merged_before_it_travels():
    b = pa.RecordBatch.from_arrays([pa.array([*range(5000), None]), pa.array(["hot"] * 5000 + [None])], names=["doc_id", "text"])
    (out,) = exactdedup._merged(iter([b]))
    assert len(out) == 2 and out.column(0).to_pylist() == [0, None] and out.column(1).to_pylist() == [list(range(5000)), [None]]


@pytest.mark.parametrize("limit", [96 << 20, 200_000])
def test_drop_copies(hostile, limit):
    out = exactdedup.drop_copies(hostile, limit=limit)
    assert out.columns == hostile.columns
    rows = out.collect()
    texts = Counter(r["text"] for r in rows)
    assert texts.pop(None) == 3 and set(texts.values()) == {1} and set(texts) == {r["text"] for r in hostile.collect()} - {None}
    kept = {r["text"]: r["doc_id"] for r in rows}
    assert kept[""] == 5 and {r["doc_id"] for r in rows} >= {1, 8, 9} and not {r["doc_id"] for r in rows} & {6, 10}
    assert exactdedup.drop_copies(empty(hostile)).count() == 0


# --- 8, sharding

def brute_shards(ids, shards, vnodes, slack, hash_of):
    """Key by key, from the definition."""
    at, owner = sharding.ring(shards, vnodes)
    room = [int(np.ceil((1 + slack) * len(ids) / shards))] * shards
    segments = defaultdict(list)
    for i in ids:
        segments[int(np.searchsorted(at, hash_of[i])) % len(at)].append((hash_of[i], i is not None, i or 0, i))
    waiting = [(s, [k[3] for k in sorted(segments[s])]) for s in range(len(at)) if s in segments]
    out, hops = [], 0
    while waiting:
        left = []
        for s, keys in waiting:
            shard = int(owner[(s + hops) % len(owner)])
            take, room[shard] = keys[: room[shard]], room[shard] - min(len(keys), room[shard])
            out += [(k, shard, hops) for k in take]
            if keys[len(take) :]:
                left.append((s, keys[len(take) :]))
        waiting, hops = left, hops + 1
    return sorted(out, key=repr)


def test_sharding(spark, hostile):
    wide = spark.range(3000).withColumnRenamed("id", "doc_id").select("doc_id", *(F.lit(1).alias(c) for c in CLASHES if c != "doc_id"))
    for d, shards in ((wide, 7), (hostile, 3), (wide, 1)):
        ids = [r[0] for r in d.select("doc_id").collect()]
        hash_of = {r[0]: r[1] for r in d.select("doc_id", F.xxhash64("doc_id")).distinct().collect()}
        got = sharding.assign(d, shards, 4, 0.1)
        assert sorted(((r["doc_id"], r["shard"], r["hops"]) for r in got.collect()), key=repr) == brute_shards(ids, shards, 4, 0.1, hash_of)
        assert max(Counter(r["shard"] for r in got.collect()).values()) <= math.ceil(1.1 * len(ids) / shards)
    assert sharding.assign(empty(hostile)).count() == 0
    with pytest.raises(ValueError):
        sharding.ring(0, 1)


def test_an_id_of_many_rows_is_one_row_until_the_end(spark):
    d = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id")).unionByName(spark.range(900).select(F.lit(7).cast("long").alias("doc_id")))
    ids = [r[0] for r in d.collect()]
    hash_of = {r[0]: r[1] for r in d.select("doc_id", F.xxhash64("doc_id")).distinct().collect()}
    for chunk in (1, 13, 1 << 20):
        got = sharding.assign(d, 5, 4, 0.1, chunk=chunk)
        assert sorted(((r["doc_id"], r["shard"], r["hops"]) for r in got.collect()), key=repr) == brute_shards(ids, 5, 4, 0.1, hash_of)


def test_a_new_shard_moves_few_keys(spark):
    d = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(d, n, 64, 0.25).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


# --- 4, SimHash

def test_sketch_is_the_sign_of_summed_signs(prose):
    texts = ["one", "one two", prose(700, 3), prose(50, 4)]
    flat, at = common.hashed_tokens(texts, common.HashCache())
    got = simhash.sketches(flat, at)
    for k in range(len(texts)):
        own = flat[at[k] : at[k + 1]]
        grams, _ = simhash._grams(own, np.array([0, len(own)]), 2)
        assert len(grams) == max(1, len(own) - 1)
        bits = np.unpackbits(np.stack([common.mix(grams + c) for c in simhash._C], axis=1).view(np.uint8), axis=1)
        assert (np.packbits(bits.sum(0, dtype=int) * 2 > len(grams)) == got[k]).all()


@pytest.mark.parametrize("seed", range(3))
def test_links_join_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (6, 32), np.uint8)
    sk = base[rng.integers(0, 6, 900)] ^ np.packbits(rng.random((900, 256)) < 0.08, axis=1)
    bucket = np.sort(rng.choice([0, 1, 2, 3, 90, 91], 900, p=[0.5, 0.2, 0.2, 0.05, 0.04, 0.01]))
    root = list(range(900))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(900):
        for j in range(i + 1, 900):
            if bucket[i] == bucket[j] and np.bitwise_count(sk[i] ^ sk[j]).sum() <= 40:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {(i, find(i)) for i in range(900) if find(i) != i}
    assert {tuple(x) for x in simhash.links(bucket, sk, 40, block=2).tolist()} == want


def test_near_copies(corpus):
    d, pairs = corpus
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(d).collect()}
    assert np.mean([got[c] == got[o] for c, o in pairs.items()]) >= 0.9
    touched = set(pairs) | set(pairs.values())
    assert all(got[k] == k for k in got if k not in touched)
    rows = d.orderBy("doc_id").collect()
    flat, at = common.hashed_tokens([r["text"] for r in rows], common.HashCache())
    sk = simhash.sketches(flat, at)
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if np.bitwise_count(sk[i] ^ sk[j]).sum() <= simhash.RADIUS]
    assert len(near) >= 45 and np.mean([got[i] == got[j] for i, j in near]) >= 0.9


def test_groups_are_the_same_however_buckets_are_cut(spark, prose):
    r, passage = random.Random(3), prose(60, 1)
    rows = []
    for k in range(60):
        words = prose(r.randrange(20, 200), 300 + k).split()
        rows.append((2 * k, " ".join([*words, passage])))
        words[r.randrange(len(words))] = "other"
        rows.append((2 * k + 1, " ".join([*words, passage])))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole, cut = ({r["doc_id"]: r["group_id"] for r in simhash.groups(d, heavy=h).collect()} for h in (1 << 40, 2))
    assert whole == cut and sum(g == k for k, g in whole.items()) < 80


def test_near_copies_of_hostile_tables(hostile):
    got = plain(simhash.groups(hostile).select("doc_id", "group_id", "kept"))
    assert len(got) == hostile.count()
    by = {i: g for i, g, _ in got}
    assert by[1] == by[2] == 1 and by[8] == by[9] == by[10] == 8 and by[3] == 3 and by[5] == 5 and by[6] == 6 and by[None] is None
    assert all(k == (i is None or i == g) for i, g, k in got)
    out = simhash.one_per_group(hostile)
    assert out.columns == hostile.columns and {r["doc_id"] for r in out.collect()} == {i for i, _, k in got if k}
    assert simhash.groups(empty(hostile)).count() == 0 and simhash.one_per_group(empty(hostile)).count() == 0


# --- 1, decontamination

def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def brute_leaks(docs, items, ratio):
    out = {}
    for d, text in docs:
        w = common.WORD.findall((text or "").lower())
        for i, t in items:
            it = common.WORD.findall((t or "").lower())
            if not it:
                continue
            best = min(((edit_distance(it, [*w[s : s + len(it)], *[None] * (s + len(it) - len(w))]), s) for s in range(len(w))), default=(1 << 30, 0))
            if best[0] <= int(ratio * len(it) + 1e-9):
                out[d, i] = best[0]
    return out


def test_leaks_against_brute_force(spark, prose):
    r = random.Random(4)
    items = [(k, prose(r.randrange(5, 45), 50 + k)) for k in range(12)] + [(12, "word"), (13, ""), (14, None)]
    docs = []
    for k in range(60):
        words = prose(r.randrange(1, 60), 900 + k).split()
        if k % 2:
            some = items[r.randrange(12)][1].split()
            for _ in range(int(r.choice([0, 0.1, 0.2]) * len(some))):
                p = r.randrange(len(some))
                some = some[:p] + ([] if r.random() < 0.3 else [r.choice(WORDS)]) + some[p + (r.random() < 0.7) :]
            p = r.randrange(len(words) + 1)
            words[p:p] = some
        docs.append((k, " ".join(words)))
    docs += [(60, "a word here"), (61, ""), (62, None)]
    want = brute_leaks(docs, items, 0.2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + items[:1] + [(None, "the of and to in")], "item_id long, text string")
    for chars in (1 << 20, 200):
        got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontam.leaks(d, b, block_chars=chars).collect()}
        assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) > 25
        assert all(got[k] >= want[k] for k in got) and (60, 12) in got
        assert {x["doc_id"] for x in decontam.drop_leaks(d, b, block_chars=chars).collect()} == set(range(63)) - {k for k, _ in got}


@pytest.mark.parametrize("size", [59, 100, 200, 400])
def test_long_items_at_the_limit_are_found(size):
    r = np.random.default_rng(size)
    words = [f"w{k}" for k in range(3000)]
    items, texts, want = [], [], []
    for k in range(60):
        item = [words[p] for p in r.integers(3000, size=size)]
        most = int(decontam.RATIO * size + 1e-9)
        some = list(item)
        if k % 3 == 2:  # as many words left out as put in
            for p in sorted(r.permutation(size)[: most // 2].tolist(), reverse=True):
                del some[p]
            for p in r.integers(size - most, size=most // 2).tolist():
                some.insert(p, words[int(r.integers(3000))])
        else:  # substitutions anywhere, or all within the first words
            for p in (r.permutation(size) if k % 3 else np.arange(size))[:most].tolist():
                some[p] = words[int(r.integers(3000))]
        items.append((k, " ".join(item)))
        before = [words[p] for p in r.integers(3000, size=int(r.integers(30)))]
        texts.append(" ".join([*before, *some, *([] if k % 2 else before)]))
        want.append(len(before))
    found = decontam.Items(items, decontam.RATIO, decontam.REPETITIONS, decontam.SAMPLES)
    text, item, window, distance = found.find(*common.hashed_tokens(texts, common.HashCache()))
    assert (text == item).all() and len(set(text.tolist())) == len(text) >= 0.9 * len(texts)
    for k, w, d in list(zip(text.tolist(), window.tolist(), distance.tolist()))[:6]:
        a, b = items[k][1].split(), texts[k].split()[w : w + size]
        assert d == edit_distance(a, b + [None] * (size - len(b))) <= decontam.RATIO * size


@pytest.mark.parametrize("size", [20, 40, 80, 160, 400])
@pytest.mark.parametrize("ratio", [0.1, 0.15, 0.2])
def test_recall_of_mixed_edits(size, ratio):
    r = np.random.default_rng(size)
    items, texts, near = [], [], []
    for k in range(40):
        item = r.integers(3000, size=size).tolist()
        some = list(item)
        for _ in range(int(ratio * size + 1e-9)):
            p = int(r.integers(len(some)))
            some[p : p + int(r.integers(2))] = r.integers(3000, size=int(r.integers(2))).tolist()
        before = r.integers(3000, size=20).tolist()
        text = [*before, *some, *r.integers(3000, size=size).tolist()]
        windows = np.array([text[s : s + size] for s in range(14, 27)], np.uint64)
        most = int(decontam.RATIO * size + 1e-9)
        near.append(decontam.edits(np.array([item] * len(windows), np.uint64), windows, most).min() <= most)
        items.append((k, " ".join(f"w{x}" for x in item)))
        texts.append(" ".join(f"w{x}" for x in text))
    text, item, _, _ = decontam.Items(items, decontam.RATIO, decontam.REPETITIONS, decontam.SAMPLES).find(*common.hashed_tokens(texts, common.HashCache()))
    found = set(zip(text.tolist(), item.tolist()))
    assert sum(near) > 8 and np.mean([(k, k) in found for k in range(40) if near[k]]) >= 0.93


def test_leaks_of_hostile_tables(spark, hostile, prose):
    b = spark.createDataFrame([(1, prose(80, 2)), (2, "日本語 x")], "item_id long, text string")
    got = plain(decontam.leaks(hostile, b).select("doc_id", "item_id"))
    assert got == sorted([(1, 1), (2, 1), (2, 1), (None, 1)], key=repr)
    out = decontam.drop_leaks(hostile, b)
    assert out.columns == hostile.columns and out.count() == hostile.count() - 4
    for d, x in ((empty(hostile), b), (hostile, empty(b)), (empty(hostile), empty(b))):
        assert decontam.leaks(d, x).count() == 0 and decontam.drop_leaks(d, x).count() == d.count()


# --- 3 and 6, BPE and token counts

def test_chunked_encoding_is_exact(prose):
    c, enc = bpe.Chunks(tokencount.VOCABULARY), tokencount.encoding(tokencount.VOCABULARY)
    r = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "日本", "!", "\t", "  x", " the", "　", "🙂", "'ll", "<|endoftext|>", "́", "слово ", "。", "нет,", "ab'", "語、"]
    texts = ["", "日本語" * 3000, ("日本語の文章です。" * 7 + "次の文、") * 300, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 300, *(prose(n, n) for n in (1, 40, 3000)), *("".join(r.choice(bits[: r.randrange(2, len(bits))]) for _ in range(r.choice([1, 50, 900, 5000]))) for _ in range(120))]
    for t in texts:
        ids = c.encode(t)
        assert ids.tolist() == enc.encode_ordinary(t) and c.decode(ids) == t
    before = c.encoded
    shared = prose(3000, 77)
    c.encode("one start " + shared)
    first = c.encoded - before
    c.encode("and quite another beginning " + shared)
    assert first > 5 and c.encoded - before - first <= 3  # all but the first chunks are found again


def test_texts_of_other_scripts_are_encoded_in_time_that_grows_with_them():
    import time

    c, r = bpe.Chunks(tokencount.VOCABULARY), random.Random(5)
    words = ["".join(r.choice("абвгдежзиклмнопрстуф") for _ in range(r.randrange(2, 9))) for _ in range(5000)]
    signs = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000)]
    russian = " ".join(r.choice(words) for _ in range(150_000))
    chinese = "".join(r.choice(signs) + ("，" if r.random() < 0.1 else "") for _ in range(300_000))
    for text in (russian, chinese):
        took = []
        for f in (c.ids, lambda b: c.encode(b.decode())):
            began = time.process_time()
            f(text.encode())
            took.append(time.process_time() - began)
        assert (c.encode(text) == c.ids(text.encode())).all() and took[1] < 2 * took[0] + 0.2, took


def test_encode_decode_and_count_tables(hostile):
    got, counts = bpe.encode(hostile).collect(), plain(tokencount.count_tokens(hostile))
    enc = tokencount.encoding(tokencount.VOCABULARY)
    texts = sorted(((r["doc_id"], r["text"]) for r in hostile.collect()), key=repr)
    assert sorted(((r["doc_id"], None if r["token_ids"] is None else enc.decode(r["token_ids"])) for r in got), key=repr) == texts
    assert all(r["exact"] is (None if r["token_ids"] is None else True) for r in got)
    want = sorted(((i, None if t is None else len(enc.encode_ordinary(t))) for i, t in texts), key=repr)
    assert counts == want == sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr)
    assert plain(bpe.decode(bpe.encode(hostile))) == texts
    assert bpe.encode(empty(hostile)).count() == 0 and tokencount.count_tokens(empty(hostile)).count() == 0


def test_counts_over_many_runs(spark, prose):
    rows = [(k, prose(1 + k % 50, k)) for k in range(300)] + [(300, "the " * 70_000)]
    enc = tokencount.encoding(tokencount.VOCABULARY)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    want = {k: len(enc.encode_ordinary(t)) for k, t in rows}
    for some, hot in ((d, tokencount.HOT), (d, 2), (d.orderBy(F.rand()), 2)):
        assert {r[0]: r[1] for r in tokencount.count_tokens(some, run_chars=2000, hot=hot).collect()} == want


def test_postings_of_a_hot_pretoken_are_spread(spark):
    split = tokencount.splitter()
    salts = set()
    for base in range(40):
        b = tokencount._invert(["the cat", f" the dog{base}", "the"] * 300, base, split)
        by = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist()))
        assert by["the"] > 0 and by[" cat"] == 0
        salts.add(by["the"])
    assert len(salts) > 30


# --- 9, quality

def test_classifier_on_held_out_rows(spark, prose):
    rows = [(k, prose(60, k) if k % 3 else " | ".join(prose(60, k).split()), int(k % 3 > 0)) for k in range(300)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 200] + [(0, None), (None, 1), (999, 0)], "doc_id long, quality int")
    model = quality.train(d, labels)
    got = {r["doc_id"]: r["kept"] for r in quality.score(d, model).collect()}
    assert np.mean([got[k] == bool(y) for k, _, y in rows if k >= 200]) >= 0.98
    assert {r["doc_id"] for r in quality.keep_good(d, model).collect()} == {k for k, v in got.items() if v}
    again = quality.train(d.repartition(5), labels)
    assert (again.weights == model.weights).all()


def test_toxic_rows_are_rejected_whatever_their_quality(spark, prose):
    rows = [(k, prose(60, k) + (" vile scum vermin" if k % 4 == 0 else "")) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, None if k % 5 == 0 else 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    model = quality.train(d, labels)
    got = {r["doc_id"]: r for r in quality.score(d, model).collect()}
    assert np.mean([got[k]["kept"] == (k % 4 > 0) == (got[k]["toxic_score"] <= 0) for k in range(200, 300)]) >= 0.98
    assert {r["doc_id"] for r in quality.keep_good(d, model).collect()} == {k for k, r in got.items() if r["kept"]}


def test_fit_against_a_plain_solution():
    """Ratios by hand, and the dual's optimum: no other point along any coordinate is better, and primal and dual meet."""
    r = np.random.default_rng(2)
    bits, size = 6, 64
    rows = [np.unique(r.integers(size, size=int(r.integers(3, 12)))).astype(np.uint32) for _ in range(60)]
    good = np.array([int((x < 32).sum() + r.integers(3) > len(x) / 2) for x in rows])
    model = quality.fit(rows, good, bits, blend=1.0, epochs=3000)
    p, q = np.ones(size), np.ones(size)
    for x, g in zip(rows, good):
        for k in x.tolist():
            (p if g else q)[k] += 1
    ratio = np.where(p + q > 2, np.log(p / p.sum() / (q / q.sum())), 0.0)
    dense = np.zeros((60, size))
    for i, x in enumerate(rows):
        dense[i, x] = ratio[x] / len(x) ** 0.5
    y = np.where(good > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * 60
    # primal by subgradient descent on 1/2 (w.w + b.b) + sum of cost * hinge
    full = np.column_stack([dense, np.ones(60)])

    def primal(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (full @ v))).sum()

    v, best = np.zeros(size + 1), np.inf
    for t in range(1, 40_000):
        g = v - full.T @ (cost * y * (y * (full @ v) < 1))
        v = v - g / (t + 10)
        best = min(best, primal(v))
    w = np.where(ratio != 0, model.weights / np.where(ratio != 0, ratio, 1), 0)
    assert primal(np.append(w, model.bias)) <= best * 1.02 + 1e-6


def test_labelled_features_are_bounded_by_bytes(spark, prose):
    d = spark.createDataFrame([(k, prose(300, k)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    few, all_, twice = (quality.train(x, labels, max_bytes=n) for x, n in ((d, 20_000), (d, 1 << 30), (d.union(d), 1 << 30)))
    assert 0 < np.count_nonzero(few.weights) < np.count_nonzero(all_.weights) and (all_.weights == twice.weights).all()


def test_scores_by_hand(prose):
    x = quality.features([prose(20, 1), "", "a"], common.HashCache())
    assert all((np.diff(v.astype(np.int64)) > 0).all() for v in x)
    m = quality.Model(np.arange(1 << quality.BITS, dtype=np.float32) / 1e6, 0.5)
    got = quality._scores([prose(20, 1), "", "a"], m, common.HashCache())
    want = [float(m.weights[v].sum(dtype=np.float64)) / max(1, len(v)) ** 0.5 + 0.5 for v in x]
    assert np.allclose(got, want, atol=1e-5)


def test_classifier_on_hostile_tables(spark, hostile):
    labels = spark.createDataFrame([(1, 1), (8, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    for some in (labels, empty(labels), labels.where("quality = 1")):
        model = quality.train(hostile, some)
        got = quality.score(hostile, model)
        assert got.count() == hostile.count() and got.where("score IS NULL AND NOT kept").count() == 3
        out = quality.keep_good(hostile, model)
        assert out.columns == hostile.columns and out.where("text IS NULL").count() == 0 and out.count() == got.where("kept").count()
        assert quality.score(empty(hostile), model).count() == 0
    assert quality.keep_good(hostile, quality.train(empty(hostile), labels)).count() == hostile.count() - 3


# --- 5, language model

def paths(flat):
    """Codes and lengths of words, without Spark: {word: (code, length)} and the path left over."""
    words, n = np.unique(flat, return_counts=True)
    fine = np.floor(np.log2(n) * 8).astype(int)
    bins = np.unique(fine)
    size = lm.lengths(np.array([n[fine == b].mean() for b in bins]), np.array([float((fine == b).sum()) for b in bins]))
    length, code, out = size[np.searchsorted(bins, fine)], 0, {}
    for k in range(1, int(size.max()) + 1):
        code *= lm.FAN
        for w in words[length == k].tolist():
            out[w] = (code, k)
            code += 1
    return out, (code, int(size.max()))


def brute_log_probability(w, before, path):
    """ln P of one path after the words ``before``, feature by feature and class by class in plain Python, and the rows and children it takes."""
    m, k = (1 << 64) - 1, [int(x) for x in lm._K]
    mix = lambda x: int(common.mix(np.array([x & m], np.uint64))[0])
    one, two = ([int(lm._START)] * 2 + [int(x) for x in before])[-1:-3:-1]
    h = [k[3], mix(one * k[0] + k[1]), mix(mix(one * k[0] + k[1]) + two * k[2]), mix(two * k[2] + k[3])]
    code, length = path
    lp, used = 0.0, []
    for d in range(length):
        node = ((code >> (4 * (length - d))) + (d << 60)) * k[1] & m
        node ^= node >> 29
        rows = [((x + node) * k[0] & m) >> int(w.shift) for x in (h if d < lm.SHALLOW else h[:2])]
        child = code >> (4 * (length - d - 1)) & 15
        z = [sum(float(w.table[r, c]) for r in rows) for c in range(lm.FAN)]
        lp += z[child] - math.log(sum(math.exp(x) for x in z))
        used.append((rows, child))
    return lp, used


def test_paths_are_a_code(prose):
    flat, _ = common.hashed_tokens([prose(3000, k) for k in range(5)] + [" ".join(f"w{k}" for k in range(700))], common.HashCache())
    known, left = paths(flat)
    every = [*known.values(), left]
    assert len(set(every)) == len(every) and all(0 <= c < lm.FAN**n for c, n in every)
    for c, n in every:  # none begins another
        assert not any((c >> 4 * k, n - k) in set(every) for k in range(1, n))
    words, n = np.unique(flat, return_counts=True)
    share = n / n.sum()
    mean = sum(s * known[w][1] for w, s in zip(words.tolist(), share))
    assert mean < -(share * np.log2(share)).sum() / 4 + 0.6


def test_scores_and_gradients_against_plain_python():
    r = np.random.default_rng(3)
    flat = r.integers(1, 40, 300).astype(np.uint64) * np.uint64(0x1234567)
    at = np.array([0, 1, 1, 120, 300])
    known, _ = paths(flat)
    code, length = (np.array([known[x][k] for x in flat.tolist()], t) for k, t in ((0, np.uint64), (1, np.int64)))
    w = lm.Weights(r.normal(size=(4096, lm.FAN)).astype(np.float32), r.random(4096).astype(np.float32))
    got, used = lm.log_probabilities(w, flat, at, code, length), []
    for a, b in zip(at, at[1:]):
        for p in range(a, b):
            want, some = brute_log_probability(w, flat[a:p], (int(code[p]), int(length[p])))
            assert math.isclose(got[p], want, rel_tol=1e-4)
            used += some
    # all paths after one context, the unused one included, have probability 1
    every = [*known.values()]
    total = sum(math.exp(brute_log_probability(lm.Weights.zero(12), [5], q)[0]) for q in every)
    assert total <= 1 and math.isclose(sum(lm.FAN ** -float(n) for _, n in every), total, rel_tol=1e-6)
    gradient = np.zeros((4096, lm.FAN))
    for rows, child in used:
        z = np.exp([sum(float(w.table[x, c]) for x in rows) for c in range(lm.FAN)])
        z /= z.sum()
        z[child] -= 1
        for x in rows:
            gradient[x] += z
    parts = lm.steps(lm.contexts(flat, at), code, length, w.shift)
    before, w = w, lm.Weights(w.table.copy(), w.squares.copy())
    every = np.concatenate([rows[f] for _, rows, _ in parts for f in range(len(rows))])
    g = np.concatenate([lm._softmax(w.table, rows) - np.eye(lm.FAN)[child] for _, rows, child in parts for _ in rows])
    row, total = lm._summed(g.astype(np.float32), every[None])
    assert np.allclose(total, gradient[row], atol=1e-3) and set(np.flatnonzero(gradient.any(axis=1)).tolist()) <= set(row.tolist())
    _, rows, child = parts[0]
    gradient = np.zeros((4096, lm.FAN))
    for some, c in zip(rows.T, child):
        z = np.exp([sum(float(w.table[x, k]) for x in some) for k in range(lm.FAN)])
        z /= z.sum()
        z[c] -= 1
        for x in some:
            gradient[x] += z
    lm.update(w, rows, child, rate=0.5)
    squares = before.squares + (gradient**2).sum(axis=1)
    assert np.allclose(w.squares, squares, rtol=1e-3)
    moved = gradient.any(axis=1)
    assert np.allclose(w.table[moved], (before.table - 0.5 * gradient / np.sqrt(squares + 1e-6)[:, None])[moved], atol=2e-3) and (w.table[~moved] == before.table[~moved]).all()


def test_training_beats_the_unigram_model_on_texts_it_has_not_seen():
    r = np.random.default_rng(5)
    follow = {k: r.integers(200, size=4) for k in range(200)}

    def text():
        out = [int(r.integers(200))]
        while len(out) < 300:
            out.append(int(r.choice(follow[out[-1]])))
        return " ".join(f"w{x}" for x in out)

    flat, at = common.hashed_tokens([text() for _ in range(60)], common.HashCache())
    known, _ = paths(flat)
    code, length = (np.array([known[x][k] for x in flat.tolist()], t) for k, t in ((0, np.uint64), (1, np.int64)))
    cut, w = at[50], lm.Weights.zero(14)
    lm.descend(w, flat[:cut], at[:51], code[:cut], length[:cut])
    got = lm.log_probabilities(w, flat[cut:], at[50:] - cut, code[cut:], length[cut:]).mean()
    words, n = np.unique(flat, return_counts=True)
    unigram = np.log(n / n.sum())[np.searchsorted(words, flat[cut:])].mean()
    assert got > unigram + 1.0 and got < -math.log(4)


def test_vocabulary_of_a_table(spark, tmp_path, prose):
    flat, _ = common.hashed_tokens([prose(4000, k) for k in range(3)], common.HashCache())
    words, n = np.unique(flat, return_counts=True)
    d = spark.createDataFrame(list(zip(words.view(np.int64).tolist(), n.tolist())), "word long, n long").repartition(3)
    names, count = lm.vocabulary(d, str(tmp_path))
    code, length = names.of(words)
    assert count == len(words) == len(set(zip(code.tolist(), length.tolist())))
    assert np.corrcoef(length, -np.log(n))[0, 1] > 0.8
    _, unknown = names.of(np.array([12345], np.uint64))
    assert (int(names.of(np.array([12345], np.uint64))[0][0]), int(unknown[0])) == names.unknown and names.unknown not in set(zip(code.tolist(), length.tolist()))


def test_changes_of_rare_rows_add_up_and_those_of_frequent_rows_are_averaged():
    base = lm.Weights.zero(12)
    parts = []
    for k in range(2):
        now = base.copy()
        now.table[5], now.squares[5] = 1.0, 0.5
        now.table[6], now.squares[6] = 1.0 + k, 1e6
        parts += list(lm._moves(base, now, k))
    rows = [pa.RecordBatch.from_arrays([b.column(0), pa.array([0], pa.int64()), *b.columns[2:]], names=["part", "group", "rows", "moves", "squares"]) for b in parts]
    (summed,) = lm._added(iter(rows))
    total, gained = (np.frombuffer(summed.column(k)[0].as_py(), np.float32) for k in (2, 3))
    mixed = total.reshape(-1, lm.FAN) / (gained + lm.SUMMED)[:, None]
    assert 1.8 < mixed[5, 0] <= 2 and math.isclose(mixed[6, 0], 1.5, rel_tol=1e-3) and not mixed[7].any()


def test_changes_are_sent_in_small_batches():
    base = lm.Weights.zero(16)
    now = base.copy()
    now.table[:], now.squares[:] = np.arange(1 << 16)[:, None] % 1000, 1.0
    now.squares[3 * lm.SPAN : 4 * lm.SPAN] = 0
    parts = list(lm._moves(base, now, 7))
    assert max(b.nbytes for b in parts) < 2 << 20
    sent = pa.Table.from_batches(parts).to_pylist()
    assert [x["part"] for x in sent] == [k for k in range(128) if k != 3] and {x["origin"] for x in sent} == {7}
    for x in sent:
        assert (np.frombuffer(x["moves"], np.float16).reshape(-1, lm.FAN) == now.span(x["part"])[0][np.frombuffer(x["rows"], np.uint16)]).all() and len(x["squares"]) == 4 * lm.SPAN


def test_a_task_of_training_holds_one_table(prose, tmp_path):
    import tracemalloc

    bits, r = 18, np.random.default_rng(1)
    whole = r.normal(scale=0.1, size=(1 << bits, lm.FAN + 1)).astype(np.float32) ** 2
    spans = tuple((k, lm._put(str(tmp_path), whole[k * lm.SPAN : (k + 1) * lm.SPAN])) for k in range(0, (1 << bits) // lm.SPAN, 2))
    stored = lm.Stored(str(tmp_path), bits, spans)
    flat, at = common.hashed_tokens([prose(2000, k) for k in range(2)], common.HashCache())
    words, place = np.unique(flat, return_inverse=True)
    names = lm.Vocabulary(str(tmp_path), (), np.zeros((0, 16), np.uint64), (5, 4))
    run = pa.RecordBatch.from_arrays([pa.array([x.tobytes()] * 3, pa.binary()) for x in (np.diff(at), words, place.astype(np.uint16))], names=["sizes", "words", "places"])
    tracemalloc.start()
    got = list(lm._learned(iter([run]), names, stored, len(flat), 7))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * (68 << bits)
    code, length = names.of(flat)
    base = stored.load()
    assert (base.span(2)[0] == whole[1024:1536, : lm.FAN]).all() and not base.span(1)[0].any() and not stored.span(1)[0].any()
    want = []
    for k, runs in enumerate((2, 1)):  # a block is full after two
        now = base.copy()
        for _ in range(runs):
            lm.descend(now, flat, at, code, length)
        want += lm._moves(base, now, 7 + k)
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(want))


def test_runs_are_stored_in_small_pages(spark):
    rows = [(k, " ".join(f"{k}x{i}" for i in range(70_000))) for k in range(10)]
    runs, folder = lm.prepared(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert runs.count() == 10
    hadoop = spark._jvm.org.apache.parquet.hadoop
    sizes = []
    for path in runs.inputFiles():
        source = hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
        with_pages = hadoop.ParquetFileReader.open(source)
        for block in with_pages.getFooter().getBlocks():
            sizes += [c.getTotalUncompressedSize() / with_pages.readOffsetIndex(c).getPageCount() for c in block.getColumns()]
        with_pages.close()
    assert 100_000 < max(sizes) < 2 << 20


def test_lm_scores(spark, prose, hostile):
    rows = [(k, prose(200, k)) for k in range(60)] + [(100, " ".join(reversed("zq wv kj xx yy".split() * 40))), (101, "one"), (102, "one two")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(d, block=2000).collect()}
    r = got[3]
    assert r["n_words"] == len(common.WORD.findall(rows[3][1])) and math.isclose(r["perplexity"], math.exp(-r["log_prob"] / r["n_words"]), rel_tol=1e-3)
    flat, _ = common.hashed_tokens([t for _, t in rows], common.HashCache())
    assert np.median([got[k]["perplexity"] for k in range(60)]) < len(set(flat.tolist())) / 2
    h = lm.score(hostile)
    assert h.count() == hostile.count() and h.where("n_words = 0 AND perplexity IS NULL AND log_prob IS NULL").count() == h.where("n_words = 0").count() >= 5
    same = [x["log_prob"] for x in h.where("doc_id = 1 OR doc_id = 2").where("n_words > 5").collect()]
    assert len(same) == 4 and len(set(same)) == 2
    assert lm.score(empty(hostile)).count() == 0


def test_table_scores_are_those_of_the_model(spark, prose, tmp_path):
    d = spark.createDataFrame([(k, prose(50, k)) for k in range(12)] + [(12, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["log_prob"] for r in lm.score(d, rounds=1).collect()}
    flat, at = common.hashed_tokens([prose(50, k) for k in range(12)], common.HashCache())
    known, _ = paths(flat)
    code, length = (np.array([known[x][k] for x in flat.tolist()], t) for k, t in ((0, np.uint64), (1, np.int64)))
    w = lm.Weights.zero(12)
    lm.descend(w, flat, at, code, length)
    lp = lm.log_probabilities(w, flat, at, code, length)
    assert got[12] is None and all(math.isclose(got[k], lp[at[k] : at[k + 1]].sum(), rel_tol=0.05) for k in range(12))


# --- 2, URL filter

def test_canonical():
    for url, want in {
        "HTTP://user:pw@WWW.Ex.ORG:80/a/?b=2&a=1#top": ("ex.org/a?a=1&b=2", "ex.org"), "https://m.ex.org": ("ex.org", "ex.org"), "//ex.org/a/": ("ex.org/a", "ex.org"), "not a url": ("not a url", ""), "": ("", ""),
        "http://www.org/x": ("www.org/x", "www.org"), "http:///x": ("/x", ""), "http://[2001:db8::1]:8080/a/": ("[2001:db8::1]/a", "[2001:db8::1]"),
        "http://ex.org/" + "a/" * 200_000: ("ex.org/" + "a/" * 199_999 + "a", "ex.org"),
    }.items():
        assert urlfilter.canonical(url) == want


def test_url_filter(spark, monkeypatch):
    urls = [f"http://h{k % 7}.example.org/p/{k}" for k in range(200)] + [None, "", "junk", "http://a.bad.net/x?b=1&a=2", "http://bad.net", "http://xbad.net", "http://www.one.org/q/", "http://one.org/q#f", "http://one.org/r"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, "http://one.org/q", None)], "page_id long, url string, verdict string")
    entries = spark.createDataFrame([("host:bad.net",), ("one.org/q",), ("one.org/q",), ("junk",), (None,), ("h3.example.org/p/3",)] + [(f"z{k}.org/",) for k in range(500)], "entry string")
    want = {"http://a.bad.net/x?b=1&a=2": "host", "http://bad.net": "host", "http://www.one.org/q/": "url", "http://one.org/q#f": "url", "junk": "url", "http://h3.example.org/p/3": "url"}
    got = plain(urlfilter.look_up(pages, entries).select("page_id", "verdict"))
    assert got == sorted([(k, want.get(u, None if u is None else "none")) for k, u in enumerate(urls)] + [(None, "url")], key=repr)
    assert urlfilter.drop_listed(pages, entries).count() == len(urls) + 1 - 7
    assert urlfilter.look_up(pages, empty(entries)).where("verdict <> 'none'").count() == 0 and urlfilter.look_up(empty(pages), entries).count() == 0
    assert urlfilter.overused(empty(pages)).count() == 0


def test_colliding_digests_are_told_apart(tmp_path):
    keys = np.array([5, 5, 5, 9], np.uint64)
    raw = [b"a", b"bb", b"", b"c"]
    np.save(open(tmp_path / "s.keys", "wb"), keys)
    np.save(open(tmp_path / "s.at", "wb"), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    (tmp_path / "s.text").write_bytes(b"".join(raw) + b"\0")
    s = urlfilter.Segment(str(tmp_path), "s")
    assert s.holds(np.array([5, 5, 5, 9, 7], np.uint64), [b"bb", b"x", b"", b"c", b"a"]).tolist() == [True, False, True, True, False]


# --- 10, HTML

def test_tree_matching_is_maximal():
    def score(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
        for i, x in enumerate(a[1], 1):
            for j, y in enumerate(b[1], 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score(x, y))
        return 1 + best[-1][-1]

    r = random.Random(6)

    def tree(depth):
        return (r.choice("ab"), [tree(depth - 1) for _ in range(r.randrange(4))] if depth else [])

    def html(t):
        return f"<x{t[0]}>{''.join(map(html, t[1]))}</x{t[0]}>"

    m = htmlextract.Matcher()
    for _ in range(40):
        s, t = ("r", [tree(3) for _ in range(r.randrange(5))]), ("r", [tree(3) for _ in range(r.randrange(5))])
        a, b = m.parse(html(s)), m.parse(html(t))
        assert m.score(a.shape[0], b.shape[0]) == 1 + score(s, t)
    wide = ("r", [("a", [("b", [])] * (k % 3)) for k in range(80)]), ("r", [("a", [("b", [])] * (k % 4)) for k in range(70)])
    a, b = (m.parse(html(t)) for t in wide)
    assert m.score(a.shape[0], b.shape[0]) == 1 + score(*wide)


def page(title, paragraphs, k):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<!doctype html><html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><div id=top>Site name</div><nav><a href=/{k}>Link {k}</a></nav><div class='main'><h1>{title}</h1>{body}</div><div id=foot>&copy; all of us</div><!-- gone --></body></html>"


@pytest.mark.parametrize("limit", [htmlextract.BROADCAST_BYTES, 0])
def test_extraction(spark, limit):
    rows = [(k, f"http://site.org/{k}", page(f"Title {k}", [f"text {k} {j}" for j in range(1 + k % 4)], k)) for k in range(20)]
    rows += [(100, "http://lone.org/", page("Lone", ["one & only"], 1)), (101, None, "<p>free</p>"), (102, "http://site.org/n", None), (103, "http://site.org/e", ""), (None, "http://site.org/x", "<b>odd"), (104, "junk", "<p>a</p><p>b")]
    rows += [(105, "http://deep.org/", "<div>" * 3000 + "deep" + "</div>" * 3000), (106, "http://deep.org/2", "<ul>" + "<li>item" * 4000 + "</ul>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("slots"), F.lit(3).alias("content"))
    got = {r["page_id"]: r for r in htmlextract.extract(d, broadcast_bytes=limit).collect()}
    assert len(got) == len(rows)
    for k in range(20):
        assert got[k]["content"].split("\n") == [f"Title {k}", *(f"text {k} {j}" for j in range(1 + k % 4))] and got[k]["template_nodes"] == 2
    assert got[100]["content"] == "Site name\nLone\none & only\n© all of us" and got[101]["content"] == "free" and got[102]["content"] is None and got[103]["content"] == ""
    assert got[None]["content"] == "odd" and got[104]["content"] == "a\nb" and got[105]["content"] == "deep" and got[106]["content_nodes"] == 4000
    assert htmlextract.extract(d.limit(0)).count() == 0


def words_of(source):
    """A DOM by the standard library's parser, as (name, class and id, children or text)."""
    from html.parser import HTMLParser

    root = ("", "", [])
    stack = [root]

    class P(HTMLParser):
        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            node = (tag, (a.get("class"), a.get("id")), [])
            stack[-1][2].append(node)
            if tag not in ("br", "img"):
                stack.append(node)

        def handle_endtag(self, tag):
            stack.pop()

        def handle_data(self, data):
            if data.strip():
                stack[-1][2].append(("#", "", " ".join(data.split())))

    P().feed(source)
    return root


def best_match(a, b):
    """((nodes, equal subtrees, equal classes), pairs of texts) of a best match of two trees of equal name, by plain recursion."""
    if a[0] != b[0]:
        return None
    if a[0] == "#":
        return 1, [(a, b)]
    x, y = a[2], b[2]
    got = {}
    best = [[(0, 0, 0)] * (len(y) + 1) for _ in range(len(x) + 1)]
    add = lambda s, t: tuple(map(sum, zip(s, t)))
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            m = got[i, j] = best_match(c, d)
            options = [best[i][j + 1], best[i + 1][j]]
            if m:
                options.append(add(best[i][j], (m[0], c == d, c[:2] == d[:2])))
            best[i + 1][j + 1] = max(options)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        m = got[i - 1, j - 1]
        if m and best[i][j] == add(best[i - 1][j - 1], (m[0], x[i - 1] == y[j - 1], x[i - 1][:2] == y[j - 1][:2])):
            pairs += m[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[-1][-1][0], pairs


def test_whole_extraction_against_brute_force(spark):
    r = random.Random(9)

    def made(k):
        ad = f"<div class='ad'>Buy {r.randrange(1000)}</div>" if r.random() < 0.5 else ""
        items = "".join(f"<li id='item-{k}-{j}'><b>Row {k} {j}</b><i>More</i></li>" for j in range(r.randrange(1, 7)))
        paragraphs = "".join(f"<p>Text {k} {j} {r.randrange(100)}</p>" for j in range(r.randrange(4)))
        return f"<html><body class='post postid-{k}'><div id='top'>Site</div>{ad}<h1>Title {k}</h1><p class='by'>Written by us</p>{paragraphs}<ul class='list-{k}'>{items}</ul><div class='foot'><p>All rights</p><p>Page {k}</p></div></body></html>"

    rows = [(k, made(k)) for k in range(30)]
    d = spark.createDataFrame([(k, "http://one.org/x", h) for k, h in rows], "page_id long, url string, html string")
    got = {x["page_id"]: x for x in htmlextract.extract(d).collect()}
    ref, trees = words_of(rows[0][1]), {k: words_of(h) for k, h in rows}

    def texts(t):
        return [t] if t[0] == "#" else [x for c in t[2] for x in texts(c)]

    aligned, same, pairs = Counter(), Counter(), {}
    for k, t in trees.items():
        pairs[k] = {id(q): p for p, q in best_match(ref, t)[1]}
        for q in texts(t):
            p = pairs[k].get(id(q))
            if p:
                aligned[id(p)] += 1
                same[id(p)] += p[2] == q[2]
    constant = {p for p, n in aligned.items() if n > 1 and n >= 15 and same[p] >= 0.9 * n}
    for k, t in trees.items():
        want = [q[2] for q in texts(t) if not ((p := pairs[k].get(id(q))) and id(p) in constant and p[2] == q[2])]
        assert got[k]["content"].split("\n") == want and "Site" not in want and "All rights" not in want and f"Title {k}" in want


def test_layouts_of_a_host_have_templates_of_their_own(spark):
    rows = [(k, f"<body class='single postid-{k}'><header>Head</header><article><h1>A{k}</h1><p>t{k}</p></article><div>Foot</div></body>") for k in range(10, 20)]
    rows += [(k, f"<body class='archive page-{k}'><header>Head</header><main><ul><li>Posts</li><li>L{k}</li></ul></main><div>Other foot</div></body>") for k in range(20, 26)]
    rows += [(0, "<body><form>Sign in</form><p>Welcome back</p><div>Foot</div></body>")]
    d = spark.createDataFrame([(k, "http://one.org/", h) for k, h in rows] + [(k, "http://[::1]:80/", "<p>v6</p>") for k in (90, 91)], "page_id long, url string, html string")
    for limit in (htmlextract.BROADCAST_BYTES, 0):
        got = {x["page_id"]: x for x in htmlextract.extract(d, broadcast_bytes=limit).collect()}
        assert all(got[k]["content"] == f"A{k}\nt{k}" for k in range(10, 20)) and all(got[k]["content"] == f"L{k}" for k in range(20, 26))
        assert got[0]["content"] == "Welcome back" and got[90]["host"] == "[::1]" and got[91]["content"] == ""


def test_hostile_pages_take_little_time(spark):
    import time

    bad = ["<div x=\"1\" '" * 80_000, "<div x=\"1\" '" * 80_000 + ">", "<a b='" * 150_000, "<!--" * 250_000, "<script>" * 120_000, "<p" * 400_000, "<" * 1_000_000, "<div>" * 200_000, "</x>" * 250_000, "<div>" * 90_000 + "</x>" * 120_000, "<p>a" * 200_000, "<i x = " * 140_000, "<b class=\"a\"" * 90_000]
    for source in bad:
        m = htmlextract.Matcher()
        reference = m.parse("<div><p>one</p><p>two</p></div>" * 5)
        for page in (source, source + "<p>end"):  # against a common page, then against one as bad
            began = time.process_time()
            tree = m.parse(page)
            m.align(reference, tree)
            assert time.process_time() - began < 5, page[:20]
            reference = tree
    wide = "<ul>" + "".join(f"<li class='c{k}' id='i{k}'>{k}</li>" for k in range(1700)) + "</ul>"
    began = time.process_time()
    a, b = m.parse(wide), m.parse(wide.replace("<li", "<b>x</b><li", 400))
    assert len(m.align(a, b)) == 1700 and time.process_time() - began < 5


def test_long_lists_are_aligned_whole():
    names, r = "pbi", random.Random(4)
    x = "".join(f"<{names[k % 3]}>{k}</{names[k % 3]}>" for k in range(600))
    y = "".join(f"<{names[k % 3]}>{k}</{names[k % 3]}>" + ("<u>new</u>" if r.random() < 0.2 else "") for k in range(600) if r.random() < 0.9) + "<div>last</div>"
    for cells in (htmlextract.CELLS, 5_000):
        m = htmlextract.Matcher(cells=cells)
        a, b = m.parse(x + "<div>last</div>"), m.parse(y)
        pairs = m.align(a, b)
        assert len(pairs) == b.text.count("last") + sum(t is not None and t.isdigit() for t in b.text)
        assert all(a.text[p] == b.text[q] for q, p in pairs.items())
    deep = htmlextract.Matcher()
    a, b = (deep.parse("<div>" * n + "<p>in" + "</div>" * n + "<p>out") for n in (3000, 2900))
    assert len(deep.align(a, b)) == 1


def test_extraction_of_hostile_tables(spark, hostile, prose):
    d = hostile.withColumnRenamed("doc_id", "page_id").withColumn("html", F.col("text")).withColumn("url", F.when(F.col("lang") == "en", "http://h.org/")).drop("slots", "host").withColumn("slots", F.lit("a"))
    got = htmlextract.extract(d).collect()
    assert len(got) == d.count() and sum(x["content"] is None for x in got) == 3
    tie = spark.createDataFrame([(1, "http://t.org", "<p>b</p><p>x</p>"), (1, "http://t.org", "<p>a</p><p>x</p>"), (1, "http://t.org", "<p>a</p><p>x</p>"), (None, "http://t.org", "<p>0</p><p>x</p>")], "page_id long, url string, html string")
    assert sorted(x["content"] for x in htmlextract.extract(tie).collect()) == ["0", "a", "a", "b"]
    assert htmlextract.extract(empty(d)).count() == 0
