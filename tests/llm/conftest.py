import pytest

WORDS = "the of and to in that it is was for with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many fore must well back years".split()
CLASHES = "owner_id score kept group_id shard hops position segment row base rep sketch minima bucket node root n_tokens token_ids exact t i y x text_ rank s __gone".split()


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n pseudo-random words."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.7 else "") + ("." if r.random() < 0.1 else "") for _ in range(n))

    return make


@pytest.fixture(scope="session")
def hostile(spark, prose):
    """Documents with nulls in any column, empty, blank and very long texts, ties, repeated rows, odd characters and columns of clashing names."""
    long = prose(60_000, 1)
    rows = [
        (1, prose(80, 2), "en", "a", 5), (2, prose(80, 2), "en", "b", 5), (2, prose(80, 2), "en", "b", 5), (3, None, "en", "a", None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "", "de", "a", 0), (7, " \n\t ", "en", None, 4),
        (None, prose(80, 2), "en", "a", 5), (None, None, None, None, None), (None, "alone " + prose(30, 4), "en", "a", 1), (8, long, "en", "a", len(long)), (9, long + " end", "en", "a", 1), (10, long, "en", "a", 2), (11, "x", "en", "a", 1),
        (12, "日本語のテキスト" * 50, "ja", "a", 1), (13, "🙂" * 500, None, "a", 1), (14, "a\u0000b‮", "en", "a", 1), (15, "word " * 5000, "en", "a", 1), (16, "x" * 50_000, "en", "a", 1), (2, prose(90, 6), "en", "c", 5),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return d.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES))).cache()


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """Clean documents, and copies of some with a few words changed: (table, {copy: original})."""
    import random

    r, rows, pairs = random.Random(8), [], {}
    for k in range(150):
        rows.append((k, prose(r.randrange(60, 400), 1000 + k), "en", "s", 1))
    for k in range(150, 200):
        o = r.randrange(150)
        words = rows[o][1].split()
        for _ in range(max(1, len(words) // 33)):
            words[r.randrange(len(words))] = r.choice(WORDS) + "x"
        rows.append((k, " ".join(words), "en", "s", 1))
        pairs[k] = o
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache(), pairs
