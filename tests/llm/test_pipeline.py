import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from auditlake.llm import bpe, common, decontam, quality, simhash, tokencount
from auditlake.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import brute_leaks

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "decontamination", "bpe"]
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, prose):
    """A small corpus with a case for each stage."""
    folder = tmp_path_factory.mktemp("sf")
    clean = {k: prose(120, 100 + k) for k in range(30)}
    junk = {k: " | ".join(prose(120, 100 + k).split()) for k in range(30, 50)}
    item = prose(30, 999)
    words = clean[5].split()
    words[10] = words[60] = "changed"
    planted = {50: clean[3], 51: " ".join(words), 52: prose(40, 7) + " " + item + " " + prose(40, 8), 53: junk[30]}
    docs = [(k, t, "en", "s", len(t)) for k, t in (clean | junk | planted).items()] + [(54, None, "en", "s", None), (None, prose(90, 55), None, None, 1), (0, clean[0], "en", "s", len(clean[0]))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit(1).alias("kept")).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 30), 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).schema == docs.schema
        assert stage(spark, docs.limit(0), tables).count() == 0
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = [tuple(r)[:2] for r in docs.collect()]
    scores = quality._scores([t for _, t in rows], model, common.HashCache())
    rows = [r for r, s in zip(rows, scores) if s >= quality.THRESHOLD and r[1] is not None]
    assert {i for i, _ in rows} == {*range(30), 50, 51, 52, None}
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t, i)
    rows = [(i, t) for t, i in first.items()]
    flat, at = common.hashed_tokens([t for _, t in rows], common.HashCache())
    sk = simhash.sketches(flat, at)
    near = lambda a, b: int(sum(bin(x ^ y).count("1") for x, y in zip(sk[a].tolist(), sk[b].tolist()))) <= simhash.RADIUS
    rows = [r for k, r in enumerate(rows) if r[0] is None or not any(o[0] is not None and o[0] < r[0] and near(k, j) for j, o in enumerate(rows))]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_leaks(rows, items, decontam.RATIO)}
    enc = tokencount.encoding(tokencount.VOCABULARY)
    want = sorted(((i, enc.encode_ordinary(t)) for i, t in rows if i not in bad), key=repr)
    got = corpus_pipeline.run(spark, tables)
    assert sorted(((r["doc_id"], r["token_ids"]) for r in got.collect()), key=repr) == want
    assert {i for i, _ in want} == {*range(30), None}
    assert dict(bpe.encode(docs).dtypes)["token_ids"] == "array<int>"


def test_pipeline_without_labels_or_benchmark(spark, tables, tmp_path):
    """Without labels no document is rejected but those without text, and without a benchmark none is contaminated."""
    for t in ("documents", "labels", "benchmark"):
        d = spark.read.parquet(f"{tables}/{t}.parquet")
        (d if t == "documents" else d.limit(0)).write.parquet(f"{tmp_path}/{t}.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 1, 30, 52, None} <= got and not {50, 51, 53, 54} & got


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in ORACLE_SQL:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        c = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in c.description]
        assert sorted(names) == sorted(got.columns) and sorted(tuple(str(r[n]) for n in names) for r in rows) == sorted(tuple(map(str, r)) for r in c.fetchall())
    elif name != "op1_decontamination":
        table = "pages" if name.startswith("op10") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
