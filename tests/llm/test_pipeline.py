"""The pipeline's stages against plain versions, each on its own input."""

import os
import re

import corpus_pipeline
from pyspark.sql import functions as F
from lexiloom.llm import registry

from tests.llm.test_llm_operators import brute_leaks
from tests.llm.test_simhash_similar import brute_groups

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text or "" for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k == len(corpus_pipeline.STAGES) - 1:
            rows = {r.doc_id: r for r in out.collect()}
            assert set(rows) == set(kept) and all(r.lossless for r in rows.values())
            break
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        now = {r.doc_id: r.text or "" for r in docs.collect()}
        assert all(now[d] == kept[d] for d in now)
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            gone = set(kept) - set(now)
            assert sum(labels.get(d) == 0 for d in gone) <= 1
        if name == "exact_dedup":
            first = {}
            for d in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", kept[d]), d)
            assert set(now) == set(first.values())
        if name == "near_dedup":
            ids = sorted(kept)
            assert set(now) == {ids[r] for r in brute_groups([kept[d] for d in ids])}
        if name == "decontamination":
            leaks = {d for d, *_ in brute_leaks(kept.items(), benchmark)}
            assert set(now) == set(kept) - leaks
        kept = now


ODD = [
    (1, "a", "x"), (5, "a", None), (5, "b", "y"), (None, "a", "x"), (5, None, "x"), (6, "", "x"), (1, "a", "x"),
    (8, "word " * 40, "x"), (9, "word " * 40, "x"), (9, "WORD " * 41, "x"), (10, "so here is the whole test item again", "x"),
    (None, "the whole test item", "x"), (11, "other " * 30_000, "x"), (12, "\u2581 \U0001f600\x00", None),
]


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # names that the stages use themselves
    for c in ("h", "t", "node", "content", "gone_id", "gone_text", "own_id", "own_hash", "kept", "first", "size"):
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, None), (None, 1), (1, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the whole test item"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_run_on_odd_rows(spark, tmp_path):
    docs = odd_tables(spark, f"file://{tmp_path}", ODD)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = sorted((str(r.doc_id), (r.text or "")[:8]) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    left = lambda rows: sorted((str(d), (t or "")[:8]) for d, t, _ in rows)
    assert seen["toxicity"] == left(ODD)
    # one of the two rows (1, "a") stays, (5, "a") goes, (5, "b") and rows with a null id stay; null is empty
    assert seen["exact_dedup"] == left(r for k, r in enumerate(ODD) if k not in (1, 5, 6, 8))
    assert seen["near_dedup"] == left(r for k, r in enumerate(ODD) if k not in (1, 5, 6, 8, 9))
    assert seen["decontamination"] == left(r for k, r in enumerate(ODD) if k not in (1, 5, 6, 8, 9, 10, 11))
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(d for d, _ in seen["decontamination"])
    assert all(r.lossless for r in got) and {r.doc_id: len(r.ids) for r in got}[5] <= 2
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {n for n in os.listdir(shared) if "-" in n}
    corpus_pipeline.run(spark, f"file://{tmp_path}")
    # beside Spark's own checkpoints only the result's folder is left
    assert len([n for n in set(os.listdir(shared)) - before if not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", n)]) == 1
    odd_tables(spark, f"file://{tmp_path}/none", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []


def test_registry_matches_its_sql(spark, duck):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, DATA)
        columns = sorted(df.columns)
        want = duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(want, key=repr), name
