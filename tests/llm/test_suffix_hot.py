"""Texts that share one representative: equality, hot ranks, and keys that go on over batches."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.llm import suffix_dedup

from tests.llm.test_llm_operators import brute_repeats

ONE = "njvaobrbzzllszdz uvh  fqpyvq  nsmdkjjgmmupvznjpepeyabgfbmp ykfyeppatwo s nlby  b gtgf cubvwpqykyyyzzvzrngmck tdwrip fvlrznyj fkxvzgiqknp v oaesyo wjyrazhf ctprmwniijpct s"
TWO = "vpjbgn  qjmipqion  tmvd svbsfrtgzkhopjbxpv gakmjxezczghwermjkfyeppatwo s nlby  b gtgf cubvwpqykyyyzzvzrngmck t wixwxb j xdqfbgur u  ngjksip oxctw  tgck py fyawrg z oguyxq"


def test_texts_without_a_common_string_stay_whole(spark):
    got = suffix_dedup.repeated_passages(spark.createDataFrame([(1, ONE), (2, TWO)], "doc_id long, text string"))
    assert [(r.n_bytes, r.n_removed) for r in got.collect()] == [(170, 0), (170, 0)]


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_one_core_in_many_surroundings(spark, monkeypatch, hot):
    """All texts share 110 bytes; with a low threshold nearly every rank is hot, with a high one none."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    core = word(110)
    near = [word(30) for _ in range(5)]
    rows = [(k, word(rnd.randint(0, 80)) + rnd.choice(near) + core + rnd.choice(near) + word(rnd.randint(0, 80))) for k in range(120)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = brute_repeats([(k, t.encode()) for k, t in rows], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 10000


def test_settle_does_not_depend_on_batches():
    rnd = np.random.default_rng(5)
    rows = sorted((int(k), int(f), int(d), 0, int(n)) for k, f, d, n in zip(rnd.integers(0, 12, 300), rnd.integers(0, 3, 300), rnd.integers(0, 99, 300), rnd.integers(1, 9, 300)))
    rows = sorted({r[:3]: r for r in rows}.values())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.int32(),))], names=["k", "f", "doc", "pos", "n"])

    def found(size):
        out = suffix_dedup.settle(True)(batch.slice(a, size) for a in range(0, batch.num_rows, size))
        return sorted((d, kind) for b in out for d, kind in zip(b["doc"].to_pylist(), b["kind"].to_pylist()))

    several = {k for k, *_ in rows if len({f for kk, f, *_ in rows if kk == k}) > 1}
    opened = [min(r[2] for r in rows if r[:2] == kf) for kf in {r[:2] for r in rows} if kf[0] in several]
    whole = found(1000)
    assert sorted(d for d, kind in whole if kind == suffix_dedup.OPEN) == sorted(opened)
    assert {kind for _, kind in whole} == {suffix_dedup.OPEN, suffix_dedup.COVERED}
    for size in (1, 2, 5, 50):
        assert [x for x in found(size) if x[1] == suffix_dedup.OPEN] == [x for x in whole if x[1] == suffix_dedup.OPEN]
