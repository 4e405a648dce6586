"""The pipeline's near-copy stage against brute force."""

import itertools
import random
import re

import corpus_pipeline
import numpy as np
from lexiloom.llm import simhash_similar

from tests.llm.test_llm_operators import closure

DATA = "/root/testdata/sf0.001"


def brute_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return closure(len(sets), near)


def test_stage_drops_what_is_alike(spark):
    """Copies with a few words changed lie within 0.8 of five-word shingles, not within 3 bits."""
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for k in range(150):
        base = texts[rnd.randrange(len(texts))].split() if k > 20 and k % 2 else [rnd.choice(words) for _ in range(rnd.randint(0, 300))]
        for _ in range(len(base) * rnd.randint(0, 5) // 200):
            base[rnd.randrange(len(base))] = "Edit"
        texts.append(" ".join(base))
    texts += ["", None, "One two", "one  TWO", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = brute_groups(texts)
    assert len(set(root)) < 110
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(root)


def test_second_round_joins_what_the_first_of_a_band_does_not(spark, monkeypatch):
    """One band for all: its first text is far from most, which are near one another."""
    monkeypatch.setattr(simhash_similar, "band_masks", lambda bits, bands: np.zeros((1, 4), np.uint64))
    rnd = random.Random(8)
    bases = [[f"{k}x{i}" for i in range(rnd.randint(80, 120))] for k in range(4)]
    texts = [" ".join(w if rnd.random() > 0.006 else "edit" for w in rnd.choice(bases)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash_similar.similar_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(brute_groups(texts)))


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(3, long), (5, long + " more"), (5, "something else"), (None, long + " again"), (3, long)]
    got = simhash_similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([rows[0], rows[2], rows[3], rows[4]], "doc_id long, text string").collect())
    assert simhash_similar.drop_similar(got.limit(0)).count() == 0


def test_recall_and_ring_filter():
    """Of sets at 0.8 a band and the radius find 0.9 of those that the bits allow; the filter loses nothing within the radius."""
    rng = np.random.default_rng(9)
    x = [np.zeros(4000, np.uint64) for _ in range(4)]
    for row in range(4000):
        for bit in rng.choice(256, rng.integers(0, 90), replace=False):
            x[bit // 64][row] |= np.uint64(1 << int(bit % 64))
    count = sum(np.bitwise_count(w).astype(int) for w in x)
    assert (simhash_similar.ring_close(x) == (count <= simhash_similar.RADIUS)).all()
    bits, bands = simhash_similar.band_plan(50_000)
    masks = [sum(1 << int(b) for b in rng.choice(256, bits, replace=False)) for _ in range(bands)]
    found = total = 0
    for _ in range(400):
        both, own = rng.integers(0, 1 << 63, 340, dtype=np.uint64), [rng.integers(0, 1 << 63, 30, dtype=np.uint64) for _ in range(2)]
        a, b = (simhash_similar.wide_fingerprint(np.concatenate([both, o])) for o in own)  # similarity 0.85
        differ = sum(((p ^ q) & (1 << 64) - 1) << 64 * k for k, (p, q) in enumerate(zip(a, b)))
        total += 1
        found += differ.bit_count() <= simhash_similar.RADIUS and any(not differ & m for m in masks)
    assert found > 0.95 * total


def test_a_pair_belongs_to_its_first_shared_band():
    rng = np.random.default_rng(10)
    masks = simhash_similar.band_masks(12, 30)
    x = [rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) & rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(4)]
    whole = [sum(int(w[i]) << 64 * k for k, w in enumerate(x)) for i in range(len(x[0]))]
    bands = [sum(int(w) << 64 * k for k, w in enumerate(row)) for row in masks]
    assert {m.bit_count() for m in bands} == {12}
    want = [next((k for k, m in enumerate(bands) if not differ & m), len(bands)) for differ in whole]
    assert len(set(want)) == 31 and simhash_similar.first_shared(x, masks).tolist() == want


def test_parities_never_part_sets_that_are_alike():
    """Pairs around the level: none that is alike is lost, sets just below it mostly are; empty sets pass."""
    rng = np.random.default_rng(11)
    lost = kept_below = below = alike = 0
    for k in range(3000):
        n = int(rng.integers(1, 400))
        own = [int(rng.integers(0, n // 5 + 2)) for _ in range(2)]
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, o, dtype=np.uint64)])) for o in own)
        odd = [np.array([p ^ q]).view(np.uint64) for p, q in zip(simhash_similar.parities(a), simhash_similar.parities(b))]
        passed = simhash_similar.may_be_alike(odd, np.array([len(a) + len(b)]))[0]
        similar = simhash_similar.alike(a, b)
        alike += similar
        lost += similar and not passed
        far = len(np.intersect1d(a, b)) < 0.75 * len(np.union1d(a, b)) and 80 < n < 200
        below, kept_below = below + far, kept_below + (far and passed)
    assert alike > 500 and lost == 0 and below > 50 and kept_below < below / 2
    none = np.empty(0, np.uint64)
    assert simhash_similar.may_be_alike([np.zeros(1, np.uint64)] * 4, np.array([0]))[0] and simhash_similar.parities(none) == [0] * 4


def test_large_keys_are_cut_into_blocks(spark, monkeypatch):
    """All sets behind one key, in blocks of a few: the same components, no pair twice and none lost."""
    monkeypatch.setattr(simhash_similar, "band_masks", lambda bits, bands: np.zeros((1, 4), np.uint64))
    rnd = random.Random(9)
    bases = [[f"{k}x{i}" for i in range(rnd.randint(80, 120))] for k in range(6)]
    texts = [" ".join(w if rnd.random() > 0.01 else "edit" for w in rnd.choice(bases)) for _ in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute_groups(texts)))
    proposed = []
    verified = simhash_similar.verified
    monkeypatch.setattr(simhash_similar, "verified", lambda pairs, *rest: verified(proposed.append(pairs) or pairs, *rest))
    seen = []
    for size in (7, 2048):
        monkeypatch.setattr(simhash_similar, "KEY_SETS", size)
        proposed.clear()
        assert {r.doc_id: r.component_id for r in simhash_similar.similar_groups(docs).collect()} == want
        seen.append(sorted((r.a, r.b) for r in proposed[-1].collect()))
    assert seen[0] == seen[1] and len(set(seen[0])) == len(seen[0])
