"""Embedding near-duplicates, vector codes and ranked search: against brute force, and on the odd cases."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from lexiloom.llm import embedding_join, ranked_search, registry, vector_codes

INF, NAN = float("inf"), float("nan")
ODD = [
    (1, [1.0, 0.0], 0, "x"),
    (2, [2.0, 0.0], None, "x"),
    (2, [2.0, 0.0], None, "x"),
    (3, [0.95, 0.3], 1, None),
    (4, None, 1, "x"),
    (5, [], 1, "x"),
    (6, [0.0, -0.0], 1, "x"),
    (7, [1.0, None], 1, "x"),
    (8, [NAN, 1.0], 1, "x"),
    (9, [INF, 1.0], 1, "x"),
    (None, [-1.0, 0.001], 0, "x"),
    (11, [0.0, 0.0, 5.0], 0, "x"),
    (12, [3e38, 0.0], 0, "x"),
]
SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute_links(vectors, threshold):
    """(n_links, members of the component) of each vector by all pairs."""
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    width = max(len(v) for v, o in zip(vectors, ok) if o)
    x = np.array([list(v) + [0] * (width - len(v)) if o else [0] * width for v, o in zip(vectors, ok)], float)
    norm = np.sqrt((x * x).sum(1))
    x /= np.where(norm, norm, 1)[:, None]
    near = x @ x.T >= threshold
    near[~np.array(ok)] = near[:, ~np.array(ok)] = False
    np.fill_diagonal(near, False)
    out = []
    for k in range(len(x)):
        seen, todo = {k}, [k]
        while todo:
            for m in np.flatnonzero(near[todo.pop()]).tolist():
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((int(near[k].sum()), seen))
    return out


def clustered(n, width, seed):
    """Vectors in tight and loose groups, copies among them, and lone ones."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    spread = rng.choice([0.0, 0.02, 0.12, 0.3, 1.5], size=n)
    return (centres[rng.integers(0, 12, n)] + spread[:, None] * rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize("tile", [16, 4096])
def test_embedding_links_equal_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_join.links, "__defaults__", (embedding_join.THRESHOLD, tile))
    x = clustered(400, 40, 3)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == 400
    for k, (n, members) in enumerate(brute_links([v for _, v in rows], 0.9)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (n, min(members), k == min(members))


def test_embedding_odd_cases(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(df).collect()), key=repr)
    want = []
    for (k, v, *_), (n, members) in zip(ODD, brute_links([r[1] for r in ODD], 0.9)):
        ids = [ODD[m][0] for m in members if ODD[m][0] is not None]
        least = min(ids, default=None)
        want.append((k, n, least, k is not None and k == least))
    assert got == sorted(want, key=repr)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0
    assert embedding_join.near_vectors(df.where("vec_id = 4")).count() == 1


def test_bounds_of_leading_axes_lose_no_pair():
    x = embedding_join.unit(clustered(300, 64, 5).astype(float))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j, dot = embedding_join.linked_cells(x @ axes, x @ axes, True, 0.9)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)))}
    assert {(a, b) for a, b, d in zip(i, j, dot) if d >= 0.9} == want


def test_embedding_sql_on_copies(spark):
    x = clustered(150, 16, 8)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = sorted(map(tuple, embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    want = con.sql(f"select vec_id, n_links, component_id, kept from ({registry.oracle_sql()['op11_embedding_dedup']})").fetchall()
    assert got == sorted(want) and sum(r[1] for r in got)


# vector codes


def brute_codes(rows, rounds=6, parts=8, entries=16):
    """The contract in plain Python integers; rows are (vec_id, vector)."""
    size = -(-max(len(v) for _, v in rows) // parts)
    cut = [[[math.floor(4096 * x) for x in (list(v) + [0.0] * size * parts)[p * size : (p + 1) * size]] for p in range(parts)] for _, v in rows]
    first = sorted(range(len(rows)), key=lambda k: rows[k][0])[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for x in cut:
                met.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k])] if k in met else e for k, e in enumerate(books[p])]
    found = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return [("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for f in found], hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("width", [64, 24, 13])
def test_vector_codes_equal_plain_integers(spark, width):
    x = clustered(120, width, width)
    rows = [(int(k), v.tolist(), int(k) % 3 if k % 4 else None) for k, v in zip(np.random.default_rng(1).permutation(120), x)]
    got = {r.vec_id: r for r in vector_codes.encode_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want, digest = brute_codes([r[:2] for r in rows])
    sums = {}
    for (_, _, label), (_, error) in zip(rows, want):
        sums[label] = sums.get(label, 0) + error
    for (k, _, label), (code, error) in zip(rows, want):
        assert (got[k].code, got[k].error, got[k].label_error, got[k].codebooks_sha256) == (code, error, sums[label], digest)


def test_nearest_entry_by_transform_is_exact_with_ties():
    rng = np.random.default_rng(0)
    for size in (1, 3, 8):
        x, book = rng.integers(-4, 5, (500, size)), rng.integers(-4, 5, (16, size))
        entry, far = vector_codes.nearest(x, book)
        plain = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (entry == plain.argmin(1)).all() and (far == plain.min(1)).all()


def test_sequency_rows_are_orthogonal_and_in_order():
    h = vector_codes.sequency(16)
    assert (h @ h.T == 16 * np.eye(16, dtype=int)).all()
    assert ((np.diff(h, axis=1) != 0).sum(1) == np.arange(16)).all()


def test_vector_codes_odd_cases(spark):
    df = spark.createDataFrame([r for r in ODD if r[0] != 12], SCHEMA)
    got = vector_codes.encode_vectors(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1", "2", "2", "3", "5", "6", "None", "11"])
    assert all(r.error == 0 and len(r.code) == 16 for r in got)
    assert vector_codes.encode_vectors(df.limit(0)).count() == 0
    assert vector_codes.encode_vectors(df.where("vec_id = 4")).count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.encode_vectors(spark.createDataFrame(ODD, SCHEMA)).collect()


# ranked search


def brute_ranks(docs, items, top=10):
    """Every item's best documents by scoring all documents."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(k, words(t)) for k, t in docs]
    n_docs, length = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    out = []
    for item, text in items:
        scored = []
        for k, w in own:
            score = 0
            for t in set(words(text)):
                df, tf = sum(t in v for _, v in own), w.count(t)
                if tf:
                    m = 100 - 90 + (90 * len(w) * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, k is None, k or 0))
        out += [(item, rank, None if none else k, -s) for rank, (s, none, k) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [8, 64])
def test_ranked_search_equals_scoring_all(spark, shard, monkeypatch):
    monkeypatch.setattr(ranked_search.search_shards, "__defaults__", (shard,))
    rng = np.random.default_rng(shard)
    vocab = [f"w{k}" for k in range(60)] + ["Été", "中文", "WORD"]
    p = 1 / np.arange(1, len(vocab) + 1)
    text = lambda n: " ".join(rng.choice(vocab, n, p=p / p.sum()))
    docs = [(int(k), text(int(rng.integers(0, 40)))) for k in rng.permutation(150)]
    docs += [(200 + k, "w3 w9 w3 w40") for k in range(25)]
    items = [(k, text(int(rng.integers(1, 12)))) for k in range(20)] + [(50, "w3 w9"), (51, "nothing here"), (52, None)]
    got = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items)


def test_ranked_search_odd_cases(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (4, "A-b c", None), (4, "a b", "x"), (None, "a b", "x"), (7, "long " * 20000 + "b", "x"), (8, "...", "x")]
    items = [(1, "a b", 0), (1, "b", 0), (None, "c", 0), (3, "", 0), (4, None, 0), (5, "zzz", 0)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(items, "item_id long, text string, rank int")
    got = sorted(map(tuple, ranked_search.ranked(d, i).collect()), key=repr)
    assert got == brute_ranks([r[:2] for r in docs], [r[:2] for r in items])
    assert ranked_search.ranked(d.limit(0), i).count() == ranked_search.ranked(d, i.limit(0)).count() == 0
    assert ranked_search.ranked(d.where("doc_id = 1"), i).count() == 0


def test_items_are_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 2)
    docs, items = [(k, f"w{k} w{k % 3} common") for k in range(30)], [(k, f"w{k} common") for k in range(5)]
    got = ranked_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranks(docs, items)


def test_treap_children_match_the_grid():
    rng = np.random.default_rng(2)
    cells = {(int(r), int(c)): int(v) for r, c, v in zip(rng.integers(0, 20, 200), rng.integers(0, 50, 200), rng.integers(1, 99, 200))}
    row, col, value = (np.array(x) for x in zip(*((r, c, v) for (r, c), v in cells.items())))
    treap = ranked_search.Treap(row, col, value, 20, 50)
    for r in range(20):
        for c in range(50):
            at = np.zeros(1, np.int64)
            for level in range(treap.bits):
                shift = treap.bits - level - 1
                at = treap.child(level, at, np.array([(r >> shift & 1) << 1 | (c >> shift & 1)]))
            assert (int(treap.levels[-1].best[at[0]]) if at[0] >= 0 else None) == cells.get((r, c))
