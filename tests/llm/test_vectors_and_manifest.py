"""Clustering, manifest and neighbours against brute force, on the smallest tables and on odd input."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from legwork.llm import clustering, merkle, neighbours
from legwork.llm.oracles import clustering_sql, merkle_sql

SF = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<float>, label int, cluster int, distance long, node long, q long, id long, v string"


def vectors(spark, rows):
    """Vectors beside columns whose names the operators use too."""
    return spark.createDataFrame([(i, v, 0, 9, 9, 9, 9, 9, "x") for i, v in rows], VEC)


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            own = [v for (_, v), c in zip(kept, near, strict=True) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(e for _, o, e in found if o == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("block", [4096, 7])
def test_clusters_of_odd_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-3, 3) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(40)]  # copies
    rows += [(7, rows[7][1]), (None, [0.5, 0.5, 0.5]), (200, None), (201, []), (202, [1.0, 2.0]), (203, [1.0, None, 2.0]), (204, [NAN, 0.0, 0.0]), (205, [INF, 0.0, 0.0]), (206, [-0.0, 0.0, -1e-9]), (207, [1.0] * 4)]
    got = clustering.report(vectors(spark, rows), k=4, rounds=3, dims=3, scale=16.0, seed=1)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 4, 3, 3, 16.0, 1)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])]
    got = clustering.report(vectors(spark, rows), k=8, rounds=2, dims=2, scale=1.0, seed=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows, 8, 2, 2, 1.0, 3)
    assert clustering.report(vectors(spark, []), dims=2).collect() == []
    assert clustering.report(vectors(spark, [(1, None)]), dims=2).collect() == []


def test_components_that_could_overflow_raise(spark):
    with pytest.raises(Exception, match="would not fit in a long"):
        clustering.report(vectors(spark, [(1, [1e30, 0.0])]), dims=2).collect()


def test_tables_give_the_distances():
    v = np.random.default_rng(1).integers(-9, 9, (50, 6))
    c = np.random.default_rng(2).integers(-9, 9, (3, 6))
    block = clustering.Block(clustering.encoded(list(range(50)), v))
    assert (block.vectors() == v).all()
    assert (block.distances(c) == ((v[:, None] - c[None]) ** 2).sum(2)).all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def same(df, found):
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_clusters_equal_sql(spark, duck):
    same(clustering.report(spark.read.parquet(f"{SF}/embeddings.parquet")), duck.execute(clustering_sql()))


def test_manifest_equals_sql(spark, duck):
    same(merkle.report(spark.read.parquet(f"{SF}/documents.parquet")), duck.execute(merkle_sql(6, 4)))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(level, i, path):
    """Root of a list of digests, and the siblings on the way of the i-th."""
    while len(level) > 1:
        run = i - i % 3
        path.append((level[run:i], level[i + 1 : run + 3]))
        level, i = [sha("".join(level[j : j + 3])) for j in range(0, len(level), 3)], i // 3
    return level[0]


def brute_manifest(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    none_first = lambda x: (x is not None, x if x is not None else 0)
    leaf = lambda r, text: sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, leaf(r, r[1])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: (none_first(x[0][0]), x[1]))
    subroots = [climb([h for _, h in groups[s]], 0, []) for s in order]
    out = []
    for g, s in enumerate(order):
        for i, (r, h) in enumerate(groups[s]):
            path = []
            climb([x for _, x in groups[s]], i, path)
            root = climb(subroots, g, path)
            fold = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                fold = leaf(r, None if r[1] is None else r[1].replace("\n", ""))
            for before, after in path:
                fold = sha("".join([*before, fold, *after]))
            out.append((r[0], h, subroots[g], root, sha("".join("".join([*b, *a]) for b, a in path)), fold, fold == root))
    return sorted(out, key=repr)


DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place long, node long, base long, n long, run string"


def manifest(spark, rows):
    got = merkle.report(spark.createDataFrame([(*r, "x", 1, 1, 1, 1, "y") for r in rows], DOC))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest_of_odd_rows_equals_brute_force(spark):
    rows = [(i, f"text {i}\nline" if i % 2 else f"text {i}", "en", "hot", 5) for i in range(40)]
    rows += [(i, "äöü\n\n" * 3, None, ("b", "a", "", "Ä")[i % 4], None) for i in range(100, 108)]
    rows += [(200, None, "en", None, 1), (201, "", "en", None, 0), (None, "no id\n", "en", "a", 1), (None, "no id\n", "en", "a", 1), (5, "same id", "en", "hot", 1), (300, "alone\n", "de", "single", 1), (301, "x\n" * 30000, "de", "long", 60000)]
    assert manifest(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(n)]
    assert manifest(spark, rows) == brute_manifest(rows)


def test_the_row_limit_of_recursive_queries_is_restored(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    manifest(spark, [(i, "a", "en", "s", 1) for i in range(5)])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def exact_neighbours(rows, k, every):
    whole = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in whole:
        if i % every == 0:
            near = sorted((-sum(np.float64(x) * np.float64(y) for x, y in zip(v, w, strict=True)), j) for j, w in whole if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {q for q, near in want.items() if near}
    hits = 0
    for q, rs in found.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(want[q]) + 1))
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        assert all(r["vec_id"] != q for r in rs)
        hits += len({r["vec_id"] for r in rs} & {j for j, _ in want[q]})
    return hits / max(1, sum(map(len, want.values())))


def test_neighbours_of_the_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    got = neighbours.neighbours(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert recall(got.collect(), exact_neighbours(rows, 20, 20)) >= 0.95


def test_neighbours_of_odd_vectors(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) * (1 + i % 3) for _ in range(8)]) for i in range(150)]  # lengths differ: inner product, not cosine
    rows += [(i, rows[3][1]) for i in range(200, 300)]  # a third are copies
    rows += [(20, rows[20][1]), (None, rows[1][1]), (400, None), (420, []), (440, [0.0] * 8), (460, [1.0, None] * 4), (480, [NAN] + [0.0] * 7), (500, [INF] + [0.0] * 7), (520, [1.0, 2.0]), (521, [2.0, 1.0]), (540, [7.0])]
    got = neighbours.neighbours(vectors(spark, rows)).collect()
    want = exact_neighbours(rows, 20, 20)
    assert recall(got, want) >= 0.99
    pairs = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    for q, near in want.items():
        assert all(math.isclose(pairs[q, j], s, rel_tol=1e-12, abs_tol=1e-12) for j, s in near if (q, j) in pairs)
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 520] == [(521, 4.0)]


def test_neighbours_search_walks_the_graph(spark, monkeypatch):
    """Rounds refine the first lists, small parts lose nothing, and few nodes are opened."""
    monkeypatch.setattr(neighbours, "PART", 8)
    monkeypatch.setattr(neighbours, "RUN", 16)
    draw = np.random.default_rng(9)
    rows = [(int(i), v.tolist()) for i, v in enumerate(draw.normal(size=(1500, 12)))]
    index = neighbours.build(vectors(spark, rows), k=10, degree=24, tables=2)
    assert index.rounds >= 2
    got = neighbours.search(index, index.rows.where("id % 20 = 0"), k=10, beam=32, opened=4).collect()
    assert recall(got, exact_neighbours(rows, 10, 20)) >= 0.9


def test_neighbours_of_empty_and_single(spark):
    assert neighbours.neighbours(vectors(spark, [])).collect() == []
    assert neighbours.neighbours(vectors(spark, [(20, [1.0, 0.0])])).collect() == []
    got = neighbours.neighbours(vectors(spark, [(20, [1.0, 0.0]), (40, [1.0, 0.0])])).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(20, 1, 40, 1.0), (40, 1, 20, 1.0)]
