import numpy as np
import pytest

from tessella.llm import neargraph, topk
from pyspark.sql import functions as F


def brute_top(rows, wanted, k):
    rows = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    by = {}
    for i, v in rows:
        by[i] = min(by.get(i, v), v)
    out = []
    for i, v in by.items():
        if wanted(i):
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in by.items() if j != i and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block_rows", [(8192, 8192), (40, 3), (16, 100)])
def test_top_k(spark, shard_rows, block_rows):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(9)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, rows[3][1]), (50, rows[50][1]), (404, [0.5, 0.25]), (450, [1.0, -1.0]), (451, []), (500, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("shard", F.lit(1))
    found = topk.top_k(vectors, F.col("id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows, lambda i: i % 50 == 0, 5)
    assert topk.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 5.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    scores = {r["vec_id"]: r["score"] for r in topk.top_k(huge, F.col("id") == 0).collect()}
    assert scores == {1: 768000000 * 512000000 + 256 * 1280, 2: -(2**63)}


def test_bounds_hold():
    rng = np.random.default_rng(6)
    points, queries = rng.standard_normal((500, 16)), rng.standard_normal((20, 16))
    tree = topk.BallTree(points)
    upper = tree.bounds(queries)
    assert sorted(x for _, rows in tree.leaves for x in rows) == list(range(500))
    for k, (_, rows) in enumerate(tree.leaves):
        assert ((points[rows] @ queries.T).max(0) <= upper[k]).all()


def brute_links(rows, threshold=0.93):
    fit = {n: (label, np.array(v, float)) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(np.array(v, float))}
    near = {n: [m for m, (lm, w) in fit.items() if m != n and lm == label and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold] for n, (label, v) in fit.items()}
    component = {}
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        component[n] = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
    return sorted(((i, len(near.get(n, [])), component[n]) for n, (i, _, _) in enumerate(rows)), key=str)


def cases():
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1, 2):
        for _ in range(60):
            rows.append((len(rows), rng.standard_normal(16), label))
        for size in (2, 3, 25):
            center = rng.standard_normal(16)
            rows += [(len(rows) + k, center + 0.08 * rng.standard_normal(16), label) for k in range(size)]
        copy = rng.standard_normal(16)
        rows += [(len(rows) + k, copy, label) for k in range(12)]
    rows = [(i, [float(x) for x in np.float32(v)], label) for i, v, label in rows]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, rows[0][1], 1), (None, rows[0][1], 0), (905, [None] * 16, 1), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_rows": 16, "part_rows": 20}])
def test_near_duplicates(spark, options):
    rows = cases()
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("cluster", F.lit(1))
    found = neargraph.near_duplicates(vectors, **options)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()), key=str)
    expected = brute_links(rows)
    assert [g[0] for g in got] == [e[0] for e in expected]
    want = {str(e[0]): e[1:] for e in expected}
    links = [(g[1], want[str(g[0])][0]) for g in got]
    assert all(a <= b for a, b in links) and sum(a for a, _ in links) >= 0.97 * sum(b for _, b in links)
    assert sum(g[2] == want[str(g[0])][1] for g in got) >= 0.97 * len(got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.collect() if r["vec_id"] is not None)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neargraph.near_duplicates(empty).count() == 0


def planted(n_base=2600, dim=64, labels=2, seed=4):
    """Vectors far apart, noisy copies of some in groups of two to hundreds, cosines from 0.9 to 1."""
    rng, out = np.random.default_rng(seed), []
    unit = lambda x: x / np.sqrt((x**2).sum(-1, keepdims=True))
    for label in range(labels):
        base = unit(rng.standard_normal((n_base, dim)))
        rows = [base]
        for k, size in enumerate([1] * 400 + [5] * 60 + [40] * 8 + [300]):
            noise = rng.uniform(0.05, 0.42) / dim**0.5 if size < 300 else 0.2 / dim**0.5
            rows.append(unit(base[k] + noise * rng.standard_normal((size, dim))))
        out += [(v, label) for v in np.concatenate(rows)]
    return [(k, [float(x) for x in out[i][0]], out[i][1]) for k, i in enumerate(rng.permutation(len(out)))]


@pytest.mark.parametrize("shard_rows, overlap", [(64, 8), (24, 8), (64, 2)])
def test_recall(spark, shard_rows, overlap):
    rows = planted()
    labels, v = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    true = np.zeros((len(rows), len(rows)), bool)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        true[np.ix_(own, own)] = v[own] @ v[own].T >= 0.93
    np.fill_diagonal(true, False)
    vectors, report = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), {}
    found = neargraph.near_duplicates(vectors, shard_rows=shard_rows, overlap=overlap, report=report).collect()
    got = np.zeros(len(rows), np.int64)
    for r in found:
        got[r["vec_id"]] = r["n_links"]
    want = true.sum(1)
    assert (got <= want).all() and want.sum() > 100_000 and (want > 0).sum() > 2000
    few = want < 100  # groups of every size count, not the largest alone
    recall = got.sum() / want.sum(), got[few].sum() / want[few].sum()
    assert min(recall) >= 0.9 and report["recall"] >= 0.9 and report["true_links"] > 0 and abs(report["recall"] - recall[0]) < 0.1


def test_no_recall_without_links(spark):
    vectors, report = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), {}
    assert neargraph.near_duplicates(vectors, report=report).where("n_links > 0").count() == 0
    assert report["recall"] is None and report["true_links"] == 0


def test_many_clusters(spark):
    """At least fifty shards a label, and none of more than part_rows rows but dense ones."""
    rows = planted()
    reps = spark.createDataFrame([(k, 1, v, label) for k, v, label in rows], "id long, copies long, v array<double>, cell long")
    sizes = {r["cell"]: r["count"] for r in neargraph.clusters(reps, 32, 128, 0.07, 8).groupBy("cell").count().collect()}
    assert len(sizes) >= 100 and np.median(list(sizes.values())) < 400
    dense = [(k, 1, [1.0, k * 1e-4], 7) for k in range(3000)]
    held = neargraph.clusters(spark.createDataFrame(dense, "id long, copies long, v array<double>, cell long"), 32, 128, 0.07, 8)
    assert held.count() == 3000 and held.select("cell").distinct().count() == 1


def test_pruning_keeps_ways():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 12))
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    links = neargraph.build(v)
    assert links.shape[1] == neargraph.DEGREE + neargraph.FAR_LINKS and (links < 400).all() and all(k not in row for k, row in enumerate(links[:, : neargraph.DEGREE]))
    found = neargraph.search(v, links, v, np.full(400, -1), 0.999)
    assert found.diagonal().mean() > 0.8  # from the medoid alone
