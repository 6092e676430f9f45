"""Neighbours against brute force."""

import numpy as np
import pytest

from judgeloom.llm import ann


def plain(rows, queries, k=ann.K):
    """Nearest first by the inner product summed from left to right, ties to the smaller id; rows of equal id and vector once."""
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    held = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and good(v)})
    out = []
    for q, v in sorted({(i, tuple(map(float, v))) for i, v in queries if i is not None and good(v)}):
        found = sorted((-float(np.cumsum([a * b for a, b in zip(v, w, strict=True)])[-1]), i) for i, w in held if len(w) == len(v) and i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, of, k=ann.K, shard=ann.SHARD):
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int").repartition(3)
    queries = spark.createDataFrame([(i, v, 0) for i, v in of], "vec_id long, embedding array<double>, node int")
    got = ann.search(ann.index(ann.nodes(vectors, k), shard), queries, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_small_tables_are_exact_with_all_odd_cases(spark):
    rng = np.random.RandomState(0)
    rows = [(i, rng.randn(8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [rows[3], rows[3]] + [(7, rng.randn(8).tolist())]  # copies, repeated rows, an id with two vectors
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, float("nan")] + [0.0] * 6), (204, [float("inf")] + [0.0] * 7), (205, [None] + [1.0] * 7), (None, [1.0] * 8), (206, [1.0, 2.0, 3.0]), (220, [2.0, 1.0, 0.0]), (207, [5.0] * 8)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(7, rows[7][1]), (100, rows[0][1])]
    assert run(spark, rows, queries) == plain(rows, queries)
    assert run(spark, rows, queries, 3, 16) == plain(rows, queries, 3)


def test_recall_of_several_shards_and_lengths(spark):
    """Vectors of different lengths in clusters, in several shards of one graph each: recall against brute force, scores exact."""
    rng = np.random.RandomState(1)
    centres = rng.randn(30, 32)
    rows = [(i, (centres[i % 30] * rng.uniform(0.3, 2) + 0.7 * rng.randn(32)).tolist()) for i in range(6000)]
    rows += [(10_000 + i, rows[11][1]) for i in range(500)]  # a large group of copies
    queries = [r for r in rows if r[0] % 100 == 0]
    got, want = run(spark, rows, queries, shard=2500), plain(rows, queries)
    assert len({(q, r) for q, r, _, _ in got}) == len(got) == len(want)
    near, truth = {(q, i) for q, _, i, _ in got}, {(q, i) for q, _, i, _ in want}
    assert len(near & truth) >= 0.95 * len(truth)
    exact = {(q, i): s for q, _, i, s in want}
    assert all(s == exact[q, i] for q, _, i, s in got if (q, i) in exact)
    assert all(a[3] >= b[3] for a, b in zip(got, got[1:], strict=False) if a[0] == b[0])


def test_the_graph_is_flat_layered_and_linked():
    rng = np.random.RandomState(2)
    vectors = rng.randn(3000, 16)
    layers = ann.build(ann.even(vectors), [20, 300, 3000])
    assert [x.shape for x in layers] == [(21, ann.LINKS), (301, ann.LINKS), (3001, ann.LINKS_LOWEST)]
    for links in layers:
        n = len(links) - 1
        assert (links[n] == n).all() and (links <= n).all() and not (links[:n] == np.arange(n)[:, None]).any()
        assert ((links[:n] < n).sum(axis=1) > 0).all()
        reached, todo = {0}, [0]
        while todo:
            new = {int(x) for x in links[todo.pop()] if x < n} - reached
            reached |= new
            todo += new
        assert len(reached) > 0.99 * n
    assert np.allclose(np.einsum("ij,ij->i", ann.even(vectors), ann.even(vectors)), (vectors**2).sum(axis=1).max(), rtol=1e-5)


@pytest.mark.parametrize("rows,queries", [([], []), ([(1, [1.0, 0.0])], []), ([], [(0, [1.0])]), ([(0, [1.0])], [(0, [1.0])])])
def test_no_rows(spark, rows, queries):
    assert run(spark, rows, queries) == []
