from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import hilbert


def brute(rows, ids, k):
    out = {}
    for q in ids:
        v = rows[q]
        d = sorted((float(np.sqrt(((np.array(v, float) - np.array(x, float)) ** 2).sum())), i) for i, x in rows.items() if i != q)
        out[q] = d[:k]
    return out


def test_the_curve_visits_neighbours():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = hilbert.hilbert_index(points, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_recall_on_isotropic_and_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 24))
    for x, share in ((rng.normal(size=(1500, 24)), None), (centre[rng.integers(0, 30, 1500)] + 0.1 * rng.normal(size=(1500, 24)), None)):
        rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
        df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<float>")
        got = hilbert.nearest(df, df.where("vec_id % 50 = 0"), share=share).collect()
        want = brute(rows, range(0, 1500, 50), 10)
        hits = sum((r["score"], r["vec_id"]) in [(s, i) for s, i in want[r["query_id"]]] or any(i == r["vec_id"] for _, i in want[r["query_id"]]) for r in got)
        assert len(got) == 300 and hits >= 0.9 * 300
        true = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
        for (q, i), s in true.items():
            assert abs(s - np.sqrt(((np.array(rows[q]) - np.array(rows[i])) ** 2).sum())) < 1e-9


def test_slices_keep_the_result(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = {i: v.tolist() for i, v in enumerate(rng.normal(size=(300, 4)))}
    rows.update({i: [1.0, 2.0, 3.0, 4.0] for i in range(300, 420)})  # one block of equal vectors
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 20)
    got = hilbert.nearest(df, df, k=5, share=1.0).collect()
    want = brute(rows, rows, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((q, n + 1, i) for q, d in want.items() for n, (_, i) in enumerate(d))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit(0.0), "query_id": F.lit(3), "k": F.lit(1)})
    got = [tuple(r) for r in hilbert.nearest(df, df.where("vec_id in (0, 3, 9)"), k=10).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 10)]
    assert [g[3] for g in got][:2] == [0.0, 1.0]
    assert hilbert.nearest(df.limit(0), df, k=3).count() == 0
    assert hilbert.nearest(df, df.limit(0), k=3).count() == 0
