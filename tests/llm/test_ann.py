import numpy as np

from foldline.llm.ann import nearest, scan
from foldline.llm.shared import work_dir


def exact(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in (i for i in good if i % every == 0):
        scored = sorted((-float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), i) for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = exact(rows, 50, 5), {}
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, list int")
    for r in nearest(frame, work_dir(spark, "t")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({x[1] for x in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [4.0, 0.0])]
    form = "vec_id long, embedding array<double>"
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(spark.createDataFrame(rows, form), work_dir(spark, "t")).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 50, 1.0), (0, 4, 4, 0.0), (50, 1, 0, 1.0), (50, 2, 2, 1.0), (50, 3, 3, 1.0), (50, 4, 4, 0.0)]
    assert nearest(spark.createDataFrame([], form), work_dir(spark, "t")).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(3)
    data = rng.standard_normal((3000, 64))
    lost = 0
    for q in rng.standard_normal((20, 64)):
        want = np.argsort(((data - q) ** 2).sum(1))[:5]
        kept = scan(q, data, 5)
        lost += len(set(want) - set(kept))
        assert len(kept) < 1500
    assert lost <= 2
