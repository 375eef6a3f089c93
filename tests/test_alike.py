"""Sequences of one text are searched once, and every id has its rows."""

import random

import numpy as np
import pytest

from foldline.operators import search

M = np.where(np.eye(5, dtype=bool), 5, -4)


def made(spark, seed=4):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(8, 16))) for _ in range(6)]
    rows = [(f"d{k}", texts[k % 6]) for k in range(60)]
    return rows, spark.createDataFrame(rows, "sid string, seq string")


def scored(rows, least):
    read = lambda s: np.array(["ABCDE".index(c) for c in s])
    return {(q, t): x for q, a in rows for t, b in rows if (x := search.smith_waterman(read(a), read(b), M)) >= least}


@pytest.mark.parametrize("lot", [3, 4096])
def test_scores_of_copies(spark, monkeypatch, lot):
    monkeypatch.setattr(search, "LOT", lot)
    rows, frame = made(spark)
    got = search.all_against_all(frame, "ABCDE", M, 15).collect()
    assert {(r.query, r.target): r.score for r in got} == scored(rows, 15) and len(got) == len(scored(rows, 15))
    lots = search.alike(frame)
    assert sorted(s for r in lots.collect() for s in r.sids) == sorted(s for s, _ in rows)
    assert lots.count() == 6 if lot > 60 else lots.count() > 6


def test_screening_counts_copies(spark):
    rows, frame = made(spark)
    seen = {r.query: r for r in search.screening(frame, "ABCDE", M, 15).collect()}
    want = scored(rows, 15)
    assert len(seen) == 60 and {r.pairs for r in seen.values()} == {60}
    for q, r in seen.items():
        assert r.counted >= r.aligned >= sum(a == q for a, _ in want) and r.aligned % 10 == 0


def first_fp(want, classes):
    """query -> hits of family, superfamily, fold before the first of another fold, and fp."""
    up = lambda c: c.rsplit(".", 1)[0] if "." in c else c
    out = {}
    for q in {q for q, t in want if q in classes and t in classes}:
        fam, n, fp = classes[q], [0, 0, 0], 0
        for _, t in sorted((-x, t) for (p, t), x in want.items() if p == q and t in classes):
            c = classes[t]
            if up(up(c)) != up(up(fam)):
                fp = 1
                break
            n[0 if c == fam else 1 if up(c) == up(fam) else 2] += 1
        out[q] = (*n, fp)
    return out


@pytest.mark.parametrize("folds", [1, 3])
def test_hits_of_copies(spark, folds):
    """The table has a row for each pair of texts, and every id the hits that it would have with a row for each pair of ids."""
    rows, frame = made(spark)
    rng = random.Random(folds)
    classes = {s: f"a.{rng.randrange(folds)}.{rng.randrange(2)}.{rng.randrange(2)}" for s, _ in rows if rng.random() < 0.9}
    lookup = spark.createDataFrame(list(classes.items()), "sid string, class string")
    want = first_fp(scored(rows, 9), classes)
    hits, asked, held = search.all_texts_against_all(frame, "ABCDE", M, 9)
    assert hits.count() <= 36
    read = lambda df: {r.query: (r.fam_hits, r.sfam_hits, r.fold_hits, r.fp) for r in df.collect()}
    assert read(search.first_fp_hits(hits, lookup, asked, held)) == want
    each = spark.createDataFrame([(q, t, x) for (q, t), x in scored(rows, 9).items()], "query string, target string, score long")
    assert read(search.first_fp_hits(each, lookup)) == want
