import random

import pytest

from foldline.operators import neighbors

FORM = "chain string, idx int, valid boolean, x double, y double, z double"


def brute(rows, k=1, sep=1, fall_back=None):
    """(chain, idx) -> the k-th nearest, or the nearest so far along the chain, by comparing all residues of a chain."""
    last = {}
    for c, i, *_ in rows:
        last[c] = max(last.get(c, 0), i)
    good = [(c, i, p) for c, i, valid, *p in rows if valid and 0 < i < last[c] and all(v is not None and v == v for v in p)]
    out = {(c, i): None for c, i, *_ in rows}
    for c, i, p in good:
        near = sorted((round(sum((a - b) * (a - b) for a, b in zip(p, q)), 9), j) for d, j, q in good if d == c and j != i)
        far = [n for n in near if abs(n[1] - i) >= sep]
        if sep > 1 and far and (fall_back is None or far[0][0] < fall_back**2):
            near = far
        out[c, i] = near[k - 1][1] if len(near) >= k else None
    return out


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c, n, kind in (("walk", 300, 0), ("cloud", 250, 1), ("one place", 120, 2), ("grid", 125, 3), ("short", 4, 0), ("line", 90, 4), ("gone", 3, 5)):
        p = [0.0, 0.0, 0.0]
        for i in range(n):
            if kind == 0:
                p = [v + rng.gauss(0, 2) for v in p]
            elif kind == 1:
                p = [rng.gauss(0, 1) ** 3 for _ in p]  # dense in the middle, few far out
            elif kind == 2:
                p = [1.0, 2.0, 3.0] if i % 3 else [rng.random() for _ in p]
            elif kind == 3:
                p = [float(i % 5), float(i // 5 % 5), float(i // 25)]  # many ties
            elif kind == 4:
                p = [i * 3.8, 0.0, 0.0]
            rows.append((c, i, rng.random() > 0.1, *p) if kind != 5 else (c, i, True, None, float("nan"), 1.0))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [1, 8])
def test_cells_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbors, "CELL", cell)
    rows = made(cell)
    frame = spark.createDataFrame(rows, FORM)
    for options in ({}, {"min_separation": 4, "fall_back": 3.0}, {"min_separation": 9}):
        got = {(r.chain, r.idx): r.partner for r in neighbors.nearest(frame, list("xyz"), digits=9, **options).collect()}
        assert got == brute(rows, sep=options.get("min_separation", 1), fall_back=options.get("fall_back"))
    want = {k: v for k, v in brute(rows, k=5).items() if v is not None}
    assert {(r.chain, r.idx): r.partner for r in neighbors.kth_nearest(frame, list("xyz"), 5, digits=9).collect()} == want


def test_few_pairs_are_made(spark, tmp_path):
    """The cells of a long chain: a residue meets a bounded number of others."""
    rng = random.Random(3)
    frame = spark.createDataFrame([("c", i, True, *(rng.random() for _ in "xyz")) for i in range(4000)], FORM)
    neighbors.nearest(frame, list("xyz"), folder=str(tmp_path)).count()
    first = spark.read.parquet(f"{tmp_path}/round-0")
    assert first.where("proven").count() > 0.9 * 3998 and not (tmp_path / "round-3").exists()


def test_no_residues(spark):
    assert neighbors.nearest(spark.createDataFrame([], FORM), list("xyz")).count() == 0
