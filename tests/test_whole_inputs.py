"""Queries over whole tables, against brute force; their SQL takes whole tables too (test_queries)."""

import re

import numpy as np
import pytest

from foldline.operators.search import smith_waterman, smith_waterman_many
from foldline.plans import inputs
from foldline.plans.catalog import ORACLES, QUERIES
from tests.test_queries import SF, compare


def test_no_sql_cuts_its_tables():
    assert not any("l_orderkey % 5" in sql or "% 45" in sql or "vec_id % 10 =" in sql for sql in ORACLES.values())


def test_pairs_of_each_order(spark, tmp_path):
    items = [(order, 1 + order % 3, 7 * order, order) for order in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = set()
    for r in inputs.alignments(spark, str(tmp_path)).collect():
        i = j = k = 0
        for n, op in re.findall("([0-9]*)([DIMP])", r.cigar):
            n = int(n or 1)
            want |= {(r.alignment_id, k + t, i + t, j + t) for t in range(n) if op == "P"}
            i, j, k = i + n * (op in "DMP"), j + n * (op in "IMP"), k + n * (op == "P")
    got = {tuple(r) for r in QUERIES["cigar_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and {int(a.split(":")[1]) for a, *_ in got} == set(range(1, 8))


def test_every_user_has_a_sequence(spark, tmp_path):
    events = [(u + 45 * k, t, f"e{(u + t) % 5}") for u in range(3) for k in range(3) for t in range(30)]
    rows = [(n, u, t, e) for n, (u, t, e) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.sid: r.seq for r in QUERIES["state_sequences"](spark, str(tmp_path)).collect()}
    assert got == {f"d{u}": "".join("ABCDE"[int(e[1])] for v, _, e in events if v == u) for u in {u for u, _, _ in events}}
    found = QUERIES["sw_scores"](spark, str(tmp_path)).collect()
    assert {r["query"] for r in found} == {"d0"} and {r.target for r in found} == set(got) and len(got) == 9  # queries: users divisible by 100


def test_alignment_of_many_is_that_of_each():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-4, 8, (5, 5))
    for _ in range(60):
        a = rng.integers(0, 5, rng.integers(0, 40))
        many = [rng.integers(0, 5, rng.integers(0, 40)) for _ in range(rng.integers(0, 8))]
        assert smith_waterman_many(a, many, matrix).tolist() == [smith_waterman(a, b, matrix) for b in many]


@pytest.mark.parametrize("name", ["first_fp_hits", "first_fp_sensitivity", "mean_sensitivity", "roc_curve"])
def test_blocks_of_vectors(spark, name, monkeypatch):
    monkeypatch.setattr("foldline.operators.search.VECTORS", 40)
    compare(QUERIES[name](spark, SF), name, SF)


def test_codebook_of_whole_vectors(spark):
    assert {len(r.vec) for r in QUERIES["kmeans_codebook"](spark, SF).collect()} == {64}
