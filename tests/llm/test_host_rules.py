import random
import re

import duckdb
import pytest

from foldline.llm.host_rules import ORACLE, RULES, host_rates, host_verdicts
from foldline.llm.shared import work_dir

FORM = "doc_id long, text string, source string, host int, n_words string, kept int"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(t: str) -> list:
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def measures(text) -> tuple:
    t = text or ""
    w = words_of(t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {x for i, g in enumerate(windows) if windows.count(g) > 1 for x in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def base_failed(m: tuple) -> bool:
    return m[0] < 10 or 100 * m[4] > 20 * m[0]


def made(rng) -> list:
    word = lambda: rng.choice("abcdé") * rng.randint(1, 4) + rng.choice(["", "#", "x"])
    rows = [(1, None, "s", 0, "", 0), (2, "", "s", 0, "", 0), (3, " \t\x0b\n\n", None, 0, "", 0), (None, "a b c d e " * 3, "s", 0, "", 0), (4, "x\ry\x1fz\x85w v", "s", 0, "", 0)]
    for d in range(60):
        w = [word() for _ in range(rng.choice([3, 12, 60]))]
        if d % 4 == 0:
            w += w[:7]
        if d % 7 == 0:
            w = ["a"] * rng.randint(4, 30)
        rows.append((10 + d, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w), rng.choice(["s", "t", "u", None]), 0, "", 0))
    return rows + [rows[-1]]


def test_measures_against_loops(spark):
    rows = made(random.Random(5))
    got = host_verdicts(spark.createDataFrame(rows, FORM).repartition(3), work_dir(spark, "t")).collect()
    want = sorted(((r[0], *measures(r[1]), base_failed(measures(r[1]))) for r in rows), key=repr)
    assert sorted(((r.doc_id, *(r[c] for c in COUNTS), r.base_failed) for r in got), key=repr) == want
    assert not any(r.base_failed and r.kept for r in got)


def test_sql(spark):
    place = "/root/testdata/sf0.001/documents.parquet"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{place}'")
    found = host_verdicts(spark.read.parquet(place), work_dir(spark, "t"))
    made = duck.execute(ORACLE)
    assert found.columns == [d[0] for d in made.description]
    assert sorted(map(tuple, found.collect())) == sorted(made.fetchall())


def test_hosts(spark):
    """A host of junk loses its clean documents; a small host with as large a share is judged by what is usual."""
    good = lambda k: " ".join(f"word{k}x{j}" for j in range(20))
    rows = [(k, good(k), f"clean{k % 8}", 0, "", 0) for k in range(400)]
    rows += [(1000 + k, "too short" if k % 10 else good(k), "junk", 0, "", 0) for k in range(200)]
    rows += [(2000, "too short", "tiny", 0, "", 0), (2001, good(1), "tiny", 0, "", 0), (2002, good(2), None, 0, "", 0)]
    kept = {r.doc_id for r in host_verdicts(spark.createDataFrame(rows, FORM), work_dir(spark, "t")).where("kept").collect()}
    assert kept == {*range(400), 2001, 2002}


def test_rates_against_formula(spark):
    hosts = {"a": (10, 1), "b": (200, 190), "c": (50, 0), "d": (1, 1)}
    rows = [(h, k < failed, False, k < failed, False) for h, (n, failed) in hosts.items() for k in range(n)]
    got = {r.host: r for r in host_rates(spark.createDataFrame(rows, ", ".join(["host string", *(f"{r} boolean" for r in RULES)]))).where("rule = 'base'").collect()}
    n = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / n
    spread = sum(c * (f / c - mean) ** 2 for c, f in hosts.values()) / n - mean * (1 - mean) * len(hosts) / n
    strength = max(1.0, min(10_000.0, mean * (1 - mean) / spread - 1))
    for h, (c, f) in hosts.items():
        assert got[h].rate == pytest.approx((f + mean * strength) / (c + strength)) and (got[h].n, got[h].failed) == (c, f)


def test_empty_and_long(spark):
    assert host_verdicts(spark.createDataFrame([], FORM), work_dir(spark, "t")).count() == 0
    text = " ".join(f"w{k % 60_000}" for k in range(120_000))
    row = host_verdicts(spark.createDataFrame([(1, text, "s", 0, "", 0)], FORM), work_dir(spark, "t")).first()
    assert (row.n_words, row.n_repeat_words, row.kept) == (120_000, 120_000, False)
