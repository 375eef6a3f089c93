import random

from foldline.operators.ranks import numbered, running
from foldline.sources.scratch import cut, shared_folder


def test_places_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 9), k) for k in range(500)] + [(None, 500)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = numbered(frame, [frame["a"].desc_nulls_last(), frame["b"]], shared_folder(spark, "t")).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.number)] == want and sorted(r.number for r in got) == list(range(501))
    empty = spark.createDataFrame([], "a int")
    assert numbered(empty, [empty["a"]], shared_folder(spark, "t")).count() == 0


def test_running_totals_over_several_levels(spark):
    rng = random.Random(2)
    rows = [(key, at, rng.randint(-9, 9)) for key, n in (("x", 100), ("y", 1), ("z", 9)) for at in range(n)]
    frame = cut(spark.createDataFrame(rows, "key string, at long, v long"), shared_folder(spark, "t"))
    for piece in (3, 4096):
        got = running(frame, ["key"], "at", {"total": ("sum", "v"), "mixed": ("bit_xor", "v")}, piece).collect()
        assert len(got) == len(rows)
        for r in got:
            upto = [v for k, at, v in rows if k == r.key and at <= r.at]
            mixed = 0
            for v in upto:
                mixed ^= v
            assert (r.total, r.mixed) == (sum(upto), mixed)
