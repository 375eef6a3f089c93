import math
import random
import zlib

import pytest

from foldline.llm.quality import ALPHA, BETA, L1, L2, PASSES, features, score_quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    fold = [r for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [r.score for r in fold if quality[r.doc_id]], [r.score for r in fold if not quality[r.doc_id]]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(r.predicted == quality[r.doc_id] for r in fold) >= 0.96 * len(fold)


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "good words here", 9), (4, "x " * 50_000, 9), (5, "a b", 9), (5, "a b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = spark.createDataFrame([(5, 1), (5, 1), (4, None), (None, 0), (77, 0)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 5}) == 1
    none = score_quality(docs, labels.where("doc_id > 1000")).collect()
    assert {r.score for r in none} == {0.5} and score_quality(docs.where("doc_id > 1000"), labels).count() == 0


def test_against_plain_loops(spark):
    """The published update rule over dicts, one document at a time, in the stated order; ids may be negative or repeated."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["good", "fine", "clean"] if k % 2 else ["bad", "spam", "junk"]) + rng.choice("abc") for _ in range(rng.randint(1, 30)))) for k in range(-40, 40)]
    rows += [(-3, "another text of one id"), (5, "and one more"), (5, "and one more")]
    marks = [(k, k % 2) for k in range(-40, 40)] + [(7, 0)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    label = {k: int(k % 2 if k != 7 else 0.5 >= 0.5) for k in range(-40, 40)}
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    learned = [(k * 0x9E3779B97F4A7C15 % 2**64, *(a.tobytes() for a in features(t)), features(t), label[k]) for k, t in rows if not held(k)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= L1:
            return 0.0
        return -(z[i] - math.copysign(L1, z[i])) / ((BETA + math.sqrt(n[i])) / ALPHA + L2)

    def score(f):
        return 1 / (1 + math.exp(-sum(weight(i) * float(v) for i, v in zip(f[0].tolist(), f[1].tolist()))))

    for _ in range(PASSES):
        for *_, f, y in sorted(learned, key=lambda x: x[:3]):
            p = score(f)
            for i, v, w in [(i, v, weight(i)) for i, v in zip(f[0].tolist(), f[1].tolist())]:
                g = (p - y) * v
                more = math.sqrt(n.get(i, 0.0) + g * g)
                z[i] = z.get(i, 0.0) + g - (more - math.sqrt(n.get(i, 0.0))) / ALPHA * w
                n[i] = n.get(i, 0.0) + g * g
    want = sorted((k, held(k), score(features(t))) for k, t in rows)
    for parts in (1, 5):
        got = sorted((r.doc_id, r.held_out, r.score) for r in score_quality(docs.repartition(parts), labels).collect())
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-5)
