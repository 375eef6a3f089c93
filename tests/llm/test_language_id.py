import math
import zlib
from itertools import combinations

import pytest

from foldline.llm.language_id import PENALTY, fit, grams, identify, with_language

EN = "the quick brown fox and the other one that was here with them "
DE = "der schnelle fuchs und die andere welche nicht hier bei ihnen war "


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    fold = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in fold) >= 0.98 * len(fold) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_and_odd_rows(spark):
    rows = [(k, EN * 3 if k % 2 else DE * 3, "en" if k % 2 else "de", 0.5) for k in range(40)]
    rows += [(100, None, "en", 1.0), (101, "", "en", 1.0), (102, "12 !? 3", None, 1.0), (103, EN * 60 + DE * 30, None, 1.0), (None, DE * 2, None, 1.0), (104, "é" * 50_000, None, 1.0), (0, DE, "de", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {}
    for r in identify(docs).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, got.values())) == len(rows) and len(got[0]) == 2
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert got[103][0][0] == "en" and 0.55 < got[103][0][1] < 0.8
    assert got[None][0][0] == "de" and got[1] == [("en", 1.0)]
    kept = with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}
    assert {r.lang_pred for r in identify(docs.where("lang is null")).collect()} == {"und"}
    assert identify(docs.where("doc_id > 1000")).count() == 0


def test_mixture_against_all_subsets(spark):
    """Expectation-maximisation in plain loops for every set of languages, the best by penalised likelihood."""
    fr = "le renard brun et les autres qui sont avec elle dans la maison "
    rows = [(k, text * 3, lang) for k, (text, lang) in enumerate([(EN, "en"), (DE, "de"), (fr, "fr")] * 12)]
    mixture = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in (EN * 4, EN * 30 + DE * 30, fr * 40 + EN * 20 + DE * 30, fr):
        ids = grams(text).tolist()
        best = None
        for size in (1, 2, 3):
            for chosen in combinations(range(3), size):
                p = [[math.exp(float(mixture.log_p[i, c])) for c in chosen] for i in ids]
                pi = [1 / size] * size
                for _ in range(60):
                    totals = [0.0] * size
                    for row in p:
                        joint = [a * b for a, b in zip(row, pi)]
                        for c, x in enumerate(joint):
                            totals[c] += x / sum(joint)
                    pi = [t / len(p) for t in totals]
                value = sum(math.log(sum(a * b for a, b in zip(row, pi))) for row in p) - (size - 1) * PENALTY * math.log(len(ids)) / 2
                if best is None or value > best[0]:
                    best = (value, dict(zip(chosen, pi)))
        assert mixture.proportions(text).tolist() == pytest.approx([best[1].get(c, 0.0) for c in range(3)], abs=0.02)
