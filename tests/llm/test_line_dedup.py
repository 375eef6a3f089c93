import random

import pytest
from pyspark.sql import functions as F

from foldline.llm.line_dedup import distance as banded
from foldline.llm.line_dedup import edit_distance, keep_first_lines, line_classes, within
from foldline.llm.shared import work_dir


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(rng: random.Random, line: str, times: int) -> str:
    for _ in range(times if line else 0):
        k, c = rng.randrange(max(1, len(line))), rng.choice("abcdé ")
        line = rng.choice([line[:k] + c + line[k:], line[:k] + line[k + 1 :], line[:k] + c + line[k + 1 :]])
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance_is_exact_within_the_band(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(edits + 1, 40)))
        b = edited(rng, a, rng.randint(0, edits + 2)) if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(len(a)))
        if abs(len(a) - len(b)) <= edits < len(b):
            rows.append((a, b))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", edit_distance("a", "b", edits).alias("d"), F.levenshtein("a", "b").alias("l")).collect():
        assert r.d == r.l if r.l <= edits else r.d > edits, r


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within_is_exact(spark, edits):
    rng, rows = random.Random(edits + 10), []
    for _ in range(1500):
        a = "".join(rng.choice("abé ") for _ in range(rng.choice([rng.randint(edits + 1, 20), rng.randint(20, 90), rng.randint(500, 1100)])))
        b = edited(rng, a, rng.randint(0, edits + 2))
        if rng.random() < 0.2:  # edits that stand apart
            b = a + "x" * rng.randint(0, edits + 1) if rng.random() < 0.5 else "y" + a[1:-1] + "z"
        if abs(len(a) - len(b)) <= edits < len(b):
            rows.append((a, b))
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", within("a", "b", edits).alias("near"), F.levenshtein("a", "b").alias("l")).collect():
        assert r.near == (r.l <= edits), r


def test_beginnings(spark):
    rng, rows = random.Random(5), []
    for _ in range(500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(3, 12)))
        rows.append((a, edited(rng, a, rng.randint(0, 2)) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))))
    rows = [r for r in rows if 2 < len(r[1]) <= len(r[0]) + 2 and abs(len(r[0]) - len(r[1])) <= 2]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", F.expr(banded("a", "b", 2, whole=False)).alias("d")).collect():
        least = min(distance(r.a, r.b[:k]) for k in range(max(0, len(r.a) - 2), len(r.b) + 1))
        assert r.d == least if least <= 2 else r.d > 2, r


def brute(texts: dict, edits: int, least: int) -> set:
    where = {}
    for d in sorted(k for k in texts if k is not None):
        for n, line in enumerate((texts[d] or "").split("\n") if texts[d] is not None else []):
            if len(line) >= least:
                where.setdefault(line, []).append((d, n))
    lines = list(where)
    root, links = list(range(len(lines))), [0] * len(lines)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(lines)):
        for j in range(i):
            if abs(len(lines[i]) - len(lines[j])) <= edits and distance(lines[i], lines[j]) <= edits:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = {}
    for k, line in enumerate(lines):
        classes.setdefault(find(k), []).extend((p, links[k]) for p in where[line])
    return {(*p, *min(q for q, _ in c), n) for c in classes.values() if len(c) > 1 for p, n in c}


def test_against_brute_force(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(6, 50))) for _ in range(25)]
    texts = {d: "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6))) for d in range(60)}
    texts |= {100: None, 101: "", 102: "\n\n", None: bases[0]}
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in texts.items()], "doc_id long, text string, line string, id int")
    for edits, least in ((2, 8), (1, 10)):
        got = {tuple(r) for r in line_classes(frame, work_dir(spark, "t"), edits, least).collect()}
        assert got == brute(texts, edits, least)


def test_documents_keep_first_lines(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nshort", 0, None), (2, f"short\n{line}s\nown words of this document only", 0, "en"), (3, line, 0, None), (4, None, 7, None), (5, "", 0, None), (None, line, 5, None)]
    got = {(r.doc_id, r.text, r.n_chars) for r in keep_first_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string"), work_dir(spark, "t")).collect()}
    assert got == {(1, f"{line}\nshort", 0), (2, "short\nown words of this document only", 37), (4, None, 7), (5, "", 0), (None, line, 5)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_classes(empty, work_dir(spark, "t")).count() == 0
