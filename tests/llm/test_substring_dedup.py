import random
import re

import pytest

from foldline.llm import substring_dedup
from foldline.llm.catalog import QUERIES
from foldline.llm.shared import work_dir
from foldline.llm.substring_dedup import remove_spans, repeated_spans

FORM = "doc_id long, text string"


def brute(docs, line_words, run_words):
    """The operator's definition over sets of (doc_id, text), with dicts."""
    places = {}
    for doc, text in {d for d in docs if None not in d}:
        clauses, lines, line_no = [], {}, 0
        for m in re.finditer(r"[^\n.!?,;:|]*(?:\n|[.!?,;:|]+)|[^\n.!?,;:|]+", text):
            words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x.group().lower(), m.group()))
            if words:
                a = m.start() + re.search(r"[^\x20\x09-\x0d]", m.group()).start()
                clauses.append((a, m.start() + len(re.sub(r"[\x20\x09-\x0d]+$", "", m.group())), words))
                lines.setdefault(line_no, []).append(clauses[-1])
            line_no += m.group().endswith("\n")
        for x, y in zip(clauses, clauses[1:]):
            places.setdefault(("pair", tuple(x[2]), tuple(y[2])), []).append((doc, x[0], y[1], len(x[2]), len(y[2])))
        for a, b, words in clauses:
            if len(words) >= run_words:
                places.setdefault(("clause", tuple(words)), []).append((doc, a, b, 0, len(words)))
        for line in lines.values():
            words = [w for x in line for w in x[2]]
            if len(words) >= line_words:
                places.setdefault(("line", tuple(words)), []).append((doc, line[0][0], line[-1][1], 0, 0))
    gone = {}
    for unit, held in places.items():
        for doc, a, b, n, tail in sorted(held)[1:]:
            gone.setdefault(doc, []).append((a, b, unit[0], n, tail, min(held)[:2]))

    def joined(spans):
        out = []
        for s in sorted(spans):
            if out and s[0] < max(x[1] for x in out[-1]):
                out[-1].append(s)
            else:
                out.append([s])
        return out

    rows = set()
    for doc, spans in gone.items():
        kept = [s for s in spans if s[2] == "line"]
        for run in joined([s for s in spans if s[2] != "line"]):
            pairs = [s for s in run if s[2] == "pair"]
            if (sum(s[3] for s in pairs) + max(run, key=lambda s: (s[1], s[0]))[4] if pairs else max(s[4] for s in run)) >= run_words:
                kept += run
        order = {"pair": 0, "clause": 1, "line": 2}
        for run in joined(kept):
            first = min(run, key=lambda s: (s[0], order[s[2]]))
            rows.add((doc, run[0][0], max(s[1] for s in run), *first[5]))
    return rows


def passage(rng, n):
    return " ".join(f"{rng.choice(['Und', 'the', 'été'])}{rng.randint(0, 10**6)}{rng.choice(['', '', '', ',', '.'])}" for _ in range(n))


@pytest.mark.parametrize("seen", [substring_dedup.SEEN, 7])
def test_against_brute_force(spark, seen, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEEN", seen)
    rng = random.Random(seen)
    shared = [passage(rng, rng.randint(5, 30)) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice([passage(rng, rng.randint(1, 12)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 6))]
        docs.append((d, rng.choice([" ", "\n", "\n\n"]).join(p.upper() if rng.random() < 0.1 else p for p in parts)))
    docs += [(70, None), (71, ""), (72, "\n ,\n"), (None, shared[0] * 3), (3, docs[3][1]), (80, "a b, " * 50), (81, "one. two. " * 30)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], FORM + ", span int, kept string").repartition(5)
    want = brute(docs, 8, 12)
    assert {tuple(r) for r in repeated_spans(frame, work_dir(spark, "t"), 8, 12).collect()} == want and len(want) > 40


def test_passages_inside_and_across_lines(spark, tmp_path):
    rng = random.Random(5)
    clauses = [" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(8)) + "," for _ in range(7)]
    own = lambda k: f"own{k} words{k} here{k}."
    texts = {
        1: f"{own(1)} {' '.join(clauses)} {own(11)}",
        2: f"{own(2)} {' '.join(clauses).upper()} {own(12)}",  # inside a line
        3: f"{own(3)} {' '.join(clauses[:3])}\n{' '.join(clauses[3:])} {own(13)}",  # across two
        4: f"{own(4)} {' '.join(clauses[:3])} {own(14)}",  # too short
        5: own(5),
    }
    spark.createDataFrame(list(texts.items()), FORM).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op6_substring_dedup"](spark, str(tmp_path)).collect()}
    assert set(rows) == {2, 3} and all(r.kept_doc_id == 1 and r.kept_start == len(own(1)) + 1 for r in rows.values())
    for d, r in rows.items():
        assert " ".join(texts[d][r.span_start : r.span_end].lower().split()) == " ".join(clauses)


def test_removal(spark):
    line = " ".join(f"word{k}" for k in range(25))
    texts = {1: f"{line}\nend", 2: f"é own\n{line.upper()}  \nend", 3: f"{line}\n{line}", 4: None, 5: "", None: line}
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], FORM + ", gone int, _GONE int")
    spans = repeated_spans(docs, work_dir(spark, "t"))
    assert sorted(tuple(r)[:4] for r in spans.collect()) == [(2, 6, 6 + len(line), 1), (3, 0, len(line), 1), (3, len(line) + 1, 2 * len(line) + 1, 1)]
    left = remove_spans(docs, spans)
    assert {r.doc_id: r.text for r in left.collect()} == {**texts, 2: "é own\n  \nend", 3: "\n"} and left.columns == docs.columns
    none = spark.createDataFrame([], FORM)
    assert repeated_spans(none, work_dir(spark, "t")).count() == 0 and remove_spans(none, spans).count() == 0


def test_very_long_texts(spark):
    long = ", ".join(f"clause {k} of this one" for k in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "x. " + long), (3, "no mark" * 50_000)], FORM)
    assert [tuple(r) for r in repeated_spans(docs, work_dir(spark, "t")).collect()] == [(2, 3, 3 + len(long), 1, 0)]
