import random
import re

import numpy as np

from foldline.llm import ngram_join, shared
from foldline.llm.ngram_join import link_sets, needed, similarity_classes
from foldline.llm.shared import components, work_dir


def brute(texts: dict, n: int, percent: int) -> dict:
    """doc_id -> (set size, smallest doc_id that links reach), by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    where = {}
    for d in ids:
        for g in sets[d]:
            where.setdefault(g, []).append(d)
    for d in ids:
        for e in {x for g in sets[d] for x in where[g] if x > d}:
            if 100 * len(sets[d] & sets[e]) >= percent * len(sets[d] | sets[e]):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in ids}


def made(seed: int) -> dict:
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randint(0, 9))
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "One", 6: "one two", 7: "É one two three four", 8: "é one two three four"}
    passage = " ".join(word() for _ in range(30))
    for base in range(12):
        words = [word() for _ in range(rng.choice([5, 20, 80, 300]))]
        if base % 3 == 0:
            words += passage.split()
        for copy in range(rng.choice([1, 2, 9])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            texts[100 + len(texts)] = rng.choice([" ", "\n"]).join(w)
    return texts


def test_against_brute_force(spark):
    for seed in range(2):
        texts = made(seed)
        frame = spark.createDataFrame([(d, t, 0, "x") for d, t in texts.items()], "doc_id long, text string, rep int, prefix string")
        for n, percent in ((4, 85), (5, 80)):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(frame, work_dir(spark, "t"), n, percent).collect()}
            assert got == brute(texts, n, percent)


def test_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(docs, work_dir(spark, "t"), 4, 85).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()}, 4, 85)


def test_links_in_blocks():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(15):
        base = rng.choice(4000, rng.integers(1, 200), replace=False)
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], rng.choice(4000, 3)])).astype(np.uint64))
    for sides in ([1] * len(sets), [1 + k % 2 for k in range(len(sets))]):
        root = list(range(len(sets)))
        want = list(range(len(sets)))

        def find(r, k):
            while r[k] != k:
                k = r[k]
            return k

        for a, b in link_sets(sets, sides, 80):
            root[find(root, a)] = find(root, b)
        for a in range(len(sets)):
            for b in range(a):
                if (sides[a] != sides[b] or len(set(sides)) == 1) and len(np.intersect1d(sets[a], sets[b])) >= needed(len(sets[a]), len(sets[b]), 80):
                    want[find(want, a)] = find(want, b)
        assert len({(find(root, k), find(want, k)) for k in range(len(sets))}) == len({find(root, k) for k in range(len(sets))}) == len({find(want, k) for k in range(len(sets))})


def test_odd_rows(spark):
    form = "doc_id long, text string"
    rows = similarity_classes(spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (7, "A b c"), (9, "x"), (9, "y"), (11, "y")], form), work_dir(spark, "t"), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9), (11, 9)]
    assert similarity_classes(spark.createDataFrame([], form), work_dir(spark, "t"), 4, 85).count() == 0


def test_common_ngrams_are_dealt(spark, monkeypatch):
    """N-grams of many sets in several places, and groups of many blocks, give the same classes."""
    for name, value in (("COMMON", 2), ("SHARES", 3), ("BLOCK", 300)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(30)]
    texts = {}
    for d in range(120):
        own = passage + [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 12))]
        own[rng.randrange(30)] = rng.choice(["x", "y"])
        texts[d] = " ".join(own)
    texts |= {200 + k: f"{' '.join(passage[:8])} only{k} " + " ".join(f"o{k}x{j}" for j in range(9)) for k in range(30)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(frame, work_dir(spark, "t"), 4, 85).collect()}
    assert got == brute(texts, 4, 85) and len({c for _, c in got.values()}) > 5


def test_common_ngrams_of_sets_that_go(spark):
    """A paragraph stands alone in a few documents and inside many long ones, which take no part: the few are still one class."""
    rng = random.Random(12)
    paragraph = " ".join(f"p{k}" for k in range(40))
    texts = {k: " ".join(f"r{rng.randrange(10**9)}" for _ in range(1000)) + " " + paragraph for k in range(300)}
    texts |= {1000 + k: f"{paragraph} own{k} more{k}" for k in range(6)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, percent, parts in ((4, 85, 1), (5, 80, 1), (4, 85, 7)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(frame.repartition(parts), work_dir(spark, "t"), n, percent).collect()}
        assert got == brute(texts, n, percent) and got[1005][1] == 1000


def test_components_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 5)
    edges = [(0, k) for k in range(1, 200)] + [(500 + k, 501 + k) for k in range(40)] + [(900, 899), (7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "t")).collect()}
    assert found == {k: 0 for k in range(200)} | {k: 500 for k in range(500, 541)} | {899: 899, 900: 899}


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(80_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 500_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), work_dir(spark, "t")).collect()}
    assert got == {1: (79_996, 1), 2: (79_997, 1), 3: (1, 3)}
