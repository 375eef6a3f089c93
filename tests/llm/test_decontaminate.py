import random
import re

from foldline.llm.decontaminate import candidates, contained_items, without_items


def brute(docs, items, n, percent):
    def tokens(text):
        return [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]

    def runs(text, m):
        w = tokens(text)
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}

    def whole_or_runs(text):
        return runs(text, min(n, len(tokens(text)))) if tokens(text) else set()

    d = {}
    for k, t in docs:
        for m in range(1, n + 1):
            d.setdefault(k, set()).update(runs(t, m))
    b = {}
    for k, t in items:
        b.setdefault(k, set()).update(whole_or_runs(t))
    return {(x, y, len(d[x] & b[y]), len(b[y])) for x in d if x is not None for y in b if b[y] and 100 * len(d[x] & b[y]) >= percent * len(b[y])}


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "be", "Cé", "dog", "e1", "fox", "go"])
    items = [(k, " ".join(word() for _ in range(rng.randint(3, 30)))) for k in range(30)] + [(90, None), (91, ""), (92, "a b c d")]
    docs = []
    for k in range(60):
        own = [word() for _ in range(rng.choice([3, 40, 700]))]
        part = items[rng.randrange(30)][1].split()
        own[len(own) // 2 : len(own) // 2] = [w.upper() + rng.choice(["", ",", "!"]) for w in part[: rng.randint(1, len(part))]]
        docs.append((k, rng.choice([" ", "\n", " - "]).join(own)))
    docs += [(100, None), (101, ""), (5, items[3][1])]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, shingle int")
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    want = brute(docs, items, 5, 80)
    assert {tuple(r) for r in contained_items(d, b).collect()} == want and want
    assert {r.doc_id for r in without_items(d, b).collect()} == {x for x, _ in docs} - {x[0] for x in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert contained_items(d, none).count() == 0 and without_items(d, none).count() == len(docs)


def test_only_candidates_are_verified(spark):
    item = " ".join(f"w{k}" for k in range(24))  # 20 shingles, 16 needed, 5 in the sketch
    docs = [(k, " ".join(f"d{k}x{j}" for j in range(200))) for k in range(50)]
    words = item.split()
    docs += [(100, "a b c " + item + " d e"), (101, " ".join(words[:12])), (102, " ".join(words[:22]))]
    docs += [(110 + k, f"x{k} " + " ".join(words[k : k + 5]) + " " + " ".join(f"y{k}z{j}" for j in range(40))) for k in range(20)]  # one shingle each
    docs += [(200, " ".join(words[:14])), (200, " ".join(words[10:]))]  # one document, in two rows
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id for r in candidates(d, b).collect()}
    assert {100, 102, 200} <= found and not found & {*range(50), 101}  # 101 has no room for 16 shingles
    assert len(found & set(range(110, 130))) == 5
    got = {(r.doc_id, r.matched) for r in contained_items(d, b).collect()}
    assert got == {(100, 20), (102, 18), (200, 20)}


def test_null_ids_and_long_texts(spark):
    item = "one two three four five six seven"
    docs = [(None, item), (1, "x y z " * 100_000 + item), (2, None), (3, "word" * 100_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(9, item), (None, item)], "item_id long, text string")
    assert [tuple(r) for r in contained_items(d, b).collect()] == [(1, 9, 3, 3)]
    assert {r.doc_id for r in without_items(d, b).collect()} == {None, 2, 3}


def test_items_of_few_words(spark):
    """Items below five words are found where their words stand in a row, and nowhere else; an id's short and long texts count together."""
    items = [(1, "Zeta"), (2, "one two"), (3, "p q r s"), (4, "one two three four five"), (5, "..."), (6, "u v"), (6, "k1 k2 k3 k4 k5 k6 k7 k8"), (-7, "neg id")]
    docs = [(10, "a zeta b"), (11, "two one"), (12, "x one, two three"), (13, "p q r"), (14, "P q R s"), (15, "zetas"), (16, "one two three four five"), (17, "u v"), (18, "u v - k1 k2 k3 k4 k5 k6 k7 k8"), (-19, "neg id"), (20, "s"), (20, "zeta")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5, 80)
    assert {tuple(r) for r in contained_items(d, b).collect()} == want
    assert {(x, y) for x, y, _, _ in want} == {(10, 1), (12, 2), (14, 3), (16, 2), (16, 4), (18, 6), (-19, -7), (20, 1)}


def test_a_document_that_holds_many_items(spark):
    """A long document meets its items' shingles, not each item with all its shingles."""
    rng = random.Random(5)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(300)]
    docs = [(1, " ".join(t for _, t in items)), (2, " ".join(rng.choice(items)[1][:40] for _ in range(50))), (3, items[7][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in contained_items(d, b).collect()} == brute(docs, items, 5, 80)
