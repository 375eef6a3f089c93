import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from foldline.llm.catalog import QUERIES

DE = "der die das und nicht hier bei ihnen eine andere schnelle fuchs".split()
EN = "the and that with here them other quick brown fox over lazy".split()


def text(rng, words, n):
    return " ".join(f"{rng.choice(words)}{rng.choice(['', 'er', 'ly', 'en'])}{rng.randint(0, 99)}" for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, text(rng, EN if k % 2 else DE, 60), "en" if k % 2 else "de", "s", 0) for k in range(30)]
    own = {k: t for k, t, *_ in rows}
    item = text(rng, EN, 25)
    near = own[1].split()
    near[30] = "changed"
    line = "this very line is found in two of the documents"
    rows += [
        (100, "12 34 !!", "en", "s", 8), (101, None, "en", "s", 0),
        (102, " ".join(near), "en", "s", 0),
        (103, own[2] + f"\n{line}", "de", "s", 0), (104, text(rng, EN, 40) + f"\n{line}s", "en", "s", 0),
        (105, text(rng, EN, 300) + " " + item.upper() + " " + text(rng, EN, 300), "en", "s", 0),
    ]
    form = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, form).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    ids = {r[0] for r in rows}
    assert set(kept[0]) == ids - {100, 101}
    assert set(kept[1]) == set(kept[0]) and kept[1][104] == rows[-2][1].split("\n")[0] and kept[1][103].endswith(line)
    assert set(kept[2]) == set(kept[1]) - {102}
    assert set(kept[3]) == set(kept[2]) - {105}
    # Document 2's text is a line of document 103 too, which comes later and loses it.
    assert kept[1][103] == line
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in found.collect()} == set(kept[3]) and "ids_sha256" in found.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, sf).count() > 100
    assert {f"op{k}" for k in range(1, 14)} == {name.split("_")[0] for name in QUERIES}


def test_clashing_names_nulls_and_repeats(spark, tmp_path):
    """Every stage with columns named like its own, null and repeated ids and texts, and an empty table."""
    rng = random.Random(2)
    form = "doc_id long, text string, lang string, source string, n_chars long, gone int, kept int, lang_pred int, lang_score int, _gone int, _kept int, rep int, component_id int"
    texts = [text(rng, EN if k % 2 else DE, 40) + "\nthe same short line" for k in range(12)] + [None, "", "one two three four five six", "long words " * 30_000]
    rows = [(k if k != 5 else None, t, "en" if k % 2 else "de", None, 0, *range(8)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], form)
    spark.createDataFrame([(0, "nothing of this is there at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name != "encode":
            assert out.columns == docs.columns, name
            docs = out.persist()
        assert out.count() >= 10, name


def near(a: str, b: str, k: int) -> bool:
    """The edit distance of a and b is at most k."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    if not a or not b or not k:
        return len(a) + len(b) <= k
    return near(a[1:], b[1:], k - 1) or near(a[1:], b, k - 1) or near(a, b[1:], k - 1)


def classes(items: list, linked) -> list[set]:
    root = list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in linked:
        root[find(i)] = find(j)
    out = {}
    for k in range(len(items)):
        out.setdefault(find(k), set()).add(k)
    return list(out.values())


def test_all_stages_against_brute_force(spark, tmp_path):
    """run() over whole tables and some near copies: sets, loops over all pairs, and the library's encoding."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    sf, own = str(tmp_path), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(6)
    near_copies = []
    for k in range(6):
        lines = [[f"{rng.choice(EN)}{rng.randint(0, 9999)}" for _ in range(80)] for _ in range(3)]
        for copy in range(2):
            near_copies.append((10_000 + 2 * k + copy, "\n".join(" ".join(w) for w in lines), "en", "s", 0))
            for w in lines:  # one word of each line, by more than the edits of a repeated line
                w[rng.randrange(80)] = "anotherword"
    own.union(spark.createDataFrame(near_copies, own.schema)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # Language: documents without a letter go.
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    # Lines: of a class the first stays; short lines are alike only if equal.
    places = {}
    for d in sorted(docs):
        for n, line in enumerate(docs[d].split("\n")):
            if line:
                places.setdefault(line, []).append((d, n))
    lines = sorted(places, key=len)
    by_length = {}
    for k, line in enumerate(lines):
        if len(line) >= 30:
            by_length.setdefault(len(line), []).append(k)
    links = [(i, j) for n, at in by_length.items() for m in (n, n + 1, n + 2) for i in at for j in by_length.get(m, []) if i < j and near(lines[i], lines[j], 2)]
    gone = {p for group in classes(lines, links) for p in sorted(p for k in group for p in places[lines[k]])[1:]}
    left = {d: [x for n, x in enumerate(t.split("\n")) if (d, n) not in gone] for d, t in docs.items()}
    docs = {d: "\n".join(x) for d, x in left.items() if x}
    # Near duplicates: the smallest id of each group stays.
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(docs)
    alike = [(i, j) for i in range(len(ids)) for j in range(i) if sets[ids[i]] and 100 * len(sets[ids[i]] & sets[ids[j]]) >= 80 * len(sets[ids[i]] | sets[ids[j]])]
    docs = {ids[min(group)]: docs[ids[min(group)]] for group in classes(ids, alike)}
    # Decontamination: documents that hold four fifths of an item's runs of five words go.
    runs = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})([x for x in re.split(r"[\W_]+", t.lower()) if x])
    held = [runs(t) for t in items if t and runs(t)]
    docs = {d: t for d, t in docs.items() if not any(100 * len(runs(t) & x) >= 80 * len(x) for x in held)}
    want = set()
    for d, t in docs.items():
        ids_of = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids_of, skip_special_tokens=False)
        want.add((d, len(ids_of), hashlib.sha256(",".join(map(str, ids_of)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert len(want) > 100 and len(gone) > 20 and len(alike) >= 6
    assert got == want
